"""Scans, fingerprints, saved results, audio and versioned state on real files."""

import hashlib
import json
import struct
import wave

import pytest

from talkgrid.operators import render, signal
from talkgrid.sources import files


@pytest.fixture
def media(tmp_path):
    for name in ("b/Talk.MP3", "a.wav", "B.mkv", "notes.txt", ".hidden.wav", "out/x.wav", "c.bin", "b/.dir.mp4", "noext"):
        path = tmp_path / "media" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    return str(tmp_path / "media")


def names(df):
    return [r.source for r in df.collect()]


def test_discover_media(spark, media):
    assert names(files.discover_media(spark, media, ["out"])) == ["a.wav", "B.mkv", "b/Talk.MP3"]
    assert names(files.discover_media(spark, media, recursive=False)) == ["a.wav", "B.mkv"]
    assert names(files.discover_media(spark, media, extensions=[".txt", ".bin"])) == ["c.bin", "notes.txt"]
    heard = spark.createDataFrame([("c.bin",), ("missing",)], "source string")
    assert names(files.discover_media(spark, media, ["out", "b"], with_audio=heard)) == ["a.wav", "B.mkv", "c.bin"]


def test_fingerprints_and_ownership(spark, media):
    found = {r.source: (r.size, r.sha256) for r in files.fingerprints(spark, media).collect()}
    assert found["b/Talk.MP3"] == (10, hashlib.sha256(b"b/Talk.MP3").hexdigest())
    expected = spark.createDataFrame([(s, "0" * 64 if s == "a.wav" else h) for s, (_, h) in found.items() if s != "noext"] + [("gone", "1")], "source string, sha256 string")
    assert {(r.source, r.status) for r in files.owned_faults(spark, media, expected).collect()} >= {("a.wav", "changed"), ("noext", "unexpected"), ("gone", "missing")}


def test_results_and_outputs(spark, tmp_path):
    good = {"schema_version": "1.7", "turns": [], "processing": {}}
    texts = {"good.json": json.dumps(good), "bad.json": "{", "old.json": json.dumps(good | {"schema_version": "1.0"}), "turns.json": json.dumps(good | {"turns": 3}), "empty.srt": "", "empty.txt": "", "a.vtt": "WEBVTT\n\n", "b.vtt": "no", "x.detailed.txt": "y"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    faults = {r.source: r.fault for r in files.results(spark, str(tmp_path)).collect()}
    assert faults == {"good.json": None, "bad.json": "not JSON", "old.json": "unsupported version", "turns.json": "no turns"}
    valid = {r.source: (r.format, r.valid) for r in files.valid_outputs(spark, str(tmp_path)).collect()}
    assert {k for k, (_, v) in valid.items() if v} == {"good.json", "empty.srt", "a.vtt", "x.detailed.txt"} and valid["x.detailed.txt"][0] == "detailed_txt"


def sound(path, rate=16_000, hertz=200):
    from math import pi, sin

    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(16_000 * sin(2 * pi * hertz * k / rate))) for k in range(rate // 2)))


def test_review_audio_and_pitch(spark, tmp_path):
    sound(tmp_path / "a.wav")
    rows = files.review_audio(spark, str(tmp_path))
    row = signal.pitches(signal.levels(rows)).first()
    assert len(row.samples) == 8000 and row.pitch_hz == 200.0 and row.pitch_variation == 0.0
    assert abs(row.rms_dbfs - -9.24) < 0.05 and abs(row.peak_dbfs - -6.23) < 0.05 and abs(row.change_db) < 0.1 and row.clipped == 0
    sound(tmp_path / "b.wav", 8000)
    with pytest.raises(Exception, match="16 kHz"):
        files.review_audio(spark, str(tmp_path)).collect()


def test_versioned_table(spark, tmp_path):
    state = files.VersionedTable(spark, f"{tmp_path}/state")
    assert state.read() is None and state.revision() == 0
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "x int")
    assert state.commit(rows(1)) == 1
    before = state.read()
    assert state.commit(rows(1, 2), expected=1) == 2
    assert {r.x for r in before.collect()} == {1} and {r.x for r in state.read().collect()} == {1, 2}
    with pytest.raises(RuntimeError, match="revision 2"):
        state.commit(rows(3), expected=1)
    with pytest.raises(Exception, match="boom"):
        state.commit(rows(4).selectExpr("raise_error('boom') AS x"))
    assert {r.x for r in state.read().collect()} == {1, 2}
    assert state.commit(state.read().union(rows(5))) == 3
    assert sum(p.name.startswith("v") for p in (tmp_path / "state").iterdir()) == 2


def test_written_outputs(spark, tmp_path):
    text = spark.createDataFrame([(1, "a\nb"), (2, "c")], "recording_id long, text string")
    with pytest.raises(ValueError, match="pdf"):
        render.write({"txt": text, "pdf": text}, str(tmp_path))
    render.write({"txt": text, "json": text}, str(tmp_path))
    back = spark.read.text(f"{tmp_path}/txt", wholetext=True)
    assert {(r.recording_id, r.value.strip()) for r in back.collect()} == {(1, "a\nb"), (2, "c")}
    assert spark.read.json(f"{tmp_path}/json").count() == 2
