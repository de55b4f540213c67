"""Media and saved results as tables: folder scans, fingerprints, recordings' JSON, review audio, and versioned state."""

from __future__ import annotations

import io
import json
import uuid
import wave
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.session import remove

# Suffixes of media files, and the version of a recording's JSON.
MEDIA = (
    ".3gp .aac .aiff .alac .amr .ape .asf .avi .flac .m2ts .m4a .m4v .mka .mkv .mov .mp2 .mp3 .mp4 .mpeg .mpg .mts .oga .ogg .ogv .opus .ts .wav .webm .wma .wmv"
).split()
RESULT_VERSION = "1.7"


def _listed(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files with source, their path under folder; an empty one has no time of change."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    # both as a path without the store's name, which listings write in several ways
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z]+:/+", "/"), "/+", "/")
    bare = F.concat(plain(F.lit(root)), F.lit("/"))
    rows = files.withColumn("source", F.substring(plain(F.col("path")), F.length(bare) + 1, F.length("path")))
    # the reader passes over empty files, but its index, which the driver holds anyway, names them
    every = spark.createDataFrame([(unquote(x),) for x in files.inputFiles()], "path string")
    every = every.select("path", F.substring(plain(F.col("path")), F.length(bare) + 1, F.length("path")).alias("source"))
    empty = every.join(rows.select("source"), "source", "left_anti")
    return rows.unionByName(empty.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"), "source"))


def discover_media(spark: SparkSession, folder: str, excluded: list[str] = (), recursive: bool = True, extensions: list[str] | None = None, with_audio: DataFrame | None = None) -> DataFrame:
    """source (path under folder), length and modified of the media files, in order of the path without regard to case.

    Names that begin with a dot and files in excluded folders (under folder) are
    passed over. extensions, as text.extension_list() gives them, or else the
    known MEDIA and the sources in with_audio(source), which have an audio
    stream. Only names are listed; no file is read.
    """
    rows = _listed(spark, folder, recursive).select("source", "length", F.col("modificationTime").alias("modified"))
    if not recursive:
        rows = rows.where(~F.col("source").contains("/"))
    rows = rows.where(~F.regexp_extract("source", r"([^/]*)$", 1).startswith("."))
    for inside in excluded:
        rows = rows.where(~F.col("source").startswith(inside.strip("/") + "/"))
    suffix = F.lower(F.regexp_extract("source", r"[^/.](\.[^./]*)$", 1))
    if extensions is not None:
        rows = rows.where(suffix.isin(list(extensions)))
    else:
        named = rows.where(suffix.isin(MEDIA))
        rows = named if with_audio is None else named.union(rows.where(~suffix.isin(MEDIA)).join(with_audio.select("source"), "source", "left_semi").select(*rows.columns))
    return rows.orderBy(F.lower("source"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """source, size, modified, sha256 of the whole content, and hash_algorithm of every file."""
    rows = _listed(spark, folder)
    return rows.select("source", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.lit("sha256-full-v1").alias("hash_algorithm"))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """source, payload (JSON text) and fault of the recordings' JSON files: not JSON, of another version, or without turns and processing."""
    files = _listed(spark, folder).where(F.lower("source").endswith(".json")).select("source", F.col("content").cast("string").alias("payload"))
    parsed = F.from_json("payload", "schema_version string, turns string, processing string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = files.withColumn("x", parsed)
    fault = (
        F.when(F.col("x").isNull() | F.col("x._corrupt").isNotNull(), "not JSON")
        .when(~F.col("x.schema_version").eqNullSafe(RESULT_VERSION), "unsupported version")
        .when(~F.coalesce(F.col("x.turns").startswith("["), F.lit(False)), "no turns")
        .when(~F.coalesce(F.col("x.processing").startswith("{"), F.lit(False)), "no processing")
    )
    return rows.select("source", "payload", fault.alias("fault"))


def valid_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """source, format and valid of output files: not empty (an SRT may be), a VTT with its header, JSON as results() wants it."""
    kind = F.when(F.col("source").endswith(".detailed.txt"), "detailed_txt").otherwise(F.regexp_extract("source", r"\.([^.]*)$", 1))
    files = _listed(spark, folder).select("source", "length", kind.alias("format"), F.col("content").cast("string").alias("text"))
    judged = results(spark, folder).select("source", F.col("fault").isNull().alias("sound"))
    ok = (
        F.when(F.col("length") == 0, F.col("format") == "srt").when(F.col("format") == "vtt", F.col("text").startswith("WEBVTT\n"))
        .when(F.col("format") == "json", F.coalesce("sound", F.lit(False))).otherwise(F.lit(True))
    )
    return files.join(judged, "source", "left").select("source", "format", ok.alias("valid"))


def review_audio(spark: SparkSession, folder: str) -> DataFrame:
    """source and samples from -1 to 1 of WAV files; any that is not mono, 16 bits and 16 kHz is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decode(content: pd.Series) -> pd.Series:
        import numpy as np

        def one(data: bytes):
            with wave.open(io.BytesIO(data)) as w:
                if (w.getnchannels(), w.getsampwidth(), w.getframerate()) != (1, 2, 16_000):
                    raise ValueError("review audio must be mono, 16 bits and 16 kHz")
                return np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype("float32") / 32768.0

        return content.map(one)

    rows = _listed(spark, folder).where(F.lower("source").endswith(".wav"))
    return rows.select("source", decode("content").alias("samples"))


class VersionedTable:
    """A table of which each commit is a folder of its own, and a pointer file names the one that holds.

    Readers see the last commit until the pointer is replaced, which is one
    rename. What a broken commit has left is not named by the pointer, and goes
    with the next commit, as does all but the version before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict | None:
        path = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(path):
            return None
        lines = self.spark.read.text(f"{self.folder}/CURRENT").collect()
        return json.loads(lines[0].value)

    def read(self) -> DataFrame | None:
        now = self._pointer()
        return self.spark.read.parquet(f"{self.folder}/{now['version']}") if now else None

    def revision(self) -> int:
        now = self._pointer()
        return now["revision"] if now else 0

    def commit(self, rows: DataFrame, expected: int | None = None) -> int:
        """Write rows as the next version; expected, if given, must be the revision that they were made from."""
        now = self._pointer()
        revision = now["revision"] if now else 0
        if expected is not None and expected != revision:
            raise RuntimeError(f"the state is at revision {revision}, not {expected}")
        name = f"v{revision + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        fresh = self._path(f"{self.folder}/CURRENT.{name}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"version": name, "revision": revision + 1, "before": now and now["version"]}).encode()))
        out.close()
        target = self._path(f"{self.folder}/CURRENT")
        if now:
            self._fs.delete(target, False)
        if not self._fs.rename(fresh, target):
            raise RuntimeError("the state could not be replaced")
        for status in self._fs.listStatus(self._path(self.folder)):
            held = status.getPath().getName()
            if held not in (name, "CURRENT", now and now["version"]):
                remove(self.spark, f"{self.folder}/{held}")
        return revision + 1


def owned_faults(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """source and status (missing, unexpected, changed) of files that are not as expected(source, sha256); without any the folder can be replaced."""
    from talkgrid.operators.attribution import differences

    return differences(expected, fingerprints(spark, folder).where("source not like '.%'").select("source", "sha256"), "source", "sha256")
