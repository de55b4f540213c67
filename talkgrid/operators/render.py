"""Transcripts as text: tone lines, paragraphs, the readable and the detailed transcript, cues, and names of output files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.functions import text as T
from talkgrid.operators.sessions import UNKNOWN, in_order, paragraph_numbers

# Observations that the readable transcript names, and how.
CONTEXT = {"long pause before": "long pause before", "overlap": "overlapping speech", "interruption": "interruption", "elevated volume": "elevated volume"}
# The head of the detailed transcript.
NOTICE = (
    "Observed annotations are measured acoustic/timing features. Tone annotations",
    "are approximate model estimates, not facts about emotion, intent, honesty,",
    "mental state, diagnosis, or the meaning of the conversation.",
    "Speaker labels are probabilistic acoustic assignments. Verify attribution",
    "against the recording before concluding who said a statement.",
)
PRESERVED = "Words are preserved. Timestamps and speaker review details are in Review."
UNCERTAIN = "[Speaker attribution: uncertain; verify against the recording]"


def percent(p: Column) -> Column:
    """A share as whole per cent, halves to even."""
    return F.concat(F.bround(p * 100).cast("long").cast("string"), F.lit("%"))


def tone_line(scores: Column, n_windows: Column, varies: Column, kind: Column) -> Column:
    """The three best labels with their shares; array<struct<label, p>> of shares from 0 to 1."""
    name = lambda x: F.when(x["label"] == "unknown", "unclassified").otherwise(F.coalesce(x["label"], F.lit("unclassified")))
    shown = F.array_join(F.transform(F.slice(scores, 1, 3), lambda x: F.concat(name(x), F.lit(" "), percent(F.coalesce(x["p"], F.lit(0.0))))), ", ")
    line = F.when(varies, F.concat(F.lit("varies across "), n_windows.cast("string"), F.lit(" windows; "), shown)).otherwise(shown)
    return F.when(scores.isNull(), "not estimated").when(kind == "unavailable", "unavailable").when(line == "", "no estimate").otherwise(line)


def collapsed(signals: Column) -> Column:
    """An array without nulls and without repeats of the one before."""
    real = F.array_compact(signals)
    return F.filter(real, lambda x, i: (i == 0) | (x != F.get(real, i - 1)))


def paragraph_blocks(turns: DataFrame, profiles: DataFrame) -> DataFrame:
    """recording_id, paragraph, block: the lines of each paragraph, with its context and tone.

    turns(..., observed array, tone); profiles(voice, label).
    """
    rows = paragraph_numbers(turns).groupBy("recording_id", F.col("grp").alias("paragraph")).agg(
        F.first("speaker").alias("voice"), in_order(["turn_ord"], "text").alias("text"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn_ord", "observed"))), lambda x: x["observed"])).alias("observed"),
        F.transform(F.array_sort(F.collect_list(F.struct("turn_ord", "tone"))), lambda x: x["tone"]).alias("tones"),
    ).join(profiles.select("voice", "label"), "voice", "left")
    named = F.create_map(*[F.lit(x) for pair in CONTEXT.items() for x in pair])
    context = F.array_distinct(F.array_compact(F.transform("observed", lambda o: F.try_element_at(named, o))))
    tones = collapsed(F.col("tones"))
    tone = F.when(F.size(tones) == 1, tones[0]).otherwise(F.concat(F.lit("varied ("), F.array_join(F.slice(tones, 1, 3), " -> "), F.lit(")")))
    lines = F.array(
        F.concat(T.speaker_display(F.col("voice"), F.col("label")), F.lit(":")), F.col("text"),
        F.when(F.size(context) > 0, F.concat(F.lit("[Context: "), F.array_join(context, "; "), F.lit("]"))),
        F.when(F.size(tones) > 0, F.concat(F.lit("[Vocal tone estimate: "), tone, F.lit("]"))),
    )
    return rows.select("recording_id", "paragraph", F.array_join(F.array_compact(lines), "\n").alias("block"))


def speaker_list(turns: DataFrame, profiles: DataFrame) -> DataFrame:
    """recording_id and speakers, the voices in the order in which they are first heard, each with its label and role."""
    seen = turns.groupBy("recording_id", F.coalesce("speaker", F.lit(UNKNOWN)).alias("voice")).agg(F.min("turn_ord").alias("first")).join(profiles, "voice", "left")
    notes = F.array_compact(F.array(F.when((F.col("label") != "") & (F.col("label") != F.col("voice")), F.col("label")), F.when(F.col("role").isin("adult", "child"), F.col("role"))))
    shown = F.concat(F.when(F.col("voice") == UNKNOWN, "UNKNOWN").otherwise(F.col("voice")), F.when(F.size(notes) > 0, F.concat(F.lit(" ("), F.array_join(notes, "; "), F.lit(")"))).otherwise(F.lit("")))
    return seen.groupBy("recording_id").agg(in_order(["first"], shown, ", ").alias("speakers"))


def readable(recordings: DataFrame, turns: DataFrame, profiles: DataFrame) -> DataFrame:
    """recording_id and txt, the transcript to read. recordings(recording_id, source, language, ready); one without turns says so."""
    blocks = paragraph_blocks(turns, profiles).groupBy("recording_id").agg(in_order(["paragraph"], "block", "\n\n").alias("body"))
    rows = recordings.join(speaker_list(turns, profiles), "recording_id", "left").join(blocks, "recording_id", "left")
    line = lambda name, c, default: F.concat(F.lit(name), F.coalesce(c, F.lit(default)))
    head = [
        F.when(F.col("ready"), "ANALYSIS-READY TRANSCRIPT").otherwise("DRAFT: SPEAKER REVIEW REQUIRED"), F.lit("========================="),
        line("Source: ", "source", ""), line("Language: ", "language", "unknown"), line("Speakers: ", "speakers", "none detected"),
        F.lit(PRESERVED), F.lit(""), F.lit("TRANSCRIPT"), F.lit("----------"), F.lit(""), F.coalesce("body", F.lit("[No speech was transcribed.]")),
    ]
    return rows.select("recording_id", F.concat(F.concat_ws("\n", *head), F.lit("\n")).alias("txt"))


def detailed(recordings: DataFrame, turns: DataFrame, profiles: DataFrame) -> DataFrame:
    """recording_id and txt, the transcript with times, observations and tone of each turn (observed array, tone_line, uncertain)."""
    rows = turns.join(profiles.select(F.col("voice").alias("speaker"), "label"), "speaker", "left")
    observed = F.when(F.size("observed") > 0, F.array_join("observed", "; ")).otherwise("no notable acoustic flags")
    stamp = lambda c: T.timestamp_text(F.col(c) / 1000.0)
    block = F.array_compact(F.array(
        F.concat(F.lit("["), stamp("s"), F.lit(" - "), stamp("e"), F.lit("] "), T.speaker_display(F.col("speaker"), F.col("label")), F.lit(":")), F.trim("text"),
        F.when(F.col("uncertain"), F.lit(UNCERTAIN)), F.concat(F.lit("[Observed: "), observed, F.lit("]")), F.concat(F.lit("[Tone approx: "), "tone_line", F.lit("]")),
    ))
    bodies = rows.select("recording_id", "turn_ord", F.array_join(block, "\n").alias("block")).groupBy("recording_id").agg(in_order(["turn_ord"], "block", "\n\n").alias("body"))
    head = [F.lit("TRANSCRIPT"), F.lit("=========="), F.concat(F.lit("Source: "), "source"), F.concat(F.lit("Language: "), F.coalesce("language", F.lit("unknown"))), F.lit(""), *map(F.lit, NOTICE), F.lit(""), F.lit("TRANSCRIPT"), F.lit("----------"), F.lit("")]
    out = recordings.join(bodies, "recording_id", "left")
    return out.select("recording_id", F.concat(F.concat_ws("\n", *head, F.coalesce("body", F.lit("[No speech was transcribed.]"))), F.lit("\n")).alias("txt"))


def cues(segments: DataFrame, profiles: DataFrame, kind: str) -> DataFrame:
    """recording_id and text, the segments(recording_id, ord, s, e, speaker, text) as SRT or VTT cues."""
    rows = segments.join(profiles.select(F.col("voice").alias("speaker"), "label"), "speaker", "left")
    voice, text, mark = T.speaker_display(F.col("speaker"), F.col("label")), F.trim("text"), "," if kind == "srt" else "."
    times = F.concat(T.timestamp_text(F.col("s") / 1000.0, mark), F.lit(" --> "), T.timestamp_text(F.col("e") / 1000.0, mark))
    if kind == "srt":
        number = F.row_number().over(Window.partitionBy("recording_id").orderBy("ord")).cast("string")
        cue = F.concat_ws("\n", number, times, F.concat(F.lit("["), voice, F.lit("] "), text))
    else:
        cue = F.concat_ws("\n", times, F.concat(F.lit("<v "), T.html_escape(voice), F.lit(">"), T.html_escape(text), F.lit("</v>")))
    body = rows.select("recording_id", "ord", cue.alias("cue")).groupBy("recording_id").agg(in_order(["ord"], "cue", "\n\n").alias("body"))
    return body.select("recording_id", F.concat(F.lit("" if kind == "srt" else "WEBVTT\n\n"), "body", F.lit("\n")).alias("text"))


def output_names(sources: DataFrame, formats: Column) -> DataFrame:
    """source, format and path of the files that a source(relative path) is written to: the transcript apart from what is for review."""
    folder = F.when(F.col("source").contains("/"), F.regexp_extract("source", r"^(.*/)[^/]*$", 1)).otherwise(F.lit(""))
    name = F.concat(folder, F.regexp_extract("source", r"([^/]*)$", 1))
    every = F.concat(F.array(F.lit("txt"), F.lit("detailed_txt")), formats)
    rows = sources.select("source", name.alias("name"), F.explode(every).alias("format"))
    ending = F.when(F.col("format") == "detailed_txt", "detailed.txt").otherwise(F.col("format"))
    root = F.when(F.col("format") == "txt", "transcripts/").otherwise("review/")
    return rows.select("source", "format", F.concat(root, "name", F.lit("."), ending).alias("path"))


def embedded(json: Column) -> Column:
    """JSON text that is safe inside a script element."""
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def write(frames: dict[str, DataFrame], folder: str) -> None:
    """One folder of text files for each format; an unknown format is an error before anything is written."""
    odd = set(frames) - {"txt", "detailed_txt", "json", "srt", "vtt"}
    if odd:
        raise ValueError(f"unsupported output format: {', '.join(sorted(odd))}")
    for name, df in frames.items():
        if name == "json":
            df.write.mode("overwrite").partitionBy("recording_id").json(f"{folder}/{name}")
        else:
            text = next(c for c in df.columns if c != "recording_id")
            df.select("recording_id", F.col(text).alias("value")).write.mode("overwrite").partitionBy("recording_id").text(f"{folder}/{name}")
