"""Scalar functions over labels, words and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_text(seconds: Column, mark: str = ".") -> Column:
    """HH:MM:SS and milliseconds; null, NaN and negative times are 0."""
    ms = F.bround(F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), 0.0).otherwise(seconds) * 1000).cast("long")
    part = lambda size, most: (F.floor(ms / size) % most).cast("int")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000).cast("int"), part(60_000, 60), part(1000, 60), part(1, 1000))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ends_sentence(word: Column) -> Column:
    return word.rlike(r"""[.!?]["')\]} ]*$""")


def sentence_continues(left: Column, right: Column) -> Column:
    """The last word of left does not end a sentence and the first letter of right's first word is lower."""
    core = F.regexp_replace(F.element_at(F.split(F.trim(left), r"\s+"), -1), r"""["')\]} ]+$""", "")
    letter = F.regexp_extract(F.element_at(F.split(F.trim(right), r"\s+"), 1), r"\p{L}", 0)
    return F.coalesce((core != "") & ~core.rlike("[.!?]$") & letter.rlike(r"^\p{Ll}$"), F.lit(False))


def is_lexical(word: Column) -> Column:
    """Has a letter or digit and is not wholly in brackets."""
    return word.rlike(r"[\p{L}\p{N}]") & ~word.rlike(r"^(\[.*\]|\(.*\)|<.*>)$")


def speaker_label(label: Column) -> Column:
    """Trailing digits give SPEAKER_NN; other labels are cleaned, raised and prefixed."""
    digits = F.regexp_extract(label, r"(\d+)$", 1)
    clean = F.upper(F.regexp_replace(F.regexp_replace(label, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    # numbers may be longer than any integer type
    number = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(digits != "", F.concat(F.lit("SPEAKER_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))).otherwise(
        F.concat(F.lit("SORTFORMER_"), F.when(clean == "", F.lit("UNKNOWN")).otherwise(clean))
    )


def extension_list(raw: Column) -> Column:
    """Comma-separated suffixes, trimmed, lower, with a dot, first seen first; null stays null, and a list without any is an error."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    named = F.array_distinct(F.transform(parts, lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x))))
    return F.when(F.size(named) == 0, F.raise_error(F.lit("at least one extension is needed"))).otherwise(named)


def review_formats(raw: Column) -> Column:
    """Comma-separated names of formats, trimmed, lower, each once, with json, in front if it is not named; an unknown name is an error."""
    parts = F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    named = F.when(F.array_contains(parts, "json"), parts).otherwise(F.array_prepend(parts, "json"))
    odd = F.array_except(parts, F.array(*map(F.lit, ("json", "srt", "vtt"))))
    return F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown review format "), odd[0]))).otherwise(named)


def token(word: Column) -> Column:
    """The word characters of a word, in lower case with a sharp s as ss."""
    return F.regexp_replace(F.replace(F.lower(word), F.lit("ß"), F.lit("ss")), r"(?U)\W+", "")


def speaker_display(speaker: Column, label: Column) -> Column:
    """UNKNOWN, the label with the voice in brackets, or the voice alone."""
    voice = F.when(F.coalesce(speaker, F.lit("")) == "", F.lit("SPEAKER_UNKNOWN")).otherwise(speaker)
    named = F.when((F.coalesce(label, F.lit("")) != "") & (label != voice), F.concat(label, F.lit(" ["), voice, F.lit("]"))).otherwise(voice)
    return F.when(voice == "SPEAKER_UNKNOWN", F.lit("UNKNOWN")).otherwise(named)


def one_space(text: Column) -> Column:
    """Runs of any white space as one space, and none at either end."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def short_id(length: int, *parts: Column) -> Column:
    """The first length digits of a hash of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with its keys in order, the same for equal values."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
