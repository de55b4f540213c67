"""Multipart credential linking over whole texts, with SQL functions only.

Strong spans (assigned secrets, access keys, long hex strings) are reported
always. Weak parts - user-like identifiers, bare high-entropy strings and
endpoints - are reported only where complementary parts co-occur: parts of a
document are interval-joined within SCOPE code points, an identifier needs a
secret near it, a bare secret needs an identifier, an endpoint needs both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrid.llm._scan import bind, running
from talkgrid.session import durable

#: Code points between two parts of one credential, at most.
SCOPE = 256

# The patterns that are reported always.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: Weak parts: an identifier, a bare secret, an endpoint.
IDENTIFIER = r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
BARE_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]{0,80}[0-9])(?=[a-z0-9+/_=-]{0,80}[A-Z])(?=[A-Z0-9+/_=-]{0,80}[a-z])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"(?i:https?|ftp|postgres|mysql|mongodb|redis|s3)://[^\s\"'<>]{4,}"

#: In the order that breaks ties of spans with one start.
KINDS = ("assign", "access", "hex", "identifier", "bare", "endpoint")
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"


def spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<s long, e long>> of the leftmost non-overlapping matches for which keep(match) holds, in code points.

    Matches are framed by two private-use characters, and the text is split at
    them; those characters in the text itself become a third one first, which
    changes neither a match nor a length.
    """
    framed = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER), f"({pattern})", f"{_OPEN}$1{_CLOSE}")
    pieces = F.split(framed, f"[{_OPEN}{_CLOSE}]")
    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")

    def cut(p: Column) -> Column:
        # every second piece is a match
        ends = running(p, lambda x: F.length(x).cast("long"))
        placed = bind(ends, lambda e: F.transform(p, lambda x, i: F.struct((e[i] - F.length(x)).alias("s"), e[i].alias("e"), ((i % 2 == 1) if keep is None else (i % 2 == 1) & keep(x)).alias("good"))))
        return F.transform(F.filter(placed, lambda x: x["good"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    return F.when(text.rlike(pattern), bind(pieces, cut)).otherwise(none)


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def _joined(found: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", kind(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end by start, in code points, end exclusive. Null texts
    are empty; repeated rows give equal rows; a null doc_id is kept; other
    columns are ignored; an empty table gives no row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE
    longer = lambda n: lambda m: F.length(m) >= n
    parts = {
        "assign": spans(text, ASSIGN, value),
        "access": spans(text, ACCESS, longer(LEAST_ACCESS)),
        # shorter runs are dropped anyway, so only runs of the least length are framed
        "hex": spans(text, f"[0-9a-f]{{{LEAST_HEX},}}"),
        "identifier": spans(text, IDENTIFIER),
        "bare": spans(text, BARE_SECRET),
        "endpoint": spans(text, ENDPOINT),
    }
    scanned = durable(docs.select(F.col("doc_id"), F.xxhash64(text).alias("th"), *[_named(x, k).alias(k) for k, x in parts.items()]))
    base = F.concat(*KINDS_BASE)
    weak = F.concat("identifier", "bare", "endpoint")

    some = scanned.where(F.size(weak) > 0).select("doc_id", "th", base.alias("base"), weak.alias("weak")).dropDuplicates(["doc_id", "th"])
    asking = some.select("doc_id", "th", F.explode("weak").alias("w"))
    # in all buckets that it covers, as the distance to what follows counts from its end
    asking = asking.select("doc_id", "th", "w", F.explode(F.sequence(F.floor(F.col("w.s") / SCOPE), F.floor(F.col("w.e") / SCOPE))).alias("bucket"))
    near = some.select("doc_id", "th", F.explode(F.concat("base", "weak")).alias("p"))
    reach = F.sequence(F.floor((F.col("p.s") - SCOPE) / SCOPE), F.floor((F.col("p.e") + SCOPE) / SCOPE))
    near = near.select("doc_id", "th", "p", F.explode(reach).alias("bucket"))
    a, b = asking.alias("a"), near.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")) & (F.col("a.bucket") == F.col("b.bucket"))
    apart = F.greatest(F.col("b.p.s") - F.col("a.w.e"), F.col("a.w.s") - F.col("b.p.e"), F.lit(0).cast("long"))
    role = lambda *kinds: F.col("b.p.k").isin([KINDS.index(k) for k in kinds])
    found = (
        a.join(b, same & (apart <= SCOPE))
        .groupBy("a.doc_id", "a.th", "a.w")
        .agg(F.max(role("assign", "hex", "bare")).alias("secret"), F.max(role("access", "identifier")).alias("id"))
    )
    kind = F.col("w.k")
    meets = (
        ((kind == KINDS.index("identifier")) & F.col("secret"))
        | ((kind == KINDS.index("bare")) & F.col("id"))
        | ((kind == KINDS.index("endpoint")) & F.col("secret") & F.col("id"))
    )
    linked = found.where(meets).groupBy("doc_id", "th").agg(F.collect_list("w").alias("linked"))
    x, y = scanned.alias("x"), linked.alias("y")
    rows = x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.th") == F.col("y.th")), "left")
    every = F.concat(base, F.coalesce("linked", F.expr("cast(array() as array<struct<s:bigint,k:int,e:bigint>>)")))
    return rows.select(
        F.col("x.doc_id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )


KINDS_BASE = KINDS[:3]
