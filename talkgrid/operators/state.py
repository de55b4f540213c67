"""Manifest, packets, registry and review decisions as tables: status rules, upserts, overlays and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkgrid.functions import text as T
from talkgrid.operators import intervals as I
from talkgrid.operators.sessions import UNKNOWN

FULL_HASH = "sha256-full-v1"
#: Automatic observations that a profile keeps.
KEPT = 20


def same_content(a: str, b: str) -> Column:
    """Two fingerprints (structs of hash_algorithm, sha256, size) are of one content; the time of change does not count."""
    f = lambda side, c: F.col(f"{side}.{c}")
    both = (f(a, "hash_algorithm") == FULL_HASH) & (f(b, "hash_algorithm") == FULL_HASH)
    return F.coalesce(both & (F.length(f(a, "sha256")) == 64) & (f(a, "sha256") == f(b, "sha256")) & f(a, "size").eqNullSafe(f(b, "size")), F.lit(False))


def pending(groups: Column, turns: Column) -> Column:
    """The larger queue, as groups and turns overlap."""
    return F.greatest(F.coalesce(groups, F.lit(0)), F.coalesce(turns, F.lit(0)))


def is_ready(count: Column, status: Column) -> Column:
    return (count == 0) & F.coalesce(status, F.lit("current")).isin("current", "metadata_equivalent")


def completion(rows: DataFrame) -> DataFrame:
    """rows with reason, why a source must be processed (again), or null if it is complete.

    status null: never processed; fingerprint and settings are those of the last
    run, the others those of now; bad_output is the first output that is missing
    or invalid.
    """
    reason = (
        F.when(F.col("status").isNull(), "not previously processed")
        .when(~F.col("status").isin("complete", "awaiting_review") | ~F.coalesce("completed", F.lit(False)), F.concat(F.lit("previous status is "), "status"))
        .when(F.col("retry"), "a processing stage requested retry")
        .when(~F.col("fingerprint").eqNullSafe(F.col("now_fingerprint")), "source changed")
        .when(~F.col("settings").eqNullSafe(F.col("now_settings")), "processing settings changed")
        .when(F.col("bad_output").isNotNull(), F.concat(F.lit("required "), F.upper("bad_output"), F.lit(" output is missing or invalid")))
    )
    return rows.withColumn("reason", reason)


def packet_status(rows: DataFrame) -> DataFrame:
    """rows with state, the first rule of the ladder that fails, and allowed, whether decisions can be applied.

    Columns: well_formed, manifest_agrees, available, stored and current
    (fingerprints), reprocess, moved, source_status, pending.
    """
    stored = F.struct("stored.*")
    odd = ~stored.eqNullSafe(F.struct("current.*")) | F.col("moved") | ~F.coalesce("source_status", F.lit("current")).isin("current", "metadata_equivalent")
    state = (
        F.when(~F.col("well_formed") | ~F.col("manifest_agrees"), "malformed_saved_state")
        .when(~F.col("available"), "source_unavailable")
        .when(~F.col("stored.hash_algorithm").eqNullSafe(FULL_HASH), "recovery_required")
        .when(~same_content("stored", "current"), "source_content_changed")
        .when(F.col("reprocess"), "recovery_required")
        .when(odd, "metadata_equivalent")
        .when(F.col("pending") > 0, "pending_review")
        .otherwise("ready")
    )
    return rows.withColumn("state", state).withColumn("allowed", F.col("state").isin("metadata_equivalent", "pending_review", "ready"))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """table with the last change of each key in place of its row; new keys are added."""
    last = changes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n", order)
    return table.join(last, key, "left_anti").unionByName(last.select(*table.columns))


def add_observations(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry(voice, observation, ord, verified, content) after new observations of the same columns, with ord after all others.

    An observation belongs to one voice. A verified one is not replaced by an
    automatic one, and one of equal content stays as it is; else the new one
    takes its place, in whichever voice. A voice keeps all verified and the last
    KEPT automatic ones.
    """
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy("observation").orderBy(F.desc("verified"), F.desc("ord")))).where("__n = 1").drop("__n")
    old = registry.select("observation", F.col("voice").alias("o_voice"), F.col("verified").alias("o_verified"), F.col("content").alias("o_content"))
    met = last.join(old, "observation", "left")
    same = F.coalesce((F.col("voice") == F.col("o_voice")) & (F.col("verified") == F.col("o_verified")) & (F.col("content") == F.col("o_content")), F.lit(False))
    guarded = F.coalesce(F.col("o_verified") & ~F.col("verified"), F.lit(False))
    taken = met.where(~same & ~guarded).select(*registry.columns)
    whole = registry.join(taken.select("observation"), "observation", "left_anti").select(*registry.columns).unionByName(taken)
    newest = F.row_number().over(Window.partitionBy("voice", "verified").orderBy(F.desc("ord")))
    return whole.withColumn("__n", newest).where(F.col("verified") | (F.col("__n") <= KEPT)).drop("__n")


def replace_references(registry: DataFrame, confirmed: DataFrame, sessions: DataFrame) -> DataFrame:
    """The registry with the verified observations of the sessions replaced by confirmed ones; automatic ones of the same observation go, too."""
    gone = registry.where("verified").join(sessions.select("session"), "session", "left_semi")
    left = registry.join(gone.select("observation"), "observation", "left_anti").join(confirmed.select("observation"), "observation", "left_anti")
    return left.select(*registry.columns).unionByName(confirmed.withColumn("verified", F.lit(True)).select(*registry.columns))


def resolve_aliases(merges: DataFrame) -> DataFrame:
    """source and target of merges(ord, source, target) of voices, with targets that were merged later followed on.

    A voice is merged away once. Links are shortened by half at a time, so the
    rounds grow with the logarithm of the longest chain.
    """
    from talkgrid.session import durable

    links = durable(merges.select("source", "target"))
    while True:
        ahead = links.select(F.col("source").alias("target"), F.col("target").alias("further"))
        now = durable(links.join(ahead, "target", "left").select("source", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        links = now.select("source", "target")
        if now.where("moved").isEmpty():
            return links


def agreed_aliases(batches: DataFrame) -> DataFrame:
    """key and value of the batches' (key, value) pairs, for the keys with one value in all of them."""
    return batches.groupBy("key").agg(F.count_distinct("value").alias("n"), F.first("value").alias("value")).where("n = 1").select("key", "value")


def new_voice_ids(taken: DataFrame, wanted: DataFrame, first: int = 1) -> DataFrame:
    """wanted(key) with the next free VOICE_%04d each, in order of key, from number first on; taken(voice)."""
    used = taken.select(F.regexp_extract("voice", r"^VOICE_(\d{4,})$", 1).alias("n")).where("n <> ''").select(F.col("n").cast("long").alias("n")).where(F.col("n") >= first).distinct()
    # the k-th free number is k plus the used ones before it: used number u, the i-th of them, stands after u - first - i free ones
    ranks = used.withColumn("i", F.row_number().over(Window.orderBy("n")) - 1).select((F.col("n") - first - F.col("i")).alias("k"))
    jumps = ranks.groupBy("k").agg(F.count("*").alias("c"))
    rows = wanted.withColumn("k", (F.row_number().over(Window.orderBy("key")) - 1).cast("long"))
    both = rows.select("key", "k", F.lit(0).cast("long").alias("c")).unionByName(jumps.select(F.lit(None).cast("string").alias("key"), "k", "c"))
    passed = F.sum("c").over(Window.orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = both.withColumn("n", F.col("k") + passed + first).where("key is not null")
    return numbered.select("key", F.format_string("VOICE_%04d", "n").alias("voice"))


def registry_faults(observations: DataFrame, profiles: DataFrame) -> DataFrame:
    """fault and id of what makes a registry invalid: voice names, vectors of another length or none, repeated observations, unknown voices."""
    size = profiles.select(F.max("dimension").alias("dimension"))
    bad_name = profiles.where(~F.col("voice").rlike(r"^VOICE_\d{4,}$")).select(F.lit("bad voice id").alias("fault"), F.col("voice").alias("id"))
    lengths = observations.crossJoin(F.broadcast(size)).where(F.coalesce(F.col("length"), F.lit(0)) != F.col("dimension")).select(F.lit("wrong dimension").alias("fault"), F.col("observation").alias("id"))
    twice = observations.groupBy("observation").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated observation").alias("fault"), F.col("observation").alias("id"))
    lost = observations.join(profiles, "voice", "left_anti").select(F.lit("unknown voice").alias("fault"), F.col("observation").alias("id"))
    return bad_name.union(lengths).union(twice).union(lost)


def parse_diarizer_rows(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows with s and e in seconds, speaker and model_speaker of a "start end label" line, or error; starts are not negative and no end is before its start."""
    parts = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    start, end = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    good = (F.size(parts) >= 3) & start.isNotNull() & end.isNotNull()
    begin = F.greatest(F.lit(0.0), start)
    label = F.get(parts, F.lit(2))
    return rows.select(
        *rows.columns, F.when(good, begin).alias("s"), F.when(good, F.greatest(begin, end)).alias("e"),
        F.when(good, T.speaker_label(label)).alias("speaker"), F.when(good, label).alias("model_speaker"), F.when(~good, "invalid segment").alias("error"),
    )


def diarization_faults(segments: DataFrame, timeline: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """recording_id, labels, labelled segments and fault (null if usable) of each recording with segments."""
    known = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("", UNKNOWN)
    heard = segments.groupBy("recording_id").agg(F.count("*").alias("segments"), F.count_if(known("speaker")).alias("labelled"))
    seen = timeline.groupBy("recording_id").agg(F.count("*").alias("intervals"), F.count_distinct(F.when(known("speaker"), F.col("speaker"))).alias("labels"))
    rows = heard.join(seen, "recording_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("intervals", "labels")})
    fault = F.when((F.col("intervals") == 0) | (F.col("labels") == 0) | (F.col("labelled") == 0), "no usable speaker timeline or segment labels")
    if least is not None:
        fault = fault.when(F.col("labels") < least, "too few speakers")
    if most is not None:
        fault = fault.when(F.col("labels") > most, "too many speakers")
    return rows.select("recording_id", "segments", "labelled", "intervals", "labels", fault.alias("fault"))


def resolve_choices(turns: DataFrame, groups: DataFrame, overrides: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pieces of turns(recording_id, turn_ord, local, s, e) with the choice that a reviewer made: of a range, else of the turn, else of the local speaker.

    groups(recording_id, local, choice); overrides(recording_id, turn_ord,
    choice); ranges(recording_id, turn_ord, s, e, choice), disjoint and inside
    their turn.
    """
    key = ["recording_id", "turn_ord"]
    own = turns.join(overrides.withColumnRenamed("choice", "turn_choice"), key, "left").join(groups.withColumnRenamed("choice", "group_choice"), ["recording_id", "local"], "left")
    own = own.select(*key, "local", "s", "e", F.coalesce("turn_choice", "group_choice").alias("choice"))
    rest = I.subtract_own(
        own.select("recording_id", F.col("turn_ord").alias("ord"), "s", "e", F.struct("local", "choice").alias("speaker")), ranges.select("recording_id", F.col("turn_ord").alias("ord"), "s", "e")
    )
    rest = rest.select("recording_id", F.col("ord").alias("turn_ord"), F.col("speaker.local").alias("local"), "s", "e", F.col("speaker.choice").alias("choice"))
    made = ranges.join(own.select(*key, "local"), key).select(*key, "local", "s", "e", "choice")
    return rest.unionByName(made)


def range_faults(turns: DataFrame, ranges: DataFrame) -> DataFrame:
    """recording_id, turn_ord, s, e and fault of ranges that name no turn, lie outside it, or overlap the one before."""
    key = ["recording_id", "turn_ord"]
    rows = ranges.join(turns.select(*key, F.col("s").alias("t_s"), F.col("e").alias("t_e")), key, "left")
    before = F.max("e").over(Window.partitionBy(*key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    inside = (F.col("t_s") <= F.col("s")) & (F.col("s") < F.col("e")) & (F.col("e") <= F.col("t_e"))
    fault = F.when(F.col("t_s").isNull(), "absent turn").when(~inside, "outside its turn").when(before > F.col("s"), "overlaps another range")
    return rows.select(*key, "s", "e", fault.alias("fault")).where("fault is not null")


def overlay(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """words(recording_id, seg_ord, word_ord, local_speaker, speaker, s, e) with speaker and identity after the choices of pieces(recording_id, local, ord, s, e, choice).

    The piece of the word's local speaker that holds its middle decides, of
    several the first, and at the very end of the last one this; untimed words
    stay as they are.
    """
    key = ["recording_id", "seg_ord", "word_ord"]
    width = I.BUCKET
    points = words.where("s is not null and e is not null").select(*key, F.col("local_speaker").alias("local"), (F.col("s") + F.col("e")).alias("m"))
    points = points.withColumn("bucket", F.floor(F.col("m") / (2 * width)))
    spread = pieces.select("recording_id", "local", "ord", (2 * F.col("s")).alias("a"), (2 * F.col("e")).alias("b"), "choice")
    spread = spread.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / (2 * width)), F.floor(F.greatest("a", "b") / (2 * width)))))
    met = points.join(spread, ["recording_id", "local", "bucket"]).where("a <= m and m <= b")
    piece = F.struct("ord", "choice")
    found = met.groupBy(*key).agg(F.min(F.when(F.col("m") < F.col("b"), piece)).alias("inside"), F.max(F.when(F.col("m") == F.col("b"), piece)).alias("last"))
    chosen = found.select(*key, F.coalesce("inside", "last")["choice"].alias("choice"))
    rows = words.join(chosen, key, "left")
    out = F.col("choice").isin("unknown", "ignore")
    identity = F.when(F.col("choice") == "unknown", "unresolved_human").when(F.col("choice") == "ignore", "human_excluded").when(F.col("choice").isNotNull(), "human_verified")
    return rows.select(*key, "local_speaker", "choice", F.when(out, UNKNOWN).otherwise(F.coalesce("choice", "speaker")).alias("speaker"), identity.alias("identity"))


def group_status(words: DataFrame) -> DataFrame:
    """recording_id, local_speaker, status and reviewed voices of each local speaker by the choices of all its words, or null where one has none."""
    per = words.groupBy("recording_id", "local_speaker").agg(
        F.max(F.col("choice").isNull()).alias("open"), F.max(F.coalesce(F.col("choice") == "unknown", F.lit(False))).alias("unknown"), F.array_sort(F.collect_set("choice")).alias("choices")
    )
    voices = F.filter("choices", lambda c: c != "ignore")
    done = ~F.col("open") & ~F.col("unknown")
    status = (
        F.when(done & (F.size(voices) == 0), "human_excluded").when(done & (F.size("choices") == 1), "human_verified").when(done, "human_verified_mixed_cluster").when(F.col("unknown"), "unresolved_human")
    )
    return per.select("recording_id", "local_speaker", status.alias("status"), F.when(done, F.array_join(voices, ",")).alias("reviewed"))


def reference_coverage(windows: DataFrame, pieces: DataFrame) -> DataFrame:
    """recording_id, ord, profile and covered of the windows(recording_id, ord, local, s, e, eligible, excluded) that one choice alone covers enough."""
    good = windows.where("eligible and not excluded").select("recording_id", "ord", "local", "s", "e")
    met = I.ms_join(good, pieces.select("recording_id", "local", "s", "e", "choice")).where("local = r_local")
    sums = met.groupBy("recording_id", "ord", "s", "e").agg(
        F.count_distinct(F.coalesce("r_choice", F.lit(""))).alias("n"), F.first("r_choice").alias("profile"), F.sum(F.least("e", "r_e") - F.greatest("s", "r_s")).alias("covered")
    )
    enough = (F.col("n") == 1) & ~F.coalesce("profile", F.lit("unknown")).isin("unknown", "ignore") & (F.col("covered") >= F.least(F.lit(200), (F.col("e") - F.col("s")) / 4))
    return sums.where(enough).select("recording_id", "ord", "profile", "covered")


def apply_identities(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows with the voice decided for their local speaker; decisions(recording_id, local_speaker, voice, status); others keep their label."""
    named = decisions.select("recording_id", "local_speaker", "voice", F.col("status").alias("match_status"))
    return rows.join(named, ["recording_id", "local_speaker"], "left").withColumn("speaker", F.coalesce("voice", "speaker")).drop("voice")


def secondary_consensus(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label and share of the second label that most of a key's words have, if half of them (200 ms at least) were compared and 65 % agree."""
    timed = words.where("s is not null and e is not null").withColumn("ms", F.greatest(F.lit(0), F.col("e") - F.col("s")))
    per = timed.groupBy(*keys, "secondary").agg(F.sum("ms").alias("ms"), F.min("ord").alias("first"))
    w = Window.partitionBy(*keys)
    whole = per.withColumn("total", F.sum("ms").over(w)).where("secondary is not null").withColumn("compared", F.sum("ms").over(w))
    best = whole.withColumn("n", F.row_number().over(w.orderBy(F.desc("ms"), "first"))).where("n = 1")
    enough = (F.col("compared") >= F.greatest(F.lit(200.0), F.col("total") / 2.0)) & (100 * F.col("ms") >= 65 * F.col("compared"))
    return best.select(*keys, F.when(enough, F.col("secondary")).alias("label"), "ms", "compared")


def segment_majority(words: DataFrame) -> DataFrame:
    """recording_id, seg_ord and the speaker of most of the segment's time, of equal ones the first."""
    timed = words.where("s is not null and e is not null")
    per = timed.groupBy("recording_id", "seg_ord", "speaker").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.col("s"))).alias("ms"), F.min("word_ord").alias("first"))
    best = per.withColumn("n", F.row_number().over(Window.partitionBy("recording_id", "seg_ord").orderBy(F.desc("ms"), "first"))).where("n = 1")
    return best.select("recording_id", "seg_ord", "speaker", "ms")


def set_ranges(ranges: DataFrame, new: DataFrame) -> DataFrame:
    """ranges(recording_id, turn_ord, s, e, choice) with room made for new ones of the same columns, at most one that meets each; those with a null choice only clear."""
    key = ["recording_id", "turn_ord"]
    cut = new.select(*key, F.col("s").alias("n_s"), F.col("e").alias("n_e"))
    met = ranges.join(cut, key, "left").withColumn("hit", F.coalesce((F.col("e") > F.col("n_s")) & (F.col("s") < F.col("n_e")), F.lit(False)))
    columns = [*key, "s", "e", "choice"]
    hit = met.where("hit")
    apart = ranges.join(hit.select(*columns), columns, "left_anti")
    left = hit.where("s < n_s").withColumn("e", F.col("n_s")).select(*columns)
    right = hit.where("e > n_e").withColumn("s", F.col("n_e")).select(*columns)
    return apart.select(*columns).union(left).union(right).union(new.where("choice is not null").select(*columns))


def cache_key(*parts: Column) -> Column:
    """A key of all that a result depends on."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def cached(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """asked(id, key) with hit, whether the cache has the key; what it has not is to be made and appended."""
    return asked.join(cache.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left").select("id", "key", F.coalesce("hit", F.lit(False)).alias("hit"))


def restore(now: DataFrame, saved: DataFrame) -> DataFrame:
    """now(id, content, parts) with the saved choice of the same id if content and segmentation are the same, and blocked if one was saved for others."""
    old = saved.select("id", F.col("content").alias("o_content"), F.col("parts").alias("o_parts"), "choice", F.lit(True).alias("held"))
    same = (F.col("content") == F.col("o_content")) & (F.col("parts") == F.col("o_parts"))
    return now.join(old, "id", "left").select("id", F.when(same, F.col("choice")).alias("choice"), F.coalesce(F.col("held") & ~same, F.lit(False)).alias("blocked"))


def sync_labels(rows: DataFrame, aliases: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with their speaker after aliases(source, target) and the label that labels(voice, label) gives it now."""
    moved = aliases.select(F.col("source").alias("speaker"), "target")
    named = rows.join(moved, "speaker", "left").withColumn("speaker", F.coalesce("target", "speaker")).drop("target")
    return named.join(labels.select(F.col("voice").alias("speaker"), "label"), "speaker", "left").select(*rows.columns, "label")
