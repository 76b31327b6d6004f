"""Lessons that are scored by use, decay over time and are pruned: counters and ranks over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import exprs as x

#: Defaults of evolve().
THRESHOLD, CAPACITY, DECAY, PROTECTED = 0.3, 50, 0.95, 5


def counters(usage: DataFrame) -> DataFrame:
    """id, uses, wins, losses, last_us of each artifact; usage has artifact, success, us."""
    won = F.col("success").cast("long")
    return usage.groupBy(F.col("artifact").alias("id")).agg(F.count("*").alias("uses"), F.sum(won).alias("wins"), F.sum(1 - won).alias("losses"), F.max("us").alias("last_us"))


def trajectory(usage: DataFrame) -> DataFrame:
    """event_id, artifact, uses, roi after each use, in order of time and event_id.

    Events are numbered within buckets of time of each artifact and the buckets' counts are added
    up, so that an artifact with a third of all events is not in one task.
    """
    bucketed = usage.withColumn("_b", F.floor(F.col("us") / BUCKET_US))
    sums = bucketed.groupBy("artifact", "_b").agg(F.count("*").alias("n"), F.sum(F.col("success").cast("long")).alias("w"))
    before = Window.partitionBy("artifact").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("artifact", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("artifact", "_b").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = bucketed.select("artifact", "_b", "event_id", F.count("*").over(inside).alias("n"), F.sum(F.col("success").cast("long")).over(inside).alias("w"))
    both = run.join(starts, ["artifact", "_b"])
    uses, wins = F.col("n") + F.col("n0"), F.col("w") + F.col("w0")
    return both.select("event_id", "artifact", uses.alias("uses"), x.roi(wins, uses).alias("roi"))


BUCKET_US = 6 * 3600 * 1_000_000


def in_scope(scope: Column, wanted: str | None) -> Column:
    """Global rows, those of the scope itself and of what lies below it; all without a scope."""
    if not wanted or wanted == "all":
        return F.lit(True)
    return (scope == "global") | (scope == wanted) | scope.startswith(wanted + ".")


def active(artifacts: DataFrame, kinds: list[str] | None = None, scope: str | None = None) -> DataFrame:
    """Artifacts of these kinds in the scope that are not pruned."""
    kept = artifacts.filter(in_scope(F.col("scope"), scope))
    if "pruned" in artifacts.columns:
        kept = kept.filter(~F.coalesce("pruned", F.lit(False)))
    return kept.filter(F.col("kind").isin(*kinds)) if kinds else kept


# The kinds that count as preferences and as guards.
PREFERENCES = ["preference", "invariant"]
GUARDS = ["anti_pattern", "guard"]


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))


def search(artifacts: DataFrame, query: str = "", tags: list[str] | None = None, scope: str | None = None, top: int = 10) -> DataFrame:
    """The best artifacts (with `score`) for words of a query and tags; by ROI without either.

    A word that name or content holds counts 2, a tag 3, ROI up to 1.5; without a common word or
    tag an artifact is no hit. Ties go to the smaller id.
    """
    rows = active(artifacts, scope=scope)
    if not query.split() and not tags:
        return rows.withColumn("score", F.col("roi")).orderBy(F.desc("roi"), "id").limit(top)
    asked = F.array(*map(F.lit, dict.fromkeys(query.lower().split()))).cast("array<string>")
    named = F.array(*map(F.lit, dict.fromkeys(t.lower() for t in tags or []))).cast("array<string>")
    both = F.size(F.array_intersect(asked, F.array_union(words(F.col("content")), words(F.col("name")))))
    tagged = F.size(F.array_intersect(named, F.transform("tags", F.lower)))
    scored = rows.withColumns({"_w": both, "_t": F.coalesce(tagged, F.lit(0))}).filter((F.col("_w") > 0) | (F.col("_t") > 0))
    return scored.withColumn("score", 2.0 * F.col("_w") + 3.0 * F.col("_t") + 1.5 * F.col("roi")).drop("_w", "_t").orderBy(F.desc("score"), "id").limit(top)


def decayed(artifacts: DataFrame, rate: float = DECAY, half_life_days: float | None = None, now_us: int | Column = 0) -> DataFrame:
    """ROI times the rate, a generation on; with a half life by the time since the last use instead."""
    if half_life_days:
        now = now_us if isinstance(now_us, Column) else F.lit(now_us)
        return artifacts.withColumn("roi", x.half_life(F.col("roi"), (now - F.col("last_us")) / 1e6, half_life_days))
    out = artifacts.withColumn("roi", F.col("roi") * rate)
    return out.withColumn("generation", F.col("generation") + 1) if "generation" in artifacts.columns else out


def evolve(artifacts: DataFrame, threshold: float = THRESHOLD, capacity: int = CAPACITY, protect: int = PROTECTED) -> DataFrame:
    """id, roi, pruned, reason of artifacts (id, roi, last_us) whose ROI has decayed already.

    Those under the threshold go; of more than capacity the latest used are protected and the rest
    keeps the highest ROI. What survives is at most capacity rows, found by two top-k sorts, so
    nothing is ranked as a whole. Ties: of equal times the smaller id is protected, of equal ROI
    the smaller id goes first.
    """
    alive = artifacts.filter(F.col("roi") >= threshold)
    over = alive.limit(capacity + 1).count() > capacity
    low = F.format_string("ROI %.3f below threshold %s", F.col("roi"), F.lit(str(threshold)))
    if not over:
        fails = F.col("roi") < threshold
        return artifacts.select("id", "roi", fails.alias("pruned"), F.when(fails, low).alias("reason"))
    recent = alive.select("id", "roi", "last_us").orderBy(F.desc("last_us"), "id").limit(protect)
    if protect > capacity:
        recent = recent.orderBy(F.desc("roi"), F.desc("id")).limit(capacity)
    kept = recent.select("id")
    if protect < capacity:
        rest = alive.join(x.bounded(kept, protect), "id", "left_anti").select("id", "roi").orderBy(F.desc("roi"), F.desc("id")).limit(capacity - protect)
        kept = kept.unionByName(rest.select("id"))
    marked = artifacts.join(x.bounded(kept.withColumn("_kept", F.lit(True)), capacity), "id", "left")
    fails = F.col("_kept").isNull()
    return marked.select("id", "roi", fails.alias("pruned"), F.when(F.col("roi") < threshold, low).when(fails, F.format_string("Capacity constraint (limit %d)", F.lit(capacity))).alias("reason"))


def matched(lessons: DataFrame, incoming: DataFrame) -> DataFrame:
    """key, id: for each incoming lesson (key, name, scope, content) the first stored one (id, seq
    and the same) with its name, or with its scope and content (case and blanks aside).

    Two joins on equality, not one on an OR. Of the stored lessons that share a name, or a scope and
    content, only the first meets the incoming ones, so no join makes more rows than come in.
    """
    plain = lambda c: F.lower(F.trim(c))
    first = [F.min_by("id", "seq").alias("id"), F.min("seq").alias("seq")]
    stored = lessons.select("id", "seq", plain(F.col("name")).alias("_n"), "scope", plain(F.col("content")).alias("_c"))
    new = incoming.select("key", plain(F.col("name")).alias("_n"), "scope", plain(F.col("content")).alias("_c"))
    named, said = (new.join(stored.groupBy(*by).agg(*first), by) for by in (["_n"], ["scope", "_c"]))
    hits = named.select("key", "id", "seq").unionByName(said.select("key", "id", "seq"))
    return hits.groupBy("key").agg(F.min_by("id", "seq").alias("id"))


def merged(lessons: DataFrame, incoming: DataFrame) -> DataFrame:
    """lessons (id, seq, name, scope, content, tags, uses, wins) after one incoming batch.

    A match is revived: it takes the content, the scope unless that is global, the tags it lacks,
    and counts a success; of several for one stored lesson the last by key. Others are added with
    one success and ids from their keys.
    """
    pairs = matched(lessons, incoming)
    ranked = incoming.join(pairs, "key", "left").withColumn("_n", F.row_number().over(Window.partitionBy(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("new-"), F.col("key").cast("string")))).orderBy(F.desc("key"))))
    last = ranked.filter("_n = 1")
    change = last.filter(F.col("id").isNotNull()).select("id", F.col("scope").alias("_scope"), F.col("content").alias("_content"), F.col("tags").alias("_tags"))
    old = lessons.join(change, "id", "left")
    hit = F.col("_content").isNotNull()
    kept = old.select(
        F.col("id").cast("string").alias("id"),
        "name",
        F.when(hit & (F.col("_scope") != "global"), F.col("_scope")).otherwise(F.col("scope")).alias("scope"),
        F.coalesce("_content", "content").alias("content"),
        F.when(hit, F.array_union("tags", "_tags")).otherwise(F.col("tags")).alias("tags"),
        (F.col("uses") + hit.cast("long")).alias("uses"),
        (F.col("wins") + hit.cast("long")).alias("wins"),
    )
    added = last.filter(F.col("id").isNull()).select(F.concat(F.lit("new-"), F.col("key").cast("string")).alias("id"), "name", "scope", "content", "tags", F.lit(1).cast("long").alias("uses"), F.lit(1).cast("long").alias("wins"))
    return kept.unionByName(added)


def summary_line(telemetry: bool = False) -> Column:
    """A line of the summary, from kind, name, scope, tags, content (and roi, wins, uses)."""
    scope = F.when((F.col("scope") != "global") & (F.col("scope") != ""), F.concat(F.lit(" `["), "scope", F.lit("]`"))).otherwise("")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" `["), F.array_join("tags", ", "), F.lit("]`"))).otherwise("")
    more = F.format_string(" (ROI: %.2f, SR: %.0f%%)", F.col("roi"), 100 * x.laplace(F.col("wins"), F.col("uses"))) if telemetry else F.lit("")
    return F.concat(F.lit("- ["), F.upper("kind"), F.lit("] **"), "name", F.lit("**"), scope, tags, more, F.lit(": "), "content")
