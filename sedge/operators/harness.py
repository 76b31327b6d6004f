"""Feedback, preferences and episodes: what is learnt from corrections, and the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import exprs as x

# Patterns of feedback in Vietnamese and English, and words that make a rule one of
# safety (anywhere in the forbidden action).
NEGATIVE = [
    r"(?iu)(?:đừng|không|tuyệt đối không|hạn chế)\s+(?:dùng|làm|thực hiện|gọi|viết)?\s*([^,;\n]+?)(?:[,;]|\s+mà|\s+thay vào đó|\s+hãy|\s+nên|\s+cần|\s+dùng)\s+(?:hãy|nên|cần|dùng|thay bằng|ưu tiên)\s*(.+?)(?:\.\s*$|\n|$)",
    r"(?iu)(?:do not|don't|never|avoid|stop)\s+(?:use|using|calling|doing|writing)?\s*([^,;\n]+?)(?:[,;]|\s+instead|\s+rather than|\s+use|\s+prefer)\s+(?:use|prefer|instead use|always use|rely on)\s*(.+?)(?:\.\s*$|\n|$)",
]
POSITIVE = r"(?iu)(?:luôn luôn|luôn|cần phải|bắt buộc|always|ensure|prefer)\s+(?:dùng|sử dụng|tuân thủ|áp dụng|use|follow)?\s*(.+?)(?:\.\s*$|\n|$)"
SAFETY = ["xóa", "delete", "rm", "unlink", "drop"]
LEADING_USE = r"(?iu)^(?:dùng|sử dụng|use)\s+"


def _bare(c: Column) -> Column:
    """Without blanks, then without quotes at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")


def _key(text: Column, none: str, empty: str) -> Column:
    found = F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 2), 1, 3)
    clean = F.lower(F.regexp_replace(F.when(F.size(found) == 0, none).otherwise(F.array_join(found, "_")), "[^a-zA-Z0-9_]", ""))
    return F.when(clean == "", empty).otherwise(clean)


def distilled(feedback: DataFrame) -> DataFrame:
    """feedback (text, scope and more) with guard and preference structs; either may be null.

    "Do not X, instead Y" gives both, a positive rule or any other text a preference; a blank text
    nothing. The first pattern that matches counts.
    """
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    hit = F.when(text.rlike(NEGATIVE[0]), 0).when(text.rlike(NEGATIVE[1]), 1).when(text.rlike(POSITIVE), 2).otherwise(3)
    part = lambda i: F.when(F.col("_hit") == 0, F.regexp_extract(text, NEGATIVE[0], i)).otherwise(F.regexp_extract(text, NEGATIVE[1], i))
    rows = feedback.withColumn("_hit", F.when(F.coalesce(F.length(text), F.lit(0)) > 0, hit))
    rows = rows.withColumns({"_x": _bare(part(1)), "_y": F.trim(F.regexp_replace(_bare(part(2)), LEADING_USE, "")), "_z": _bare(F.regexp_extract(text, POSITIVE, 1))})
    name = _key(F.col("_x"), "guard_rule", "learned_guard")
    guard = F.struct(
        x.short_id(name, F.col("scope"), F.col("_x")).alias("id"), name.alias("name"), F.col("_x").alias("forbidden"), F.col("_y").alias("preferred"), "scope", F.lit(0.9).alias("severity")
    )
    category = F.when(F.col("_hit") < 2, F.when(x.contains_any(F.lower("_x"), SAFETY), "safety").otherwise("style")).when(F.col("_hit") == 2, "style").otherwise("interaction")
    loose = F.regexp_replace(F.lower(F.regexp_replace(F.substring(text, 1, 20), "[^a-zA-Z0-9_]", "_")), "^_+|_+$", "")
    key = F.when(F.col("_hit") < 2, F.concat(F.lit("prefer_"), name)).when(F.col("_hit") == 2, _key(F.col("_z"), "convention", "user_preference")).otherwise(F.when(loose == "", "general_pref").otherwise(loose))
    value = F.when(F.col("_hit") < 2, F.col("_y")).when(F.col("_hit") == 2, F.col("_z")).otherwise(text)
    said = F.when(F.col("_hit") < 2, F.concat(F.lit("Prefer "), "_y", F.lit(" over "), "_x")).when(F.col("_hit") == 2, F.concat(F.lit("Enforce: "), "_z")).otherwise(F.substring(text, 1, 100))
    sure = F.when(F.col("_hit") < 2, 0.9).when(F.col("_hit") == 2, 0.85).otherwise(0.75)
    pref = F.struct(x.short_id(category, key, F.col("scope")).alias("id"), category.alias("category"), key.alias("key"), value.alias("value"), said.alias("description"), "scope", sure.alias("confidence"))
    return rows.withColumns({"guard": F.when(F.col("_hit") < 2, guard), "preference": F.when(F.col("_hit").isNotNull(), pref)}).drop("_hit", "_x", "_y", "_z")


def confidence(adhered: Column, violated: Column) -> Column:
    return (adhered + 2) / (adhered + violated + 3)


def applied(preferences: DataFrame, feedback: DataFrame) -> DataFrame:
    """id, scope, adhered, violated, confidence of preferences after a batch of feedback in order.

    preferences has id, scope, adhered, violated, confidence; feedback n (the order), kind, scope,
    pref_id, pref_confidence (what a correction or preference teaches, else null). What is taught
    replaces a preference of its id and starts anew; praise and approval after that count as
    adherence for global preferences and those of its scope.
    """
    taught = feedback.filter(F.col("pref_id").isNotNull()).groupBy(F.col("pref_id").alias("id")).agg(F.max("n").alias("_n"), F.max_by("scope", "n").alias("_scope"), F.max_by("pref_confidence", "n").alias("_c"))
    base = preferences.join(taught, "id", "full_outer").select(
        "id",
        F.coalesce("_scope", "scope").alias("scope"),
        F.when(F.col("_n").isNotNull(), 1).otherwise(F.col("adhered")).cast("long").alias("adhered"),
        F.when(F.col("_n").isNotNull(), 0).otherwise(F.col("violated")).cast("long").alias("violated"),
        F.coalesce("_c", "confidence").alias("confidence"),
        F.coalesce("_n", F.lit(-1)).alias("_n"),
    )
    praise = feedback.filter(F.col("kind").isin("praise", "approval")).select("n", "scope").distinct()
    # global preferences hear all praise; praise of the scope "global" is heard by them alone
    heard = praise.filter("scope <> 'global'").unionByName(praise.select("n").distinct().select("n", F.lit("global").alias("scope")))
    both = base.join(later(heard, base.select("id", "scope", F.col("_n").alias("n"))), "id")
    now = F.col("adhered") + F.col("times")
    return both.select("id", "scope", now.alias("adhered"), "violated", F.when(F.col("times") > 0, confidence(now, F.col("violated"))).otherwise(F.col("confidence")).alias("confidence"))


#: Numbers of events that are counted together.
SPAN = 1 << 16


def later(events: DataFrame, asked: DataFrame) -> DataFrame:
    """id, times: for each of asked (id, scope, n) how many events (scope, n) of its scope come after n.

    Events are counted in spans of their numbers, the spans' counts are added up and only inside a
    span rows are sorted, so neither a pair for each event nor a list of events is made.
    """
    rows = events.select("scope", "n", F.lit(None).cast(asked.schema["id"].dataType).alias("id"), F.lit(1).alias("one")).unionByName(asked.select("scope", "n", "id", F.lit(0).alias("one"))).withColumn("_b", F.floor(F.col("n") / SPAN))
    sums = rows.groupBy("scope", "_b").agg(F.sum("one").alias("s"))
    after = sums.select("scope", "_b", F.coalesce(F.sum("s").over(Window.partitionBy("scope").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("after"))
    inside = F.sum("one").over(Window.partitionBy("scope", "_b").orderBy(F.desc("n"), "one").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", inside).filter("one = 0").join(after, ["scope", "_b"]).select("id", (F.col("within") + F.col("after")).alias("times"))


def alignment(episodes: DataFrame, adherence: Column | float = 1.0) -> DataFrame:
    """alignment: one row; 88 without episodes. episodes has passed, feedback."""
    n = F.count("*")
    good, wrong = F.sum(F.col("passed").cast("long")), F.sum((F.col("feedback") == "correction").cast("long"))
    kept = adherence if isinstance(adherence, Column) else F.lit(adherence)
    raw = 100.0 * (0.40 * (good / n) + 0.35 * (1 - wrong / n) + 0.25 * kept)
    score = F.when(n == 0, 88.0).otherwise(F.greatest(F.lit(10.0), F.least(F.lit(100.0), F.round(raw, 1))))
    return episodes.agg(score.alias("alignment"))


def maturity(stability: Column, density: Column, hotspots: Column, episodes: Column) -> Column:
    """A score from 5 to 100."""
    stable = F.least(F.lit(35.0), 35.0 * stability)
    tested = F.least(F.lit(25.0), 50.0 * density)
    hot = F.least(F.lit(20.0), 4.0 * F.least(hotspots, F.lit(5)))
    known = F.when(episodes > 0, F.least(F.lit(20.0), 20.0 * F.ln(1 + episodes) / F.ln(F.lit(50.0)))).otherwise(5.0)
    return F.greatest(F.lit(5.0), F.least(F.lit(100.0), stable + tested + hot + known))


# Names of the phases.
PHASES = ["Phase 1: Inception", "Phase 2: Expansion", "Phase 3: Hardening", "Phase 4: Enterprise"]


def phase(score: Column) -> Column:
    return F.when(score < 25, PHASES[0]).when(score < 55, PHASES[1]).when(score < 80, PHASES[2]).otherwise(PHASES[3])


# Extensions that maturity looks at, and folders that it skips.
MATURITY_SUFFIXES = ["py", "ts", "js", "go", "rs", "java", "cpp", "c", "h"]
MATURITY_SKIPPED = ["node_modules", "dist", "build", "__pycache__", "vendor"]


def measured(files: DataFrame, now: Column) -> DataFrame:
    """stability, density of files (path, mtime in seconds): one row."""
    folders = F.split("path", "/")
    folders = F.slice(folders, F.lit(1), F.size(folders) - 1)
    seen = files.filter(F.substring_index("path", ".", -1).isin(*MATURITY_SUFFIXES) & F.col("path").contains(".") & ~F.exists(folders, lambda d: d.isin(*MATURITY_SKIPPED) | d.startswith(".")))
    test = F.lower(x.file_name(F.col("path"))).contains("test") | F.array_contains(folders, "tests")
    tests, n = F.sum(test.cast("long")), F.count("*")
    old = F.sum((now - F.col("mtime") > 86400).cast("long"))
    return seen.agg((F.coalesce(old, F.lit(0)) / F.greatest(n, F.lit(1))).alias("stability"), (F.coalesce(tests, F.lit(0)) / F.greatest(n - F.coalesce(tests, F.lit(0)), F.lit(1))).alias("density"))


def relevant(rules: DataFrame, files: list[str], weight: str, top: int) -> DataFrame:
    """The heaviest rules that are global or whose scope is a part of a target file's path."""
    paths = F.array(*map(F.lit, files)).cast("array<string>")
    hit = (F.col("scope") == "global") | F.exists(paths, lambda p: F.contains(p, F.col("scope")))
    return rules.filter(hit).orderBy(F.desc(weight), "id").limit(top)


def retained(episodes: DataFrame, keep: int = 100) -> DataFrame:
    """The latest episodes (ts_us, conv_id): a top-k, not a rank over all."""
    return episodes.orderBy(F.desc("ts_us"), F.desc("conv_id")).limit(keep)


def fitness(score: Column) -> Column:
    return F.when(score >= 80, "OPTIMAL").otherwise("ADAPTING")

