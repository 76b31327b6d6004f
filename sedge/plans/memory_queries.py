"""Queries over lessons, preferences, episodes and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import exprs as x
from sedge.operators import harness, memory
from sedge.plans.registry import query, values_sql
from sedge.streaming import usage

_NOW = "epoch_us(TIMESTAMP '2024-02-15 00:00:00')"
NOW_US = 1707955200 * 1_000_000


@query("SELECT artifact AS id, count(*) AS uses, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS losses, max(us) AS last_us FROM v_usage GROUP BY artifact")
def usage_counters(t):
    return memory.counters(t.usage())


@query("SELECT id, round((wins + 1) / (uses + 2e0), 9) AS rate FROM v_artifacts")
def laplace_rate(t):
    return memory.counters(t.usage()).select("id", F.round(x.laplace(F.col("wins"), F.col("uses")), 9).alias("rate"))


@query("SELECT id, roi FROM v_artifacts")
def roi_score(t):
    return memory.counters(t.usage()).select("id", F.round(x.roi(F.col("wins"), F.col("uses")), 9).alias("roi"))


@query(
    """SELECT event_id, artifact, n AS uses, round(greatest(0e0, least(1e0, 7e-1 * (w + 1) / (n + 2) + 3e-1 * least(n / 5e0, 1e0))), 6) AS roi FROM (
    SELECT event_id, artifact, count(*) OVER o AS n, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) OVER o AS DOUBLE) AS w FROM v_usage WINDOW o AS (PARTITION BY artifact ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))"""
)
def roi_trajectory(t):
    return memory.trajectory(t.usage()).select("event_id", "artifact", "uses", F.round("roi", 6).alias("roi"))


@query("SELECT id, roi FROM v_artifacts WHERE scope = 'global' OR scope = 'core' OR starts_with(scope, 'core.')")
def memory_scope_filter(t):
    return memory.active(t.artifacts(), scope="core").select("id", "roi")


@query("SELECT id, kind FROM v_artifacts WHERE kind IN ('anti_pattern', 'guard')")
def memory_type_filter(t):
    return memory.active(t.artifacts(), memory.GUARDS).select("id", "kind")


_LESSONS = "SELECT p_partkey AS id, lower(p_name) AS name, p_name || ' ' || p_type || ' ' || p_brand AS content, CASE p_partkey % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'core' ELSE 'core.math' END AS scope, lower(p_type) AS tag, round(p_size / 50e0, 6) AS roi FROM part"


def _lessons(t):
    scope = F.when(F.col("p_partkey") % 3 == 0, "global").when(F.col("p_partkey") % 3 == 1, "core").otherwise("core.math")
    return t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("content"), scope.alias("scope"), F.array(F.lower("p_type")).alias("tags"), F.round(F.col("p_size") / 50.0, 6).alias("roi"))


@query(
    f"""SELECT id, round(2e0 * w + 3e0 * g + 15e-1 * roi, 6) AS score FROM (SELECT id, roi, len(list_intersect(['red', 'economy', 'widget'], list_distinct(string_split(lower(content || ' ' || name), ' ')))) AS w, CASE WHEN tag = 'small' THEN 1 ELSE 0 END AS g
    FROM ({_LESSONS}) WHERE scope = 'global' OR scope = 'core' OR starts_with(scope, 'core.')) WHERE w > 0 OR g > 0 ORDER BY score DESC, id LIMIT 10"""
)
def memory_search(t):
    return memory.search(_lessons(t), "Red economy widget", ["SMALL"], "core").select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(roi * pow(2e0, -greatest({_NOW} - last_us, 0) / 1e6 / (30e0 * 86400e0)), 6) AS roi FROM v_artifacts")
def temporal_decay(t):
    return memory.decayed(t.artifacts(), half_life_days=30.0, now_us=NOW_US).select("id", F.round("roi", 6).alias("roi"))


@query("SELECT id, round(roi * 95e-2, 6) AS roi FROM v_artifacts")
def generational_decay(t):
    return memory.decayed(t.artifacts()).select("id", F.round("roi", 6).alias("roi"))


@query(
    """SELECT id, CASE WHEN r < 3e-1 OR (n > 50 AND protected > 5 AND rank > 45) THEN 1 ELSE 0 END AS pruned FROM (
    SELECT id, r, n, protected, row_number() OVER (PARTITION BY r >= 3e-1, protected > 5 ORDER BY r DESC, id DESC) AS rank FROM (
    SELECT id, roi * 95e-2 AS r, count(*) FILTER (roi * 95e-2 >= 3e-1) OVER () AS n, row_number() OVER (PARTITION BY roi * 95e-2 >= 3e-1 ORDER BY last_us DESC, id) AS protected FROM v_artifacts))"""
)
def evolve_prune(t):
    return memory.evolve(memory.decayed(t.artifacts())).select("id", F.col("pruned").cast("int").alias("pruned"))


@query(
    f"""SELECT a.id AS key, min(b.id) AS id FROM ({_LESSONS}) a JOIN ({_LESSONS}) b ON a.id % 5 = 0 AND b.id % 5 <> 0 AND (trim(lower(a.name)) = trim(lower(b.name)) OR (a.scope = b.scope AND a.content = b.content)) GROUP BY a.id"""
)
def lesson_dedup(t):
    rows = _lessons(t).withColumn("seq", F.col("id"))
    return memory.matched(rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0").withColumnRenamed("id", "key"))


_OLD = [(1, 1, "Guard nulls", "core", "check for none", ["a"], 1, 1), (2, 2, "Use pools", "global", "pool connections", ["b"], 3, 2), (3, 3, "guard nulls ", "core.x", "later twin", [], 1, 0)]
_NEW = [(1, " GUARD NULLS", "engine.ast", "check first", ["c", "a"]), (2, "Other name", "global", "pool connections", ["b"]), (3, "Fresh", "global", "brand new", [])]


@query("SELECT id, name, scope, content, tags, CAST(uses AS BIGINT) AS uses, CAST(wins AS BIGINT) AS wins FROM " + values_sql([("1", "Guard nulls", "engine.ast", "check first", "a,c", 2, 2), ("2", "Use pools", "global", "pool connections", "b", 4, 3), ("3", "guard nulls ", "core.x", "later twin", "", 1, 0), ("new-3", "Fresh", "global", "brand new", "", 1, 1)], "id, name, scope, content, tags, uses, wins"))
def lesson_merge(t):
    old = t.values(_OLD, "id long, seq long, name string, scope string, content string, tags array<string>, uses long, wins long")
    new = t.values(_NEW, "key long, name string, scope string, content string, tags array<string>")
    return memory.merged(old, new).withColumn("tags", F.array_join("tags", ","))


@query(
    """SELECT n, least(count(*), 50) AS left_over, round(max(CASE WHEN g = 0 THEN r END), 6) AS best FROM (SELECT g AS n, id, roi * pow(95e-2, g) AS r, 0 AS g FROM v_artifacts, range(1, 4) x(g)) WHERE r >= 3e-1 GROUP BY n"""
)
def evolve_summary(t):
    """How many artifacts are left after each of three generations, and the best score."""
    out, rows = None, t.artifacts()
    for n in (1, 2, 3):
        rows = memory.decayed(rows)
        kept = memory.evolve(rows).filter(~F.col("pruned"))
        one = kept.agg(F.count("*").alias("left_over"), F.round(F.max("roi"), 6).alias("best")).filter("left_over > 0").select(F.lit(n).cast("long").alias("n"), "left_over", "best")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT conv_id, round((asks + 2) / (turns + 3e0), 6) AS confidence FROM v_episodes")
def preference_confidence(t):
    return t.episodes().select("conv_id", F.round(harness.confidence(F.col("asks"), F.col("turns") - F.col("asks")), 6).alias("confidence"))


_SCORE = "(SELECT round(100 * (40e-2 * sum(CASE WHEN passed THEN 1 ELSE 0 END) / count(*) + 35e-2 * (1 - CAST(sum(CASE WHEN feedback = 'correction' THEN 1 ELSE 0 END) AS DOUBLE) / count(*)) + 25e-2 * (sum(asks) + 1) / (sum(turns) + 2e0)), 1) AS alignment FROM v_episodes)"


def _alignment(t):
    return harness.alignment(t.episodes(), (F.sum("asks") + 1) / (F.sum("turns") + 2.0))


@query(f"SELECT alignment FROM {_SCORE}")
def alignment_score(t):
    return _alignment(t)


@query(f"SELECT alignment, CASE WHEN alignment >= 80 THEN 'OPTIMAL' ELSE 'ADAPTING' END AS fitness FROM {_SCORE}")
def fitness_eval(t):
    return _alignment(t).withColumn("fitness", harness.fitness(F.col("alignment")))


_GRID = "range(0, 11) s(s), range(0, 4) d(d), range(0, 7) h(h), range(0, 60, 10) e(e)"
_MATURITY = "greatest(5e0, least(1e2, least(35e0, 35 * s / 10e0) + least(25e0, 50 * d / 5e0) + least(20e0, 4e0 * least(h, 5)) + CASE WHEN e > 0 THEN least(20e0, 20 * ln(1e0 + e) / ln(50e0)) ELSE 5e0 END))"


@query(f"SELECT s AS stability, d AS density, h AS hotspots, e AS episodes, round({_MATURITY}, 6) AS score, CASE WHEN {_MATURITY} < 25 THEN 'Phase 1: Inception' WHEN {_MATURITY} < 55 THEN 'Phase 2: Expansion' WHEN {_MATURITY} < 80 THEN 'Phase 3: Hardening' ELSE 'Phase 4: Enterprise' END AS phase FROM {_GRID}")
def maturity_score(t):
    grid = t.spark.range(11).toDF("stability").crossJoin(t.spark.range(4).toDF("density")).crossJoin(t.spark.range(7).toDF("hotspots")).crossJoin(t.spark.range(0, 60, 10).toDF("episodes"))
    score = harness.maturity(F.col("stability") / 10.0, F.col("density") / 5.0, F.col("hotspots"), F.col("episodes"))
    return grid.withColumns({"score": F.round(score, 6), "phase": harness.phase(score)})


@query("SELECT round(CAST(count(*) FILTER (1000000 - doc_id * 100 > 86400) AS DOUBLE) / count(*), 6) AS stability, round(CAST(count(*) FILTER (contains(lower(path), 'doc_1')) AS DOUBLE) / count(*) FILTER (NOT contains(lower(path), 'doc_1')), 6) AS density FROM v_files")
def stability_density(t):
    named = t.files().select(F.replace("path", F.lit("doc_1"), F.lit("test_1")).alias("path"), (F.col("doc_id") * 100).cast("double").alias("mtime"))
    return harness.measured(named, F.lit(1_000_000.0)).select(F.round("stability", 6).alias("stability"), F.round("density", 6).alias("density"))


def _timed(t):
    return t.episodes().withColumn("ts_us", F.pmod(F.col("conv_id") * 7919, F.lit(1009)))


@query("SELECT conv_id FROM v_episodes ORDER BY (conv_id * 7919) % 1009 DESC, conv_id DESC LIMIT 5")
def recent_episodes(t):
    return harness.retained(_timed(t), 5).select("conv_id")


@query("SELECT conv_id, feedback FROM v_episodes ORDER BY (conv_id * 7919) % 1009 DESC, conv_id DESC LIMIT 100")
def episode_retention(t):
    return harness.retained(_timed(t)).select("conv_id", "feedback")


_RULES = [(1, "global", 0.9), (2, "src/auth", 0.95), (3, "docs", 0.99), (4, "global", 0.8), (5, "auth", 0.7)]


@query("SELECT CAST(id AS BIGINT) AS id FROM " + values_sql([(2,), (1,), (4,)], "id"))
def harness_relevant(t):
    return harness.relevant(t.values(_RULES, "id long, scope string, confidence double"), ["src/auth/login.py"], "confidence", 3).select("id")


_SAID = [
    (1, "Do not use eval, instead use literal_eval.", "eval", "literal_eval", "guard", "style", "prefer_eval"),
    (2, "đừng dùng os.unlink, hãy dùng send2trash", "os.unlink", "send2trash", "guard", "safety", "prefer_osunlink"),
    (3, "Always use type hints.", "", "type hints", "preference", "style", "type_hints"),
    (4, "Looks fine to me", "", "Looks fine to me", "preference", "interaction", "looks_fine_to_me"),
    (5, "never using user files; prefer moving them", "user files", "moving them", "guard", "style", "prefer_user_files"),
    (6, "   ", "", "", "none", "", ""),
]


@query("SELECT CAST(n AS BIGINT) AS n, forbidden, preferred, outcome, category, key FROM " + values_sql([(r[0], *r[2:]) for r in _SAID], "n, forbidden, preferred, outcome, category, key"))
def feedback_distill(t):
    got = harness.distilled(t.values([(*r[:2], "global") for r in _SAID], "n long, text string, scope string"))
    blank = F.lit("")
    return got.select(
        "n",
        F.coalesce("guard.forbidden", blank).alias("forbidden"),
        F.coalesce("guard.preferred", "preference.value", blank).alias("preferred"),
        F.when(F.col("guard").isNotNull(), "guard").when(F.col("preference").isNotNull(), "preference").otherwise("none").alias("outcome"),
        F.coalesce("preference.category", blank).alias("category"),
        F.coalesce("preference.key", blank).alias("key"),
    )


_NAMES = ["use eval in hot paths", "a b c", "", "os.remove(path) always", "--- !!! ???", "---"]


@query("SELECT forbidden, name FROM " + values_sql(list(zip(_NAMES, ["use_eval_hot", "guard_rule", "guard_rule", "osremovepath_always", "__", "learned_guard"])), "forbidden, name"))
def rule_name(t):
    return t.values([(n,) for n in _NAMES], "forbidden string").select("forbidden", x.rule_name(F.col("forbidden")).alias("name"))


@query("SELECT p_partkey AS id, left(sha256('style:' || p_name || ':' || lower(p_type)), 10) AS pref FROM part")
def preference_id(t):
    return t.part.select(F.col("p_partkey").alias("id"), x.short_id(F.lit("style"), F.col("p_name"), F.lower("p_type")).alias("pref"))


_PREFS = [("p1", "global", 1, 0, 0.9), ("p2", "core", 2, 1, 0.7), ("p3", "ui", 1, 0, 0.85)]
_HEARD = [(1, "praise", "core", None, None), (2, "correction", "core", "p2", 0.9), (3, "approval", "core", None, None), (4, "preference", "global", "p4", 0.85), (5, "neutral", "ui", None, None), (6, "praise", "global", None, None)]


@query("SELECT id, scope, CAST(adhered AS BIGINT) AS adhered, CAST(violated AS BIGINT) AS violated, CAST(confidence AS DOUBLE) AS confidence FROM " + values_sql([("p1", "global", 4, 0, 0.857143), ("p2", "core", 2, 0, 0.8), ("p3", "ui", 1, 0, 0.85), ("p4", "global", 2, 0, 0.8)], "id, scope, adhered, violated, confidence"))
def feedback_apply(t):
    got = harness.applied(t.values(_PREFS, "id string, scope string, adhered long, violated long, confidence double"), t.values(_HEARD, "n long, kind string, scope string, pref_id string, pref_confidence double"))
    return got.withColumn("confidence", F.round("confidence", 6))


_SUMMARY = "<!-- start -->\n### Learned\n\n- keep this\n  # not this\nplain line\n<!-- a\nb -->"


@query("SELECT '- keep this' || chr(10) || 'plain line' AS text")
def clean_summary(t):
    return t.values([(_SUMMARY,)], "text string").select(x.clean_summary(F.col("text")).alias("text"))


def _timely(t):
    return t.usage().withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT CAST(us // 86400000000 * 86400 AS BIGINT) AS start, artifact, count(*) AS uses, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM v_usage GROUP BY ALL")
def usage_tumbling(t):
    return usage.windowed(_timely(t)).withColumn("start", F.unix_timestamp("start"))


@query("SELECT CAST((us // 21600000000 - k) * 21600 AS BIGINT) AS start, artifact, count(*) AS uses, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM v_usage, range(0, 4) k(k) GROUP BY ALL")
def usage_sliding(t):
    return usage.windowed(_timely(t), "1 day", "6 hours").withColumn("start", F.unix_timestamp("start"))


@query(
    """SELECT min(us) AS start_us, artifact, count(*) AS uses FROM (SELECT artifact, us, sum(CASE WHEN prev IS NULL OR us - prev >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY artifact ORDER BY us ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT artifact, us, lag(us) OVER (PARTITION BY artifact ORDER BY us) AS prev FROM v_usage)) GROUP BY artifact, s"""
)
def usage_session(t):
    return usage.sessions(_timely(t)).select(F.unix_micros("start").alias("start_us"), "artifact", "uses")


@query("SELECT artifact, event_id AS last_event FROM (SELECT artifact, event_id, row_number() OVER (PARTITION BY artifact ORDER BY us DESC, event_id DESC) AS n FROM v_usage) WHERE n = 1")
def usage_latest(t):
    return usage.newest(t.usage(), order=("us", "event_id")).select("artifact", F.col("event_id").alias("last_event"))
