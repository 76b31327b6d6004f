"""Views that give the test tables the shape of files, symbols, edges, usage and episodes.

Each view exists twice: as a DataFrame here and as SQL text for DuckDB in SQL[...].
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = {"en": ("py", "Python"), "fr": ("ts", "TypeScript"), "de": ("go", "Go"), "es": ("java", "Java")}


class Tables:
    """The tables of a folder and the views on them; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def files(self) -> DataFrame:
        ext = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "fr", "ts").when(F.col("lang") == "de", "go").otherwise("java")
        language = F.when(F.col("lang") == "en", "Python").when(F.col("lang") == "fr", "TypeScript").when(F.col("lang") == "de", "Go").otherwise("Java")
        return self.documents.select(
            "doc_id",
            "source",
            F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)).alias("path"),
            language.alias("language"),
            "text",
            F.size(F.split("text", "\n")).cast("long").alias("total_lines"),
            F.length("text").cast("long").alias("size"),
        )

    def symbols(self) -> DataFrame:
        simple, container = F.replace("p_name", F.lit(" "), F.lit("_")), F.replace("p_brand", F.lit("#"), F.lit("_"))
        return self.part.select(
            F.col("p_partkey").alias("id"),
            F.concat_ws(".", container, simple).alias("name"),
            simple.alias("simple_name"),
            container.alias("container"),
            F.lower("p_type").alias("entity_type"),
            F.concat(F.lit("pkg_"), F.col("p_size").cast("string"), F.lit("/mod_"), (F.col("p_partkey") % 40).cast("string"), F.lit(".py")).alias("relative_path"),
            (F.col("p_partkey") % 500 + 1).cast("long").alias("line_number"),
            F.concat(F.lit("def "), simple, F.lit("(self)")).alias("signature"),
            F.concat_ws(" ", F.lit("Handles"), F.lower("p_type"), F.col("p_name")).alias("docstring"),
        )

    def resolved(self) -> DataFrame:
        """Resolved imports (dep, caller), with repeats and imports of a file by itself."""
        n = self.customer.agg(F.count("*").alias("n"))
        return self.orders.crossJoin(F.broadcast(n)).select((F.col("o_orderkey") % F.col("n")).alias("dep"), F.col("o_custkey").alias("caller"))

    def edges(self) -> DataFrame:
        from sedge.operators import graph

        return graph.ingress(self.resolved())

    def tests(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("v"), (F.col("c_mktsegment") == "MACHINERY").alias("is_test"))

    def imports(self) -> DataFrame:
        found = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))))
        return self.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("caller"), found.alias("imp"))

    def module_imports(self) -> DataFrame:
        """path, imports_internal and imports_external: the links of a page, and their first parts."""
        from sedge.operators import parse

        links = F.array_sort(parse.hrefs(F.col("html")))
        outer = F.array_sort(F.array_distinct(F.transform(links, lambda i: F.substring_index(F.ltrim(i, F.lit("/")), "/", 1))))
        return self.pages.select("page_id", F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("path"), links.alias("imports_internal"), outer.alias("imports_external"))

    def usage(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("artifact"), (F.col("event_type") != "error").alias("success"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "ts")

    def artifacts(self) -> DataFrame:
        """Artifacts with their counters, score, last use and order of age."""
        from sedge.functions import exprs as x

        n, s = F.count("*"), F.sum(F.col("success").cast("long"))
        kinds = F.when(F.col("id") % 4 == 0, "lesson").when(F.col("id") % 4 == 1, "preference").when(F.col("id") % 4 == 2, "anti_pattern").otherwise("guard")
        scopes = F.when(F.col("id") % 5 == 0, "global").when(F.col("id") % 5 == 1, "core").when(F.col("id") % 5 == 2, "core.math").otherwise("frontend.ui")
        used = self.usage().groupBy(F.col("artifact").alias("id")).agg(n.alias("uses"), s.alias("wins"), F.max("us").alias("last_us"))
        return used.select("id", "uses", "wins", "last_us", F.round(x.roi(F.col("wins"), F.col("uses")), 9).alias("roi"), kinds.alias("kind"), scopes.alias("scope"))

    def packages(self) -> DataFrame:
        return self.nation.join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("package"), "n_nationkey", "r_name", "n_name")

    def package_files(self) -> DataFrame:
        return self.customer.join(F.broadcast(self.packages()), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.col("package"), F.lit("/"), F.col("c_name")).alias("path"), "c_custkey", F.col("package").alias("owner"))

    def episodes(self) -> DataFrame:
        turns = self.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum((F.col("role") == "user").cast("long")).alias("asks"))
        kind = F.when(F.col("conv_id") % 7 == 0, "correction").when(F.col("conv_id") % 7 == 1, "praise").when(F.col("conv_id") % 7 == 2, "preference").otherwise("neutral")
        return turns.select("conv_id", "turns", "asks", (F.col("conv_id") % 5 != 0).alias("passed"), kind.alias("feedback"))


SQL = {
    "v_files": """SELECT doc_id, source, source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'ts' WHEN 'de' THEN 'go' ELSE 'java' END AS path,
        CASE lang WHEN 'en' THEN 'Python' WHEN 'fr' THEN 'TypeScript' WHEN 'de' THEN 'Go' ELSE 'Java' END AS language, text, CAST(len(string_split(text, chr(10))) AS BIGINT) AS total_lines, CAST(length(text) AS BIGINT) AS size FROM documents""",
    "v_symbols": """SELECT p_partkey AS id, replace(p_brand, '#', '_') || '.' || replace(p_name, ' ', '_') AS name, replace(p_name, ' ', '_') AS simple_name, replace(p_brand, '#', '_') AS container, lower(p_type) AS entity_type,
        'pkg_' || CAST(p_size AS VARCHAR) || '/mod_' || CAST(p_partkey % 40 AS VARCHAR) || '.py' AS relative_path, CAST(p_partkey % 500 + 1 AS BIGINT) AS line_number, 'def ' || replace(p_name, ' ', '_') || '(self)' AS signature,
        'Handles ' || lower(p_type) || ' ' || p_name AS docstring FROM part""",
    "v_edges": """SELECT DISTINCT o_orderkey % (SELECT count(*) FROM customer) AS dep, o_custkey AS consumer FROM orders WHERE o_orderkey % (SELECT count(*) FROM customer) <> o_custkey""",
    "v_tests": "SELECT c_custkey AS v, c_mktsegment = 'MACHINERY' AS is_test FROM customer",
    "v_imports": """SELECT page_id, regexp_replace(url, '^https?://', '') AS caller, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS imp FROM pages""",
    "v_usage": "SELECT user_id AS artifact, event_type <> 'error' AS success, epoch_us(ts) AS us, event_id, ts FROM events",
    "v_packages": "SELECT r_name || '/' || n_name AS package, n_nationkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "v_package_files": "SELECT package || '/' || c_name AS path, c_custkey, package AS owner FROM customer JOIN v_packages ON c_nationkey = n_nationkey",
    "v_episodes": """SELECT conv_id, count(*) AS turns, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS asks, conv_id % 5 <> 0 AS passed,
        CASE conv_id % 7 WHEN 0 THEN 'correction' WHEN 1 THEN 'praise' WHEN 2 THEN 'preference' ELSE 'neutral' END AS feedback FROM conversations GROUP BY conv_id""",
    "v_artifacts": """SELECT artifact AS id, count(*) AS uses, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS wins, max(us) AS last_us,
        round(greatest(0e0, least(1e0, 7e-1 * (CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS DOUBLE) + 1) / (count(*) + 2) + 3e-1 * least(count(*) / 5e0, 1e0))), 9) AS roi,
        CASE artifact % 4 WHEN 0 THEN 'lesson' WHEN 1 THEN 'preference' WHEN 2 THEN 'anti_pattern' ELSE 'guard' END AS kind,
        CASE artifact % 5 WHEN 0 THEN 'global' WHEN 1 THEN 'core' WHEN 2 THEN 'core.math' ELSE 'frontend.ui' END AS scope FROM v_usage GROUP BY artifact""",
}


def with_views(sql: str) -> str:
    """sql after a WITH clause for the views that it names (views may use views before them)."""
    needed, text = [], sql
    for name in reversed(SQL):
        if name in text:
            needed.append(name)
            text += SQL[name]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in needed)
    if not head:
        return sql
    s = sql.lstrip()
    if s.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {s[len('WITH RECURSIVE'):]}"
    return f"WITH {head}, {s[4:]}" if s.upper().startswith("WITH ") else f"WITH {head} {s}"
