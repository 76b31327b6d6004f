"""Symbol lookup and BM25 ranking.

An index is two tables, postings (id, col, weight, pos, term) and lengths (id, d). Stored sorted by
term, a search reads only the row groups whose terms can start with what it looks for.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import exprs as x

WEIGHTS = {"name": 10, "simple_name": 10, "container": 5, "entity_type": 2, "relative_path": 2, "signature": 1, "docstring": 1}
K1, B = 1.2, 0.75


def _accents() -> dict[str, str]:
    """Lower-case letters that are a Latin base letter and marks, with their base."""
    out = {}
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        if parts[0] in ascii_lowercase and len(parts) > 1 and all(unicodedata.category(m) == "Mn" for m in parts[1:]):
            out[chr(code)] = parts[0]
    return {c: base for c, base in out.items() if c not in UNFOLDED}


#: Composed letters that the tokenizer leaves as they are.
UNFOLDED = "ǡ"
ACCENTS = _accents() | dict.fromkeys("ſẛ", "s")
#: What is folded, then the combining marks, which are dropped.
ACCENTED, PLAIN = "".join(ACCENTS) + "".join(map(chr, range(0x300, 0x370))), "".join(ACCENTS.values())


def find(symbols: DataFrame, query: str | None = None, kind: str | None = None, exact: bool = False, limit: int = 50, path: str | None = None) -> DataFrame:
    """Symbols that match all that is given, best first.

    exact compares simple_name or name without regard to the case of A to Z, otherwise either may
    contain the query. A match of simple_name comes before one of name, then by line; without a
    query by path and line. Ties go by path and id. Wildcards of LIKE have no meaning.
    """
    df = symbols
    simple, name = x.fold(F.col("simple_name")), x.fold(F.col("name"))
    order: list = [F.col("relative_path"), F.col("line_number"), F.col("id")]
    if query:
        q = query.translate(str.maketrans(x.UPPER, x.LOWER))
        df = df.filter((simple == q) | (name == q) if exact else simple.contains(q) | name.contains(q))
        order = [F.when(simple == q, 1).when(name == q, 2).otherwise(3), F.col("line_number"), F.col("relative_path"), F.col("id")]
    if kind:
        df = df.filter(F.col("entity_type") == kind)
    if path:
        df = df.filter(x.fold(F.col("relative_path")).contains(path.translate(str.maketrans(x.UPPER, x.LOWER))))
    return df.orderBy(*order).limit(limit)


def lookup(symbols: DataFrame, wanted: DataFrame, limit: int = 50) -> DataFrame:
    """q, place (from 1) and the symbols that an exact find of each q of wanted gives.

    One join on equality, of each symbol by either name; one that matches by both counts once. Of a
    name that very many symbols have, each task passes on `limit` rows at most.
    """
    asked = wanted.select("q", x.fold(F.col("q")).alias("_k")).distinct()
    simple, full = x.fold(F.col("simple_name")), x.fold(F.col("name"))
    known = F.array(F.struct(simple.alias("_k"), F.lit(1).alias("_r")), F.struct(F.when(~simple.eqNullSafe(full), full).alias("_k"), F.lit(2).alias("_r")))
    rows = symbols.select(*symbols.columns, F.inline(known))
    order = Window.partitionBy("q").orderBy("_r", "line_number", "relative_path", "id")
    best = rows.join(asked, "_k").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return best.select("q", "place", *symbols.columns)


def holders(symbols: DataFrame, name: str) -> DataFrame:
    """relative_path of the files that hold a symbol of this name, alone or in a container."""
    named = (F.col("name") == name) | F.col("name").endswith("." + name)
    return symbols.filter(named).select("relative_path").distinct()


def terms(c: Column) -> Column:
    """Case and accents folded, cut at all that is neither letter nor digit."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(symbols: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(w).alias("weight"), terms(F.col(c)).alias("t")) for c, w in weights.items()])).alias("e")
    return symbols.select("id", each).select("id", "e.col", "e.weight", F.posexplode("e.t").alias("pos", "term"))


def vocabulary(symbols: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """col, term, n (how often it stands there) and docs (how many ids have it there; null is none).

    A row counts once for each of its terms, so nothing is held for a term and an id, unless the id
    is that of several rows: only such rows are kept apart by it. Rows are dealt by id first; a table
    in one file would else be tokenized in one task.
    """
    ids = symbols.select("id").filter(F.col("id").isNotNull()).repartition("id")
    again = ids.groupBy("id").agg(F.count("*").alias("_rows")).filter("_rows > 1").select("id", F.col("id").alias("_own"))
    rows = symbols.select("id", *weights).join(again.hint("shuffle_hash"), "id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), terms(F.col(c)).alias("t")) for c in weights])).alias("e")
    one = F.when(F.col("id").isNotNull(), 1).otherwise(0).alias("d")
    said = F.transform("e.t", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    held = F.transform(F.array_distinct("e.t"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), one))
    found = rows.select("id", "_own", each).select("_own", "e.col", F.inline(F.concat(said, held)))
    parts = found.groupBy("col", "term", "_own").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return parts.groupBy("col", "term").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_own").isNull(), F.col("d")).otherwise(1)).alias("docs"))


def lengths(symbols: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    return symbols.select("id", sum((F.size(terms(F.col(c))) for c in weights), F.lit(0)).cast("long").alias("d"))


def write_index(symbols: DataFrame, path: str) -> None:
    postings(symbols).repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    lengths(symbols).write.mode("overwrite").parquet(f"{path}/lengths")


def phrases(query: str) -> list[list[str]]:
    """The distinct words of a query; a word with underscores is a phrase of its parts."""
    words = dict.fromkeys(re.findall("[A-Za-z0-9_]+", query))
    out = []
    for w in words:
        parts = [p for p in w.lower().split("_") if p]
        if parts:
            out.append(parts)
    return out


def bm25(post: DataFrame, lens: DataFrame, query: str, limit: int = 20, digits: int = 6) -> DataFrame:
    """id, score of the best symbols, the smallest (most negative) score first, ties by id.

    The last part of each phrase matches as a prefix, except for one-letter words. A phrase that
    half of all rows or more hold weighs next to nothing.
    """
    asked = list(enumerate(phrases(query)))
    last = lambda parts: F.col("term") == parts[-1] if len(parts) == 1 and len(parts[0]) < 2 else F.col("term").startswith(parts[-1])
    alone = [(i, last(parts)) for i, parts in asked if len(parts) == 1]
    found = None
    if alone:  # all words of one part in one scan
        hits = post.filter(reduce(Column.__or__, [c for _, c in alone]))
        found = hits.select("id", "weight", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in alone]))).alias("phrase"))
    for i, parts in asked:
        if len(parts) > 1:
            hit = post.filter(last(parts))
            for back, part in enumerate(reversed(parts[:-1]), 1):
                before = post.filter(F.col("term") == part).select("id", "col", (F.col("pos") + back).alias("pos"))
                hit = hit.join(before, ["id", "col", "pos"], "left_semi")
            one = hit.select("id", "weight", F.lit(i).alias("phrase"))
            found = one if found is None else found.unionByName(one)
    if found is None:
        return post.sparkSession.createDataFrame([], "id long, score double")
    found = found.groupBy("id", "phrase").agg(F.sum("weight").cast("double").alias("f"))
    rows = found.groupBy("phrase").agg(F.count("*").alias("n"))  # a row for each phrase
    totals = lens.agg(F.count("*").alias("docs"), F.avg("d").alias("mean"))
    raw = F.ln((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(1e-6)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("mean")))
    scored = found.join(F.broadcast(rows), "phrase").join(lens, "id").crossJoin(F.broadcast(totals)).groupBy("id").agg(F.round(-F.sum(part), digits).alias("score"))
    return scored.orderBy("score", "id").limit(limit)


def search(symbols: DataFrame, query: str, limit: int = 20, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Symbols with their score, best first; without words or hits what find() gives, with a null
    score. An empty query gives nothing."""
    if not query or not query.strip():
        return symbols.withColumn("score", F.lit(None).cast("double")).limit(0)
    if phrases(query):
        post, lens = index or (postings(symbols), lengths(symbols))
        hits = bm25(post, lens, query, limit)
        if not hits.isEmpty():
            return symbols.join(x.bounded(hits, limit), "id").orderBy("score", "id")
    return find(symbols, query.strip(), limit=limit).withColumn("score", F.lit(None).cast("double"))
