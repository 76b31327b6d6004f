"""Near-duplicate groups by HyperMinHash sketches, banding and confirmed links.

1. Each text becomes the set of its word shingles, as 64-bit hashes. Texts with equal sets are one
   class, represented by its smallest doc_id; all that follows is on classes.
2. A HyperMinHash sketch has REGISTERS buckets. A bucket keeps of the smallest hash that fell in it
   the number of leading zeros and MANTISSA bits after the first one; an empty bucket borrows
   from the next one that is not, with the distance mixed in. ROWS registers in a row make a band.
3. Classes that agree on a band are candidates. No bucket gives all its pairs: every member is
   first compared with one hub, the member with the most crowded bands, and links merge components.
   The texts that some bucket then still joins across components are compared pair by pair, less
   the pairs that exact bounds rule out (rarest shingles first). So no candidate pair is left out
   except inside a component.
4. A candidate's similarity is estimated from the registers, less the collisions expected by
   chance; pairs that may reach the threshold are confirmed on the full shingle sets of the texts.
5. Components come from min-label star contraction; nothing is gathered in the driver.
"""

from __future__ import annotations

import functools
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import common

REGISTERS, ROWS, MANTISSA = 96, 4, 10
BANDS = REGISTERS // ROWS
#: How far an estimate may be off (in standard errors), and below how many shingles registers
#: repeat each other, which makes it coarser.
ERRORS, SMALL = 5.5, REGISTERS
#: Chance that two registers of different hashes agree: about 2^-MANTISSA / 3 summed over zeros.
COLLISION = 2.0**-MANTISSA / 1.5

#: Rounds of stars at most, and members of a bucket that meet its one row in one task.
ROUNDS, HOT = 200, 100_000
#: Bytes of a text, or hashes of a set, that are worked on at a time, so that a long text takes little more
#: memory than its bytes and the 8 bytes of each of its words.
SEGMENT = 1 << 18

_LOG = logging.getLogger(__name__)
_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@functools.lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, dtype=np.uint64), np.ones(n, dtype=np.uint64)
    if n > 1:
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(_BACK)
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
    return up, down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pieces(values: np.ndarray):
    """The array in views of at most SEGMENT values."""
    return (values[at : at + SEGMENT] for at in range(0, len(values), SEGMENT))


def words_of(text: str | None) -> np.ndarray:
    """A hash of each word (runs without ASCII white space, A-Z lower-cased), wherever it stands.

    A word that goes on in the next segment is carried over as its sum so far and its length.
    """
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    up, down = _powers(min(SEGMENT, 1 << max(12, len(b).bit_length())))
    out, was, size = [np.zeros(0, dtype=np.uint64)], 0, 0
    put = lambda sums, sizes: out.append(_mix(sums + sizes * _PLACE[-1]))
    for part in pieces(b):
        space = np.ones(len(part) + 2, dtype=bool)
        space[1:-1] = _SPACE[part]
        edge = np.flatnonzero(space[1:] != space[:-1])
        first, end = edge[::2], edge[1::2]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[part]] * up[: len(part)], out=total[1:])
        sums, sizes = (total[end] - total[first]) * down[first], (end - first).astype(np.uint64)
        if size and len(first) and first[0] == 0:
            sums[0] = (was + pow(_BASE, size, 1 << 64) * int(sums[0])) % (1 << 64)
            sizes[0] += np.uint64(size)
        elif size:
            put(np.array([was], dtype=np.uint64), np.array([size], dtype=np.uint64))
        was = size = 0
        if len(end) and end[-1] == len(part):
            was, size = int(sums[-1]), int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        put(sums, sizes)
    if size:
        put(np.array([was], dtype=np.uint64), np.array([size], dtype=np.uint64))
    return np.concatenate(out)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of so many words (see words_of); of all its
    words if it has fewer; none without words."""
    h = words_of(text)
    if not len(h):
        return h
    k = min(words, len(h))
    found = np.empty(len(h) - k + 1, dtype=np.uint64)
    for at in range(0, len(found), SEGMENT):
        n = min(SEGMENT, len(found) - at)
        s = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            s = (s ^ h[at + j : at + j + n]) * _PLACE[j % 15] + (s >> np.uint64(29))
        found[at : at + n] = _mix(s)
    del h
    found.sort()
    new = np.ones(len(found), dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found if new.all() else found[new]


def shared_size(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return sum(int((y[np.minimum(np.searchsorted(y, part), len(y) - 1)] == part).sum()) for part in pieces(x))


def registers(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS numbers of 16 bits: leading zeros (up to 63) and mantissa, none of them empty."""
    m = np.uint64(REGISTERS)
    none = np.uint64(2**64 - 1)
    least = np.full(REGISTERS, none)
    for part in pieces(hashes):
        np.minimum.at(least, (part % m).astype(np.int64), part // m)
    full = np.flatnonzero(least != none)
    least = least[full]
    bits = np.frexp(least.astype(np.float64))[1]
    shift = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)
    value = ((64 - bits).astype(np.uint64) << np.uint64(MANTISSA)) | ((least >> shift) & np.uint64((1 << MANTISSA) - 1))
    to = np.searchsorted(full, np.arange(REGISTERS))
    source = to % len(full)
    gap = np.where(to < len(full), full[source], full[0] + REGISTERS) - np.arange(REGISTERS)
    return (value[source] ^ (gap.astype(np.uint64) * np.uint64(0x9E37))).astype(np.uint16)


def name_of(hashes: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, as two signed numbers."""
    a = b = 0
    for part in pieces(hashes):
        a += int(_mix(part + np.uint64(1)).sum(dtype=np.uint64))
        b += int(_mix(part ^ np.uint64(_BASE)).sum(dtype=np.uint64))
    return tuple((x + (1 << 63)) % (1 << 64) - (1 << 63) for x in (a, b))


def bands(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: its registers side by side, mixed with its number."""
    return _mix(regs.view("<u8") ^ _mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit name of the set; null if empty), regs."""

    def run(batches):
        for batch in batches:
            n, a, b, regs = [], [], [], []
            for t in batch.column("text"):
                h = shingles(t.as_py(), words)
                n.append(len(h))
                if not len(h):
                    a.append(None), b.append(None), regs.append(None)
                    continue
                for column, x in zip((a, b), name_of(h)):
                    column.append(x)
                regs.append(registers(h).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "regs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, regs binary")


def banded(classes: DataFrame) -> DataFrame:
    """key, id: a row for each class and band."""

    def run(batches):
        for batch in batches:
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), BANDS)
            regs = batch.column("regs").to_pylist()
            keys = np.concatenate([bands(np.frombuffer(r, dtype="<u2")) for r in regs]) if regs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], names=["key", "id"])

    return classes.select("id", "regs").mapInArrow(run, "key long, id long")


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose registers do not speak against it."""
    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    both = pairs.join(one, "a").join(two, "b").filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            same = (x == y).mean(axis=1)
            estimate = np.maximum(same - COLLISION, 0) / (1 - COLLISION)
            n = np.asarray(batch.column("n"))
            p = percent / 100
            slack = ERRORS * np.sqrt(p * (1 - p) * (1 / REGISTERS + np.where(n < SMALL, 2 / n, 0)))
            keep = estimate >= p - slack
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "ra", "rb", F.least("na", "nb").alias("n")).mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs with 100 * |intersection| >= percent * |union| of their full shingle sets.

    A hub meets many members in a row; its set is made once for each run of pairs.
    """
    hub = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    member = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(member, "b").join(hub, "a").select("a", "b", "ta", "tb")

    def run(batches):
        last, mine = None, None
        for batch in batches:
            keep = []
            ta, tb, ids = batch.column("ta"), batch.column("tb"), batch.column("a").to_pylist()
            for i in range(batch.num_rows):
                text = ta[i].as_py()
                if ids[i] != last or text != was:
                    last, was, mine = ids[i], text, shingles(text, words)
                other = shingles(tb[i].as_py(), words)
                common_size = shared_size(mine, other)
                keep.append(100 * common_size >= percent * (len(mine) + len(other) - common_size) and common_size > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that each end of an edge (a, b) can reach.

    Alternates large and small stars, each cut by a written table, until nothing changes. That takes
    rounds in proportion to the square of the logarithm of the edges; ROUNDS ends a run that never would.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    before = None
    for turn in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        now = common.stash(small, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.countDistinct("u")).first()
        _LOG.info("stars, round %d: %d edges", turn + 1, state[0])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def tokens(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, s: the distinct shingles of the texts of these ids."""

    def run(batches):
        for batch in common.slices(batches):
            sets = [shingles(t.as_py(), words) for t in batch.column("text")]
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), [len(h) for h in sets])
            every = np.concatenate(sets).view(np.int64)
            del sets
            for i, s in zip(pieces(ids), pieces(every)):
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s)], names=["id", "s"])

    return texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, s long")


def met(rows: DataFrame, ones: DataFrame) -> DataFrame:
    """rows (key, n, id and more; n of them have the key) with the columns of ones, a row for each key.

    A key of more than HOT rows is split by id, and its one row is given to each part.
    """
    parts = lambda n: F.ceil(n / HOT).cast("int")
    sizes = rows.select("key", F.pmod(F.xxhash64("id"), parts(F.col("n"))).cast("int").alias("_part"), *[c for c in rows.columns if c != "key"])
    each = ones.withColumn("_part", F.explode(F.sequence(F.lit(0), parts(F.col("_n")) - 1))).drop("_n")
    return sizes.join(each, ["key", "_part"]).drop("_part")


def contenders(at: DataFrame, texts: DataFrame, sketches: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels among the texts that a bucket joins across labels, less
    those whose bounds rule the similarity out. The bounds are exact, so no link is lost.

    at has key, n (how many rows have it), id, label. First, a text of n shingles of which u are in no other text at hand can
    have no link if 100 * (n - u) < percent * n. The shingles of those that remain are put in one
    order, the rarest first. If the first that two texts share stands at i and j, they share at
    most min(na - i, nb - j), so a pair is only made where that may do: texts meet at rare shingles.
    """
    open_keys = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("n").alias("_n")).filter("lo < hi").select("key", "_n")
    open_ids = common.stash(met(at, open_keys).select("id", "label").distinct(), "open")
    sizes = sketches.groupBy("id").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    several = F.col("copies") > 1  # an id with several texts has no bounds
    alone = tokens(texts, open_ids, words).groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other").groupBy("id").agg(F.count("*").alias("u"))
    rest = open_ids.join(sizes, "id").join(alone, "id", "left").filter(several | (100 * (F.col("n") - F.coalesce("u", F.lit(0))) >= percent * F.col("n"))).select("id", "label", "n", several.alias("several"))
    rest = common.stash(rest, "contenders")
    each = common.stash(tokens(texts, rest, words), "shingles")
    shared = each.join(each.groupBy("s").agg(F.count("*").alias("texts")).filter("texts > 1"), "s")
    by_id = Window.partitionBy("id")
    placed = shared.join(rest, "id").withColumn("at", F.row_number().over(by_id.orderBy("texts", "s")) - 1 + F.col("n") - F.count("*").over(by_id))
    placed = placed.select("s", "id", "label", "n", F.when(F.col("several"), None).otherwise(F.col("n") - F.col("at")).alias("most")).filter(F.col("most").isNull() | (100 * F.col("most") >= percent * F.col("n")))
    placed = common.stash(placed, "prefixes")
    one = placed.select("s", F.col("id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("most").alias("ma"))
    two = placed.select(F.col("s").alias("t"), F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("most").alias("mb"))
    least = F.least("ma", "mb")
    fits = F.col("ma").isNull() | F.col("mb").isNull() | (100 * least >= percent * (F.col("na") + F.col("nb") - least))
    return one.join(two, (F.col("s") == F.col("t")) & (F.col("la") < F.col("lb")) & fits).select("a", "b")


def links_of(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """labels (id, label) of the classes that are linked with another one; None if there are none."""
    keys = common.stash(banded(classes), "bands")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keys = common.stash(keys.join(shared, "key"), "shared-bands")
    sketches = common.stash(classes.join(keys.select("id").distinct(), "id", "left_semi"), "sketches")
    texts = common.stash(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sketches.select("id"), "id", "left_semi"), "texts")
    ordered = lambda pairs: common.stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    # the hub of a band is the member whose bands are the most crowded: the centre of its group
    crowd = keys.join(keys.groupBy("id").agg(F.sum("n").alias("crowd")), "id")
    hubs = crowd.groupBy("key").agg(F.max(F.struct("crowd", (-F.col("id")).alias("hub"))).alias("h"), F.max("n").alias("_n"))
    found = met(keys, hubs).select("id", (-F.col("h.hub")).alias("hub"), F.col("h.crowd").alias("crowd")).filter("id <> hub")
    votes = found.groupBy("id", "hub").agg(F.count("*").alias("n"), F.max("crowd").alias("crowd"))
    chosen = votes.groupBy("id").agg(F.max(F.struct("n", "crowd", (-F.col("hub")).alias("h"))).alias("w")).select((-F.col("w.h")).alias("a"), F.col("id").alias("b"))
    tested = ordered(chosen)
    links = common.stash(confirmed(plausible(tested, sketches, percent), texts, words, percent), "links")
    labels = None if links.isEmpty() else common.stash(components(links), "labels")

    at = keys.select("key", "n", "id")
    at = at.withColumn("label", F.col("id")) if labels is None else at.join(labels, "id", "left").select("key", "n", "id", F.coalesce("label", "id").alias("label"))
    rest = ordered(contenders(at, texts, sketches, words, percent)).join(tested, ["a", "b"], "left_anti")
    new = common.stash(confirmed(plausible(rest, sketches, percent), texts, words, percent), "links")
    if new.isEmpty():
        return labels
    return common.stash(components(new if labels is None else links.unionByName(new)), "labels")


def joined_by_ids(usable: DataFrame, named: DataFrame) -> DataFrame:
    """named (set_a, set_b, label) where all sets of texts that one doc_id has get one label."""
    several = common.stash(usable.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "several-texts")
    if several.isEmpty():
        return named
    held = common.stash(usable.join(several, "doc_id").select("doc_id", "set_a", "set_b").join(named, ["set_a", "set_b"]).select("doc_id", "label").distinct(), "several-labels")
    edges = common.stash(held.join(held.groupBy("doc_id").agg(F.min("label").alias("a")), "doc_id").select("a", F.col("label").alias("b")).filter("a < b").distinct(), "id-links")
    if edges.isEmpty():
        return named
    roots = components(edges).toDF("label", "root")
    return named.join(roots, "label", "left").select("set_a", "set_b", F.coalesce("root", "label").alias("label"))


def groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of shingles
    of so many words; component_id is the smallest doc_id that links lead to, kept says that it is
    the row's own. Null, empty and blank texts have no shingles and no links. Rows with one doc_id
    count as one document that has the links of each of its texts. A null doc_id links nothing,
    its component_id is null and it is kept. Other columns do not matter.
    """
    sketch = common.stash(sketched(docs, words), "sketch")
    usable = sketch.filter(F.col("set_a").isNotNull() & F.col("doc_id").isNotNull())
    sets = common.stash(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id")), "sets")
    classes = usable.select(F.col("doc_id").alias("id"), "set_a", "set_b", F.col("n_shingles").alias("n"), "regs").join(sets, ["set_a", "set_b", "id"]).dropDuplicates(["set_a", "set_b"]).select("id", "n", "regs")
    labels = links_of(classes, docs, words, percent)
    named = sets.withColumn("label", F.col("id")) if labels is None else sets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = joined_by_ids(usable, named)
    found = sketch.select("doc_id", "n_shingles", "set_a", "set_b").join(named.select("set_a", "set_b", "label"), ["set_a", "set_b"], "left")
    out = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"), words=3, percent=85)
