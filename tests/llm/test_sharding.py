import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sedge.llm import common, sharding
from tests.conftest import SF
from tests.llm.tables import docs


def test_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, SF, "documents").collect()}
    found = sharding.op4_sharding(spark, SF).collect()
    assert Counter(r.doc_id for r in found) == Counter(texts.keys())
    slots = defaultdict(list)
    for r in found:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    moved = sum(r.grown_shard == 16 for r in found) / len(found)
    assert 0.02 < moved < 0.11


def test_the_same_again_and_shuffled(spark):
    rows = docs(spark, [(i, f"t{i}") for i in range(400)])
    once = {r.doc_id: (r.shard, r.slot) for r in sharding.sharded(rows).collect()}
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.sharded(rows.repartition(7)).collect()}
    assert once == again
    first = [i for i, _ in sorted(((i, s) for i, s in once.items() if s[0] == 0), key=lambda x: x[1])]
    assert first != sorted(first)


def test_edges(spark):
    rows = docs(spark, [(None, "a"), (None, None), (1, ""), (2, "x" * 300_000), (3, "r"), (3, "r"), (3, "s")]).withColumns({"SHARD": F.lit("old"), "_row": F.lit(1), "_n": F.lit(2)})
    out = sharding.sharded(rows, shards=3).collect()
    assert len(out) == 7 and len({r.shard for r in out if r.doc_id == 3}) == 1
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.sharded(docs(spark, [])).collect() == []


def test_a_hot_row_is_spread_over_buckets(spark):
    rows = docs(spark, [(1, "same")] * 5000 + [(None, None)] * 3000 + [(i, "other") for i in range(2, 300)])
    slots = defaultdict(list)
    found = sharding.sharded(rows, shards=2, bucket_bytes=20_000).collect()
    for r in found:
        slots[r.shard].append(r.slot)
    assert len(found) == 8298 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in found if r.doc_id == 1}) == len({r.shard for r in found if r.doc_id is None}) == 1
    placed, _, buckets = sharding.scattered(rows, 2, 20_000, sharding.SEED)
    held = placed.select("_row.doc_id", "_bucket").collect()
    assert len({r._bucket for r in held if r.doc_id == 1}) > 10 and len({r._bucket for r in held if r.doc_id is None}) > 5
    assert max(Counter(r._bucket for r in held).values()) < 2 * 20_000 / sharding.ROW_BYTES and buckets > 20


def test_the_plan_has_no_python_and_one_shuffle_of_texts(spark):
    plan = sharding.op4_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("shufflepartitionidpassthrough") == 1


def test_written_folders(spark, tmp_path):
    sharding.write(docs(spark, [(i, f"t{i}") for i in range(50)]), str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
