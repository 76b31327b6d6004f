import corpus_pipeline
from pyspark.sql import functions as F
from sedge.llm import common, quality, toxicity
from tests.llm.tables import components, docs as made
from tests.llm.test_tokens import check_packing

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = common.table(spark, SMALL, "documents")
    labels = common.table(spark, SMALL, "labels")
    good = quality.fitted(docs, labels)
    toxic = toxicity.fitted(docs, labels).scorer()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if good.score(t) >= quality.THRESHOLD]
    rows = [(i, t) for i, t in rows if toxic(t) < toxicity.THRESHOLD]
    root = components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if root[i] == i]
    assert 0 < len(rows) < docs.count()
    check_packing(spark, corpus_pipeline.run(spark, SMALL).collect(), rows)


def test_stages_keep_the_columns_of_documents(spark):
    docs = common.table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "packing"]


def test_edges(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text), (None, text), (1, text), (2, text + " more"), (3, None), (4, ""), (2, text + " more")]
    odd = made(spark, rows).withColumns({"score": F.lit("mine"), "predicted": F.lit(7), "id": F.lit(1), "regs": F.lit("x")})
    near = corpus_pipeline.keep_one_of_near(spark, odd, SMALL)
    assert near.columns == odd.columns
    assert sorted((r.doc_id for r in near.collect()), key=str) == [1, 3, 4, None, None]
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.drop_toxic):
        out = stage(spark, odd, SMALL)
        assert out.columns == odd.columns and all(r.score == "mine" and r.predicted == 7 for r in out.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, made(spark, []), SMALL).collect() == []
