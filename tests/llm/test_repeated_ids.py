"""Rows that repeat a doc_id with different texts."""

import corpus_pipeline
from sedge.llm import neardup
from tests.llm.tables import docs

ONE, TWO, OTHER = (" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two", "other"))


def test_sets_of_one_id_are_one_component(spark):
    rows = [(3, ONE), (5, ONE), (5, TWO), (7, TWO), (9, OTHER)]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.groups(docs(spark, rows), 3, 85).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (9, 9, True)}


def test_pipeline_loses_no_text(spark):
    for rows in ([(3, ONE), (5, ONE), (5, TWO), (7, TWO)], [(5, TWO), (7, TWO), (5, ONE), (3, ONE)], [(3, TWO), (5, ONE), (5, TWO), (5, ONE)]):
        kept = sorted(r.text for r in corpus_pipeline.keep_one_of_near(spark, docs(spark, rows), "").collect())
        assert kept == [ONE, TWO]
