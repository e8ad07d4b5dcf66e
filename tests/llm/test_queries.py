"""Registered queries against their SQL; the pipeline against brute force."""

import os

import duckdb
import pytest

import corpus_pipeline
from plotstats.llm import catalog
from plotstats.llm.oracle import ORACLE_SQL
import brute

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


def test_pipeline_stages(spark, con):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = [tuple(r) for r in docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.saved(stage(spark, docs, sf), "test-pipeline")
        after = [tuple(r) for r in docs.collect()]
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            assert set(after) <= set(before)
            gone = [labels[r[0]] for r in set(before) - set(after) if r[0] in labels]
            assert gone.count(0) >= 0.95 * sum(labels.get(r[0]) == 0 for r in before) and gone.count(1) <= 0.02 * len(labels)
        if i == 1:
            classes = brute.classes([(r[0], r[1]) for r in before], 5, 4, 5)
            assert sorted({c for _, _, c in classes}) == sorted(dict((i, c) for i, _, c in classes)[r[0]] for r in after)
            assert set(after) <= set(before)
        if i == 2:
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            hit = brute.hits([(r[0], r[1]) for r in before], items)
            assert sorted(r[0] for r in after) == sorted(r[0] for r in before if not hit[r[0]])
        if i == 3:
            texts = {r[0]: r[1] for r in before}
            assert sorted(texts) == sorted(r[0] for r in after)
            for r in after:
                assert not brute.pii(r[1]) and r[4] == len(r[1])
                assert r[1] == texts[r[0]] or brute.pii(texts[r[0]])
        if i == 4:
            assert len(after) == len(before) and all(docs.columns[j] != "lossless" or r[j] for r in after for j in range(len(r)))
        before = after


def test_pipeline_of_awkward_rows(spark, docs_of, awkward):
    docs = docs_of(awkward)
    # empty texts link with nothing; of rows that repeat id and text one stays
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [x for x in awkward if x[0] != 1] + [awkward[0]]))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([]), SF).count() == 0


def test_repetitions_of_texts_without_words_stay(spark, docs_of):
    pairs = [(1, "\t\n"), (1, "\t\n"), (2, "  "), (2, "  "), (3, None), (3, None), (4, "one text of a few words"), (4, "one text of a few words")]
    kept = corpus_pipeline.near_duplicates(spark, docs_of(pairs), SF).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(map(str, pairs[:-1]))


def test_pipeline_keeps_columns_of_any_name(spark, docs_of, awkward):
    names = ["score", "predicted", "held_out", "__text_hash", "text_hash", "_text_hash", "pii_base", "pii_added", "k", "d", "column 2", "stays"]
    docs = docs_of([*awkward, (30, "write to bob@example.org today, please, and say hello")], extra=False).selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = corpus_pipeline.saved(stage(spark, docs, SF), "test-names")
        assert after.columns == docs.columns
        for r in after.collect():
            assert r.doc_id is None or all(r[n] == f"{n}{r.doc_id}" for n in names)
        assert i == 0 or after.count()
