"""The pipeline's stages, each against a brute-force version of its decision."""

import hashlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from shoal.llm import toxicity
from tests.llm.test_near import plain_groups
from tests.llm.test_operators import library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        kept.append(docs)
    return kept


def test_columns_are_kept(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_toxic_documents_go(spark, steps):
    scores = {r.doc_id: r.predicted for r in toxicity.scores(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(i for i, p in scores.items() if not p)


def test_one_of_equal_texts_stays(steps):
    best = {}
    for r in steps[1].collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.text: r.doc_id for r in steps[2].collect()} == best and steps[2].count() == len(best)


def test_one_of_near_copies_stays(steps):
    label = plain_groups([(r.doc_id, r.text) for r in steps[2].collect()])
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted({x for _, x in label})


def test_mix_near_its_targets(steps):
    size, taken, texts = Counter(), Counter(), {}
    for r in steps[3].collect():
        size[r.source] += len(r.text.split())
        texts[r.doc_id] = r.text
    for r in steps[4].collect():
        taken[r.source] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text)
    assert abs(sum(taken.values()) - sum(size.values())) <= 16 * len(size)
    assert all(taken[s] <= 3 * size[s] for s in size)


def test_mix_is_encoded(steps):
    enc = library()
    want = Counter((r.doc_id, len(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in steps[4].collect())
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in steps[5].collect()) == want


def test_sql_of_the_queries(spark):
    from shoal.llm import queries, sql

    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, text in sql.ORACLE_SQL.items():
        df = queries.queries()[name](spark, SF)
        cur = con.execute(text)
        names = [d[0] for d in cur.description]
        tidy = lambda v: round(v, 6) if isinstance(v, float) else v
        want = sorted((tuple(map(tidy, r)) for r in cur.fetchall()), key=str)
        assert sorted((tuple(map(tidy, r)) for r in df.select(*names).collect()), key=str) == want, name
