"""The pipeline's stages, and queries against their SQL."""
import hashlib

import duckdb
import pytest

import corpus_pipeline
from ledgerlark.llm.queries import ORACLES, QUERIES

from ..conftest import SF_SMALL


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    got = QUERIES[name](spark, SF_SMALL)
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def test_all_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 34", "en", "src1", 5)], docs.schema)
    docs, columns, seen = docs.unionByName(extra), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        seen[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = corpus_pipeline.keep_table(out, name)
            seen[name] = (seen[name][0], docs)
    before, after = seen["language_id"]
    gone = {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()}
    assert {9001, 9002} <= gone and len(gone) <= 4
    before, after = seen["line_dedup"]
    assert before.count() == after.count() and after.where("n_chars <> length(text)").count() == 0
    mixed = {r["doc_id"]: r["text"] for r in seen["source_mix"][1].collect()}
    tokens = seen["bpe_encoding"][1].collect()
    assert len(tokens) == seen["source_mix"][1].count()
    assert all(r["decoded_sha256"] == hashlib.sha256(mixed[r["doc_id"]].encode()).hexdigest() for r in tokens)
    assert all(len(r["ids"]) == r["n_tokens"] > 0 for r in tokens)


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "ein Text", None), (2, None, None), (3, "12 34!", None), (4, "é", None), (5, "", None)],
                                 "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 4}
