"""The stages against brute force, and every query on the smallest tables."""

import hashlib

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from kistwerk.llm.minhash import near_duplicates

from .test_texts import brute_cut, corpus, frame, roots, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    texts = corpus(11, 40)
    docs = frame(spark, texts, False).selectExpr("doc_id", "text", "lang", "rid as source", "cast(length(text) as long) as n_chars")
    kept = corpus_pipeline.distinct_documents(spark, docs, SF)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    left = sorted(set(roots(len(texts), links)))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == left
    cut = {r.doc_id: r for r in corpus_pipeline.unrepeated_documents(spark, kept, SF).collect()}
    for i, (n, gone, _, sha) in zip(left, brute_cut([texts[i] for i in left]), strict=True):
        if gone == n and n:
            assert i not in cut
        elif not gone:
            assert cut[i].text == (texts[i] or "") and cut[i].n_chars == (None if texts[i] is None else len(texts[i]))
        else:
            assert cut[i].n_chars == len(cut[i].text) and (hashlib.sha256(cut[i].text.encode()).hexdigest() == sha or "�" not in cut[i].text)
    assert len(corpus_pipeline.STAGES) == 4


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(docs) and got.count() > 0


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_query_on_the_smallest_tables(spark, name):
    table = "embeddings" if name.startswith("op2_") else "conversations" if name.startswith("op3_") else "documents"
    got = __spark_entry__.queries()[name](spark, SF)
    rows = duckdb.sql(f"select count(*) from '{SF}/{table}.parquet'").fetchall()[0][0]
    n = got.count()
    assert n >= rows if name.startswith("op7_") else n == (rows if not name.startswith("op3_") else n)


def test_operator_keeps_links_at_scale_of_the_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: shingles(r.text) for r in docs.collect()}
    ids = sorted(texts)
    at = {d: k for k, d in enumerate(ids)}
    links = [(at[a], at[b]) for a in ids for b in ids if b < a and texts[a] and texts[b] and 100 * len(texts[a] & texts[b]) >= 85 * len(texts[a] | texts[b])]
    want = roots(len(ids), links)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, "doc_id", "text").collect()}
    assert got == {d: ids[want[k]] for k, d in enumerate(ids)}
