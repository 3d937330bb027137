"""The pipeline's stages against their operators, its odd rows, and DuckDB for the queries with SQL."""

import os
import random
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemodex.llm import language, quality, queries
from mnemodex.llm.common import id_remainder

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_near_duplicates import components, jaccard_links  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "123 !!!"), (None, "the of and in the of and"), (10**9 + 3, "of the " * 20_000)], "doc_id long, text string")
    docs = docs.unionByName(junk, allowMissingColumns=True).unionByName(docs.limit(2)).withColumns({"score": F.lit("clash"), "_0": F.lit(1), "fp": F.lit(2)})
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns and after.count() <= before.count(), name
        if name == "language_id":
            assert not {10**9, 10**9 + 1, 10**9 + 2} & {r.doc_id for r in after.select("doc_id").collect()}
        if name == "simhash_near_dedup":
            ids = [r.doc_id for r in after.select("doc_id").collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids))
        before = after
        before = spark.createDataFrame(before.collect(), before.schema)
    packed = corpus_pipeline.pack(spark, before, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


def test_stages_against_brute_force(spark):
    """Every stage's decisions, made anew on the driver, a document or a pair at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language.train(docs, id_remainder(F.col("doc_id"), 4) != 2)
    said = {i: language.decide(r.text, model) for i, r in rows.items()}
    want = {i for i, (lang, score) in said.items() if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE}
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert {r.doc_id: r.text for r in kept.collect()} == {i: rows[i].text for i in want} and want

    weights = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality", id_remainder(F.col("doc_id"), 3) != 1).astype("float32")
    scores = {}
    for i, r in rows.items():
        index, value = quality.features(r.text)
        scores[i] = float(weights[index] @ value + weights[-1])
    kept = corpus_pipeline.classify_quality(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0}

    order = sorted(rows)
    links = jaccard_links([(i, rows[i].text) for i in order])
    groups = components(range(len(order)), links)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {order[c] for c in groups.values()}

    rng = random.Random(51)
    words = [f"w{i}" for i in range(2000)]
    shared = rng.sample(words, 60)
    texts = [" ".join(rng.sample(words, 30) + shared * (i % 2) + rng.sample(words, 30)) for i in range(12)]
    made = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    for r in corpus_pipeline.drop_repeated_passages(spark, made, SF).collect():
        w = texts[r.doc_id].split()
        assert r.text.split() == (w[:30] + w[90:] if r.doc_id % 2 and r.doc_id > 1 else w) and r.n_chars == len(r.text)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    total = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert out.count() and total <= 1024


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


def test_empty_texts_are_packed_and_emptied_documents_go(spark):
    repeated = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"before it {repeated}", 3), (2, repeated, 3), (3, "", 0), (4, None, 0)], "doc_id long, text string, n_chars int")
    left = corpus_pipeline.drop_repeated_passages(spark, docs, SF)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 3, 4}
    packed = corpus_pipeline.pack(spark, left, SF).collect()
    assert {r.doc_id for r in packed} == {1, 3, 4} and {r.length for r in packed if r.doc_id > 1} == {1}


def test_fuzzy_passages_of_frequent_lines_go(spark):
    """Neighbouring lines are in many earlier documents, all of them in three later ones, each with other words changed."""
    rng = random.Random(78)
    some = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n)]
    lines = [some(12) for _ in range(6)]
    rows = [(n, " ".join(some(40) + lines[n % 5] + lines[n % 5 + 1] + some(40))) for n in range(75)]
    for n in range(3):
        fuzzy = sum(lines, [])
        for i in range(6 + 2 * n, 70, 14):
            fuzzy[i] = f"zz{n}-{i}"
        rows.append((900 + n, " ".join(some(30) + fuzzy + some(30))))
    left = {r.doc_id: len(r.text.split()) for r in corpus_pipeline.drop_repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert all(left[n] == 104 for n in range(75)) and left[900] == 132 and max(left[901], left[902]) <= 82
