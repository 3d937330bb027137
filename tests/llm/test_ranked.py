"""Ranked search against scores made one document at a time, its bounds, blocks of queries, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemodex.llm import ranked as rk
from mnemodex.llm import terms as tm

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(ASCII))


def brute_force(docs, items, k):
    bags = [(i, Counter(words(t))) for i, t in docs if i is not None]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in words(text) if bag[t])
            if score > 0:
                scores.append((-score, i))
        out += [(item, at + 1, i, -s) for at, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, docs, items, k=20):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("clash"), "score": F.lit(1), "terms": F.lit(2)})
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    return sorted(tuple(r) for r in rk.ranked(docs.repartition(3), items, k=k).collect())


def corpus(rng, n):
    common, rare = ["the", "of", "and", "in"], [f"w{i}" for i in range(300)]
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare[: rng.choice([5, 40, 300])]) for _ in range(rng.randint(0, 60)))
    docs = [(i, text()) for i in range(n)]
    return docs + [(n + i, docs[i][1]) for i in range(0, n, 7)], [(i, text()) for i in range(15)]


@pytest.mark.parametrize("shard", [2_000_000, 300, 1])
def test_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(rk, "SHARD", shard)
    docs, items = corpus(random.Random(shard), 250)
    assert found(spark, docs, items) == brute_force(docs, items, 20)
    assert found(spark, docs, items, k=3) == brute_force(docs, items, 3)


def test_blocks_of_queries(spark, monkeypatch):
    docs, items = corpus(random.Random(9), 80)
    monkeypatch.setattr(rk, "TERM_BYTES", 6_000)
    assert found(spark, docs, items) == brute_force(docs, items, 20)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "Été É été"), (5, "a_b-c 1x"), (6, "ab " * 30_000), (7, "日本 語"), (None, "ab"), (8, "ab cd"), (8, "ab cd"), (9, "ABC abc ab")]
    items = [(1, "ab ab É"), (2, None), (3, "..."), (4, "nothing here"), (5, "b 1x A 日本"), (None, "ab"), (6, "cd"), (6, "cd")]
    once = [x for x in items if x[0] is not None][:-1]
    assert found(spark, docs, items) == brute_force(docs, once, 20)
    assert found(spark, docs, []) == found(spark, [], items) == []


def test_stops_before_the_last_posting():
    """The bounds end the search early, with the same result as all postings."""
    rng = np.random.default_rng(1)
    n = 4000
    sizes = rng.integers(1, 6, n)
    terms = np.concatenate([rng.choice(8, s, replace=False) for s in sizes])
    impacts = rng.integers(1, 1000, sizes.sum())
    impacts[rng.integers(0, len(impacts), 30)] += 900_000
    shard = rk.Shard(np.arange(n), sizes, terms, impacts, 8)
    weights = np.arange(1, 9)
    calls = []
    whole = shard._complete(np.arange(n), np.arange(8), weights)
    complete = shard._complete
    shard._complete = lambda docs, *a: calls.append(len(docs)) or complete(docs, *a)
    ids, scores = shard.best(np.arange(8), weights, 20, (np.empty(0, np.int64), np.empty(0, np.int64)))
    order = np.lexsort((np.arange(n), -whole))[:20]
    assert ids.tolist() == order.tolist() and scores.tolist() == whole[order].tolist() and calls and calls[0] < 200


def test_terms_of_blocks(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "É", "AbC-d", "日本 x"] + ["".join(rng.choice("aB1 é.-_語\n\x7f") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for block in (tm.BLOCK, 50):
        monkeypatch.setattr(tm, "BLOCK", block)
        for inside, pattern in ((tm.LETTERS_DIGITS, TERM), (tm.LETTERS, re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"))):
            got, hashes = [], {}
            for first, t in tm.cut_terms(pa.array(texts).slice(1), inside):
                strings = t.strings(np.arange(len(t.starts))).to_pylist()
                for s, h in zip(strings, t.hashes.tolist()):
                    assert hashes.setdefault(s, h) == h
                at = np.append(0, np.cumsum(t.counts))
                got += [strings[a:b] for a, b in zip(at, at[1:])]
            assert got == [pattern.findall((x or "").translate(ASCII)) for x in texts[1:]] and len(set(hashes.values())) == len(hashes)
