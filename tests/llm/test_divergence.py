"""Source divergence against counts made one document at a time, radix selection with ties, tiles, blocks, merging, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemodex.llm import divergence as dv
from mnemodex.llm.terms import LETTERS, cut_terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, k, least):
    counts, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(ASCII))
        counts[lang or "", source or ""].update(words)
        holders[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in holders[lang].items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s, c in groups.items():
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:k])):
                out += [(lang, s, part, item, -v, at + 1) for at, (v, _, item) in enumerate(found)]
    return sorted(out)


def found(spark, rows, k, least):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("clash"), "value": F.lit(1), "id": F.lit(2), "tile": F.lit(None).cast("int")})
    return sorted(tuple(r) for r in dv.divergence(docs.repartition(3), k, least).collect())


def corpus(rng, n=300, sources=6):
    words = [w + e for w in ("a", "b", "haus", "été", "日本", "Ab", "the", "of") for e in ("", "x", "y", "ß", "zz", "q'")]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        pool = rng.sample(words, rng.choice([3, 10, len(words)]))
        rows.append((" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))), lang, rng.choice([f"s{i}" for i in range(sources)] + ["", None])))
    return rows


@pytest.mark.parametrize("k, least", [(50, 30), (3, 5), (1, 1)])
def test_brute_force(spark, k, least):
    rows = corpus(random.Random(k))
    assert found(spark, rows, k, least) == brute_force(rows, k, least)


def test_small_parts(spark, monkeypatch):
    """Several tiles and blocks, counts that are merged and passed on, and bounds that are joined by a shuffle."""
    rows = corpus(random.Random(7), sources=9)
    for name, value in (("TILE", 3), ("BLOCK_TERMS", 2), ("GATHERED", 40), ("SENT_GROUPS", 0)):
        monkeypatch.setattr(dv, name, value)
    assert found(spark, rows, 4, 3) == brute_force(rows, 4, 3)


def test_ties_by_bytes(spark, monkeypatch):
    """Most values are equal, so that the histograms go on over the bytes of the terms."""
    monkeypatch.setattr(dv, "FEW", 0)
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abßé日") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    rows = [("g", str(i % 3), t, 7 if i % 50 else 2**40 + i) for i, t in enumerate(terms)]
    table = spark.createDataFrame(rows, "lang string, source string, term string, value long")
    got = {(r.source, r.rank): r.term for r in dv.top_terms(table, 40, 3).collect()}
    for s in "012":
        want = sorted((-v, t.encode(), t) for _, g, t, v in rows if g == s)[:40]
        assert [got[s, i + 1] for i in range(40)] == [t for *_, t in want]


def test_odd_rows(spark):
    rows = [(None, "en", "a"), ("", "en", "b"), ("x " * 30_000, "en", "c"), ("x", "en", "c"), ("x", "en", "c"), ("1 2 ._", "en", "d"), ("x y", None, None), ("y", "fr", "only"), ("Été été", "en", "a")]
    assert found(spark, rows, 50, 1) == brute_force(rows, 50, 1)
    assert found(spark, rows, 50, 30) == brute_force(rows, 50, 30)
    assert found(spark, rows[:2], 50, 1) == brute_force(rows[:2], 50, 1)
    assert found(spark, [], 50, 1) == []


def test_counts_of_large_numbers(spark):
    """Shares stay exact where the product passes 64 bits."""
    n = 30_000_000_000
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(7 * n).alias("total"), F.lit(11).alias("v")).select(dv._share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 5) // (7 * n + 55)


def test_counts_in_a_task():
    texts = pa.array(["a b a", "b", None, "c A"])
    for limit in (dv.GATHERED, 1):
        counts = dv._Counts()
        counts.groups = {("en", "x"): 0, ("de", "y"): 1}
        for _ in range(2):
            for first, terms in cut_terms(texts, LETTERS):
                counts.add(terms, np.array([0, 1, 0, 0])[first : first + len(terms.counts)])
        got = {(r["lang"], r["term"]): (r["texts"], r["times"], r["sources"], r["counts"]) for batch in counts.rows() for r in batch.to_pylist()}
        assert got == {("en", "a"): (4, 6, ["x"], [6]), ("en", "b"): (2, 2, ["x"], [2]), ("en", "c"): (2, 2, ["x"], [2]), ("de", "b"): (2, 2, ["y"], [2])}, limit
