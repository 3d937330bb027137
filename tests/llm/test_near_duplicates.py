"""SimHash, passages and vectors against brute force, and their odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from mnemodex.llm import passages, simhash
from mnemodex.llm.components import connected_components
from mnemodex.llm.near_vectors import near_vectors
from mnemodex.llm.words import hashed_words

VOCABULARY = [f"w{i}" for i in range(3000)]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_links_within_a_block():
    rng = np.random.default_rng(1)
    f = rng.integers(-(2**63), 2**63 - 1, 200)
    f = np.concatenate([f, f[:60] ^ (1 << 5), f[:40] ^ (7 << 20), f[:20] ^ (15 << 3), [0, 1, 3, 7, 15]])
    for radius in range(4):
        i, j = simhash.links_within(f, radius)
        want = {(a, b) for a in range(len(f)) for b in range(a + 1, len(f)) if bin((int(f[a]) ^ int(f[b])) & (2**64 - 1)).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    assert got == {n: c for n, c in want.items() if n != c}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    rows = []
    for i in range(40):
        base = words(rng, 200)
        rows.append((i * 3, " ".join(base)))
        if i % 3 == 0:
            near = list(base)
            near[rng.randrange(200)] = "other"
            rows.append((i * 3 + 1, "  ".join(near).upper()))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "é É"), (906, "a\x0bb"), (None, "One"), (903, "One"), (907, "x " * 30_000), (908, "\x1fa\xa0b")]
    return rows


def test_simhash(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "node": F.lit(1), "component": F.lit(2)})
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(texts)
    prints = {t: slow_fingerprint(t) for _, t in texts}
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{prints[t]:016x}") for i, t in texts)
    ids = sorted({i for i, _ in texts if i is not None})
    by_id = {i: prints[t] for i, t in texts if i is not None}
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and bin(by_id[a] ^ by_id[b]).count("1") <= 3])
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert {r.component_id for r in got if r.doc_id is None} == {903}


def test_a_bucket_in_parts_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_BUCKET", 16)
    rng = random.Random(7)
    fps = {rng.getrandbits(16) << 40 | 5 for _ in range(60)} | {1 << b for b in range(50)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.fingerprint_edges(df)).collect()}
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3])
    assert got == {n: c for n, c in want.items() if n != c}


def jaccard_links(rows, size=5, similarity=0.8):
    sets = []
    for _, text in rows:
        w = text.encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return [(a, b) for a in range(len(rows)) for b in range(a) if (not sets[a] and not sets[b]) or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))]


@pytest.fixture(scope="module")
def similar_rows():
    rng = random.Random(41)
    rows = []
    for k in range(70):
        base = words(rng, rng.randrange(40, 300))
        rows.append(base)
        for _ in range(rng.randrange(4)):
            near = list(base)
            for i in rng.sample(range(len(base)), max(1, int(len(base) * rng.choice([0.005, 0.01, 0.02, 0.03, 0.05])))):
                near[i] = rng.choice(VOCABULARY)
            rows.append(near)
    chain = words(rng, 200)
    for i in range(12):  # neighbours are similar, ends are not
        rows.append(chain[4 * i :] + [f"c{j}" for j in range(4 * i)])
    texts = [" ".join(r) for r in rows] + ["", " ", "One two", "one TWO", "x " * 3000, "x " * 2999]
    return [(i, t) for i, t in enumerate(texts)] + [(500 + i, t) for i, t in enumerate(texts[:5])]


def test_similar_documents_against_brute_force(spark, similar_rows, monkeypatch):
    df = spark.createDataFrame(similar_rows, "doc_id long, text string").withColumns({"h": F.lit("clash"), "bucket": F.lit(1)})
    links = jaccard_links(similar_rows)
    label = components(range(len(similar_rows)), links)
    want = {similar_rows[n][0]: similar_rows[c][0] for n, c in label.items()}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert got == want
    for limit, value in (("HOT_BUCKET", 4), ("HOT_SIZE", 500)):
        with monkeypatch.context() as small:
            small.setattr(simhash, limit, value)
            assert {r.doc_id: r.component_id for r in simhash.similar_documents(df.repartition(5)).collect()} == want


def test_recall_of_similar_pairs(spark):
    """Pairs from 0.8 on, each by itself: nearly all are found, and none below."""
    rng, rows = random.Random(43), []
    for k in range(400):
        base = words(rng, 200)
        near = list(base)
        for i in rng.sample(range(200), rng.randrange(1, 8)):
            near[i] = rng.choice(VOCABULARY)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    want = {a for a, b in jaccard_links(rows)}
    got = {r.doc_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.component_id != r.doc_id}
    assert got <= want and len(got) >= 0.98 * len(want) and 200 < len(want) < 395


def test_distances_at_any_radius():
    rng = np.random.default_rng(44)
    f = rng.integers(-(2**63), 2**63 - 1, 130)
    f = np.concatenate([f, f[:60] ^ rng.integers(0, 2**18, 60), [0, -1]])
    for radius in (5, 8, 20, 31, 63):
        i, j = simhash.links_within(f, radius)
        want = {(a, b) for a in range(len(f)) for b in range(a + 1, len(f)) if bin((int(f[a]) ^ int(f[b])) & (2**64 - 1)).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_keep_one(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"gone": F.lit(True), "twice": F.lit(1)})
    kept = simhash.keep_one(df).collect()
    named = [r.doc_id for r in kept if r.doc_id is not None]
    want = {r.component_id for r in simhash.similar_documents(df).collect()} | {900}
    assert sorted(named) == sorted(want) and sum(r.doc_id is None for r in kept) == 1


def test_hubs_are_joined_apart(spark, monkeypatch):
    import mnemodex.llm.components as module

    monkeypatch.setattr(module, "HUB_ROWS", 5)
    monkeypatch.setattr(module, "HUB_SHARE", 40)
    rng = random.Random(45)
    edges = [(0, i) for i in range(1, 60)] + [(70, i) for i in range(71, 120)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in components({x for e in edges for x in e}, edges).items() if n != c}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0
    assert passages.repeated_passages(docs).count() == 0
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_passages(spark):
    rng = random.Random(3)
    p, q = words(rng, 60), words(rng, 80)
    fuzzy = list(q)
    for i in range(7, 80, 11):
        fuzzy[i] = f"zz{i}"
    longer = q[:30] + ["q1", "q2", "q3"] + q[30:50] + q[52:]
    rows = [
        (1, " ".join(words(rng, 100) + p + words(rng, 50))), (2, "\n".join(words(rng, 10) + p).upper()), (3, " ".join(q + words(rng, 300))), (4, " ".join(words(rng, 30) + fuzzy + words(rng, 20))),
        (5, " ".join(words(rng, 33) + longer)), (6, " ".join(words(rng, 400))), (7, " ".join(words(rng, 5) + p[:40] + words(rng, 5))), (8, None), (None, " ".join(p)), (9, ""), (10, "a " * 20_000),
    ]
    rows += [(i, rows[5][1]) for i in range(20, 60)] + [rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "source": F.lit("s"), "words": F.lit(2)})
    found = passages.repeated_passages(df)
    got = {(r.doc_id, r.start_word, r.n_words, r.source_id) for r in found.collect()}
    assert {g for g in got if g[0] < 20} == {(2, 10, 60, 1), (4, 30, 80, 3), (5, 33, 81, 3)}
    assert {g[0] for g in got if g[0] >= 20} == set(range(20, 60)) and all(g[2] == 400 for g in got if g[0] >= 20)
    left = {r.doc_id: r.text for r in passages.remove_passages(df, found).collect()}
    assert len(left[2].split()) == 10 and len(left[4].split()) == 50 and left[6] == rows[5][1] and left[30] == "" and left[8] is None
    assert passages.remove_passages(df, found).columns == df.columns and passages.remove_passages(df, found).count() == len(rows)


def seeds(*texts):
    """The seeds of each text with their places."""
    import pyarrow as pa

    _, h, sizes = next(hashed_words(pa.array(texts)))
    seed, owner, place, *_ = passages._marks(h, sizes)
    return [dict(zip(seed[owner == i].tolist(), place[owner == i].tolist())) for i in range(len(texts))]


def test_words_of_a_block_are_those_of_the_texts(monkeypatch):
    import pyarrow as pa

    import mnemodex.llm.words as module

    rng = random.Random(12)
    parts = ["a", "B", "Word", "WORD", " ", "  ", "\n", "é", "\x0b", "\x1c", "\xa0", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)] + ["", None, "x" * 50]
    for block in (module.BLOCK, 16):
        monkeypatch.setattr(module, "BLOCK", block)
        seen, n = {}, 0
        for first, h, sizes in hashed_words(pa.array(texts).slice(2)):
            for size, text in zip(sizes.tolist(), texts[2 + first :]):
                split = (text or "").encode().lower().split()
                assert len(split) == size
                assert all(seen.setdefault(w, x) == x for w, x in zip(split, h.tolist()))
                h, n = h[size:], n + 1
        assert n == len(texts) - 2 and len(set(seen.values())) == len(seen)


def test_shared_runs_have_a_shared_seed():
    rng = random.Random(11)
    shared = words(rng, passages.SPAN + passages.WINDOW - 1)
    for _ in range(50):
        a, b = seeds(*(" ".join(words(rng, rng.randrange(0, 40)) + shared + words(rng, rng.randrange(0, 40))) for _ in range(2)))
        assert set(a) & set(b)
    for r in range(5):  # every fifth word differs
        a, b = seeds(*(" ".join(f"other{k}{i}" if i % 5 == r else f"w{i}" for i in range(60)) for k in range(2)))
        assert len(set(a) & set(b)) >= 2


def test_seeds_follow_their_words():
    """What is said of a seed depends on its own text alone, up to its end."""
    import pyarrow as pa

    rng = random.Random(13)
    texts = [" ".join(words(rng, rng.randrange(0, 90))) for _ in range(60)]
    _, h, sizes = next(hashed_words(pa.array(texts)))
    together = list(zip(*(c.tolist() for c in passages._marks(h, sizes))))
    apart = []
    for i, text in enumerate(texts):
        for _, h, sizes in hashed_words(pa.array([text])):
            apart += [(s, i, *rest) for s, _, *rest in zip(*(c.tolist() for c in passages._marks(h, sizes)))]
    assert sorted(together) == sorted(apart)


def test_packed_columns_come_back():
    rng = np.random.default_rng(14)
    for n in (1, 7, 3000):
        columns = [rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-5, 300, n), np.zeros(n, np.uint64)]
        back = passages._unblob(passages._blob(*columns), ["u8", "i8", "i8", "u8"])
        assert all((a == b).all() for a, b in zip(columns, back))


def test_long_gaps_are_aligned_without_a_table(monkeypatch):
    rng = np.random.default_rng(15)
    for _ in range(30):
        x, y = rng.integers(0, 6, rng.integers(0, 40)), rng.integers(0, 6, rng.integers(0, 40))
        monkeypatch.setattr(passages, "TABLE", 1 << 20)
        whole = passages._common(x, y)
        monkeypatch.setattr(passages, "TABLE", 8)
        assert passages._common(x, y).sum() == whole.sum()


def brute_force(rows, least, similar):
    """Pairs (doc, source) that share words in order at one distance, ``least`` of them at ``similar``: all pairs of documents, all distances."""
    split, out = {i: t.split() for i, t in rows}, set()
    for i, x in split.items():
        for j, y in split.items():
            if j >= i:
                continue
            at = {}
            for p, w in enumerate(x):
                at.setdefault(w, []).append(p)
            distances = {}
            for q, w in enumerate(y):
                for p in at.get(w, ()):
                    distances.setdefault(p - q, []).append(p)
            for places in distances.values():
                places.sort()
                for s in range(len(places)):
                    e = s + int(similar * least) - 1
                    while e < len(places) and (i, j) not in out:
                        size = places[e] - places[s] + 1
                        if size >= least and e - s + 1 >= similar * size:
                            out.add((i, j))
                        e += 1
    return out


@pytest.mark.parametrize("low, high", [(0.8, 0.85), (0.85, 0.9), (0.9, 0.99), (1.0, 1.0)])
def test_passages_against_brute_force(spark, low, high):
    rng = random.Random(int(low * 100))
    rows = []
    for k in range(60):
        n = rng.randrange(55, 75)
        shared = words(rng, n)
        fuzzy = list(shared)
        for i in rng.sample(range(1, n - 1), int(round(n * (1 - rng.uniform(low, high))))):
            fuzzy[i] = f"zz{k}-{i}"
        rows += [(2 * k, " ".join(words(rng, 40) + shared + words(rng, 30))), (2 * k + 1, " ".join(words(rng, 25) + fuzzy + words(rng, 45)))]
    want = brute_force(rows, 50, 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.source_id) for r in passages.repeated_passages(df).collect()}
    assert len(want) >= 30 and got <= want and len(got) >= (1 if low == 1 else 0.95) * len(want)


@pytest.mark.parametrize("n", [50, 51, 52, 55, 60])
def test_equal_passages_of_frequent_seeds(spark, n):
    """Earlier documents hold a part of a passage each, so that all its seeds are frequent; two later ones hold all of it."""
    rng, rows, want = random.Random(n), [], set()
    for k in range(8):
        shared, third = words(rng, n), n // 3
        for i in range(27):
            part = shared[(i % 3) * third : (i % 3) * third + third + 8]
            rows.append((1000 * k + i, " ".join(words(rng, rng.randrange(20)) + part + words(rng, rng.randrange(5, 20)))))
        rows += [(1000 * k + 900 + i, " ".join(words(rng, rng.randrange(9)) + shared + words(rng, rng.randrange(9)))) for i in range(2)]
        want.add((1000 * k + 901, 1000 * k + 900))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.source_id): r for r in passages.repeated_passages(df).collect()}
    assert want <= set(found) and all(found[pair].n_words >= n for pair in want)


def test_what_is_found_does_not_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(17)
    lines, rows = [words(rng, 12) for _ in range(8)], []
    for i in range(150):
        rows.append((i, " ".join(words(rng, 20) + sum(rng.sample(lines, rng.randrange(7)), []) + words(rng, 20))))
    halves = words(rng, 90)
    rows += [(300, " ".join(halves[:45] + words(rng, 30))), (301, " ".join(words(rng, 30) + halves[45:])), (302, " ".join(words(rng, 9) + halves)), (303, " ".join(halves + words(rng, 9)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(passages.repeated_passages(df.repartition(1)).collect())
    assert {(r.source_id, r.n_words) for r in want if r.doc_id == 303} == {(302, 90)}
    monkeypatch.setattr(passages, "CHUNK", 900)
    monkeypatch.setattr(passages, "HEAVY", 8)
    assert sorted(passages.repeated_passages(df.repartition(7)).collect()) == want
    monkeypatch.setattr(passages, "HEAVY", 0)  # every seed is a heavy key
    assert sorted(passages.repeated_passages(df.repartition(3, "doc_id")).collect()) == want


def test_rows_of_one_id_keep_their_own_passages(spark):
    rng = random.Random(18)
    p, q = words(rng, 70), words(rng, 90)
    rows = [(1, " ".join(p)), (2, " ".join(q)), (5, " ".join(["begin", *p])), (5, " ".join([*words(rng, 40), *q])), (5, " ".join(["begin", *p])), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(df)
    assert {(r.doc_id, r.start_word, r.n_words, r.source_id) for r in found.collect()} == {(5, 1, 70, 1), (5, 40, 90, 2)} and found.count() == 2
    left = sorted((r.text for r in passages.remove_passages(df, found).filter("doc_id = 5").collect()), key=len)
    assert left[:3] == ["short", "begin ", "begin "] and len(left[3].split()) == 40


def test_chains_are_the_best_in_order():
    d, a, n = (np.array(x) for x in ([0, 20, 40, 5], [0, 20, 40, 90], [10, 10, 10, 10]))
    assert passages.chain(d, a, n, np.array([14, 14, 14, 14]))[0] == [0, 1, 2]
    rng = random.Random(4)
    for _ in range(30):
        m = 7
        d, a, n = (np.array([rng.randrange(40) for _ in range(m)]), np.array([rng.randrange(40) for _ in range(m)]), np.array([rng.randrange(1, 8) for _ in range(m)]))
        w = n + 4.0
        best = w.copy()
        for i in np.argsort(d, kind="stable"):
            for j in range(m):
                if d[j] + n[j] <= d[i] and a[j] + n[j] <= a[i]:
                    best[i] = max(best[i], w[i] + best[j] - passages.GAP_COST * (d[i] - d[j] - n[j] + a[i] - a[j] - n[j]))
        one = passages.chain(d, a, n, w)[0]
        got = sum(w[one]) - sum(passages.GAP_COST * (d[y] - d[x] - n[x] + a[y] - a[x] - n[x]) for x, y in zip(one, one[1:]))
        assert got == pytest.approx(best.max())


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.vstack([centres[i % 12] + rng.normal(size=16) * (0.05 + 0.02 * (i % 5)) for i in range(150)] + [rng.normal(size=(60, 16))])
    x[40] = x[41] = x[42]
    x[43] = x[42] * 3
    rows = [(int(i), v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [float("inf")] + [1.0] * 15), (504, []), (505, [None] + [1.0] * 15), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (42, rows[42][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("class", F.lit("clash"))
    got = near_vectors(df, 0.95).collect()
    assert len(got) == len(rows)
    fine = [(k, i, np.array(v)) for k, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(k, m) for k, _, v in fine for m, _, u in fine if k != m and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.95]
    label = components([(rows[k][0], k) for k in range(len(rows))], [((rows[a][0], a), (rows[b][0], b)) for a, b in links])
    want = sorted((rows[k][0], sum(a == k for a, _ in links), label[rows[k][0], k][0]) for k in range(len(rows)))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_over_several_cells_and_blocks(spark, monkeypatch):
    import mnemodex.llm.near_vectors as module

    monkeypatch.setattr(module, "CELL", 20)
    monkeypatch.setattr(module, "BLOCK_BYTES", 32 * 64)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=8) + np.zeros((25, 8)) for _ in range(8)]) + rng.normal(size=(200, 8)) * 0.15
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    label = components(range(200), list(zip(*np.nonzero(g))))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df, 0.95).collect()) == [(i, int(g[i].sum()), int(label[i])) for i in range(200)]


def test_pivots_fit_the_vectors(monkeypatch):
    """Grouped vectors are copied little, however many there are; where no bound excludes anything there is one cell."""
    import mnemodex.llm.near_vectors as module

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(300, 32))
    radius = float(np.sqrt(0.1))

    def copies(x, n):
        x = module._unit(x)
        pivots = module.choose_pivots(x[:4096], n, radius)
        return len(pivots), module._reach(x @ pivots.T, module._apart(pivots), radius)[1].sum() / len(x)

    for size in (50_000, 200_000, 800_000):
        k, n = copies(centres[rng.integers(0, 300, 6000)] + rng.normal(size=(6000, 32)) * 0.15, size)
        assert k > 8 and n < 2.5
    assert copies(rng.normal(size=(6000, 64)), 800_000) == (1, 1.0)


def test_passages_put_together_from_frequent_lines(spark):
    rng = random.Random(21)
    lines = [words(rng, 12) for _ in range(6)]
    rows = []
    for _ in range(15):  # all neighbouring lines, in many earlier documents
        rows += [(len(rows) + i, " ".join(words(rng, 40) + a + b + words(rng, 40))) for i, (a, b) in enumerate(zip(lines, lines[1:]))]
    shared = sum(lines, [])
    rows += [(200 + i, " ".join(words(rng, 30 + i) + shared + words(rng, 30))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)  # a chunk each
    got = {(r.doc_id, r.start_word, r.n_words) for r in passages.repeated_passages(df).collect() if r.similarity == 1}
    assert got == {(200 + i, 30 + i, 72) for i in range(1, 12)}


@pytest.mark.parametrize("block", [8192, 40])
def test_fuzzy_passages_of_frequent_seeds(spark, monkeypatch, block):
    """Lines and neighbouring lines are in many earlier documents, the whole in three later ones, each with other words changed."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng, rows, want = random.Random(77), [], set()
    for k in range(5):
        lines, at = [words(rng, 12) for _ in range(6)], 1000 * k
        for n in range(75):
            a = n % 5
            rows.append((at + n, " ".join(words(rng, 40) + lines[a] + lines[a + 1] + words(rng, 40))))
        for n in range(3):
            fuzzy = sum(lines, [])
            for i in range(6 + 2 * n, 70, 14):
                fuzzy[i] = f"zz{k}-{n}-{i}"
            rows.append((at + 900 + n, " ".join(words(rng, 30 + n) + fuzzy + words(rng, 30))))
        want |= {at + 901, at + 902}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in found if r.source_id % 1000 >= 900 and r.n_words >= 50} == want == {r.doc_id for r in found}
    for heavy in (3, 0):  # some seeds, or all, are heavy keys
        monkeypatch.setattr(passages, "HEAVY", heavy)
        assert sorted(passages.repeated_passages(df.repartition(3, "doc_id")).collect()) == sorted(found)


def test_windows_against_all_pairs(monkeypatch):
    """Whatever passage of 50 words or more lies around the seed of two windows: a link, or all its words within earlier passages."""
    rng = np.random.default_rng(5)
    base = rng.integers(2, 255, (6, 107))
    window = base[rng.integers(0, 6, 180)]
    window = np.where(rng.random(window.shape) < rng.choice([0.0, 0.05, 0.15, 0.5], (180, 1)), rng.integers(2, 255, window.shape), window)
    mixed_up = rng.integers(0, 107, 180)
    window = np.where(np.arange(107) < mixed_up[:, None], base[rng.integers(0, 6, 180)], window)
    window[:, 50:57] = 9
    window[::9, :20] = window[4::9, 80:] = 0
    window, doc = window.astype(np.uint8), np.arange(180)
    for drive in ("small", "large"):
        one = passages._Reach(window, doc, np.zeros(180, np.int64), 50, 0.8)
        one.small(np.zeros(180, np.int64), np.full(180, 180)) if drive == "small" else one.large(doc, doc)
        links = {(int(a), int(b)) for t, s in one.found for a, b in zip(t, s)}
        assert all(a > b for a, b in links)
        for t in range(180):
            for s in range(t):
                equal = (window[t] == window[s]) & (window[t] > 0)
                sums = np.append(0, np.cumsum(np.where(window[t] == 0, 0, np.where(equal, 1, -4))))
                low, high = 50 - sums[50::-1].argmin(), 50 + sums[50:].argmax()
                if high - low >= 50 and (t, s) not in links:
                    outside = np.append(equal[: one.low[t]], equal[one.high[t] :]).sum()
                    assert one.low[t] <= low and high <= one.high[t] or outside <= 4 and one.low[t] < one.high[t]


def test_fuzzy_passages_of_little_more_than_fifty_words_have_two_shared_seeds():
    rng = random.Random(31)
    for changed in (8, 10):
        for _ in range(100):
            shared = words(rng, 55)
            fuzzy = list(shared)
            for i in rng.sample(range(55), changed):
                fuzzy[i] = f"zz{i}"
            a, b = seeds(*(" ".join(words(rng, 30) + x + words(rng, 30)) for x in (shared, fuzzy)))
            assert len(set(a) & set(b)) >= 2


def test_two_seeds_reach_the_alignment():
    found = passages._candidates(*(np.array(c) for c in ([9, 9], [4, 4], [40, 52], [10, 22], [0, 0]))).to_pylist()
    assert [(r["doc"], r["source"], r["x_from"], r["y_from"]) for r in found] == [(9, 4, 0, 0)]


def test_alignment_extends_short_stretches():
    rng = np.random.default_rng(8)
    least, similar = 50, 0.8

    def found(equal):
        """What is reported of a passage between other words, with a chain over its longest equal run."""
        x, y = np.arange(200), np.arange(200) + 1000
        y[60 : 60 + len(equal)] = np.where(equal, x[60 : 60 + len(equal)], 5000)
        runs = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(int), [0]])))
        s, e = max(zip(runs[::2], runs[1::2]), key=lambda r: r[1] - r[0])
        return passages.align(x, y, [60 + int(s)], [60 + int(s)], [int(e - s)], least, similar)

    one = np.ones(51, bool)
    one[3] = False
    assert [(s, n) for s, n, _, _ in found(one)] == [(60, 51)]
    assert [(s, n) for s, n, _, _ in found(np.append(np.ones(45, bool), [False, True] * 5))] == [(60, 55)]
    assert found(np.ones(49, bool)) == [] and found(np.append(np.ones(39, bool), np.append(np.zeros(12, bool), True))) == []
    for _ in range(200):
        equal = rng.random(int(rng.integers(50, 64))) < 0.86
        equal[[0, -1]] = True
        got = found(equal)
        n = len(equal)
        sums = np.append(0, np.cumsum(equal))
        there = any(equal[s] and equal[e - 1] and sums[e] - sums[s] >= similar * (e - s) for s in range(n) for e in range(s + least, n + 1))
        assert bool(got) == there and all(m >= least and share >= similar for _, m, _, share in got)


def test_repeats_within_documents_make_one_chain_a_pair(spark, monkeypatch):
    """A line that documents repeat over and over: its places are linked in order, not each with the first one."""
    rng = random.Random(41)
    line = words(rng, 11)
    texts = [words(rng, 20) + line * (60 + 3 * i) + words(rng, 20) for i in range(20)]
    h = np.array([xxh64_intdigest(w) for t in texts for w in t], np.uint64)
    seed, owner, *rest = passages._marks(h, np.array([len(t) for t in texts]))
    assert passages._candidates(*passages._linked(seed, owner, *rest)).num_rows <= 20 * len(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(passages.repeated_passages(df).collect())
    for i in range(1, 20):  # all that is repeated is found
        hit = np.zeros(len(texts[i]), bool)
        for r in found:
            if r.doc_id == i:
                hit[r.start_word : r.start_word + r.n_words] = True
        assert hit[20:-20].all()
    monkeypatch.setattr(passages, "HEAVY", 0)
    assert sorted(passages.repeated_passages(df.repartition(3)).collect()) == found
