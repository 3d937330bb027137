"""Commits, backups, index segments, groups of vectors and tiers of a store."""

import itertools

import pytest
from pyspark.sql import functions as F

from mnemodex.operators import commits, index, search
from mnemodex.store import Store

NOW = "2024-02-01 00:00:00"


@pytest.fixture
def store(spark, tmp_path):
    name = f"memory_{tmp_path.name}".lower().replace("-", "_")
    yield Store(spark, name, str(tmp_path / "db"))
    spark.sql(f"DROP DATABASE {name} CASCADE")


def notes(spark, *rows):
    return spark.createDataFrame([(i, "fact", t, 3) for i, t in rows], "id string, kind string, text string, importance int")


def test_a_broken_save_leaves_the_old_state_whole(spark, store, monkeypatch):
    store.save(notes(spark, ("a", "payments are retried with a backoff")), NOW)
    before, part = store._last(), Store._part  # parts never change, so the same parts are the same rows
    for at in itertools.count(1, 3):
        calls = itertools.count(1)

        def broken(self, name, rows, at=at, calls=calls):
            if next(calls) == at:
                raise OSError("no space left")
            return part(self, name, rows)

        with monkeypatch.context() as m:
            m.setattr(Store, "_part", broken)
            try:
                store.save(notes(spark, ("b", "the backoff of payments is long")), NOW)
            except OSError:
                assert store._last() == before and [r.id for r in store.read("notes").collect()] == ["a"]
                continue
        break
    assert at > 6 and {r.id for r in store.read("notes").collect()} == {"a", "b"}
    with monkeypatch.context() as m:
        m.setattr(Store, "_last", lambda self, last=Store._last: (last(self)[0], 99 if self._changed else last(self)[1]))
        with pytest.raises(commits.Conflict):
            store.save(notes(spark, ("c", "another writer was faster than this one")), NOW)
    assert {r.id for r in store.read("notes").collect()} == {"a", "b"} and store.log().count() == 2
    named = {p for parts in store._last()[0].values() for p in parts}
    left = {t.name for t in spark.catalog.listTables(store.database)} - {"commits", "outcomes"}
    assert named <= left and not any(t.startswith("judged") for t in left)


def test_outcomes_stay(spark, store):
    first = store.save(notes(spark, ("a", "payments are retried with a backoff"), ("b", "short")), NOW)
    second = store.save(notes(spark, ("c", "payments are retried with a backoff")), NOW)
    assert {r.id: r.outcome for r in first.collect()} == {"a": "saved", "b": "short"} and {r.id: r.outcome for r in second.collect()} == {"c": "duplicate"}


def test_backup_and_restore(spark, store, tmp_path):
    place = str(tmp_path / "backup")
    store.save(notes(spark, ("a", "payments are retried with a backoff")), NOW)
    assert store.backup(place) == 1
    with pytest.raises(ValueError, match="not empty"):
        store.restore_backup(place, NOW)
    store.save(notes(spark, ("b", "the backoff of payments is long")), NOW)
    safety = store.restore_backup(place, NOW, force=True)
    assert [r.id for r in store.read("notes").collect()] == ["a"] and [r.id for r in store.search("backoff", NOW).collect()] == ["a"]
    assert store.restore_backup(safety, NOW, force=True) and {r.id for r in store.search("backoff", NOW).collect()} == {"a", "b"}
    other = Store(spark, store.database + "_2", str(tmp_path / "db2"))
    try:
        assert other.restore_backup(place, NOW) is None and [r.id for r in other.search("backoff", NOW).collect()] == ["a"]
    finally:
        spark.sql(f"DROP DATABASE {other.database} CASCADE")


def test_old_parts_go(spark, store, monkeypatch):
    monkeypatch.setattr("mnemodex.store.KEPT_COMMITS", 2)
    rows = spark.createDataFrame([("r1", 0)], "id string, n int")
    for i in range(5):
        store.write("aliases", rows.select(F.lit(f"e{i}").alias("entity_id"), F.lit("v").alias("value")))
    parts = [t.name for t in spark.catalog.listTables(store.database) if t.name.startswith("aliases")]
    assert len(parts) == 2 and [r.entity_id for r in store.read("aliases").collect()] == ["e4"]


def test_segments_rank_like_an_index_made_anew(spark, store, monkeypatch):
    monkeypatch.setattr(index.to_merge, "__defaults__", (2,))
    texts = {f"n{i}": f"the payment number {i} is retried {'often ' * (i % 4)}with backoff" for i in range(9)}
    for ids in (["n0", "n1", "n2"], ["n3"], ["n4", "n5", "n6", "n7"], ["n8"]):
        store.save(notes(spark, *((i, texts[i]) for i in ids)), NOW)
    store.forget(ids=["n1", "n5"], now=NOW)
    docs = store.documents()
    assert docs.count() == 7 and store.read("gone").count() <= 2
    wanted = ["often", "payment", "4"]
    got = {r.id: round(r["rank"], 9) for r in ranked(store, wanted)}
    assert got == {r.id: round(r["rank"], 9) for r in index.bm25(index.postings(docs), index.indexed(docs), wanted).collect()} and len(got) == 7
    assert sum(r.docs for r in store.read("segments").collect()) == 7 and store.read("segments").count() < 4
    assert store.repair(NOW) == {}


def ranked(store, wanted):
    store._state, store._number = store._last()
    try:
        return store._ranked(wanted).collect()
    finally:
        store._state = None


def test_merges_by_size():
    assert index.to_merge({"a": 3, "b": 3, "c": 3}) == [] and index.to_merge({"a": 3, "b": 3, "c": 1, "d": 2}) == ["a", "b", "c", "d"]
    assert index.to_merge({"a": 100, "b": 3, "c": 5, "d": 15, "e": 9, "f": 4}) == ["c", "d", "e", "f"]


def test_vectors_of_a_model_and_length_are_a_group(spark, store):
    store.save(notes(spark, ("a", "payments are retried with a backoff"), ("b", "the backoff of payments is long")), NOW)
    assert store.embed(lambda t: [float(len(t)), 1.0], "len") == {"reused": 0, "embedded": 2}
    one = store._last()[0]["vectors/len/2"]
    assert store.embed(lambda t: [1.0, 2.0, 3.0], "len") == {"reused": 0, "embedded": 2}
    assert store._last()[0]["vectors/len/2"] == one and store.read("vectors").count() == 4
    store.forget(ids=["a"], now=NOW)
    assert store.embed(lambda t: [float(len(t)), 1.0], "len") == {"reused": 1, "embedded": 0} and store.read("vectors/len/2").count() == 1
    store.save(notes(spark, ("c", "a third note about payments and more")), NOW)
    with pytest.raises(Exception, match="has not 2 numbers but 3"):
        store.embed(lambda t: [1.0, 2.0] if t == "length" else [1.0, 2.0, 3.0], "len")
    assert store.read("vectors/len/2").count() == 1


def test_later_tiers_are_not_made(spark):
    made = []

    def tier(name, rows):
        made.append(name)
        return spark.createDataFrame(rows, "id string")

    found = search.first_with_rows(spark, lambda: tier(1, []), lambda: tier(2, [("x",)]), lambda: tier(3, [("y",)]))
    assert [r.id for r in found.collect()] == ["x"] and made == [1, 2]
    assert search.first_with_rows(spark, lambda: tier(4, [])).count() == 0


def test_forgotten_sections_stay_out(spark, store, tmp_path):
    src = tmp_path / "project"
    src.mkdir()
    (src / "README.md").write_text("# Intro\nthe payment tool\n# Usage\nrun the payment tool\n# More\nread about payment\n")
    store.ingest(str(src), NOW)
    ids = {r.anchor: r.id for r in store.read("sections").collect()}
    assert store.forget(ids=[ids["intro"]], now=NOW, mode="suppress", reason="wrong") == 1 and store.forget(ids=[ids["more"]], now=NOW, mode="hard") == 1
    assert {r.id for r in store.search("payment", NOW).collect()} == {ids["usage"]}
    store.ingest(str(src), NOW, mode="rebuild")
    assert [r.anchor for r in store.read("sections").collect()] == ["usage"]
    assert {(r.anchor, r.reason) for r in store.read("suppressions").collect()} == {("intro", "wrong"), ("more", "forgotten")}
    (src / "README.md").write_text("# Intro\nanother payment tool\n# Usage\nrun the payment tool\n# More\nread about payment\n")
    store.ingest(str(src), NOW)
    assert sorted(r.anchor for r in store.read("sections").collect()) == ["intro", "usage"]


def test_old_stores_open(spark, store):
    old = spark.createDataFrame([("s1", "a.md", "intro", "the payment tool")], "id string, path string, anchor string, content string")
    part = f"{store.database}.sections_old"
    old.write.saveAsTable(part)
    log = spark.createDataFrame([(1, "x", "ingest", 1, [("sections", ["sections_old"])], [])], "number long, id string, kind string, n long, tables array<struct<name:string,parts:array<string>>>, dropped array<string>")
    log.select("number", "id", F.lit(NOW).cast("timestamp").alias("at"), "kind", "n", "tables", "dropped").write.saveAsTable(f"{store.database}.commits")
    assert store.version() == 1 and [(r.id, r.deleted, r.tokens) for r in store.read("sections").collect()] == [("s1", False, None)]
    assert store.migrate(NOW) == ["sections"] and store.version() == len(commits.MIGRATIONS) and store.read("sections").count() == 1
    assert store.repair(NOW) == {"missing": 1} and [r.id for r in store.search("payment", NOW).collect()] == ["s1"]
