"""A project's life: ingest, change, save, search, recall, forget, export and restore."""

from pyspark.sql import functions as F

from mnemodex.store import Store

NOW, LATER = "2024-02-01 00:00:00", "2024-02-02 00:00:00"
NOTES = "id string, kind string, text string, importance int, source string, tags array<string>, supersedes array<string>"


def test_life_of_a_project(spark, tmp_path):
    src = tmp_path / "project"
    (src / "src").mkdir(parents=True)
    (src / "src" / "pay.ts").write_text("export function retry() {\n  // payment retry payment\n}\n")
    (src / "README.md").write_text("# Intro\nhello\n# Usage\nrun the payment tool\n")
    (src / ".env").write_text("secret=1")
    (src / "left.log").write_text("not read")
    (src / ".gitignore").write_text("*.log\n.gitignore\n")
    store = Store(spark, "life_of_a_project", str(tmp_path / "db"))
    try:
        assert store.search("payment", NOW).count() == 0
        assert store.ingest(str(src), NOW) == {"read": 2}
        assert sorted(r.anchor for r in store.read("sections").collect()) == ["intro", "retry", "usage"]
        assert store.ingest(str(src), NOW) == {"keep": 2}
        (src / "README.md").write_text("# Only\nthe payment tool, at length\n")
        assert store.ingest(str(src), NOW) == {"read": 1, "keep": 1}
        assert sorted(r.anchor for r in store.read("sections").collect()) == ["only", "retry"]
        assert {(r.type, r.name) for r in store.read("entities").collect()} == {("module", "src"), ("module", "."), ("file", "src/pay.ts"), ("file", "README.md")}
        rows = [
            ("n1", "constraint", "payment calls must never be retried twice", 5, "src/pay.ts", None, None), ("n2", "fact", "too short", 1, None, None, None),
            ("n3", "fact", "password = abcdefghijklmnop is it", 1, None, None, None), ("n4", "decision", "we retry with a backoff see `src/pay.ts`", 3, None, None, None),
        ]
        notes = spark.createDataFrame(rows, NOTES)
        assert {r.id: r.outcome for r in store.save(notes, NOW).collect()} == {"n1": "saved", "n2": "short", "n3": "secret", "n4": "saved"}
        assert {r.outcome for r in store.save(notes.filter("id = 'n1'"), NOW).collect()} == {"duplicate"}
        edges = {(r.predicate, r.status) for r in store.read("relations").filter("predicate <> 'contains'").collect()}
        assert edges == {("applies_to", "active"), ("concerns", "active")}
        assert "n1" in {r.id for r in store.search("payment retried", NOW).collect()}
        recalled = store.recall("fix the payment retry", NOW).collect()
        assert recalled and sum(r.cost for r in recalled) <= 2000
        warm = store.warm_up(NOW).collect()
        assert [r.ref for r in warm if r.part == "guidance"] == ["n1", "n4"] and sum(r.part == "module" for r in warm) == 2

        newer = spark.createDataFrame([("n5", "decision", "we never retry payments at all", 3, "src/pay.ts", None, ["n4"])], NOTES)
        store.save(newer, LATER)
        old = store.read("relations").filter("predicate = 'concerns' and status = 'superseded'").collect()
        assert len(old) == 1 and [r.relation_id for r in store.history([old[0].object_id]).collect()] == [old[0].id]

        diary = spark.createDataFrame([("diary_1", "session", "the backoff was tried and failed", ["retry"], ["src/x.ts"], []), ("diary_2", None, "no", [], [], [])], "id string, subject string, summary string, tags array<string>, added array<string>, changed array<string>")
        assert {r.id: r.accepted for r in store.save_diary(diary, NOW).collect()} == {"diary_1": True, "diary_2": False}
        assert "diary_1" in {r.id for r in store.search("backoff tried", NOW).collect()}
        assert "diary_1" not in {r.id for r in store.recall("backoff tried", NOW).collect()} and "diary_1" in {r.id for r in store.recall("history of the backoff tried", NOW).collect()}

        assert store.embed(lambda t: [float(len(t)), 1.0], "len") == {"reused": 0, "embedded": 6}
        assert store.embed(lambda t: [float(len(t)), 1.0], "len") == {"reused": 6, "embedded": 0}
        assert store.search("payment", NOW, vector=[1.0, 0.0], model="len").count() == 6

        store.export(str(tmp_path / "out"))
        assert store.forget("retried", LATER) == 1 and store.forget("retried", LATER) == 0
        assert "n1" not in {r.id for r in store.search("payment retried", NOW).collect()}
        assert store.read("relations").filter("predicate = 'applies_to'").count() == 0
        assert store.restore(str(tmp_path / "out"), dry_run=True) == {"saved": 0, "skipped": 4}
        assert store.forget(ids=["diary_1"], now=LATER, mode="hard") == 1 and store.read("diaries").count() == 0
        assert store.forget(ids=["n5"], now=LATER, mode="suppress", reason="wrong") == 1
        assert {r.id: (r.suppressed, r.forget_reason) for r in store.read("notes").collect()}["n5"] == (True, "wrong")
        assert store.restore(str(tmp_path / "out")) == {"saved": 1, "skipped": 3}
        assert "diary_1" in {r.id for r in store.search("backoff tried", NOW).collect()}
        assert store.forget(ids=[old[0].id], now=LATER) == 1

        (src / "README.md").unlink()
        assert store.ingest(str(src), NOW) == {"clear": 1, "keep": 1}
        assert store.ingest(str(src), NOW, mode="rebuild") == {"read": 1}
        counts = {r.name: r.n for r in store.status().collect()}
        assert counts["files"] == 1 and counts["diaries"] == 1 and counts["events"] >= 8
    finally:
        spark.sql("DROP DATABASE life_of_a_project CASCADE")


def test_what_is_saved_has_a_vector(spark, tmp_path):
    def count_letters(text: str) -> list[float]:
        return [float(sum(text.lower().count(c) for c in group)) + 0.1 for group in ("pay", "xq", "mn")]

    src = tmp_path / "project"
    src.mkdir()
    (src / "README.md").write_text("# Intro\nhello\n")
    store = Store(spark, "own_vectors", str(tmp_path / "db"), embedder=count_letters, model="letters")
    try:
        store.ingest(str(src), NOW)
        assert store.read("vectors/letters/3").count() == 1
        rows = [("n1", "fact", "xxxx qqqq xxxx qqqq", 3, None, None, None), ("n2", "fact", "pay pay yap yap", 3, None, None, None)]
        store.save(spark.createDataFrame(rows, NOTES), NOW)
        diary = spark.createDataFrame([("d1", None, "nothing but mmmm and nnnn here", [], [], [])], "id string, subject string, summary string, tags array<string>, added array<string>, changed array<string>")
        store.save_diary(diary, NOW)
        before = {r.id: r.hash for r in store.read("vectors/letters/3").collect()}
        assert len(before) == 4 and {r.kind for r in store.log().collect()} >= {"memory_saved", "diary_entry_saved", "ingest_changed"}
        store.save_diary(diary.withColumn("summary", F.substring("summary", 1, 25)), LATER)
        after = {r.id: r.hash for r in store.read("vectors/letters/3").collect()}
        assert len(after) == 4 and {i for i in after if after[i] != before[i]} == {"d1"}
        # No word is shared: the request's own vector finds it.
        assert [r.id for r in store.search("xqxq", NOW, limit=1).collect()] == ["n1"]
        said = store.answer("why was xqxq replaced, see README.md", NOW).collect()
        assert [r.line.split(":")[0] for r in said if r.part == "brief"] == ["Quality", "Inspect first", "Evidence", "Relations"]
        assert {r.ref for r in said if r.part == "memory"} >= {"memory:n1"} and {r.line for r in said if r.part == "graph"} and not [r for r in said if r.part == "history"]
        # A vector that went missing comes back with the next run, though no file has changed.
        store.write("vectors/letters/3", store.read("vectors/letters/3").filter("id <> 'n2'"))
        assert store.ingest(str(src), NOW) == {"keep": 1} and {r.id: r.hash for r in store.read("vectors/letters/3").collect()} == after
    finally:
        spark.sql("DROP DATABASE own_vectors CASCADE")
