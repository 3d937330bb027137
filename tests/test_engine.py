"""Small cases of the engine's operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemodex.functions import text
from mnemodex.operators import durable, graph, index, nested, projection, relational, search, sectioning
from mnemodex.sources import files
from mnemodex.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_aliases(spark):
    assert one(spark, text.alias_form(F.lit("RecallHTTPServer"))) == "recall http server"
    assert one(spark, text.alias_form(F.lit("  my_old-Name\t"))) == "my old name"
    assert one(spark, text.alias_variants(F.lit("a_b"))) == ["a b", "a-b", "a_b"]


def test_terms_and_excerpts(spark):
    assert one(spark, text.terms(F.lit("Fix the THE src/main.ts, a b!"))) == ["fix", "the", "src/main.ts"]
    assert one(spark, text.match_terms(F.lit("src/main.ts"))) == ["srcmaints"]
    long = " ".join(f"w{i}" for i in range(100))
    assert one(spark, text.excerpt(F.lit(long))) == " ".join(f"w{i}" for i in range(90)) + "..."
    assert one(spark, text.word_tokens(F.lit("a b c"))) == 4


def test_secrets(spark):
    assert one(spark, text.has_secret(F.lit("api_key = 'abcdefghijkl'")))
    assert not one(spark, text.has_secret(F.lit("the password is long")))
    assert one(spark, text.redacted(F.lit("token=abc Bearer xyz"))) == "token=[REDACTED] Bearer [REDACTED]"


def test_markdown_sections(spark):
    df = spark.createDataFrame([("a.md", "intro\n# Intro\nx\n## Usage it\ny"), ("b.md", "  \n")], "path string, text string")
    assert [(r["index"], r.anchor) for r in sectioning.markdown(df).orderBy("index").collect()] == [(0, "file"), (1, "intro"), (2, "usage-it")]


def test_json_and_code_sections(spark):
    df = spark.createDataFrame([("a.json", '{"name": "x", "scripts": {"t": 1}}'), ("b.json", "[1]")], "path string, text string")
    rows = {(r.path, r.anchor): r.content for r in sectioning.json_keys(df).collect()}
    assert rows == {("a.json", "name"): "x", ("a.json", "scripts"): '{"t":1}', ("b.json", "file"): "[1]"}
    df = spark.createDataFrame([("a.ts", "// x\nexport function alpha() {\n}\nconst beta = 1")], "path string, text string")
    assert [(r.anchor, r.start_line, r.end_line) for r in sectioning.code(df).orderBy("index").collect()] == [("file", 1, 1), ("alpha", 2, 3), ("beta", 4, 4)]
    assert sectioning.sections(df).count() == 3


def test_ignore_rules(spark):
    rows = ["a/node_modules/b.js", "x/generated/y.ts", "a.min.js", "yarn.lock", ".env.local", "k.pem", "p.png", "src/a.ts", "tmp/x.ts", "tmp/keep.ts"]
    df = spark.createDataFrame([(r,) for r in rows], "path string").withColumn("reason", files.skip_reason(F.col("path"), ["tmp/*.ts", "!tmp/keep.ts"]))
    assert [r.reason for r in df.collect()] == ["hard_directory", "generated", "minified", "lockfile", "secret", "secret", "binary", None, "vcs_ignore", None]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "src" / "a.ts").write_text("const a = 1")
    for n in "bc":
        (tmp_path / "node_modules" / "x" / n).write_text("1")
    (tmp_path / "src" / "__init__.py").write_text("")
    (tmp_path / ".github").mkdir()
    (tmp_path / ".github" / "_ci.yml").write_text("on: push")
    (tmp_path / "src" / "circle").symlink_to(tmp_path)
    found = files.listing(spark, str(tmp_path))
    assert {r.path: r.content for r in files.contents(spark, str(tmp_path), found.filter("reason is null")).collect()} == {"src/a.ts": b"const a = 1", "src/__init__.py": b"", ".github/_ci.yml": b"on: push"}
    assert {r.path: r.reason for r in found.collect()} == {"src/a.ts": None, "src/__init__.py": None, ".github/_ci.yml": None, "node_modules": "hard_directory"}
    assert {r.reason: r.entries for r in files.diagnostics(found).collect()} == {"read": 3, "hard_directory": 1}
    gone = spark.createDataFrame([("src/left.ts",), ("src/a.ts",)], "path string")
    assert [r.path for r in files.contents(spark, str(tmp_path), gone).collect()] == ["src/a.ts"]
    assert files.listing(spark, str(tmp_path / "nowhere")).count() == 0 and files.ignore_patterns(str(tmp_path)) == ([], [])


def test_wide_and_deep_trees_are_listed_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SPREAD", 4)
    monkeypatch.setattr(files, "BATCH", 3)
    want = set()
    for i in range(3):
        for j in range(3):
            folder = tmp_path / f"a{i}" / f"b{j}" / "c" / "d"
            folder.mkdir(parents=True)
            for k in range(4):
                for name in (f"a{i}/b{j}/c/d/{k}.ts", f"a{i}/b{j}/{k}.ts", f"a{i}/{k}.ts"):
                    (tmp_path / name).write_text(name)
                    want.add(name)
    rows = files.listing(spark, str(tmp_path)).collect()
    assert sorted(r.path for r in rows) == sorted(want) and all(r.size == len(r.path) for r in rows)
    assert {(r.path, r.content.decode()) for r in files.contents(spark, tmp_path.as_uri(), spark.createDataFrame([(r.path,) for r in rows], "path string")).collect()} == {(n, n) for n in want}


def test_manifests(spark):
    rows = [
        ("package.json", json.dumps({"name": "app", "dependencies": {"zod": "1"}, "scripts": {"t": "x"}})),
        ("pyproject.toml", '[project]\nname = "p"\ndependencies = ["numpy>=1", "pandas"]'),
        ("go.mod", "module m\nrequire github.com/a/b v1.0.0\n"),
        ("pom.xml", "<project><artifactId>me</artifactId><dependencies><dependency><artifactId>dep</artifactId></dependency></dependencies></project>"),
        ("Cargo.toml", '[package]\nname = "c"\n[dependencies]\nserde = "1"'),
        ("pubspec.yaml", "name: f\ndependencies:\n  http: ^1\n"),
        ("composer.json", "{broken"),
    ]
    got = {r.path: (r.name, r.dependencies) for r in files.manifests(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"package.json": ("app", ["zod"]), "pyproject.toml": ("p", ["numpy", "pandas"]), "go.mod": ("m", ["github.com/a/b"]), "pom.xml": ("me", ["dep"]), "Cargo.toml": ("c", ["serde"]), "pubspec.yaml": ("f", ["http"]), "composer.json": (None, [])}


def test_walk_and_history(spark):
    rel = spark.createDataFrame([("r1", "a", "b", "active"), ("r2", "b", "c", "active"), ("r3", "c", "a", "active"), ("r4", "a", "d", "superseded")], "id string, subject_id string, object_id string, status string")
    rel = rel.withColumn("predicate", F.lit("p")).withColumn("valid_from", F.lit("2024-01-01").cast("timestamp_ntz"))
    names = spark.createDataFrame([(x, x.upper()) for x in "abcd"], "id string, name string")
    origin = spark.createDataFrame([("a",)], "origin_id string")
    rows = graph.walk(origin, rel, names, depth=9, limit=50).collect()
    assert {(r.entity_id, r.depth) for r in rows} == {("b", 1), ("c", 1), ("b", 2), ("c", 2)}
    dated = rel.withColumns({"valid_to": F.lit("2024-01-05").cast("timestamp_ntz"), "updated_at": F.lit("2024-01-05").cast("timestamp_ntz")})
    assert [(r.relation_id, r.subject_name, r.object_name) for r in graph.history(origin, dated, names).collect()] == [("r4", "A", "D")]
    assert graph.history(origin.limit(0), dated, names).count() == 0


def test_walk_stops_where_the_limit_is_met(spark):
    """Brute force over random graphs with a hub; no step is taken from an origin that has its rows."""
    rng = random.Random(3)
    nodes = [f"n{i:02}" for i in range(25)]
    edges = [(f"r{k}", rng.choice(nodes), rng.choice(nodes), "active") for k in range(30)] + [(f"h{i}", "n00", n, "active") for i, n in enumerate(nodes[1:])]
    rel = spark.createDataFrame(edges, "id string, subject_id string, object_id string, status string").withColumn("predicate", F.lit("p"))
    names = spark.createDataFrame([(n, "x" + n[::-1]) for n in nodes if n != "n07"], "id string, name string")
    ways = [(a, b, r) for r, a, b, _ in edges] + [(b, a, r) for r, a, b, _ in edges]
    want = set()
    for origin in nodes:
        found, front = [], [(origin, (origin,))]
        for depth in range(1, 4):
            front = [(b, (*seen, b), r) for at, seen, *_ in front for a, b, r in ways if a == at and b not in seen]
            found += [(depth, "x" + b[::-1], r, b) for b, _, r in front if b != "n07"]
        want |= {(origin, b, depth, r) for depth, _, r, b in sorted(found)[:6]}
    got = graph.walk(spark.createDataFrame([(n,) for n in nodes], "origin_id string"), rel, names, 3, 6).collect()
    assert {(r.origin_id, r.entity_id, r.depth, r.relation_id) for r in got} == want


def test_budget_skips_and_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 1500), (2, 600), (3, 400)], "id int, cost int")
    assert [r.id for r in search.within_budget(df, "cost", [F.col("id")], 2000).orderBy("id").collect()] == [1, 3]
    df = spark.createDataFrame([(1, 5000), (2, 1)], "id int, cost int")
    assert [r.id for r in search.within_budget(df, "cost", [F.col("id")], 2000).collect()] == [1]
    rng = random.Random(2)
    for budget in (1, 7, 60):
        rows = [(i, rng.randrange(1, 40)) for i in range(400)]
        want, used = [], 0
        for i, n in rows:
            if not want or used + n <= budget:
                want.append(i)
                used += n
        df = spark.createDataFrame(rows, "id int, cost int").repartition(3)
        assert sorted(r.id for r in search.within_budget(df, "cost", [F.col("id")], budget).collect()) == want
    assert [r.id for r in durable.prefix_budget(spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "id int, cost int"), "cost", [F.col("id")], 10).collect()] == [1]


def test_direct_match_ranks_before_weak(spark):
    rows = [("section", 1, "src/a.txt", "app_code", "payment retry payment retry"), ("section", 2, "src/b.txt", "app_code", "payment only"), ("section", 3, "src/c.txt", "app_code", "nothing")]
    df = spark.createDataFrame(rows, "target_type string, id long, path string, source_role string, text string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [r.id for r in search.search(df, "payment retry", 10, "2024-01-02").collect()] == [1, 2]
    assert search.search(df, "!!", 10, "2024-01-02").count() == 0
    assert search.search(df.limit(0), "payment", 10, "2024-01-02").count() == 0


def test_notes(spark, tmp_path):
    batch = spark.createDataFrame([(1, "password: abcdefghijklmn is it"), (2, "too short"), (3, "we always use tabs here"), (4, "we always use tabs here"), (5, "known note of four words"), (6, None)], "id int, text string")
    known = spark.createDataFrame([("known note of four words", False)], "text string, deleted boolean")
    assert [r.outcome for r in durable.judge_notes(batch, known).orderBy("id").collect()] == ["secret", "short", "saved", "duplicate", "duplicate", "short"]
    notes = spark.createDataFrame([("n1", "fact", "one note is here", "h1", 1.0, None, False), ("n2", "fact", "gone", "h2", 1.0, None, True)], durable.NOTE)
    diaries = spark.createDataFrame([("d1", "day", "h1", None, False)], "id string, text string, content_hash string, created_at timestamp, deleted boolean")
    durable.export_notes(notes, diaries, str(tmp_path / "out"))
    known = lambda *rows: spark.createDataFrame(list(rows), "kind string, content_hash string")
    judged = lambda k: {(r.kind, r.id): r.outcome for r in durable.import_notes(spark, str(tmp_path / "out"), k).collect()}
    assert judged(known()) == {("memory", "n1"): "saved", ("diary", "d1"): "saved"}
    assert judged(known(("memory", "h1"))) == {("memory", "n1"): "duplicate", ("diary", "d1"): "saved"}
    notes.write.json(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        durable.import_notes(spark, str(tmp_path / "other"), known())


def test_forgotten_reasons_stay(spark):
    rows = spark.createDataFrame([(1, True, "old"), (2, False, None), (3, None, None)], "id int, deleted boolean, forget_reason string")
    got = {r.id: (r.deleted, r.forget_reason) for r in relational.mark(rows, F.col("id") <= 2, "deleted", "new").collect()}
    assert got == {1: (True, "old"), 2: (True, "new"), 3: (False, None)}


def test_the_index_follows_the_documents(spark):
    rows = [("section", 1, "pay retry pay"), ("section", 2, "retry"), ("memory", 1, "Pay, pay; PAY"), ("memory", 2, ""), ("memory", 3, None)]
    docs = spark.createDataFrame(rows, "target_type string, id long, text string")
    postings, known = index.postings(docs), index.indexed(docs)
    assert {(r.term, r.target_type, r.id): (r.tf, r.size) for r in postings.collect()} == {("pay", "section", 1): (2, 3), ("retry", "section", 1): (1, 3), ("retry", "section", 2): (1, 1), ("pay", "memory", 1): (3, 3)}
    ranks = {(r.target_type, r.id): r["rank"] for r in index.bm25(postings, known, ["pay", "none"]).collect()}
    assert ranks == pytest.approx({(r.target_type, r.id): r["rank"] for r in search.bm25(docs, ["pay", "none"]).collect()})
    changed = docs.filter("target_type <> 'memory' or id <> 1").withColumn("text", F.when(F.col("id") == 2, "new words").otherwise(F.col("text")))
    assert {(r.target_type, r.id): r.state for r in index.outdated(changed, known).collect()} == {("section", 2): "changed", ("memory", 2): "changed", ("memory", 1): "gone"}
    after, listed = index.refresh(changed, postings, known)
    assert sorted(map(str, after.collect())) == sorted(map(str, index.postings(changed).collect())) and sorted(map(str, listed.collect())) == sorted(map(str, index.indexed(changed).collect()))
    assert index.outdated(changed, listed).count() == 0


def test_vectors_of_words_count_while_they_are_fresh(spark):
    docs = spark.createDataFrame([("section", i, f"src/{i}.ts", "app_code", t) for i, t in ((1, "payment"), (2, "payment"), (3, "other"))], "target_type string, id long, path string, source_role string, text string")
    docs = docs.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    v = spark.createDataFrame([("section", 1, [0.0, 1.0]), ("section", 2, [0.0, 1.0]), ("section", 3, [1.0, 0.0])], "target_type string, id long, embedding array<double>")
    text_of = F.when(F.col("id") == 1, "m:old").when(F.col("id") == 2, "m:payment").otherwise("m:other")
    v = v.withColumn("model", F.lit("m")).withColumn("hash", F.sha2(text_of, 256))
    got = {r.id: (r.lexical, r.vector, r.boost) for r in search.retrieve(docs, "payment", 10, "2024-01-02", vectors=v, vector=[0.0, 1.0], model="m").collect()}
    assert got == {1: (1, None, 0), 2: (1, 1.0, 0), 3: (0, 0.5, 0)}
    assert {r.id for r in search.retrieve(docs, "payment", 10, "2024-01-02", vectors=v, vector=[0.0, 1.0], model="x").collect()} == {1, 2}
    boost = lambda results: results.filter("id = 1").select("target_type", "id", F.lit(45).alias("boost"))
    assert [(r.id, r.boost) for r in search.retrieve(docs, "payment", 10, "2024-01-02", graph_of=boost).collect()] == [(1, 45), (2, 0)]
    assert search.retrieve(docs, "!!", 10, "2024-01-02").count() == 0


def test_hash_reuse_and_upsert(spark):
    now = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "path string, size long, mtime long")
    read = spark.createDataFrame([("b", b"y")], "path string, content binary")
    old = spark.createDataFrame([("a", 1, 5, "kept"), ("b", 1, 5, "old")], "path string, size long, mtime long, content_hash string")
    got = {r.path: r.content_hash for r in relational.reuse_hashes(now, old, read).collect()}
    assert got["a"] == "kept" and len(got["b"]) == 64
    current = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, made int")
    changes = spark.createDataFrame([(2, "z", 9), (3, "w", 9)], "k int, v string, made int")
    assert sorted(map(tuple, relational.latest_wins(current, changes, ["k"], keep=["made"]).collect())) == [(1, "x", 1), (2, "z", 1), (3, "w", 9)]
    versions = spark.createDataFrame([(2, "zz", 9, 1), (2, "a", 8, 2), (3, "w", 9, 5)], "k int, v string, made int, version int")
    assert sorted(map(tuple, relational.latest_wins(current, versions, ["k"], "version").collect())) == [(1, "x", 1), (2, "a", 8), (3, "w", 9)]


def test_stream_gives_the_batch_counts(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, events.windowed_counts(df).collect()))


def test_stream_keeps_the_latest(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.keep_latest(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "state" / "v2")).select("user_id", "event_id", "event_type")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, events.latest_by_user(df).collect()))


def test_projection(spark):
    df = spark.createDataFrame([("src/a.ts", "alpha", "symbol"), ("src/a.ts", "alpha", "symbol"), ("b.md", "intro", "heading")], "path string, anchor string, anchor_type string")
    nodes, edges = projection.file_graph(df)
    assert sorted((r.type, r.name) for r in nodes.collect()) == [("file", "b.md"), ("file", "src/a.ts"), ("symbol", "alpha")]
    edge = edges.first()
    ids = {r.name: r.id for r in nodes.collect()}
    assert (edge.subject_id, edge.predicate, edge.object_id) == (ids["src/a.ts"], "defines", ids["alpha"])
    assert sorted((r.node, r.parent, r.depth) for r in projection.taxonomy(df).collect()) == [("b.md", None, 1), ("src", None, 1), ("src/a.ts", "src", 2)]


def test_embeddings_are_reused_by_hash(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None)], "id int, text string")
    vectors = {r.id: r.vector for r in projection.embed(docs).collect()}
    assert sum(x * x for x in vectors[1]) == pytest.approx(1) or not any(vectors[1])
    assert vectors[3] == [0.0] * projection.DIMENSIONS and projection.hash_embedding("one two") == vectors[1]
    listed = {(r.id, r.bucket): r.value for r in projection.hash_vectors(docs).collect()}
    assert listed == {(i, b): pytest.approx(x, abs=1e-6) for i, v in vectors.items() for b, x in enumerate(v) if x}
    stored = docs.filter("id < 3").select("id", F.sha2(F.concat(F.lit("m:"), "text"), 256).alias("hash"))
    changed = docs.filter("id < 3").withColumn("text", F.when(F.col("id") == 2, "new").otherwise(F.col("text"))).unionByName(docs.filter("id = 3"))
    assert {r.id: r.state for r in projection.embedding_work(changed, stored, "m").collect()} == {1: "fresh", 2: "stale", 3: "needs_embedding"}


def test_runs(spark):
    diff = spark.createDataFrame([("a", "added"), ("b", "changed"), ("c", "unchanged"), ("d", "deleted")], "path string, change string")
    got = {m: [r.action for r in projection.plan_run(diff, m).orderBy("path").collect()] for m in ("full", "changed", "resume")}
    assert got == {"full": ["read", "read", "read", "clear"], "changed": ["read", "read", "keep", "clear"], "resume": ["read", "keep", "keep", "clear"]}


def test_tiers_need_no_window_over_all_rows(spark):
    from mnemodex.operators.search import tiers

    none, some, more = (spark.range(a, b).withColumn("x", F.lit(a)) for a, b in ((0, 0), (5, 8), (9, 12)))
    found = tiers(none, some, more)
    assert found.columns == ["id", "x", "tier"] and {(r.id, r.tier) for r in found.collect()} == {(5, 2), (6, 2), (7, 2)}
    assert tiers(none, none).count() == 0
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_standing_decisions(spark):
    rows = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 52), (52, 50), (60, 50), (70, 71), (70, 72), (80, 80), (None, 3)]
    got = {r.id: (r.stands, r.steps) for r in graph.standing(spark.createDataFrame(rows, "old long, new long")).collect() if r.id is not None}
    assert all(got[i] == (40, 40 - i) for i in range(1, 40))
    assert got[50] == got[51] == got[52] == got[60] == (None, None) and got[70] == (72, 1) and 80 not in got
    assert graph.standing(spark.createDataFrame([], "old long, new long")).count() == 0


def test_nested_json(spark):
    deep = '{"a":' * 30 + '"./x.js"' + "}" * 30
    rows = [("1", '{"main":"./m.js","bin":{"a":"./b.js","c":1},"exports":' + deep + "}"), ("2", "[]"), ("3", None), ("4", "no json"), ("5", '{"bin":"./","exports":null,"workspaces":{"packages":["b","a",1]}}'), ("6", '{"exports":["./e.js",["f.js"]]}')]
    docs = spark.createDataFrame(rows, "path string, text string")
    assert sorted(map(tuple, nested.entry_points(docs).collect())) == [("1", "b.js"), ("1", "m.js"), ("1", "x.js"), ("6", "e.js"), ("6", "f.js")]
    assert {r.path: r.globs for r in nested.workspaces(docs).collect()} == {"1": [], "5": ["a", "b"], "6": []}
    props = ['{"origin":"x"}', '{"origin":["x"]}', '{"in":{"origin":"x"}}', '{"origin":"x', None, '"origin"', '{"origin":1}', '{"note":"\\"origin\\":\\"x\\"","origin":"x"}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(props)], "id int, p string")
    assert [r.id for r in df.filter(nested.has_value(F.col("p"), "origin", "x")).orderBy("id").collect()] == [0, 7]


def test_strings_without_a_limit_of_rows_or_levels(spark):
    """A recursive query of Spark fails beyond 1,000,000 rows and 100 levels."""
    lists = "[" + ",".join(["\"./a.js\""] * 50) + "]"
    many = spark.range(25000).select(F.col("id").cast("string").alias("path"), F.lit(f'{{"exports":{{"x":{lists}}}}}').alias("text"))
    v = many.select(F.col("path").alias("id"), F.try_variant_get(F.try_parse_json("text"), "$.exports", "variant").alias("v"))
    assert nested.strings(v).count() == 25000 * 50
    assert nested.entry_points(many).count() == 25000
    values = ['{"a":' * 999 + '"deep"' + "}" * 999, "[" * 1000 + '"m"' + "]" * 1000, "[" * 1001 + '"m"' + "]" * 1001, '["[\\"{",[["z"],1e999,{}],"z"]', "null", '"x"', None]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, t string").select("id", F.try_parse_json("t").alias("v"))
    assert sorted((r.id, r.value) for r in nested.strings(rows).collect()) == [(0, "deep"), (1, "m"), (3, '["{'), (3, "z"), (3, "z"), (5, "x")]
    inner = '{"a":' * 800 + '"deep"' + "}" * 800
    deep = spark.createDataFrame([("p", f'{{"main":{inner},"bin":{{"b":"./b.js"}},"exports":[{inner},"./c.js"]}}')], "path string, text string")
    assert sorted(r.entry for r in nested.entry_points(deep).collect()) == ["b.js", "c.js", "deep"]
