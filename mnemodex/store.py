"""A project's memory as tables of one database, changed by commits: ingest files, save and forget notes and diaries, search, recall, warm up, export, back up.

A table is made of parts that never change. A commit is one row of a log that names the parts of every table it changed, so a change of many tables is seen whole or not
at all, and whoever reads goes on with the state they began with. Parts that the last commits don't name any more are dropped. The log also stands for the events. The text index is
made of segments: a change adds a segment and tombstones, and a search reads only the postings of its terms.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemodex.functions import scores, text
from mnemodex.operators import answers, commits, durable, graph, index, modules, projection, relational, search, sectioning
from mnemodex.session import ship
from mnemodex.sources import files

SCHEMAS = {
    "files": "path string, size long, mtime long, content_hash string",
    "sections": "id string, path string, index int, anchor string, content string, content_hash string, tokens long, source_role string, updated_at timestamp, deleted boolean, suppressed boolean, forget_reason string",
    "suppressions": "path string, anchor string, content_hash string, reason string, created_at timestamp",
    "notes": durable.NOTE + ", importance int, source string, tags array<string>, suppressed boolean, forget_reason string",
    "diaries": "id string, subject string, summary string, tags array<string>, text string, content_hash string, created_at timestamp, deleted boolean, suppressed boolean, forget_reason string",
    "entities": "id string, type string, name string, summary string, path string",
    "aliases": "entity_id string, value string",
    "relations": "id string, subject_id string, predicate string, object_id string, status string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, updated_at timestamp_ntz, superseded_by string",
    "postings": "segment string, bucket int, term string, target_type string, id string, tf int, size int",
    "indexed": "segment string, target_type string, id string, text_hash string, size int",
    "gone": "segment string, target_type string, id string, size int",
    "segments": "segment string, docs long, size long",
    "vectors": "target_type string, id string, model string, hash string, embedding array<float>",
}
#: Parts of dropped states that are kept: those of the last commits. Parts of a table that are made one.
KEPT_COMMITS, MOST_PARTS = 8, 16


def _pinned(method: Callable) -> Callable:
    """All that the method reads is of one commit."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        if self._state is not None:
            return method(self, *args, **kwargs)
        self._state, self._number = self._last()
        try:
            return method(self, *args, **kwargs)
        finally:
            self._state = None

    return run


def _change(method: Callable) -> Callable:
    """What the method writes becomes visible in one commit after it has ended, or never."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        if self._changed is not None:
            return method(self, *args, **kwargs)
        self._state, self._number = self._last()
        self._changed, self._new, self._said = {}, [], None
        before = {name: list(parts) for name, parts in self._state.items()}
        try:
            out = method(self, *args, **kwargs)
            if self._changed or self._said:
                self._commit(before)
            return out
        except BaseException:
            for part in self._new:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{part}")
            raise
        finally:
            self._state = self._changed = None

    return run


class Store:
    """With an ``embedder`` (any function from a text to a list of numbers; its ``model`` names it) whatever is read or saved gets its vector in the same commit,
    and requests are embedded by it, too; without, vectors come from ``embed`` and with the requests."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None, embedder: Callable[[str], list[float]] | None = None, model: str = "own") -> None:
        self.spark, self.database, self.embedder, self.model = spark, database, embedder, model
        ship(spark)
        self._state: dict[str, list[str]] | None = None
        self._changed: dict[str, list[str]] | None = None
        place = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")

    # Commits ------------------------------------------------------------------------------------

    def log(self) -> DataFrame:
        """The commits so far (see ``operators.commits``)."""
        name = f"{self.database}.commits"
        if not self.spark.catalog.tableExists(name):
            return self.spark.createDataFrame([], commits.LOG)
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _last(self) -> tuple[dict[str, list[str]], int]:
        log = self.log()
        number = log.agg(F.lit("").alias("name"), F.array().cast("array<string>").alias("parts"), F.coalesce(F.max("number"), F.lit(0)).alias("number"))
        rows = commits.state(log).unionByName(number).collect()  # a row for each table, and the last number
        return {r.name: list(r.parts) for r in rows if r.name}, next(r.number for r in rows if not r.name)

    def _commit(self, before: dict[str, list[str]]) -> None:
        at, kind, n = self._said or (None, "change", 0)
        number, own = self._number + 1, uuid.uuid4().hex
        if self._last()[1] != self._number:
            raise commits.Conflict(f"commit {number} of {self.database} has been made by another writer")
        dropped = sorted({p for parts in before.values() for p in parts} - {p for parts in self._state.values() for p in parts})
        row = (number, own, kind, n, [(name, parts) for name, parts in sorted(self._changed.items())], dropped)
        rows = self.spark.createDataFrame([row], "number long, id string, kind string, n long, tables array<struct<name:string,parts:array<string>>>, dropped array<string>")
        rows.select("number", "id", F.lit(at).cast("timestamp").alias("at"), "kind", "n", "tables", "dropped").coalesce(1).write.mode("append").saveAsTable(f"{self.database}.commits")
        if self.log().filter((F.col("number") == number) & (F.col("id") < own)).count():
            raise commits.Conflict(f"commit {number} of {self.database} has been made by another writer")
        # Parts that were written on the way only, and those of states that are old enough.
        named = {p for parts in self._state.values() for p in parts}
        recent = self.log().filter(F.col("number") > number - KEPT_COMMITS - 4)
        for part in [p for p in self._new if p not in named] + [r.part for r in commits.droppable(recent, KEPT_COMMITS).collect()]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{part}")

    def _event(self, now: str, kind: str, n: int) -> None:
        """What the commit to come is, in the log."""
        self._said = (now, kind, n)

    def _part(self, name: str, rows: DataFrame) -> str:
        """Write one part of a table. Postings are parted by bucket and sorted by term."""
        base = name.split("/")[0]
        fields = self.spark.createDataFrame([], SCHEMAS[base]).schema
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        part = f"{base}_{uuid.uuid4().hex}"
        self._new.append(part)
        if base == "postings":
            rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").saveAsTable(f"{self.database}.{part}")
        else:
            rows.write.saveAsTable(f"{self.database}.{part}")
        return part

    def _set(self, name: str, parts: list[str]) -> None:
        self._changed[name] = parts
        self._state[name] = parts
        if not parts:
            del self._state[name]

    def _parts(self, parts: list[str], base: str) -> DataFrame:
        rows = [commits.upgraded(self.spark.table(f"{self.database}.{p}"), base, SCHEMAS[base]) for p in parts]
        return functools.reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], SCHEMAS[base])

    @_pinned
    def read(self, name: str) -> DataFrame:
        """A table at the last commit (within a change: as changed so far). ``postings`` and other tables in groups are those of all groups."""
        if name == "events":
            return self.log().select("at", F.col("kind").alias("event_type"), "n")
        parts = [p for key, parts in sorted(self._state.items()) if key == name or key.startswith(name + "/") for p in parts]
        return self._parts(parts, name.split("/")[0])

    @_change
    def write(self, name: str, rows: DataFrame) -> None:
        """A table's new rows, in place of all it had."""
        self._set(name, [self._part(name, rows)])

    @_change
    def append(self, name: str, rows: DataFrame) -> None:
        """More rows of a table. Many small parts are made one."""
        parts = [*self._state.get(name, []), self._part(name, rows)]
        self._set(name, parts)
        if len(parts) > MOST_PARTS:
            self.write(name, self.read(name))

    @_pinned
    def version(self) -> int:
        """The version that all stored parts have (see ``commits.MIGRATIONS``). Older ones are read as the latest."""
        columns: dict[str, list[list[str]]] = {}
        for name, parts in self._state.items():
            columns.setdefault(name.split("/")[0], []).extend(self.spark.table(f"{self.database}.{p}").columns for p in parts)
        return commits.version(columns)

    @_change
    def migrate(self, now: str) -> list[str]:
        """Write the parts that are of an older version anew; returns the names of their tables."""
        old = [name for name, parts in self._state.items() if any(self.spark.table(f"{self.database}.{p}").columns != self._parts([], name.split("/")[0]).columns for p in parts)]
        for name in sorted(old):
            self.write(name, self._parts(self._state[name], name.split("/")[0]))
        if old:
            self._event(now, "migrated", len(old))
        return sorted(old)

    def _empty(self) -> bool:
        return not any(self._state.get(name) and not self.read(name).isEmpty() for name in ("sections", "notes", "diaries"))

    @_pinned
    def backup(self, path: str) -> int:
        """Copy the state of the last commit to ``path``, which must not exist; returns the commit's number. The list of tables is written last, so a copy that broke off isn't one."""
        for name in sorted(self._state):
            self._parts(self._state[name], name.split("/")[0]).write.parquet(f"{path}/{name}")
        listed = [(name, self._number) for name in sorted(self._state)]
        self.spark.createDataFrame(listed, "name string, number long").coalesce(1).write.json(f"{path}/tables")
        return self._number

    @_change
    def restore_backup(self, path: str, now: str, force: bool = False) -> str | None:
        """Make a backup the state of a new commit. A store that isn't empty refuses, unless ``force``; then its own state is backed up first, and the copy's place returned."""
        listed = [r.name for r in self.spark.read.schema("name string, number long").json(f"{path}/tables").collect()]
        safety = None
        if not self._empty():
            if not force:
                raise ValueError(f"the memory {self.database} is not empty")
            safety = f"{path.rstrip('/')}-before-{uuid.uuid4().hex}"
            self.backup(safety)
        for name in [n for n in self._state if n not in listed]:
            self._set(name, [])
        for name in listed:
            self.write(name, self.spark.read.parquet(f"{path}/{name}"))
        self._event(now, "restored", len(listed))
        return safety

    # Files --------------------------------------------------------------------------------------

    @_change
    def ingest(self, root: str, now: str, mode: str = "changed", patterns: list[str] = (), nested: bool = False) -> dict[str, int]:
        """Bring sections, graph and index up to date with the files under ``root``; returns how many paths were read, cleared and kept.

        Hashes of files whose size and time are as before are reused, and only the other files are opened. In mode ``rebuild`` all stored sections go first.
        Code is cut at lines that declare or, with ``nested``, by its symbols.
        """
        repository, own = files.ignore_patterns(root)
        listed = files.listing(self.spark, root, [*repository, *patterns], own).filter("reason is null").drop("reason")
        before = self.read("files")
        known = relational.unhashed(listed, before)
        opened = files.contents(self.spark, root, known.filter("content_hash is null"))
        self.write("files", relational.reuse_hashes(listed, before, opened))  # the snapshot that all that follows goes by
        actions = projection.plan_run(relational.snapshot_diff(before, self.read("files")), mode)
        done = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}
        if mode == "changed" and not done.get("read") and not done.get("clear"):
            if self.embedder:  # vectors that are missing or of another text are made good all the same
                self.embed(self.embedder, self.model, now)
            return done
        chosen = files.contents(self.spark, root, actions.filter("action = 'read'")).select("path", F.decode("content", "UTF-8").alias("text"))
        new = sectioning.sections(chosen, nested).withColumn("source_role", text.source_role(F.col("path"))).withColumn("updated_at", F.lit(now).cast("timestamp"))
        old, before = self.read("sections"), self._live_sections()
        kept = old.limit(0) if mode == "rebuild" else relational.without(old, actions.filter("action <> 'keep'"), ["path"])
        # What has been suppressed or deleted is remembered before its rows go, and stays out if it comes again.
        self.append("suppressions", relational.new_suppressions(relational.without(old, kept, ["id"]), self.read("suppressions")))
        new = relational.unsuppressed(new, self.read("suppressions")).withColumns({"deleted": F.lit(False), "suppressed": F.lit(False), "forget_reason": F.lit(None).cast("string")})
        self.write("sections", kept.select(old.columns).unionByName(new.select(old.columns)))
        self._graph_of_files(now)
        told = ["target_type", "id", F.sha2("text", 256).alias("h")]
        now_live, key = self._live_sections(), ["target_type", "id", "h"]
        left = relational.without(before.select(*told), now_live.select(*told), key)
        added = relational.without(now_live.select(*told, "text"), before.select(*told), key)
        self._index(added.select("target_type", "id", "text"), left)
        if self.embedder:
            self.embed(self.embedder, self.model, now)
        self._event(now, f"ingest_{mode}", done.get("read", 0))
        return done

    def _graph_of_files(self, now: str) -> None:
        """Modules and files as entities, in place of those of the run before; what notes have added stays."""
        nodes, edges = modules.module_graph(relational.active(self.read("sections"), "deleted", "suppressed"))
        at = F.lit(now).cast("timestamp_ntz")
        edges = edges.withColumns({"status": F.lit("active"), "confidence": F.lit(1.0), "valid_from": at, "updated_at": at, "valid_to": F.lit(None).cast("timestamp_ntz"), "superseded_by": F.lit(None).cast("string")})
        entities, relations = self.read("entities"), self.read("relations")
        mine = entities.filter("type not in ('module', 'file')").select("id", "type", "name", "summary", "path")
        self.write("entities", mine.unionByName(nodes.withColumn("summary", F.lit(None).cast("string"))))
        forms = F.array_distinct(F.transform(text.path_aliases(F.col("path")), text.alias_form))
        names = nodes.select(F.col("id").alias("entity_id"), F.explode(forms).alias("value")).filter("value <> ''")
        own = self.read("aliases").join(mine.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        self.write("aliases", own.unionByName(names).distinct())
        others = relations.filter("predicate <> 'contains'").select(*relations.columns)
        self.write("relations", others.unionByName(edges.select(*relations.columns)))

    # Index and vectors --------------------------------------------------------------------------

    def _index(self, added: DataFrame, left: DataFrame | None = None) -> None:
        """A segment of the documents ``added`` (target_type, id, text), and tombstones for what they replace and for ``left`` (target_type, id).

        Work follows these documents: other segments are read by key only, and merged when there are many of their size.
        """
        keys = added.select(*index.KEY) if left is None else added.select(*index.KEY).unionByName(left.select(*index.KEY))
        sizes = {r.segment: [r.docs, r.size] for r in self.read("segments").collect()}
        dead = index.tombstones(self.read("indexed"), self.read("gone"), keys)
        lost = dead.groupBy("segment").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("size")).collect() if sizes else []  # a row for each segment
        part = self._part("gone", dead) if lost else ""
        for r in lost:
            sizes[r.segment] = [sizes[r.segment][0] - r.docs, sizes[r.segment][1] - r.size]
            self._set(f"gone/{r.segment}", [*self._state.get(f"gone/{r.segment}", []), part])
        name = uuid.uuid4().hex
        listed = self._part("indexed", index.indexed(added).withColumn("segment", F.lit(name)))
        docs, size = self._parts([listed], "indexed").agg(F.count(F.lit(1)), F.sum("size")).first()
        if docs:
            self._set(f"indexed/{name}", [listed])
            self._set(f"postings/{name}", [self._part("postings", index.postings(added).withColumn("segment", F.lit(name)))])
            sizes[name] = [docs, size or 0]
        for empty in [n for n, (docs, _) in sizes.items() if not docs]:
            self._forget_segment(empty, sizes)
        while names := index.to_merge({n: docs for n, (docs, _) in sizes.items()}):
            self._merge(names, sizes)
        self.write("segments", self.spark.createDataFrame([(n, *x) for n, x in sizes.items()], SCHEMAS["segments"]))

    def _forget_segment(self, name: str, sizes: dict[str, list[int]]) -> None:
        for table in ("postings", "indexed", "gone"):
            if f"{table}/{name}" in self._state:
                self._set(f"{table}/{name}", [])
        del sizes[name]

    def _merge(self, names: list[str], sizes: dict[str, list[int]]) -> None:
        name, gone = uuid.uuid4().hex, self._gone(names)
        for table in ("postings", "indexed"):
            rows = self._parts([p for n in names for p in self._state.get(f"{table}/{n}", [])], table)
            self._set(f"{table}/{name}", [self._part(table, index.merged(rows, gone, names, name))])
        both = [sum(sizes[n][i] for n in names) for i in (0, 1)]
        for n in names:
            self._forget_segment(n, sizes)
        sizes[name] = both

    def _gone(self, names: list[str]) -> DataFrame:
        """The tombstones of some segments. A part may hold those of several."""
        parts = sorted({p for n in names for p in self._state.get(f"gone/{n}", [])})
        return self._parts(parts, "gone").filter(F.col("segment").isin(names)).distinct()

    def _ranked(self, wanted: list[str]) -> DataFrame:
        rows = self.read("segments").collect()
        names = [r.segment for r in rows]
        return index.bm25_segments(self.read("postings"), self._gone(names), sum(r.docs for r in rows), sum(r.size for r in rows), wanted)

    @_change
    def repair(self, now: str) -> dict[str, int]:
        """Bring the index up to date with all documents, whatever it lacks; returns how many were missing, changed and gone."""
        docs = self.documents()
        work = index.outdated(docs, index.live(self.read("indexed"), self.read("gone").distinct()))
        counted = {r.state: r["count"] for r in work.groupBy("state").count().collect()}
        if counted:
            self._index(docs.join(work.filter("state <> 'gone'"), index.KEY, "left_semi").select(*index.KEY, "text"), work)
            self._event(now, "repaired", sum(counted.values()))
        return counted

    @_change
    def embed(self, embedder, model: str, now: str | None = None) -> dict[str, int]:
        """Vectors of all documents that have none of this model, length and text; returns how many were embedded and reused.

        The vectors of a model and length are a group of their own, and no other group is read or written. Vectors of documents that are gone or have
        changed leave the group. A vector of another length is an error.
        """
        length = len(embedder("length"))
        group = f"vectors/{model}/{length}"
        docs, stored = self.documents(), self.read(group)
        digest = F.sha2(F.concat(F.lit(model + ":"), "text"), 256)
        entries = docs.select("target_type", "id", "text", digest.alias("hash"))
        work = projection.reconcile(entries, stored)
        stays = relational.without(stored, work, ["target_type", "id"])
        due = entries.join(work.filter("state <> 'orphaned'").select(*index.KEY), index.KEY, "left_semi")
        new = self._vectors(due, embedder, model, length)
        counted = {r.state: r["count"] for r in work.groupBy("state").count().collect()}
        reused = stored.count() - counted.get("changed", 0) - counted.get("orphaned", 0)
        embedded = counted.get("missing", 0) + counted.get("changed", 0)
        if counted:
            self.write(group, stays.select(stored.columns).unionByName(new.select(stored.columns)))
            self._event(now, "embedded", embedded)
        return {"reused": reused, "embedded": embedded}

    @staticmethod
    def _vectors(due: DataFrame, embedder, model: str, length: int) -> DataFrame:
        """``due`` (target_type, id, text, hash) with vectors; one of another length is an error."""
        new = projection.embed(due, embedder).withColumn("model", F.lit(model)).withColumnRenamed("vector", "embedding")
        wrong = F.raise_error(F.concat(F.lit(f"a vector of {model} has not {length} numbers but "), F.size("embedding").cast("string")))
        return new.withColumn("embedding", F.when(F.size("embedding") == length, F.col("embedding")).otherwise(wrong))

    def _embed_saved(self, saved: DataFrame) -> None:
        """Vectors of what has been saved (target_type, id, text), if the store has an embedder. Other documents are not read, other vectors only if one is replaced."""
        if not self.embedder:
            return
        length = len(self.embedder("length"))
        group = f"vectors/{self.model}/{length}"
        stored = self.read(group)
        new = self._vectors(saved.withColumn("hash", F.sha2(F.concat(F.lit(self.model + ":"), "text"), 256)), self.embedder, self.model, length).select(stored.columns)
        if stored.join(saved.select(*index.KEY), index.KEY, "left_semi").isEmpty():
            self.append(group, new)
        else:
            self.write(group, relational.without(stored, saved, index.KEY).select(stored.columns).unionByName(new))

    # Notes --------------------------------------------------------------------------------------

    @_change
    def save(self, batch: DataFrame, now: str) -> DataFrame:
        """Save notes (id, kind, text, importance, and source, tags and supersedes, if there are such columns); returns (id, outcome): saved, duplicate, short or secret.

        A saved note is searched at once, and becomes a node of the graph with edges to what it names; a decision supersedes the decisions it lists.
        """
        for name, kind in (("source", "string"), ("tags", "array<string>"), ("supersedes", "array<string>")):
            if name not in batch.columns:
                batch = batch.withColumn(name, F.lit(None).cast(kind))
        known = self.read("notes")
        outcome = durable.judge_notes(batch, known).withColumnRenamed("outcome", "_outcome")
        rows = batch.join(outcome, "id").withColumns({
            "content_hash": F.sha2("text", 256), "confidence": scores.importance(F.col("importance")), "created_at": F.lit(now).cast("timestamp"),
            "deleted": F.lit(False), "suppressed": F.lit(False), "forget_reason": F.lit(None).cast("string"),
        })
        judged = self._judged("judged", rows)
        saved = judged.filter("_outcome = 'saved'")
        self.append("notes", saved.select(known.columns))
        notes = saved.select("id", "kind", "source", F.lit(None).cast("string").alias("subject"), "tags", F.col("text").alias("content"), F.lit(None).cast("string").alias("summary"))
        by = saved.filter("kind = 'decision'").select(text.identifier("ent", F.lit("memory"), F.col("id")).alias("decision_id"), F.explode("supersedes").alias("old"))
        by = by.select("decision_id", text.identifier("ent", F.lit("memory"), F.col("old")).alias("subject_id"))
        self._project(notes, now, by.join(self.read("entities").select(F.col("id").alias("subject_id")), "subject_id", "left_semi"))
        added = saved.select(F.lit("memory").alias("target_type"), "id", "text")
        self._index(added)
        self._embed_saved(added)
        self._event(now, "memory_saved", saved.count())
        return self._outcomes(judged.select("id", F.col("_outcome").alias("outcome"), F.lit(None).cast("boolean").alias("accepted"))).select("id", "outcome")

    def _judged(self, name: str, rows: DataFrame) -> DataFrame:
        """A batch as a table of this change alone: it is read again after what it was judged by has changed."""
        part = f"{name}_{uuid.uuid4().hex}"
        self._new.append(part)
        rows.write.saveAsTable(f"{self.database}.{part}")
        return self.spark.table(f"{self.database}.{part}")

    def _outcomes(self, rows: DataFrame) -> DataFrame:
        """The outcomes of one batch, added to those of all batches, which stay whatever comes after."""
        batch = uuid.uuid4().hex
        rows.withColumn("batch", F.lit(batch)).write.mode("append").saveAsTable(f"{self.database}.outcomes")
        return self.spark.table(f"{self.database}.outcomes").filter(F.col("batch") == batch)

    def _project(self, notes: DataFrame, now: str, superseded: DataFrame | None = None) -> None:
        nodes, edges = graph.project_notes(notes, self.read("aliases"), now)
        entities, relations, names = self.read("entities"), self.read("relations"), self.read("aliases")
        forms = F.array_distinct(F.transform(F.array_compact(F.concat(F.array("id", F.concat(F.when(F.col("kind") == "diary", "diary#").otherwise("memory#"), "id"), F.col("subject"), F.col("source")), F.coalesce("tags", F.array().cast("array<string>")))), text.alias_form))
        node = text.identifier("ent", F.when(F.col("kind") == "diary", "diary").otherwise("memory"), F.col("id"))
        own = notes.select(node.alias("entity_id"), F.explode(forms).alias("value")).filter("value <> ''")
        edges = edges.withColumns({"valid_to": F.lit(None).cast("timestamp_ntz"), "superseded_by": F.lit(None).cast("string")}).select(relations.columns)
        after = relational.without(relations, edges, ["id"]).select(relations.columns).unionByName(edges)
        if superseded is not None:
            after = graph.supersede(after, superseded, now)
        self.write("relations", after)
        nodes = nodes.select("id", "type", "name", "summary", F.lit(None).cast("string").alias("path"))
        self.write("entities", relational.without(entities, nodes, ["id"]).select(entities.columns).unionByName(nodes))
        self.append("aliases", relational.without(own.distinct(), names, ["entity_id", "value"]))

    @_change
    def save_diary(self, rows: DataFrame, now: str) -> DataFrame:
        """Save diary entries (id, subject, summary, tags, added, changed); returns (id, accepted)."""
        entries = durable.diary_entry(rows, now).withColumns({"deleted": F.lit(False), "suppressed": F.lit(False), "forget_reason": F.lit(None).cast("string")})
        judged, known = self._judged("judged", entries), self.read("diaries")
        fine = judged.filter("accepted")
        self.write("diaries", relational.without(known, fine, ["id"]).select(known.columns).unionByName(fine.select(known.columns)))
        self._project(fine.select("id", F.lit("diary").alias("kind"), F.lit(None).cast("string").alias("source"), "subject", "tags", F.lit(None).cast("string").alias("content"), "summary"), now)
        added = fine.select(F.lit("diary").alias("target_type"), "id", "text")
        self._index(added)
        self._embed_saved(added)
        self._event(now, "diary_entry_saved", fine.count())
        return self._outcomes(judged.select("id", F.lit(None).cast("string").alias("outcome"), "accepted")).select("id", "accepted")

    def _targets(self) -> DataFrame:
        part = lambda name, kind: self.read(name).select(F.lit(kind).alias("target_type"), "id", "text", "created_at", "deleted", "suppressed", "forget_reason")
        return part("notes", "memory").unionByName(part("diaries", "diary"))

    @_change
    def forget(self, query: str = "", now: str = "", reason: str = "forgotten", ids: list[str] = (), mode: str = "soft") -> int:
        """Forget notes, diaries and sections by id, or the newest ten active notes and diaries that hold a term of ``query``: soft, suppress or hard. Returns how many.

        Their nodes leave the graph, and they leave the index. Sections that were forgotten stay out when their files are read again, as long as their content
        is the same. Ids of relations are invalidated, whatever the mode.
        """
        chosen = durable.resolve(self._targets(), search.query_terms(query, 8), list(ids))
        sections = self.read("sections").withColumn("target_type", F.lit("section"))
        chosen = chosen.unionByName(sections.filter(F.col("id").isin(list(ids))).select("target_type", "id"))
        chosen = self.spark.createDataFrame(chosen.collect(), "target_type string, id string")  # ten rows, or the ids given
        edges = self.read("relations").filter(F.col("id").isin(list(ids))).select("id")
        n = chosen.count() + edges.count()
        if not n:
            return 0
        for name, kind in (("notes", "memory"), ("diaries", "diary")):
            rows = self.read(name)
            if not self._chosen(chosen, kind):
                continue
            after = durable.forget_targets(rows.withColumn("target_type", F.lit(kind)), chosen, mode, reason)
            self.write(name, after.select(rows.columns))
        if self._chosen(chosen, "section"):
            if mode == "hard":  # the rows go, so they are remembered now
                hit = durable.forget_targets(sections, chosen, "suppress", reason)
                self.append("suppressions", relational.new_suppressions(hit.join(chosen, ["target_type", "id"], "left_semi"), self.read("suppressions")))
            self.write("sections", durable.forget_targets(sections, chosen, mode, reason).drop("target_type"))
        entities, relations = graph.delete_notes(self.read("entities"), graph.invalidate(self.read("relations"), edges, now), chosen.select("id", F.col("target_type").alias("type")))
        self.write("relations", relations)
        self.write("entities", entities)
        self._index(self.documents().limit(0), chosen)
        self._event(now, f"memory_{mode}", n)
        return n

    @staticmethod
    def _chosen(chosen: DataFrame, kind: str) -> bool:
        return not chosen.filter(F.col("target_type") == kind).isEmpty()

    def _live_sections(self) -> DataFrame:
        live = relational.active(self.read("sections"), "deleted", "suppressed")
        return live.select(F.lit("section").alias("target_type"), "id", "path", "source_role", F.col("content").alias("text"), "updated_at")

    @_pinned
    def documents(self) -> DataFrame:
        """What can be searched: sections, notes and diaries that are neither deleted nor suppressed."""
        s = self._live_sections()
        none = F.lit(None).cast("string")
        live = relational.active(self._targets(), "deleted", "suppressed")
        return s.unionByName(live.select("target_type", "id", none.alias("path"), none.alias("source_role"), "text", F.col("created_at").alias("updated_at")))

    @_pinned
    def _found(self, query: str, now: str, limit: int, mode: str, vector: list[float] | None, model: str) -> DataFrame:
        wanted = search.index_terms(query)
        if not wanted:
            return search.retrieve(self.documents(), query, limit, now, mode)
        entities, relations, names = self.read("entities"), self.read("relations"), self.read("aliases")

        def boosted(results: DataFrame) -> DataFrame:
            mapped = graph.map_results(results.withColumn("anchor", F.lit(None).cast("string")), names)
            around = graph.context_of(self._direct(query), mapped, relations, entities)
            met = around.select(F.col("origin_id").alias("entity_id")).unionByName(around.select("entity_id"))
            both = mapped.select(F.struct("target_type", "id").alias("result_id"), "entity_id")
            return graph.boosts(both, met).select("result_id.*", "boost")

        near = self.read(f"vectors/{model}/{len(vector)}") if vector else None
        return search.retrieve(self.documents(), query, limit, now, mode, self._ranked(wanted), near, vector, model, boosted)

    @_pinned
    def search(self, query: str, now: str, limit: int = 10, mode: str = "search", vector: list[float] | None = None, model: str = "") -> DataFrame:
        """(target_type, id, path, lexical, score): the first that has any of the retrieval tier, the index with what its rows belong to, and the newest notes and diaries that hold a term.

        A tier is computed only if those before it have nothing. Without a ``vector`` the store's embedder, if any, makes the request's.
        """
        columns = ["target_type", "id", "path", "lexical", "score"]
        wanted = search.index_terms(query)
        if vector is None and self.embedder and wanted:
            vector, model = self.embedder(query), self.model

        def by_index() -> DataFrame:
            rows = search.index_rows(self._ranked(wanted), self.documents(), self.read("notes"), self._targets(), limit)
            return search.by_index(rows, query, limit, now, mode).select(*columns)

        def by_words() -> DataFrame:
            live = relational.active(self._targets(), "deleted", "suppressed").select("target_type", "id", "text", F.col("created_at").alias("updated_at"), F.lit(1.0).alias("confidence"))
            return search.by_words(live, query, limit, now, mode).select(*columns)

        tiers = [by_words] if not wanted else [lambda: self._found(query, now, limit, mode, vector, model).select(*columns), by_index, by_words]
        return search.first_with_rows(self.spark, *tiers)

    @_pinned
    def recall(self, task: str, now: str, budget: int = 2000, vector: list[float] | None = None, model: str = "") -> DataFrame:
        """The best rows for a task that fit the budget, with their excerpts."""
        found = self.search(task, now, 20, "recall", vector, model)
        rows = self.documents().select("target_type", "id", "text").join(F.broadcast(found), ["target_type", "id"])
        rows = rows.withColumn("excerpt", text.excerpt(F.col("text"))).drop("text").withColumn("cost", F.greatest(F.lit(1), F.ceil(F.length("excerpt") / 4)).cast("long"))
        return search.within_budget(rows, "cost", [F.desc("score"), F.col("target_type"), F.col("id")], budget)

    def _direct(self, query: str) -> DataFrame:
        """(entity_id, position): the four entities that a request names best."""
        direct = graph.search_entities(self.read("entities"), self.read("aliases"), search.query_terms(query), 4)
        return direct.select(F.col("id").alias("entity_id"), (-F.col("score")).cast("int").alias("position"))

    @_pinned
    def answer(self, task: str, now: str, budget: int = 2000, sources: bool = False, vector: list[float] | None = None, model: str = "") -> DataFrame:
        """(part, position, ref, line, score): a brief, what to inspect first, what ``recall`` finds, and the relations around it; those that held only if the task asks for history."""
        recalled = self.recall(task, now, budget, vector, model)
        few = self.spark.createDataFrame(recalled.collect(), recalled.schema)  # they fit the budget
        entities, relations, names, direct = self.read("entities"), self.read("relations"), self.read("aliases"), self._direct(task)
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), *index.KEY))
        mapped = graph.map_results(few.withColumn("position", place).withColumn("anchor", F.lit(None).cast("string")), names)
        origins = direct.select(F.col("entity_id").alias("origin_id")).unionByName(mapped.select(F.col("entity_id").alias("origin_id"))).distinct()
        past = graph.history(origins, relations, entities)
        if not re.search(text.bounded(text.INTENTS["needs_history"]), task.lower()):
            past = past.limit(0)
        return answers.answer(few, graph.context_of(direct, mapped, relations, entities), past, sources)

    @_pinned
    def warm_up(self, now: str, budget: int = 2000) -> DataFrame:
        """(part, position, ref, line, cost): guidance, highlights and modules of the project, within a budget."""
        return modules.warm_up(self.documents(), self.read("sections"), relational.active(self.read("notes"), "deleted", "suppressed"), now, budget)

    @_pinned
    def history(self, ids: list[str], limit: int = 10) -> DataFrame:
        origins = self.spark.createDataFrame([(i,) for i in ids], "origin_id string")
        return graph.history(origins, self.read("relations"), self.read("entities"), limit)

    @_pinned
    def export(self, path: str, include_inactive: bool = False) -> None:
        durable.export_notes(self.read("notes"), self.read("diaries"), path, include_inactive)

    @_change
    def restore(self, path: str, dry_run: bool = False) -> dict[str, int]:
        """Take in the rows of an export that are not known; returns how many were saved and skipped, or would be."""
        known = self.read("notes").select(F.lit("memory").alias("kind"), "content_hash").unionByName(self.read("diaries").select(F.lit("diary").alias("kind"), "content_hash"))
        judged = durable.import_notes(self.spark, path, known)
        counted = {r.outcome: r["count"] for r in judged.groupBy("outcome").count().collect()}
        if not dry_run and counted.get("saved"):
            judged = self._judged("judged", judged)
            for name, kind in (("notes", "memory"), ("diaries", "diary")):
                rows = judged.filter((F.col("outcome") == "saved") & (F.col("kind") == kind)).select(F.from_json("payload", SCHEMAS[name]).alias("p")).select("p.*")
                self.append(name, rows)
                self._index(rows.filter("not coalesce(deleted, false) and not coalesce(suppressed, false)").select(F.lit(kind).alias("target_type"), "id", "text"))
            self._event(None, "memory_imported", counted["saved"])
        return {"saved": counted.get("saved", 0), "skipped": counted.get("duplicate", 0)}

    @_pinned
    def status(self) -> DataFrame:
        live = lambda name: relational.active(self.read(name), "deleted", "suppressed")
        return relational.counts(sections=self.read("sections"), files=self.read("files"), notes=live("notes"), diaries=live("diaries"), events=self.read("events"), entities=self.read("entities"), relations=self.read("relations"), vectors=self.read("vectors"))
