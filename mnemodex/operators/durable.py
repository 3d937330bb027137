"""Durable notes: what may be saved, forgetting, export and import, guidance, warm-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemodex.functions import scores, text
from mnemodex.operators import relational

NOTE = "id string, kind string, text string, content_hash string, confidence double, created_at timestamp, deleted boolean"


def judge_notes(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(id, outcome): secret, short, duplicate or saved, for each note (id, text) of a batch.

    A secret is looked for first, then four words are asked for; an active known note, or an earlier
    one of the batch, with the same text makes a duplicate.
    """
    words = F.size(text.words(F.coalesce("text", F.lit(""))))
    rows = batch.withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("_bad", F.when(F.coalesce(text.has_secret(F.col("text")), F.lit(False)), "secret").when(words < 4, "short"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_h", F.col("_bad").isNull()).orderBy("id")))
    seen = relational.active(known, "deleted").select(F.sha2("text", 256).alias("_h"), F.lit(True).alias("_known")).distinct()
    return rows.join(seen, "_h", "left").select("id", F.coalesce("_bad", F.when(F.col("_known") | (F.col("_n") > 1), "duplicate"), F.lit("saved")).alias("outcome"))


def forget(notes: DataFrame, query_terms: list[str], most: int = 10, reason: str = "forgotten") -> DataFrame:
    """``notes`` (id, text, created_at, deleted) of which the newest ``most`` active ones that hold a term are deleted."""
    chosen = relational.like_any(relational.active(notes, "deleted"), "text", query_terms).orderBy(F.desc("created_at"), "id").limit(most)
    marked = notes.join(chosen.select("id", F.lit(True).alias("_hit")), "id", "left")
    return relational.mark(marked, F.col("_hit"), "deleted", reason).drop("_hit")


#: What a forget does: a flag and the event it is told by; hard takes the row.
MODES = {"soft": "deleted", "suppress": "suppressed", "hard": None}


def forget_targets(targets: DataFrame, chosen: DataFrame, mode: str, reason: str | None = None) -> DataFrame:
    """``targets`` (target_type, id, deleted, suppressed, ...) after a forget of those that ``chosen`` (target_type, id) lists."""
    if mode == "hard":
        return relational.without(targets, chosen, ["target_type", "id"]).select(*targets.columns)
    hit = targets.join(chosen.select("target_type", "id", F.lit(True).alias("_hit")).distinct(), ["target_type", "id"], "left")
    marked = relational.mark(hit, F.col("_hit"), MODES[mode], reason).drop("_hit")
    return marked.select(*targets.columns, *[c for c in marked.columns if c not in targets.columns])


def resolve(notes: DataFrame, terms: list[str] = (), ids: list[str] = (), most: int = 10) -> DataFrame:
    """(target_type, id) of what a forget is about: the given ids, or of notes, then diaries, the newest active ones that hold a term, ``most`` in all."""
    if ids:
        return notes.filter(F.col("id").cast("string").isin(list(ids))).select("target_type", "id")
    live = relational.like_any(relational.active(notes, "deleted", "suppressed"), "text", list(terms))
    order = [F.when(F.col("target_type") == "memory", 0).otherwise(1), F.desc("created_at"), F.col("id")]
    return live.orderBy(*order).limit(most).select("target_type", "id")


def diary_entry(rows: DataFrame, now: str) -> DataFrame:
    """Diary entries (id, subject, summary, tags, text, content_hash, created_at, accepted) of (id, subject, summary, tags, added, changed).

    The summary gets a line of the first 8 added and one of the first 8 changed paths; the text that is searched is subject, summary and tags. Entries of under
    four words are not accepted.
    """
    line = lambda name, paths: F.when(F.size(paths) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(paths, 1, 8), ", ")))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    summary = F.concat_ws("\n", "summary", line("Added", listed(F.col("added"))), line("Changed", listed(F.col("changed"))))
    out = rows.withColumn("summary", summary)
    body = F.concat_ws("\n", F.nullif("subject", F.lit("")), F.nullif("summary", F.lit("")), F.nullif(F.array_join(listed(F.col("tags")), ", "), F.lit("")))
    out = out.withColumn("text", body).withColumn("accepted", F.size(text.words(F.col("summary"))) >= 4)
    return out.select("id", "subject", "summary", "tags", "text", F.sha2("text", 256).alias("content_hash"), F.lit(now).cast("timestamp_ntz").alias("created_at"), "accepted")


#: The tag of an export's format.
FORMAT = "durable-memory.v1"
EXPORT = "format string, kind string, id string, payload string, content_hash string, created_at timestamp"


def export_rows(notes: DataFrame, diaries: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Notes and diaries as rows of one export: (format, kind, id, payload, content_hash, created_at), kind being memory or diary, payload the row as JSON."""
    def part(rows: DataFrame, kind: str) -> DataFrame:
        rows = rows if include_inactive else relational.active(rows, *[c for c in ("deleted", "suppressed") if c in rows.columns])
        digest = F.col("content_hash") if "content_hash" in rows.columns else F.sha2("text", 256)
        return rows.select(F.lit(FORMAT).alias("format"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*rows.columns)).alias("payload"), digest.alias("content_hash"), F.col("created_at").cast("timestamp").alias("created_at"))

    return part(notes, "memory").unionByName(part(diaries, "diary"))


def export_notes(notes: DataFrame, diaries: DataFrame, path: str, include_inactive: bool = False) -> None:
    """An export as JSON lines, oldest first."""
    export_rows(notes, diaries, include_inactive).orderBy("created_at", "kind", "id").write.mode("overwrite").json(path)


def import_notes(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(kind, id, payload, content_hash, created_at, outcome): the rows of an export; ``saved`` for those whose hash no known row of the kind has, active or not, else ``duplicate``.

    ``known`` has (kind, content_hash). The schema is given, never inferred. Rows of another format or without kind and payload raise a ValueError;
    nothing is written, so a dry run is a count of the outcomes.
    """
    rows = spark.read.schema(EXPORT).json(path)
    wrong = rows.filter(~F.col("format").eqNullSafe(FORMAT) | ~F.coalesce(F.col("kind").isin("memory", "diary"), F.lit(False)) | F.col("payload").isNull())
    if not wrong.isEmpty():
        raise ValueError(f"this is no export of format {FORMAT}")
    return judge_import(rows, known)


def judge_import(rows: DataFrame, known: DataFrame) -> DataFrame:
    seen = known.select("kind", "content_hash", F.lit(True).alias("_known")).distinct()
    first = F.row_number().over(Window.partitionBy("kind", "content_hash").orderBy("id"))
    joined = rows.withColumn("_n", first).join(seen, ["kind", "content_hash"], "left")
    outcome = F.when(F.coalesce("_known", F.lit(False)) | (F.col("_n") > 1), "duplicate").otherwise("saved")
    return joined.select("kind", "id", "payload", "content_hash", "created_at", outcome.alias("outcome"))


def guidance(notes: DataFrame, newest: int = 120, most: int = 8) -> DataFrame:
    """(id, kind, score): constraints, decisions and preferences among the newest notes that score above 0."""
    recent = notes.orderBy(F.desc("created_at"), "id").limit(newest).withColumn("kind", scores.guidance_kind(F.col("kind"))).filter("kind is not null and text is not null")
    rank = F.when(F.col("kind") == "constraint", 0).when(F.col("kind") == "convention", 1).otherwise(2)
    ranked = recent.withColumn("score", scores.guidance_score(F.col("kind"), F.col("text"))).filter("score > 0")
    return ranked.orderBy(F.desc("score"), rank, F.length("text"), "id").limit(most).select("id", "kind", "score")


def highlights(docs: DataFrame, now: str, first: int = 40, most: int = 12) -> DataFrame:
    """(target_type, id, score): the ``first`` documents by type, role and date, scored anew and cut to ``most``."""
    kind = F.when(F.col("target_type") == "module", 0).when(F.col("target_type") == "section", 1).otherwise(2)
    role = F.when(F.col("source_role") == "app_code", 0).when(F.col("source_role") == "package_config", 1).when(F.col("source_role") == "test_code", 2).when(F.col("source_role") == "product_doc", 3).otherwise(4)
    order = [kind, role, F.desc("updated_at"), F.col("target_type"), F.col("id")]
    top = docs.orderBy(*order).limit(first)
    score = scores.highlight_score(F.col("target_type"), F.coalesce("source_role", F.lit("")), scores.recency(F.col("updated_at"), now, 10), text.word_tokens(F.col("text")))
    return top.withColumn("score", score).orderBy(F.desc("score"), *order).limit(most).select("target_type", "id", "score")


def prefix_budget(rows: DataFrame, cost: str, order: list, budget: int) -> DataFrame:
    """Rows in order up to the first that would pass the budget; that one and all after it go. Costs are 1 at least, so only the first ``budget`` rows are looked at."""
    running = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.orderBy(*order).limit(budget).withColumn("_sum", F.sum(cost).over(running)).filter(F.col("_sum") <= budget).drop("_sum")
