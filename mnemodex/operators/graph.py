"""Entities, aliases and relations: text search, bounded walks, history, supersession."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemodex.functions import text
from mnemodex.operators.relational import without
from mnemodex.session import cut


def both_ways(relations: DataFrame) -> DataFrame:
    """Active edges, once from either end."""
    live = relations.filter("status = 'active'")
    forth = live.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("id").alias("relation_id"), "predicate")
    return forth.unionByName(live.select(F.col("object_id").alias("src"), F.col("subject_id").alias("dst"), F.col("id").alias("relation_id"), "predicate"))


def walk(origins: DataFrame, relations: DataFrame, names: DataFrame, depth: int = 2, limit: int = 8) -> DataFrame:
    """(origin_id, entity_id, depth, relation_id, n): each simple path from an origin, the first ``limit`` of an origin by depth and name.

    ``origins`` has one column, origin_id. The depth is held between 1 and 5. A step is one equi-join of the paths so
    far with the edges; a path never meets an entity twice. Nearer entities go first, so an origin that has its ``limit``
    takes no further step: what a hub has around it is looked at once and never multiplied.
    """
    edges, named = both_ways(relations), names.select(F.col("id").alias("dst"), "name")
    front = origins.select("origin_id", F.col("origin_id").alias("entity_id"), F.array("origin_id").alias("seen"), F.lit(0).cast("long").alias("have"))
    found, steps = None, max(1, min(int(depth), 5))
    for step in range(1, steps + 1):
        taken = front.join(edges, front["entity_id"] == edges["src"]).filter(~F.array_contains("seen", F.col("dst")))
        paths = taken.join(named, "dst", "left").select("origin_id", F.col("dst").alias("entity_id"), F.array_append("seen", F.col("dst")).alias("seen"), "have", "relation_id", "name")
        rows = paths.filter("name is not null").select("origin_id", "entity_id", F.lit(step).alias("depth"), "relation_id", "name")
        found = rows if found is None else found.unionByName(rows)
        if step < steps:
            counted = paths.groupBy("origin_id").agg((F.max("have") + F.count("name")).alias("have")).filter(F.col("have") < limit)
            front = paths.drop("have", "relation_id", "name").join(counted, "origin_id")
    order = Window.partitionBy("origin_id").orderBy("depth", "name", "relation_id", "entity_id")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).select("origin_id", "entity_id", "depth", "relation_id", "n")


def history(origins: DataFrame, relations: DataFrame, names: DataFrame, limit: int = 10) -> DataFrame:
    """Superseded and invalidated relations that touch an origin, as subject or object, with both ends' names.

    (origin_id, relation_id, predicate, status, valid_from, valid_to, subject_name, object_name, n): the ``limit`` last updated ones of an origin;
    n is their order, the last to lose validity first. The alternative of two ends is a union of two equi-joins, not a nested loop.
    """
    old = relations.filter(F.col("status").isin("superseded", "invalidated"))
    ends = [old.join(origins, old[c] == origins["origin_id"]) for c in ("subject_id", "object_id")]
    both = ends[0].unionByName(ends[1]).dropDuplicates(["origin_id", "id"])
    for end in ("subject", "object"):
        both = both.join(names.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id")
    of = Window.partitionBy("origin_id")
    last = both.withColumn("_k", F.row_number().over(of.orderBy(F.desc("updated_at"), "id"))).filter(F.col("_k") <= limit)
    ranked = last.withColumn("n", F.row_number().over(of.orderBy(F.desc("valid_to"), F.desc("valid_from"), "id")))
    return ranked.select("origin_id", F.col("id").alias("relation_id"), "predicate", "status", "valid_from", "valid_to", "subject_name", "object_name", "n")


def aliases(entities: DataFrame) -> DataFrame:
    """(entity_id, value): the forms under which an entity's name is looked up."""
    forms = text.alias_variants(F.col("name"))
    return entities.select(F.col("id").alias("entity_id"), F.explode(forms).alias("value")).filter("value <> ''").distinct()


def search_entities(entities: DataFrame, known: DataFrame, wanted: list[str], limit: int = 5) -> DataFrame:
    """(id, name, score): 4 for a name that is a term, 3 for one that holds a term, 1 for such a summary, 3 for such an alias."""
    any_of = lambda tests: reduce(or_, tests, F.lit(False))
    name, about = F.lower("name"), F.lower(F.coalesce("summary", F.lit("")))
    by_alias = known.filter(any_of([F.contains("value", F.lit(t)) for t in wanted])).select(F.col("entity_id").alias("id"), F.lit(3).alias("_alias")).distinct()
    points = F.when(name.isin(wanted), 4).otherwise(0) + F.when(any_of([F.contains(name, F.lit(t)) for t in wanted]), 3).otherwise(0) + F.when(any_of([F.contains(about, F.lit(t)) for t in wanted]), 1).otherwise(0)
    out = entities.join(by_alias, "id", "left").withColumn("score", points + F.coalesce("_alias", F.lit(0)))
    return out.filter("score > 0").orderBy(F.desc("score"), "id").limit(limit).select("id", "name", "score")


def match_aliases(values: DataFrame, known: DataFrame) -> DataFrame:
    """(value, entity_id): entities of which an alias equals the normalised value."""
    wanted = values.select("value", text.alias_form(F.col("value")).alias("_form"))
    return wanted.join(known.withColumnRenamed("value", "_form"), "_form").select("value", "entity_id").distinct()


def first_matches(values: DataFrame, entities: DataFrame, known: DataFrame) -> DataFrame:
    """(request_id, entity_id, position, rank, n): the entities that the values (request_id, position, value) of a request name, each once, in the order of their first match.

    Rank 0 is an entity's id, 1 an alias, 2 its name but for case. The first match is that of the least position, then rank; n goes by it, then by the entity's id.
    """
    ids = entities.select("id", F.lower("name").alias("_name"))
    # Values repeat over requests; each different one is looked up once.
    once = values.select("value").distinct()
    by_id = once.join(ids, F.col("value") == F.col("id")).select("value", F.col("id").alias("entity_id"), F.lit(0).alias("rank"))
    by_alias = match_aliases(once, known).select("value", "entity_id", F.lit(1).alias("rank"))
    by_name = once.join(ids, F.lower("value") == F.col("_name")).select("value", F.col("id").alias("entity_id"), F.lit(2).alias("rank"))
    found = by_id.unionByName(by_alias).unionByName(by_name).groupBy("value", "entity_id").agg(F.min("rank").alias("rank"))
    first = values.join(found, "value").groupBy("request_id", "entity_id").agg(F.min(F.struct("position", "rank")).alias("m"))
    order = Window.partitionBy("request_id").orderBy("m.position", "m.rank", "entity_id")
    return first.select("request_id", "entity_id", "m.position", "m.rank", F.row_number().over(order).alias("n"))


def standing(by: DataFrame, most: int = 20) -> DataFrame:
    """(id, stands, steps): of every superseded decision the one that stands at the end of its chain; null if the chain goes round.

    ``by`` has (old, new): a decision and the one that supersedes it (of several the largest counts). Each round doubles the way that every row looks ahead, so chains of
    n decisions take log n joins by key; after ``most`` rounds only chains that go round are left.
    """
    way = by.filter("old <> new").groupBy("old").agg(F.max("new").alias("to")).withColumn("steps", F.lit(1).cast("long"))
    reach = 1
    for _ in range(most):
        ahead = way.select(F.col("old").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        way = way.join(ahead, "to", "left").select("old", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0).cast("long"))).alias("steps"))
        way = cut(way)  # a round reads the round before twice
        reach *= 2
        # A row that is still under way has looked exactly ``reach`` steps ahead.
        moving = way.filter(F.col("steps") == reach)
        if moving.join(way.select(F.col("old").alias("to")), "to", "left_semi").isEmpty():
            return way.select(F.col("old").alias("id"), F.col("to").alias("stands"), "steps")
    round_ = way.join(way.select(F.col("old").alias("to")), "to", "left_semi").select("old").distinct().withColumn("_round", F.lit(True))
    marked = way.join(round_, "old", "left")
    return marked.select(F.col("old").alias("id"), F.when(F.col("_round").isNull(), F.col("to")).alias("stands"), F.when(F.col("_round").isNull(), F.col("steps")).alias("steps"))


def supersede(relations: DataFrame, by: DataFrame, now: str, alone: bool = False) -> DataFrame:
    """``relations`` in which the active ones going out of ``by.subject_id`` are superseded by ``by.decision_id``, as of ``now``.

    Each pair of ``by`` also becomes a relation ``supersedes`` from the decision to the subject, which the superseded ones name as
    ``superseded_by``; without these (``alone``) they name the decision. Earlier ends of validity stay. A decision never supersedes itself.
    """
    pairs = by.filter("subject_id <> decision_id").groupBy("subject_id").agg(F.min("decision_id").alias("decision_id"))
    edge = relation_id(F.col("decision_id"), F.lit("supersedes"), F.col("subject_id"))
    had = set(relations.columns)
    for name, kind in (("valid_to", "timestamp_ntz"), ("superseded_by", "string")):
        if name not in had:
            relations = relations.withColumn(name, F.lit(None).cast(kind))
    columns, kinds = relations.columns, dict(relations.dtypes)
    hit = relations.join(pairs.withColumnRenamed("decision_id", "_by"), "subject_id", "left").withColumn("decision_id", F.col("_by"))
    change = (F.col("status") == "active") & F.col("_by").isNotNull()
    new = {"status": F.lit("superseded"), "valid_to": F.lit(now).cast(kinds["valid_to"]), "superseded_by": F.col("_by") if alone else edge}
    after = hit.select(*[F.when(change, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns])
    if alone:
        return after
    made = {"id": edge, "subject_id": F.col("decision_id"), "predicate": F.lit("supersedes"), "object_id": F.col("subject_id"), "status": F.lit("active"), "confidence": F.lit(1.0), "valid_from": F.lit(now), "updated_at": F.lit(now), "created_at": F.lit(now)}
    rows = pairs.select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
    return without(after, rows, ["id"]).select(*columns).unionByName(rows)


def relation_id(subject: Column, predicate: Column, target: Column) -> Column:
    return text.identifier("rel", subject, predicate, target)


def invalidate(relations: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """``relations`` in which those that ``gone`` (id) lists are invalid as of ``now``; superseded ones too, earlier ends of validity stay."""
    hit = relations.join(gone.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left")
    change = F.coalesce("_gone", F.lit(False)) & (F.col("status") != "invalidated")
    new = {"status": F.when(change, "invalidated").otherwise(F.col("status")), "valid_to": F.when(change, F.coalesce("valid_to", F.lit(now).cast(relations.schema["valid_to"].dataType))).otherwise(F.col("valid_to"))}
    return hit.select(*[new.get(c, F.col(c)).alias(c) for c in relations.columns])


def delete_entities(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """Relations neither end of which is gone: two anti-joins in place of one with an alternative."""
    for end in ("subject_id", "object_id"):
        relations = relations.join(gone.select(F.col("id").alias(end)).distinct(), end, "left_anti")
    return relations


def boosts(result_entities: DataFrame, graph_entities: DataFrame) -> DataFrame:
    """(result_id, related, boost): 15 points for each of a result's entities that the graph context has, 45 at most."""
    met = result_entities.join(graph_entities.select("entity_id").distinct(), "entity_id", "left_semi")
    return met.groupBy("result_id").agg(F.countDistinct("entity_id").alias("related")).withColumn("boost", F.least(F.lit(45), F.col("related") * 15).cast("long"))


def strongest_evidence(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(note_id, entity_id, confidence, fields, evidence) from (note_id, field, value, confidence): notes attached to the entities they name.

    Each different value is brought to its form once, however many notes have it.
    """
    named = candidates.select("value").distinct().withColumn("_form", text.alias_form(F.col("value"))).join(known.withColumnRenamed("value", "_form"), "_form")
    met = candidates.join(named, "value")
    return met.groupBy("note_id", "entity_id").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"), F.array_join(F.array_sort(F.collect_set("_form")), ",").alias("evidence"))


def context(origins: DataFrame, relations: DataFrame, names: DataFrame, depth: int = 2, limit: int = 8) -> DataFrame:
    """(relation_id, origin_id, entity_id, depth, score): what surrounds the origins, each relation once, nearer ones first and scored higher."""
    found = walk(origins, relations, names, depth, limit)
    first = Window.partitionBy("relation_id").orderBy("depth", "origin_id", "n")
    once = found.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    return once.select("relation_id", "origin_id", "entity_id", "depth", F.greatest(F.lit(1), 10 - 2 * F.col("depth")).alias("score"))


#: Types of entities that a durable note can be attached to, and what its evidence is worth.
EVIDENCE = {"source": 1.0, "tag": 0.8, "subject": 0.8, "content": 0.7, "summary": 0.7}


def note_evidence(notes: DataFrame) -> DataFrame:
    """(note_id, field, value, confidence) of (id, source, subject, tags, content, summary), any of which may be null: what a note says it is about.

    The source and its last parts, tags of two letters or more, and what is in back quotes or looks like a path in the others. Of values with one
    form the strongest stays.
    """
    one = lambda field, values: F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), F.trim(v).alias("value"), F.lit(EVIDENCE[field]).alias("confidence")))
    said = lambda field: one(field, F.coalesce(F.concat(text.quoted_values(F.col(field)), text.path_values(F.col(field))), F.array().cast("array<string>")))
    source = F.filter(text.path_aliases(F.col("source")), lambda v: v.isNotNull())
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda v: F.length(F.trim(v)) >= 2)
    every = F.concat(one("source", F.coalesce(source, F.array().cast("array<string>"))), one("tag", tags), said("subject"), said("content"), said("summary"))
    rows = notes.select(F.col("id").alias("note_id"), F.explode(every).alias("e")).select("note_id", "e.*").withColumn("_form", text.alias_form(F.col("value"))).filter("_form <> ''")
    best = rows.groupBy("note_id", "_form").agg(F.max_by(F.struct("field", "value", "confidence"), F.struct("confidence", F.col("field").alias("f"), F.col("value").alias("v"))).alias("e"))
    return best.select("note_id", "e.*")


def project_notes(notes: DataFrame, known: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of durable notes (id, kind, source, subject, tags, content, summary): a node each, and an edge to every entity it names.

    ``known`` are aliases (entity_id, value). Constraints apply to what they name, all others concern it.
    """
    node = F.when(F.col("kind") == "diary", text.identifier("ent", F.lit("diary"), F.col("id"))).otherwise(text.identifier("ent", F.lit("memory"), F.col("id")))
    nodes = notes.select(node.alias("id"), F.when(F.col("kind") == "diary", "diary").otherwise("memory").alias("type"), F.col("id").alias("name"), "kind", F.coalesce("summary", text.summary(F.col("content"))).alias("summary"))
    met = strongest_evidence(note_evidence(notes), known)
    ends = met.join(notes.select(F.col("id").alias("note_id"), node.alias("subject_id"), F.when(F.col("kind") == "constraint", "applies_to").otherwise("concerns").alias("predicate")), "note_id").filter("subject_id <> entity_id")
    at = F.lit(now).cast("timestamp_ntz")
    edges = ends.select(relation_id(F.col("subject_id"), F.col("predicate"), F.col("entity_id")).alias("id"), "subject_id", "predicate", F.col("entity_id").alias("object_id"), F.lit("active").alias("status"), "confidence", at.alias("valid_from"), at.alias("updated_at"), "fields", "evidence")
    return nodes, edges


def delete_notes(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the nodes of the notes (id, type) that ``gone`` lists."""
    nodes = gone.select(text.identifier("ent", F.col("type"), F.col("id")).alias("id"))
    return without(entities, nodes, ["id"]), delete_entities(relations, nodes)


def result_aliases(results: DataFrame) -> DataFrame:
    """(target_type, id, position, value): the forms under which results (target_type, id, path, anchor, position) are looked up among aliases."""
    ident = F.col("id").cast("string")
    forms = F.array(ident, F.concat("target_type", F.lit("#"), ident), F.col("path"), F.col("anchor"), F.concat("path", F.lit("#"), F.col("anchor")))
    return results.select("target_type", "id", "position", F.explode(F.array_distinct(F.array_compact(F.transform(forms, text.alias_form)))).alias("value")).filter("value <> ''")


def map_results(results: DataFrame, known: DataFrame, listed: DataFrame | None = None, first: int = 12) -> DataFrame:
    """(target_type, id, position, entity_id): entities of the ``first`` results: those ``listed`` for them (target_type, id, entity_id), and those with one of their aliases."""
    top = results.filter(F.col("position") <= first)
    met = result_aliases(top).join(known, "value").select("target_type", "id", "position", "entity_id")
    if listed is not None:
        met = met.unionByName(top.join(listed, ["target_type", "id"]).select("target_type", "id", "position", "entity_id"))
    return met.distinct()


def context_of(direct: DataFrame, mapped: DataFrame, relations: DataFrame, names: DataFrame, depth: int = 2, limit: int = 8) -> DataFrame:
    """(relation_id, origin_id, entity_id, depth, score): what surrounds the entities of a request, ``direct`` (entity_id, position), and of its results, ``mapped``.

    Direct entities go before mapped ones; each relation is listed once, for the first origin that reaches it.
    """
    ranked = direct.select("entity_id", F.lit(0).alias("of"), "position").unionByName(mapped.select("entity_id", F.lit(1).alias("of"), "position"))
    origins = ranked.groupBy(F.col("entity_id").alias("origin_id")).agg(F.min(F.struct("of", "position")).alias("at"))
    # At most the 4 direct entities and those of 12 results: computed once, and sent to the edges.
    origins = origins.sparkSession.createDataFrame(origins.collect(), origins.schema)
    found = walk(origins.select("origin_id"), relations, names, depth, limit).join(F.broadcast(origins), "origin_id")
    first = Window.partitionBy("relation_id").orderBy("at", "origin_id", "n")
    once = found.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    return once.select("relation_id", "origin_id", "entity_id", "depth", F.greatest(F.lit(1), 10 - 2 * F.col("depth")).alias("score"))
