"""Ranked search: BM25 candidates, exact nearest neighbours, scoring, pruning, role policy, fallback tiers.

Nothing is collected but the corpus statistics of BM25 (one row); candidates are cut by
top-k before anything is joined to them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemodex.functions import scores, text

K1, B = 1.2, 0.75


def query_terms(query: str, most: int = 12) -> list[str]:
    """The same as ``functions.text.terms``, for a query that the driver holds."""
    found = [t for t in re.split(r"[^a-z0-9_./-]+", query.lower()) if len(t) >= 2]
    return list(dict.fromkeys(found))[:most]


def index_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in (re.sub(r"[^a-z0-9_]", "", x) for x in query_terms(query)) if t))


def index_tokens(column: Column) -> Column:
    """Index tokens: maximal runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, wanted: list[str], column: str = "text") -> DataFrame:
    """``docs`` that hold one of the terms, with ``rank`` (higher is better).

    Terms are counted in the row, so the postings of all other words are never made: one scan gives the
    statistics (a single row) and one the ranks, and neither shuffles texts.
    """
    # The lambda and the generator see to it that a text is cut once, and not again for every term and filter.
    once = F.transform(F.array(index_tokens(F.coalesce(F.col(column), F.lit("")))), lambda t: F.struct(F.size(t).alias("_n"), F.filter(t, lambda x: x.isin(wanted)).alias("_hits")))
    counted = docs.select("*", F.inline(once))
    times = lambda term: F.size(F.filter("_hits", lambda t: t == F.lit(term)))
    counted = counted.select("*", *[times(term).alias(f"_f{i}") for i, term in enumerate(wanted)]).drop("_hits")
    found = [F.sum((F.col(f"_f{i}") > 0).cast("long")) for i in range(len(wanted))]
    total, mean, *df = counted.agg(F.count(F.lit(1)), F.avg("_n"), *found).first()
    if not total:
        return docs.withColumn("rank", F.lit(0.0)).limit(0)
    rank, any_term = F.lit(0.0), F.lit(False)
    for i, n in enumerate(df):
        idf = F.greatest(F.lit(1e-6), F.log(F.lit((total - n + 0.5) / (n + 0.5))))
        f = F.col(f"_f{i}").cast("double")
        rank = rank + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.lit(mean or 1.0)))
        any_term = any_term | (F.col(f"_f{i}") > 0)
    return counted.filter(any_term).withColumn("rank", rank).drop("_n", *[f"_f{i}" for i in range(len(wanted))])


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, distance) of the ``k`` rows with the least cosine distance, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col), (1 - scores.cosine(F.col(vector_col), q)).alias("distance")).orderBy("distance", id_col).limit(k)


def scored(candidates: DataFrame, wanted: list[str], now: str, vector: Column | None = None, confidence: Column | None = None) -> DataFrame:
    """``candidates`` with lexical (share of the terms found), score, excerpt."""
    place = F.concat(F.coalesce("path", F.lit("")), F.lit("\n"), "text")
    # A text's words are found once: the excerpt and its token count follow from their number and the first of them.
    most = text.EXCERPT_WORDS
    once = F.transform(F.array(text.words(F.col("text"))), lambda w: F.struct(F.size(w).alias("_n"), F.array_join(F.slice(w, 1, most), " ").alias("_head")))
    out = candidates.select("*", F.inline(once), text.term_hits(place, wanted).alias("lexical"))
    tokens = F.ceil(F.least(F.col("_n"), F.lit(most)) * F.lit(1.33).cast("double"))
    score = scores.result_score(F.col("lexical"), vector if vector is not None else F.lit(0.0), confidence if confidence is not None else F.lit(1.0), scores.recency(F.col("updated_at"), now), tokens)
    excerpt = F.when(F.col("_n") > most, F.concat("_head", F.lit("..."))).otherwise(F.col("text"))
    return out.withColumns({"score": score, "excerpt": excerpt}).drop("_n", "_head")


def prune(results: DataFrame, per_type: int, limit: int) -> DataFrame:
    """At most ``per_type`` rows of a target type, and twice ``limit`` in all, by score, then date, then type and id."""
    order = [F.desc("score"), F.desc("updated_at"), F.col("target_type"), F.col("id")]
    within = results.withColumn("_r", F.row_number().over(Window.partitionBy("target_type").orderBy(*order))).filter(F.col("_r") <= per_type)
    return within.drop("_r").orderBy(*order).limit(2 * limit)


def policy(results: DataFrame, query: str, mode: str) -> DataFrame:
    """Recall drops diaries unless the request asks for history, and weighs sources by role; search does neither."""
    if mode == "search":
        return results
    about = {name: bool(re.search(text.bounded(words), query.lower())) for name, words in text.INTENTS.items()}
    if not about["allows_diary"]:
        results = results.filter(F.col("target_type") != "diary")
    role = F.coalesce("source_role", F.when(F.col("path").isNotNull(), text.source_role(F.col("path"))), F.lit(""))
    return results.withColumn("score", F.col("score") + scores.role_delta(role, F.coalesce("path", F.lit("")), about["implementation"], about["prefers_agent"]))


def search(docs: DataFrame, query: str, limit: int, now: str, mode: str = "search") -> DataFrame:
    """The retrieval tier: candidates by BM25, score, prune, policy, order, limit. ``docs`` are the visible documents."""
    wanted = index_terms(query)
    if not wanted:
        return docs.withColumn("score", F.lit(0).cast("long")).withColumn("lexical", F.lit(0)).limit(0).select("target_type", "id", "path", "lexical", "score")
    found = bm25(docs, wanted).orderBy(F.desc("rank"), "target_type", "id").limit(4 * limit)
    kept = policy(prune(scored(found, query_terms(query), now), 4 if mode == "recall" else 6, limit), query, mode)
    return kept.orderBy(F.desc("score"), F.desc("updated_at"), "target_type", "id").limit(limit).select("target_type", "id", "path", "lexical", "score")


ROW = ["target_type", "id", "path", "source_role", "text", "updated_at"]
KEY = ["target_type", "id"]


def fresh_vectors(docs: DataFrame, vectors: DataFrame, query: list[float], model: str) -> DataFrame:
    """(target_type, id, vector) of ``docs``: the cosine of the query and the document's vector, null unless that is of this model and length and of the text as it is now.

    ``vectors`` has (target_type, id, model, hash, embedding); a hash is the SHA-256 of model, colon and text.
    """
    of_model = vectors.filter((F.col("model") == model) & (F.size("embedding") == len(query))).select(*KEY, "hash", "embedding")
    q = F.array(*[F.lit(float(x)) for x in query])
    joined = docs.join(of_model, KEY, "left")
    same = F.col("hash") == F.sha2(F.concat(F.lit(model + ":"), "text"), 256)
    return joined.select(*KEY, F.when(same, scores.cosine(F.col("embedding"), q)).alias("vector"))


def _held(rows: DataFrame) -> DataFrame:
    """A list of a few times ``limit`` rows, computed once; what follows uses it several times."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def retrieve(docs: DataFrame, query: str, limit: int, now: str, mode: str = "search", found: DataFrame | None = None, vectors: DataFrame | None = None, vector: list[float] | None = None, model: str = "", graph_of=None) -> DataFrame:
    """(target_type, id, path, lexical, vector, boost, score): the retrieval tier as a whole.

    Lexical candidates (``found``, (target_type, id, rank) from an index, or else a scan of ``docs``), each with the score of its own vector where that is fresh;
    the documents of the nearest vectors that are not among them; scores; pruning; role policy; a boost for results whose
    entities the graph has around the request (``graph_of(results)`` gives (target_type, id, boost)); order and limit. Without a query vector
    the search goes on by words alone.
    """
    wanted, terms = index_terms(query), query_terms(query)
    if not wanted:
        return docs.limit(0).select(*KEY, "path", F.lit(0).alias("lexical"), F.lit(0.0).alias("vector"), F.lit(0).cast("long").alias("boost"), F.lit(0).cast("long").alias("score"))
    ranked = bm25(docs, wanted) if found is None else docs.join(F.broadcast(found.orderBy(F.desc("rank"), *KEY).limit(4 * limit)), KEY)
    lexical = _held(ranked.orderBy(F.desc("rank"), *KEY).limit(4 * limit).select(*ROW))
    every = lexical.withColumn("vector", F.lit(None).cast("double"))
    if vectors is not None and vector is not None:
        # At most 4 * limit rows on either side.
        every = lexical.join(F.broadcast(fresh_vectors(F.broadcast(lexical), vectors, vector, model)), KEY)
        of_model = vectors.filter((F.col("model") == model) & (F.size("embedding") == len(vector)))
        q = F.array(*[F.lit(float(x)) for x in vector])
        near = _held(of_model.select(*KEY, (1 - scores.cosine(F.col("embedding"), q)).alias("distance")).orderBy("distance", *KEY).limit(4 * limit))
        near = near.select(*KEY, scores.distance_score(F.col("distance")).alias("vector"))
        extra = docs.select(*ROW).join(F.broadcast(near), KEY).join(F.broadcast(lexical.select(*KEY)), KEY, "left_anti")
        every = every.unionByName(extra)
    kept = policy(prune(scored(every, terms, now, F.coalesce("vector", F.lit(0.0))), 4 if mode == "recall" else 6, limit), query, mode)
    order = [F.desc("score"), F.desc("updated_at"), *map(F.col, KEY)]
    kept = kept.withColumn("boost", F.lit(0).cast("long"))
    if graph_of is not None:
        # A result list has at most 2 * limit rows; numbering it takes one task.
        listed = _held(kept.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))))
        boosted = graph_of(listed)
        kept = listed.drop("boost", "position").join(F.broadcast(boosted), KEY, "left").withColumn("boost", F.coalesce("boost", F.lit(0)).cast("long")).withColumn("score", F.col("score") + F.col("boost"))
    return kept.orderBy(*order).limit(limit).select(*KEY, "path", "lexical", "vector", "boost", "score")


def by_words(rows: DataFrame, query: str, limit: int, now: str, mode: str = "search") -> DataFrame:
    """The last tier: the newest notes and diaries (target_type, id, text, updated_at, confidence) that hold a term, 2 * ``limit`` of each, scored, pruned and gated alike."""
    terms, low = query_terms(query), F.lower("text")
    hit = rows.filter(reduce(or_, [F.contains(low, F.lit(t)) for t in terms], F.lit(False)))
    newest = hit.withColumn("_n", F.row_number().over(Window.partitionBy("target_type").orderBy(F.desc("updated_at"), "id"))).filter(F.col("_n") <= 2 * limit).drop("_n")
    placed = newest.withColumns({"path": F.lit(None).cast("string"), "source_role": F.lit(None).cast("string")})
    judged = scored(placed, terms, now, confidence=F.col("confidence"))
    pruned = prune(judged, 4 if mode == "recall" else 6, limit)
    if mode == "recall" and not re.search(text.bounded(text.INTENTS["allows_diary"]), query.lower()):
        pruned = pruned.filter("target_type <> 'diary'")
    return pruned.orderBy(F.desc("score"), F.desc("updated_at"), *KEY).limit(limit).select(*KEY, "path", "lexical", "score")


def index_rows(ranked: DataFrame, docs: DataFrame, notes: DataFrame, hidden: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best of the index's documents (target_type, id, rank) with what they belong to: their row of ``docs`` and the confidence of the note of that id.

    An id that is deleted or suppressed anywhere (``hidden`` has id, deleted, suppressed) is out, of whatever type the row is.
    """
    gone = hidden.filter("coalesce(deleted, false) or coalesce(suppressed, false)").select("id").distinct()
    best = ranked.join(gone, "id", "left_anti").orderBy(F.desc("rank"), *KEY).limit(limit)
    rows = docs.select(*ROW).join(F.broadcast(best), KEY)  # limit rows
    return rows.join(notes.select("id", F.col("confidence").cast("double").alias("confidence")), "id", "left").select(*ROW, F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def by_index(rows: DataFrame, query: str, limit: int, now: str, mode: str = "search") -> DataFrame:
    """The middle tier: rows of the index (``index_rows``), scored, pruned and gated; roles, vectors and the graph take no part."""
    pruned = prune(scored(rows, query_terms(query), now, confidence=F.col("confidence")), 4 if mode == "recall" else 6, limit)
    if mode == "recall" and not re.search(text.bounded(text.INTENTS["allows_diary"]), query.lower()):
        pruned = pruned.filter("target_type <> 'diary'")
    return pruned.orderBy(F.desc("score"), F.desc("updated_at"), *KEY).select(*KEY, "path", "lexical", "score")


def first_with_rows(spark: SparkSession, *tiers: Callable[[], DataFrame]) -> DataFrame:
    """The rows of the first tier that has any; those after it are neither planned nor read. A tier gives a short list."""
    found = None
    for tier in tiers:
        found = tier()
        rows = found.collect()
        if rows:
            return spark.createDataFrame(rows, found.schema)
    return found.limit(0)


def tiers(*found: DataFrame) -> DataFrame:
    """The rows of the first of ``found`` that has any: the tier is a column, and the smallest one stays."""
    every = None
    for i, df in enumerate(found):
        df = df.withColumn("tier", F.lit(i + 1))
        every = df if every is None else every.unionByName(df)
    return every.join(F.broadcast(every.agg(F.min("tier").alias("tier"))), "tier", "left_semi").select(*every.columns)  # one row


def within_budget(rows: DataFrame, cost: str, order: list[Column], budget: int) -> DataFrame:
    """Greedy: the first row stays, a later one if it still fits; one that doesn't is skipped. Costs are 1 at least.

    Once a row is skipped, all later ones of its cost are; so of each cost c only the first budget / c rows can stay, and the
    list that is folded in one row has about budget * log(budget) entries, whatever the number of rows.
    """
    columns = rows.columns
    of_cost = rows.withColumn("_k", F.row_number().over(Window.partitionBy(cost).orderBy(*order))).filter(F.col("_k") <= budget)
    few = of_cost.filter(F.col("_k") * F.col(cost) <= budget).select(*columns)
    few = few.unionByName(rows.orderBy(*order).limit(1).filter(F.col(cost) > budget))
    packed = few.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).withColumn("_row", F.struct(*columns))
    listed = packed.agg(F.array_sort(F.collect_list(F.struct("_at", F.col(cost).cast("long").alias("cost"), "_row"))).alias("rows"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    fits = lambda s, x: (F.size(s["kept"]) == 0) | (s["used"] + x["cost"] <= budget)
    fold = F.aggregate("rows", empty, lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["kept"], F.array(x["_at"])).alias("kept"))).otherwise(s))
    kept = listed.withColumn("kept", fold["kept"]).select(F.explode("rows").alias("r"), "kept").filter(F.array_contains("kept", F.col("r._at")))
    return kept.select("r._row.*")


def quality(results: DataFrame) -> DataFrame:
    """(quality, targets): strong from 200 points and two targets, partial from 80, else weak."""
    top = results.agg(F.max("score").alias("top"), F.countDistinct(F.coalesce("path", F.col("id").cast("string"))).alias("targets"))
    label = F.when((F.col("top") >= 200) & (F.col("targets") >= 2), "strong").when(F.col("top") >= 80, "partial").otherwise("weak")
    return top.select(label.alias("quality"), "targets")


def primary_targets(results: DataFrame, most: int = 5) -> DataFrame:
    """(target, score): the best different paths (ids, where there is no path) of a result list."""
    target = F.coalesce("path", F.concat_ws(":", "target_type", F.col("id").cast("string")))
    return results.groupBy(target.alias("target")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "target").limit(most)


def brief(results: DataFrame, most: int = 4) -> DataFrame:
    """(n, line): a line for each of the best results (target_type, id, path, score, excerpt): its label and the begin of its excerpt."""
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), *map(F.col, KEY)))
    top = results.orderBy(F.desc("score"), *KEY).limit(most).withColumn("n", n)
    return top.select("n", F.concat(text.target_label(F.col("path"), F.col("id"), F.lit(None).cast("string")), F.lit(": "), F.substring(text.squeeze(F.col("excerpt")), 1, 120)).alias("line"))


def compact(results: DataFrame, sources: bool = False) -> DataFrame:
    """Results without what tells where they come from, unless ``sources`` is asked for."""
    return results if sources else results.drop("anchor", "source_role", "source_id", "token_cost")
