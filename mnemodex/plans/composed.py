"""Queries of the engine's parts as they work together: the whole retrieval tier, the index, durable notes and their graph, module artifacts, warm-up, transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemodex.functions import text
from mnemodex.operators import durable, graph, index, modules, projection, relational, search
from mnemodex.plans import catalogue as c
from mnemodex.plans.catalogue import NOW, ORACLES, query, visible_documents
from mnemodex.sources import model
from mnemodex.sources.model import table

REQUEST = "fix the idiot trash and for src docs"
_TERMS, _WANTED = search.query_terms(REQUEST), search.index_terms(REQUEST)
_NO_TEXT = "CAST(NULL AS VARCHAR)"


def _ident(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256({' || chr(58) || '.join(parts)}), 1, 32)"


def _alias(x: str) -> str:
    return c._ALIAS.format(x)


# The graph of files and their modules -------------------------------------------------------------

_FILE = _ident("ent", "'file'", _alias("path"))
_MODULE = _ident("ent", "'module:' || split_part(path, '/', 1) || '#' || source_role")
_NAME = "string_split(path, '/')[-1]"
_FILES = f"""
files AS (SELECT DISTINCT path, source_role, {_FILE} AS file_id, {_MODULE} AS module_id FROM sections),
nodes AS (SELECT DISTINCT file_id AS id, path AS name FROM files UNION SELECT DISTINCT module_id, split_part(path, '/', 1) FROM files),
names AS (
  SELECT DISTINCT file_id AS entity_id, unnest([{_alias('path')}, {_alias(_NAME)}, {_alias(f"regexp_replace({_NAME}, '(.)[.][^.]+$', chr(92) || '1')")}]) AS value FROM files
  UNION SELECT DISTINCT module_id, {_alias("split_part(path, '/', 1)")} FROM files),
links AS (SELECT DISTINCT module_id AS src, file_id AS dst, {_ident('rel', 'module_id', "'contains'", 'file_id')} AS rel FROM files),
ways AS (SELECT * FROM links UNION ALL SELECT dst, src, rel FROM links)""".replace("chr(92) || '1'", r"'\1'")


def _file_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and names of all sections' files and modules."""
    nodes, edges = modules.module_graph(model.sections(spark, sf_dir))
    forms = F.array_distinct(F.transform(text.path_aliases(F.col("path")), text.alias_form))
    names = nodes.select(F.col("id").alias("entity_id"), F.explode(forms).alias("value")).distinct()
    return nodes, edges.withColumn("status", F.lit("active")), names


def _boosted(spark, sf_dir):
    nodes, edges, names = _file_graph(spark, sf_dir)

    def of(results: DataFrame) -> DataFrame:
        mapped = graph.map_results(results.withColumn("anchor", F.lit(None).cast("string")), names)
        direct = graph.search_entities(nodes.withColumn("summary", F.lit(None).cast("string")), names, _TERMS, 4)
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id"))  # four rows
        around = graph.context_of(direct.select(F.col("id").alias("entity_id"), place.alias("position")), mapped, edges, nodes)
        met = around.select(F.col("origin_id").alias("entity_id")).unionByName(around.select("entity_id"))
        return graph.boosts(mapped.select(F.struct("target_type", "id").alias("result_id"), "entity_id"), met).select("result_id.*", "boost")

    return of


def _any(column: str, of: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in of) + ")"


#: The request speaks of docs, so agents' files are asked for.
_AGENTS = c._DELTA.replace("THEN -60", "THEN 20")


def _full(mode: str, limit: int) -> str:
    recall = mode == "recall"
    order = "score DESC, updated_at DESC, target_type, id"
    score = c._SCORE.replace(c._hits("coalesce(path, '') || chr(10) || text", c.TERMS), c._hits("coalesce(path, '') || chr(10) || text", _TERMS))
    terms = ", ".join(f"'{t}'" for t in _TERMS)
    return f"""WITH RECURSIVE {c._MODEL}, {c._VISIBLE}, {c._bm25(_WANTED, 'visible')}, {c._NEAR}, {c._FRESH}, {_FILES},
lexical AS (SELECT r.target_type, r.id, path, source_role, text, updated_at, CASE WHEN v.fresh THEN 1 - v.distance END AS vector
            FROM (SELECT * FROM ranked ORDER BY rank DESC, target_type, id LIMIT {4 * limit}) r LEFT JOIN v ON v.vec_id = r.id AND v.target_type = r.target_type),
n AS (SELECT vec_id, greatest(0, least(1, 1 - distance / 2)) AS vector FROM near ORDER BY near.distance, vec_id LIMIT {4 * limit}),
extra AS (SELECT d.target_type, d.id, d.path, d.source_role, d.text, d.updated_at, n.vector FROM visible d JOIN n ON n.vec_id = d.id AND d.target_type = 'section'
          WHERE NOT EXISTS (SELECT 1 FROM lexical l WHERE l.target_type = d.target_type AND l.id = d.id)),
every AS (SELECT * FROM lexical UNION ALL SELECT * FROM extra),
scored AS (SELECT *, {c._hits("coalesce(path, '') || chr(10) || text", _TERMS)} AS lexical, CAST({score.format(vector="coalesce(vector, 0)")} AS BIGINT) AS score FROM every),
typed AS (SELECT *, row_number() OVER (PARTITION BY target_type ORDER BY {order}) AS r FROM scored),
pruned AS (SELECT * EXCLUDE (r) FROM typed WHERE r <= {4 if recall else 6} ORDER BY {order} LIMIT {2 * limit}),
judged AS (SELECT * REPLACE ({f"score + ({_AGENTS})" if recall else "score"} AS score) FROM pruned {"WHERE target_type <> 'diary'" if recall else ""}),
placed AS (SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM judged),
forms AS (SELECT target_type, id, position, unnest([CAST(id AS VARCHAR), target_type || '#' || id, path]) AS form FROM placed WHERE position <= 12),
mapped AS (SELECT DISTINCT target_type, f.id, position, entity_id FROM forms f JOIN names a ON a.value = {_alias('f.form')}),
points AS (
  SELECT e.id, CASE WHEN lower(name) IN ({terms}) THEN 4 ELSE 0 END + CASE WHEN {_any('lower(name)', _TERMS)} THEN 3 ELSE 0 END
       + CASE WHEN EXISTS (SELECT 1 FROM names a WHERE a.entity_id = e.id AND {_any('a.value', _TERMS)}) THEN 3 ELSE 0 END AS points FROM nodes e),
direct AS (SELECT id, row_number() OVER (ORDER BY points DESC, id) AS position FROM (SELECT * FROM points WHERE points > 0 ORDER BY points DESC, id LIMIT 4)),
origins AS (SELECT origin_id, min((o, position)) AS at FROM (SELECT id AS origin_id, 0 AS o, position FROM direct UNION ALL SELECT entity_id, 1, position FROM mapped) GROUP BY 1),
walk(origin_id, entity_id, depth, rel, seen) AS (
  SELECT origin_id, origin_id, 0, '', [origin_id] FROM origins
  UNION ALL SELECT w.origin_id, x.dst, w.depth + 1, x.rel, list_append(w.seen, x.dst) FROM walk w JOIN ways x ON x.src = w.entity_id WHERE w.depth < 2 AND NOT list_contains(w.seen, x.dst)),
named AS (SELECT w.*, row_number() OVER (PARTITION BY origin_id ORDER BY depth, e.name, w.rel, w.entity_id) AS n FROM walk w JOIN nodes e ON e.id = w.entity_id WHERE depth > 0),
once AS (SELECT t.*, row_number() OVER (PARTITION BY rel ORDER BY o.at, t.origin_id, n) AS k FROM named t JOIN origins o ON o.origin_id = t.origin_id WHERE n <= 8),
met AS (SELECT origin_id AS entity_id FROM once WHERE k = 1 UNION SELECT entity_id FROM once WHERE k = 1),
boosts AS (SELECT target_type, id, least(45, 15 * count(DISTINCT m.entity_id)) AS boost FROM mapped m JOIN met ON met.entity_id = m.entity_id GROUP BY 1, 2),
final AS (SELECT p.* REPLACE (score + coalesce(boost, 0) AS score), coalesce(boost, 0) AS boost FROM placed p LEFT JOIN boosts b ON b.target_type = p.target_type AND b.id = p.id)
SELECT target_type, id, path, CAST(lexical AS INTEGER) AS lexical, round(vector, 6) AS vector, CAST(boost AS BIGINT) AS boost, CAST(score AS BIGINT) AS score
FROM final ORDER BY {order} LIMIT {limit}"""


def _searched(spark, sf_dir, mode: str, limit: int) -> DataFrame:
    found = search.retrieve(
        visible_documents(spark, sf_dir), REQUEST, limit, NOW, mode, vectors=c.section_vectors(spark, sf_dir), vector=c._VECTOR, model="model-a", graph_of=_boosted(spark, sf_dir)
    )
    return found.withColumn("vector", F.round("vector", 6))


@query("search_full", _full("search", 10))
def search_full(spark, sf_dir):
    """Words, vectors, pruning and graph in one tier."""
    return _searched(spark, sf_dir, "search", 10)


@query("recall_full", _full("recall", 20))
def recall_full(spark, sf_dir):
    return _searched(spark, sf_dir, "recall", 20)


_LIKE = ["onann", "thnd"]


@query("fallback_cascade", f"""
WITH {c._MODEL}, {c._VISIBLE}, {c._bm25(_LIKE, 'visible')},
one AS (SELECT target_type, id FROM ranked ORDER BY rank DESC, target_type, id LIMIT 40),
notes AS (SELECT 'memory' AS target_type, id, text, created_at AS updated_at, confidence FROM observations WHERE NOT deleted
          UNION ALL SELECT 'diary', id, text, created_at, 1.0 FROM diaries WHERE NOT deleted),
newest AS (SELECT *, row_number() OVER (PARTITION BY target_type ORDER BY updated_at DESC, id) AS k FROM notes WHERE {_any('lower(text)', _LIKE)}),
scored AS (SELECT *, CAST(floor({c._hits('text', _LIKE)} * 100 + confidence * 20 + {c._RECENCY.format('updated_at', '20')}
             - ceil({c._TOKENS.format('(' + c._EXCERPT.format('text') + ')')} / 120.0) + 0.5) AS BIGINT) AS score FROM newest WHERE k <= 20),
typed AS (SELECT *, row_number() OVER (PARTITION BY target_type ORDER BY {c._ORDER}) AS r FROM scored),
last AS (SELECT target_type, id FROM (SELECT * FROM typed WHERE r <= 6 ORDER BY {c._ORDER} LIMIT 20) ORDER BY {c._ORDER} LIMIT 10),
t AS (SELECT *, 1 AS tier FROM one UNION ALL SELECT *, 2 FROM last)
SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def fallback_cascade(spark, sf_dir):
    """Parts of words: the index may know none, then notes and diaries are looked through."""
    request = " ".join(_LIKE)
    first = search.bm25(visible_documents(spark, sf_dir), _LIKE).orderBy(F.desc("rank"), "target_type", "id").limit(40).select("target_type", "id")
    o = relational.active(model.observations(spark, sf_dir), "deleted").select(F.lit("memory").alias("target_type"), "id", "text", F.col("created_at").alias("updated_at"), F.col("confidence").cast("double").alias("confidence"))
    d = relational.active(model.diaries(spark, sf_dir), "deleted").select(F.lit("diary").alias("target_type"), "id", "text", F.col("created_at").alias("updated_at"), F.lit(1.0).alias("confidence"))
    return search.tiers(first, search.by_words(o.unionByName(d), request, 10, NOW).select("target_type", "id"))


# The index --------------------------------------------------------------------------------------


@query("bm25_index", ORACLES["bm25_topk"])
def bm25_index(spark, sf_dir):
    """The same ranks from postings as from the texts."""
    visible = visible_documents(spark, sf_dir)
    found = index.bm25(index.postings(visible), index.indexed(visible), c._INDEX)
    return found.orderBy(F.desc("rank"), "target_type", "id").limit(40).select("target_type", "id", F.round("rank", 6).alias("rank"))


def _index_before(spark, sf_dir) -> DataFrame:
    """Documents as an index has seen them: some are missing, some have another text, some are gone since."""
    s = visible_documents(spark, sf_dir)
    old = s.filter("id % 5 <> 1").withColumn("text", F.when(F.col("id") % 5 == 2, F.concat(F.lit("was other "), "text")).otherwise(F.col("text")))
    return old.unionByName(s.filter("id % 5 = 3").withColumn("id", F.col("id") + 10_000_000))


@query("index_backfill", f"""
WITH {c._MODEL}, {c._VISIBLE}
SELECT target_type, id, CASE id % 5 WHEN 1 THEN 'missing' ELSE 'changed' END AS state FROM visible WHERE id % 5 IN (1, 2)
UNION ALL SELECT target_type, id + 10000000, 'gone' FROM visible WHERE id % 5 = 3""")
def index_backfill(spark, sf_dir):
    return index.outdated(visible_documents(spark, sf_dir), index.indexed(_index_before(spark, sf_dir)))


@query("index_upsert", rf"""
WITH {c._MODEL}, {c._VISIBLE},
t AS (SELECT target_type, id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM visible)
SELECT target_type, id, len(list_distinct(t)) AS terms, len(t) AS words FROM t WHERE len(t) > 0""")
def index_upsert(spark, sf_dir):
    """Terms and words of every document after an index was brought up to date."""
    before = _index_before(spark, sf_dir)
    postings, _ = index.refresh(visible_documents(spark, sf_dir), index.postings(before), index.indexed(before))
    return postings.groupBy("target_type", "id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("words"))


# Durable notes ----------------------------------------------------------------------------------

_EDGE = _ident("rel", "'decision:9'", "'supersedes'", "s.subject_id")


@query("supersede_existing", f"""
WITH {c._GRAPH}, s AS (SELECT DISTINCT subject_id FROM relations WHERE subject_id IN ('nation:1', 'nation:2')),
hit AS (SELECT r.*, r.status = 'active' AND s.subject_id IS NOT NULL AS hit, {_EDGE} AS edge FROM relations r LEFT JOIN s ON s.subject_id = r.subject_id)
SELECT id, predicate, subject_id, object_id, CASE WHEN hit THEN 'superseded' ELSE status END AS status,
       CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE valid_to END AS valid_to, CASE WHEN hit THEN edge ELSE superseded_by END AS superseded_by FROM hit
UNION ALL SELECT {_EDGE}, 'supersedes', 'decision:9', s.subject_id, 'active', NULL, NULL FROM s""")
def supersede_existing(spark, sf_dir):
    by = spark.createDataFrame([("nation:1", "decision:9"), ("nation:2", "decision:9"), ("nation:1", "nation:1")], "subject_id string, decision_id string")
    return graph.supersede(model.relations(spark, sf_dir), by, NOW).select("id", "predicate", "subject_id", "object_id", "status", "valid_to", "superseded_by")


@query("invalidate", f"""
WITH {c._GRAPH}, g AS (SELECT 'nc/' || c_custkey AS id FROM customer WHERE c_custkey % 4 = 0)
SELECT id, CASE WHEN id IN (SELECT id FROM g) THEN 'invalidated' ELSE status END AS status,
       CASE WHEN id IN (SELECT id FROM g) THEN coalesce(valid_to, TIMESTAMP '{NOW}') ELSE valid_to END AS valid_to FROM relations""")
def invalidate(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("nc/"), F.col("c_custkey").cast("string")).alias("id"))
    return graph.invalidate(model.relations(spark, sf_dir), gone, NOW).select("id", "status", "valid_to")


def _targets(spark, sf_dir) -> DataFrame:
    part = lambda df, kind: df.select(F.lit(kind).alias("target_type"), "id", "deleted", F.lit(False).alias("suppressed"), F.when(F.col("deleted"), "earlier").alias("forget_reason"))
    return part(model.observations(spark, sf_dir), "memory").unionByName(part(model.diaries(spark, sf_dir), "diary"))


@query("forget_modes", f"""
WITH {c._MODEL},
t AS (SELECT 'memory' AS target_type, id, deleted FROM observations UNION ALL SELECT 'diary', id, deleted FROM diaries)
SELECT target_type, id, deleted OR id % 6 = 0 AS deleted, id % 5 = 0 AS suppressed,
       CASE WHEN id % 5 = 0 THEN 'hidden' WHEN id % 6 = 0 AND NOT deleted THEN 'outdated' WHEN deleted THEN 'earlier' END AS forget_reason
FROM t WHERE id % 7 <> 0""")
def forget_modes(spark, sf_dir):
    """Soft, then suppress, then hard; earlier reasons stay where nothing is done."""
    rows = _targets(spark, sf_dir)
    for mode, every, reason in (("soft", 6, "outdated"), ("suppress", 5, "hidden"), ("hard", 7, None)):
        rows = durable.forget_targets(rows, _targets(spark, sf_dir).filter(F.col("id") % every == 0), mode, reason)
    return rows


@query("diary_save", """
WITH t AS (SELECT conv_id, coalesce(text, '') AS text, role FROM conversations WHERE turn = 0),
e AS (SELECT conv_id, text, role,
             text || CASE WHEN conv_id % 3 > 0 THEN chr(10) || 'Added: ' || CASE conv_id % 3 WHEN 1 THEN 'a.ts' ELSE 'a.ts, b.ts' END ELSE '' END
                  || CASE WHEN conv_id % 2 = 1 THEN chr(10) || 'Changed: p0, p1, p2, p3, p4, p5, p6, p7' ELSE '' END AS summary FROM t),
b AS (SELECT *, role || CASE WHEN summary <> '' THEN chr(10) || summary ELSE '' END || chr(10) || 'note, day' AS body FROM e)
SELECT CAST(conv_id AS VARCHAR) AS id, summary, sha256(body) AS content_hash,
       len(list_filter(string_split_regex(summary, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) >= 4 AS accepted FROM b""".replace("\\\\", "\\"))
def diary_save(spark, sf_dir):
    """The first turns as diary entries, with what was added and changed."""
    first = table(spark, sf_dir, "conversations").filter("turn = 0")
    none = F.array().cast("array<string>")
    added = F.when(F.col("conv_id") % 3 == 1, F.array(F.lit("a.ts"))).when(F.col("conv_id") % 3 == 2, F.array(F.lit("a.ts"), F.lit("b.ts"))).otherwise(none)
    changed = F.when(F.col("conv_id") % 2 == 1, F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("p"), i.cast("string")))).otherwise(none)
    rows = first.select(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("subject"), F.coalesce("text", F.lit("")).alias("summary"), F.array(F.lit("note"), F.lit("day")).alias("tags"), added.alias("added"), changed.alias("changed"))
    return durable.diary_entry(rows, NOW).select("id", "summary", "content_hash", "accepted")


_STEM = f"regexp_replace({_NAME}, '(.)[.][^.]+$', '\\1')"


@query("projection_upsert", rf"""
WITH {c._MODEL}, {_FILES},
notes AS (SELECT 'n' || s.id AS id, CASE s.id % 3 WHEN 0 THEN 'constraint' ELSE 'fact' END AS kind, s.path AS source, o.path AS other FROM sections s JOIN sections o ON o.id = s.id + 5),
said AS (
  SELECT id, kind, 'source' AS field, unnest([source, string_split(source, '/')[-1], {_STEM.replace('path', 'source')}]) AS value, 1.0 AS confidence FROM notes
  UNION ALL SELECT id, kind, 'tag', split_part(source, '/', 1), 0.8 FROM notes
  UNION ALL SELECT id, kind, 'content', other, 0.7 FROM notes),
form AS (SELECT *, {_alias('value')} AS form FROM said),
best AS (SELECT id, kind, form, arg_max(field, (confidence, field, value)) AS field, max(confidence) AS confidence FROM form GROUP BY 1, 2, 3),
met AS (SELECT id, kind, entity_id, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields FROM best b JOIN names a ON a.value = b.form GROUP BY 1, 2, 3),
ends AS (SELECT {_ident('ent', "'memory'", 'id')} AS subject_id, CASE kind WHEN 'constraint' THEN 'applies_to' ELSE 'concerns' END AS predicate, entity_id AS object_id, confidence, fields FROM met)
SELECT {_ident('rel', 'subject_id', 'predicate', 'object_id')} AS id, subject_id, predicate, object_id, CAST(confidence AS DOUBLE) AS confidence, fields FROM ends""")
def projection_upsert(spark, sf_dir):
    """Notes that name a source, a tag and, in back quotes, another file: their edges to files and modules."""
    s = model.sections(spark, sf_dir).select("id", "path")
    other = s.select((F.col("id") - 5).alias("id"), F.col("path").alias("other"))
    none = F.lit(None).cast("string")
    notes = s.join(other, "id").select(
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 3 == 0, "constraint").otherwise("fact").alias("kind"), F.col("path").alias("source"), none.alias("subject"),
        F.array(F.substring_index("path", "/", 1), F.lit("x")).alias("tags"), F.concat(F.lit("see `"), "other", F.lit("`")).alias("content"), none.alias("summary"),
    )
    return graph.project_notes(notes, _file_graph(spark, sf_dir)[2], NOW)[1].select("id", "subject_id", "predicate", "object_id", "confidence", "fields")


# Module artifacts -------------------------------------------------------------------------------

_MODULES = f"""
m AS (SELECT split_part(path, '/', 1) AS path, source_role, count(DISTINCT path) AS file_count, count(*) AS section_count FROM sections GROUP BY 1, 2),
modules AS (SELECT *, file_count || ' files, ' || section_count || ' sections' AS summary, array_to_string(list_filter(string_split_regex(lower(path), '[/._-]+'), lambda w: length(w) > 2)[1:8], ', ') AS topics FROM m)"""


@query("module_rows", f"""
WITH {c._MODEL}, {_MODULES}
SELECT {_ident('module', 'path', 'source_role')} AS id, path, source_role, summary, file_count, section_count, {_ident('ent', "'module:' || path || '#' || source_role")} AS entity,
       'module: ' || path || chr(10) || 'role: ' || source_role || chr(10) || 'summary: ' || summary || chr(10) || 'topics: ' || topics AS text FROM modules""")
def module_rows(spark, sf_dir):
    """Rows of modules, of which those of changed files were made anew."""
    s = model.sections(spark, sf_dir)
    before = modules.module_rows(s.filter("id % 3 <> 0"))
    changed = projection.affected_modules(s.select("path", F.lit("changed").alias("change")))
    return modules.rebuilt(before, s, changed).select("id", "path", "source_role", "summary", "file_count", "section_count", F.element_at("entities", 1).alias("entity"), "text")


@query("module_graph_edges", f"WITH {c._MODEL}, {_FILES} SELECT rel AS id, src AS subject_id, 'contains' AS predicate, dst AS object_id FROM links")
def module_graph_edges(spark, sf_dir):
    return _file_graph(spark, sf_dir)[1].drop("status")


_PACKAGE = _ident("ent", "'package'", _alias("{0}"))


@query("metadata_graph", f"""
WITH m AS (SELECT n_name AS name, 'p' || n_nationkey || '/package.json' AS path, r_name AS dependency FROM nation JOIN region ON r_regionkey = n_regionkey),
k AS (SELECT name, path, unnest(['build', 'test']) AS script FROM m),
e AS (
  SELECT {_PACKAGE.format('name')} AS subject_id, 'uses_package' AS predicate, {_PACKAGE.format('dependency')} AS object_id FROM m
  UNION SELECT {_PACKAGE.format('name')}, 'contains', {_ident('ent', "'command'", _alias("(path || '#' || script)"))} FROM k
  UNION SELECT {_ident('ent', "'command'", _alias("(path || '#' || script)"))}, 'uses_package', {_PACKAGE.format('name')} FROM k
  UNION SELECT {_ident('ent', "'module:' || path || '#package_config'")}, 'contains', {_PACKAGE.format('name')} FROM m)
SELECT {_ident('rel', 'subject_id', 'predicate', 'object_id')} AS id, * FROM e""")
def metadata_graph(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    path = F.concat(F.lit("p"), F.col("n_nationkey").cast("string"), F.lit("/package.json"))
    m = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(path.alias("path"), F.col("n_name").alias("name"), F.array("r_name").alias("dependencies"), F.array(F.lit("build"), F.lit("test")).alias("scripts"))
    return modules.metadata_graph(m)[1]


@query("module_files", f"WITH {c._MODEL} SELECT id, starts_with(path, 'src/') AS in_src, NOT contains(path, '/') AS top, regexp_matches(lower(path), '^docs/|^[.]agents/') AS tells FROM sections")
def module_files(spark, sf_dir):
    s = model.sections(spark, sf_dir)
    return s.select("id", modules.of_module(F.col("path"), "src").alias("in_src"), modules.of_module(F.col("path"), ".").alias("top"), modules.tells_of_project(F.col("path")).alias("tells"))


@query("key_files", f"""
WITH {c._MODEL}, {c._VISIBLE}, h AS ({ORACLES['warmup_highlights']}),
p AS (SELECT v.path, row_number() OVER (ORDER BY h.score DESC, h.target_type, h.id) AS position FROM h JOIN visible v ON v.target_type = h.target_type AND v.id = h.id WHERE v.path IS NOT NULL),
e AS (SELECT 0 AS o, position, path FROM p UNION ALL SELECT 1, 0, path FROM sections WHERE source_role = 'agent_config'),
f AS (SELECT path, min((o, position, path)) AS place FROM e GROUP BY path ORDER BY place LIMIT 12)
SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS n, path FROM f""")
def key_files(spark, sf_dir):
    docs = visible_documents(spark, sf_dir)
    high = durable.highlights(docs, NOW).join(docs.select("target_type", "id", "path"), ["target_type", "id"]).filter("path is not null")
    placed = high.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "target_type", "id")))  # at most 12 rows
    return modules.key_files(placed, model.sections(spark, sf_dir).filter("source_role = 'agent_config'").select("path"))


_LINE = "substr(" + c._SQUEEZE.format("text") + ", 1, 120)"
_SUMMARY = "CASE WHEN length(s) > 240 THEN rtrim(substr(s, 1, 237)) || '...' ELSE s END"


@query("warmup_context", f"""
WITH {c._MODEL}, {c._VISIBLE}, {_MODULES},
g AS (SELECT 0 AS o, 'guidance' AS part, row_number() OVER (ORDER BY x.score DESC, x.id) AS position, CAST(x.id AS VARCHAR) AS ref, x.kind || ': ' || {_SUMMARY} AS line
      FROM ({ORACLES['warmup_guidance']}) x JOIN (SELECT id, {c._SQUEEZE.format('text')} AS s FROM observations WHERE NOT deleted) n ON n.id = x.id),
h AS (SELECT 1, 'highlight', row_number() OVER (ORDER BY x.score DESC, x.target_type, x.id), coalesce(v.path, CAST(v.id AS VARCHAR)), coalesce(v.path, CAST(v.id AS VARCHAR)) || ': ' || {_LINE}
      FROM ({ORACLES['warmup_highlights']}) x JOIN visible v ON v.target_type = x.target_type AND v.id = x.id),
k AS (SELECT 2, 'module', row_number() OVER (ORDER BY section_count DESC, file_count DESC, path, source_role), path, path || ' (' || source_role || '): ' || summary
      FROM (SELECT * FROM modules ORDER BY section_count DESC, file_count DESC, path, source_role LIMIT 12)),
t AS (SELECT * FROM g UNION ALL SELECT * FROM h UNION ALL SELECT * FROM k),
r AS (SELECT *, CAST(greatest(1, ceil(length(line) / 4.0)) AS BIGINT) AS cost FROM t)
SELECT part, CAST(position AS INTEGER) AS position, ref, line, cost FROM (SELECT *, sum(cost) OVER (ORDER BY o, position) AS total FROM r) WHERE total <= 1000""")
def warmup_context(spark, sf_dir):
    notes = relational.active(model.observations(spark, sf_dir), "deleted")
    return modules.warm_up(visible_documents(spark, sf_dir), model.sections(spark, sf_dir), notes, NOW, 1000)


# Transfer and output ----------------------------------------------------------------------------


@query("export_format", f"""
WITH {c._MODEL}
SELECT '{durable.FORMAT}' AS format, 'memory' AS kind, CAST(id AS VARCHAR) AS id, sha256(text) AS content_hash, created_at FROM observations WHERE NOT deleted
UNION ALL SELECT '{durable.FORMAT}', 'diary', CAST(id AS VARCHAR), sha256(text), created_at FROM diaries WHERE NOT deleted""")
def export_format(spark, sf_dir):
    rows = durable.export_rows(model.observations(spark, sf_dir), model.diaries(spark, sf_dir))
    return rows.select("format", "kind", "id", "content_hash", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("import_dedupe_any", f"""
WITH {c._MODEL},
t AS (SELECT 'memory' AS kind, id, text FROM observations UNION ALL SELECT 'diary', id, text FROM diaries UNION ALL SELECT 'diary', id + 1000000, text FROM diaries WHERE id % 9 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, sha256(text) ORDER BY CAST(id AS VARCHAR)) AS n FROM t)
SELECT kind, CAST(id AS VARCHAR) AS id,
       CASE WHEN n > 1 OR (kind = 'memory' AND sha256(text) IN (SELECT sha256(text) FROM observations WHERE id % 4 = 0)) THEN 'duplicate' ELSE 'saved' END AS outcome FROM r""")
def import_dedupe_any(spark, sf_dir):
    """An export that has some rows twice, into a store that knows every fourth note, deleted ones too."""
    o, d = model.observations(spark, sf_dir), model.diaries(spark, sf_dir)
    rows = durable.export_rows(o, d.unionByName(d.filter("id % 9 = 0").withColumn("id", F.col("id") + 1_000_000)), include_inactive=True)
    known = o.filter("id % 4 = 0").select(F.lit("memory").alias("kind"), F.sha2("text", 256).alias("content_hash"))
    return durable.judge_import(rows, known).select("kind", "id", "outcome")


ORACLES["recall_package"] = f"""
WITH RECURSIVE found AS ({c._search_sql(4, 20, True)}), {c._MODEL},
e AS (SELECT f.*, {c._EXCERPT.format('r.text')} AS excerpt FROM found f JOIN retrieval r ON r.target_type = f.target_type AND r.id = f.id),
o AS (SELECT *, row_number() OVER (PARTITION BY target_type, path, substr(excerpt, 1, 120) ORDER BY score DESC, id) AS k FROM e),
s AS (SELECT * EXCLUDE (k), CAST(ceil(length(excerpt) / 4.0) AS BIGINT) AS cost, row_number() OVER (ORDER BY score DESC, target_type, id) AS n FROM o WHERE k = 1),
g(n, used, kept) AS (
  SELECT n, cost, true FROM s WHERE n = 1
  UNION ALL SELECT s.n, CASE WHEN g.used + s.cost <= 2000 THEN g.used + s.cost ELSE g.used END, g.used + s.cost <= 2000 FROM g JOIN s ON s.n = g.n + 1)
SELECT s.target_type, s.id, s.path, s.lexical, s.score, s.excerpt, s.cost FROM s JOIN g ON g.n = s.n WHERE g.kept"""


@query("target_labels", f"""
WITH {c._MODEL}
SELECT target_type, id, coalesce(path, CAST(id AS VARCHAR)) || CASE WHEN id % 2 = 0 THEN '#a' || id ELSE '' END AS label FROM retrieval""")
def target_labels(spark, sf_dir):
    anchor = F.when(F.col("id") % 2 == 0, F.concat(F.lit("a"), F.col("id").cast("string"))).when(F.col("id") % 4 == 1, F.lit(""))
    return model.retrieval_documents(spark, sf_dir).select("target_type", "id", text.target_label(F.col("path"), F.col("id"), anchor).alias("label"))


@query("path_aliases", f"""
WITH {c._MODEL}, n AS (SELECT id, path, {_NAME} AS name FROM sections)
SELECT id, array_to_string(list_distinct([path]) || list_filter([name, regexp_replace(name, '(.)[.][^.]+$', '\\1')], lambda x: x <> path), '|') AS names FROM n""")
def path_aliases(spark, sf_dir):
    return model.sections(spark, sf_dir).select("id", F.array_join(text.path_aliases(F.col("path")), "|").alias("names"))


@query("json_objects", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k') END AS k, event_id % 4 = 0 AS is_object FROM events")
def json_objects(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("{broken "), "event_type"))
    known = table(spark, sf_dir, "events").select("event_id", text.json_object(raw).alias("o"))
    return known.select("event_id", F.element_at("o", F.lit("k")).alias("k"), F.col("o").isNotNull().alias("is_object"))


@query("taxonomy_links", f"""
WITH {c._MODEL}, p AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM sections)
SELECT DISTINCT array_to_string(parts[1:d], '/') AS node, path FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS d FROM p)""")
def taxonomy_links(spark, sf_dir):
    return projection.links(model.sections(spark, sf_dir).select("path"))


@query("live_counts", f"""
WITH {c._MODEL}, {_FILES}
SELECT 'sections' AS name, count(*) AS n FROM sections WHERE NOT deleted AND NOT suppressed UNION ALL SELECT 'memories', count(*) FROM observations WHERE NOT deleted
UNION ALL SELECT 'diaries', count(*) FROM diaries WHERE NOT deleted UNION ALL SELECT 'entities', count(*) FROM nodes UNION ALL SELECT 'relations', count(*) FROM links
UNION ALL SELECT 'modules', count(*) FROM (SELECT DISTINCT split_part(path, '/', 1), source_role FROM sections)
UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events""")
def live_counts(spark, sf_dir):
    """The eight counts of a status."""
    s = model.sections(spark, sf_dir)
    nodes, edges, _ = _file_graph(spark, sf_dir)
    live = lambda df: relational.active(df, "deleted")
    return relational.counts(
        sections=relational.active(s, "deleted", "suppressed"), memories=live(model.observations(spark, sf_dir)), diaries=live(model.diaries(spark, sf_dir)), entities=nodes.select("id", "name").distinct(), relations=edges,
        modules=modules.module_rows(s), embeddings=table(spark, sf_dir, "embeddings"), events=table(spark, sf_dir, "events"),
    )
