"""Queries of what the store is made of: the commit log, index segments, groups of vectors, the index tier and the cascade of tiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemodex.operators import commits, graph, index, nested, projection, relational, search
from mnemodex.plans import catalogue as c
from mnemodex.plans.catalogue import NOW, ORACLES, query, visible_documents
from mnemodex.plans.composed import _any, _index_before
from mnemodex.sources import model
from mnemodex.sources.model import table

# Commits ----------------------------------------------------------------------------------------
#
# The events stand for a log: a user is a table, two events have one number, and an error is a commit after which the table is gone.

_LOG = """
rows AS (SELECT event_id // 2 AS number, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'u' || user_id AS name,
                CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 'a' || event_id || ' b' || event_id ELSE 'a' || event_id END AS parts FROM events),
one AS (SELECT number, arg_min(name, id) AS name, arg_min(coalesce(parts, ''), id) AS parts FROM rows GROUP BY number)"""


def _log(spark, sf_dir):
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    part = lambda letter: F.concat(F.lit(letter), F.col("event_id").cast("string"))
    parts = F.when(F.col("event_type") == "error", F.array().cast("array<string>")).when(F.col("event_type") == "signup", F.array(part("a"), part("b"))).otherwise(F.array(part("a")))
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 2).alias("number"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"),
        F.lit(1).cast("long").alias("n"), F.array(F.struct(name.alias("name"), parts.alias("parts"))).alias("tables"), F.array(part("z")).alias("dropped"),
    )


@query("commit_state", f"""
WITH {_LOG},
last AS (SELECT 'now' AS seen, name, arg_max(parts, number) AS parts, max(number) AS number FROM one GROUP BY name
         UNION ALL SELECT 'before', name, arg_max(parts, number), max(number) FROM one WHERE number <= (SELECT max(number) // 2 FROM one) GROUP BY name)
SELECT seen, name, parts, CAST(number AS BIGINT) AS number FROM last WHERE parts <> ''""")
def commit_state(spark, sf_dir):
    """The state of all tables at the last commit and at the one half-way, from the log alone."""
    log = _log(spark, sf_dir)
    half = log.agg(F.floor(F.max("number") / 2)).first()[0] or 0
    seen = lambda name, upto: commits.state(log, upto).select(F.lit(name).alias("seen"), "name", F.array_join("parts", " ").alias("parts"), "number")
    return seen("now", None).unionByName(seen("before", half))


@query("commit_droppable", """
SELECT DISTINCT 'z' || event_id AS part FROM events WHERE event_id // 2 <= (SELECT max(event_id // 2) FROM events) - 7""")
def commit_droppable(spark, sf_dir):
    """The parts that none of the last eight commits' states has."""
    return commits.droppable(_log(spark, sf_dir), 8)


# The index in segments --------------------------------------------------------------------------


@query("index_segments", f"""
WITH top AS ({ORACLES['bm25_topk']})
SELECT 'segments' AS state, target_type, id, rank FROM top UNION ALL SELECT 'merged', target_type, id, rank FROM top""")
def index_segments(spark, sf_dir):
    """An old segment, tombstones for what has changed or gone, and a segment of what is new: ranks as of an index made anew, before and after the two are merged."""
    docs, before = visible_documents(spark, sf_dir), _index_before(spark, sf_dir)
    named = lambda rows, name: rows.withColumn("segment", F.lit(name))
    first = named(index.indexed(before), "a")
    work = index.outdated(docs, first)
    gone = index.tombstones(first, first.limit(0), work)
    new = docs.join(work.filter("state <> 'gone'"), index.KEY, "left_semi")
    listed = first.unionByName(named(index.indexed(new), "b"))
    postings = named(index.postings(before), "a").unionByName(named(index.postings(new), "b"))
    sizes = index.statistics(listed, gone).collect()  # a row for each segment
    total, words = sum(r.docs for r in sizes), sum(r["size"] for r in sizes)

    def top(state, rows, tombstones):
        ranked = index.bm25_segments(rows, tombstones, total, words, c._INDEX)
        return ranked.orderBy(F.desc("rank"), "target_type", "id").limit(40).select(F.lit(state).alias("state"), "target_type", "id", F.round("rank", 6).alias("rank"))

    return top("segments", postings, gone).unionByName(top("merged", index.merged(postings, gone, ["a", "b"], "c"), gone))


# Groups of vectors ------------------------------------------------------------------------------


@query("vector_reconcile", f"""
WITH {c._MODEL},
entries AS (SELECT target_type, id, sha256('m:' || text) AS hash FROM sections WHERE NOT deleted AND NOT suppressed),
vectors AS (SELECT 'section' AS target_type, vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN sha256('m:' || text) ELSE sha256('m:other') END AS hash
            FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 7 <> 1),
matched AS (SELECT coalesce(e.target_type, v.target_type) AS target_type, coalesce(e.id, v.id) AS id, e.hash AS due, v.hash AS has
         FROM entries e FULL JOIN vectors v ON v.target_type = e.target_type AND v.id = e.id)
SELECT target_type, id, CASE WHEN has IS NULL THEN 'missing' WHEN due IS NULL THEN 'orphaned' ELSE 'changed' END AS state
FROM matched WHERE has IS NULL OR due IS NULL OR has <> due""")
def vector_reconcile(spark, sf_dir):
    """Which vectors of one model are missing, orphaned or of another text."""
    s = relational.active(model.sections(spark, sf_dir), "deleted", "suppressed")
    digest = lambda text: F.sha2(F.concat(F.lit("m:"), text), 256)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.lit("section").alias("target_type"), F.col("vec_id").alias("id")).filter("id % 7 <> 1").join(texts, "id", "left")
    vectors = vectors.select("target_type", "id", F.when(F.col("id") % 3 == 0, digest(F.col("text"))).otherwise(digest(F.lit("other"))).alias("hash"))
    return projection.reconcile(s.select("target_type", "id", digest(F.col("text")).alias("hash")), vectors.filter("hash is not null"))


# Tiers ------------------------------------------------------------------------------------------

_HIDDEN = """hidden AS (SELECT id FROM sections WHERE deleted OR suppressed UNION SELECT id FROM observations WHERE deleted UNION SELECT id FROM diaries WHERE deleted)"""
_PLACE = "coalesce(path, '') || chr(10) || text"


def _by_index_sql(wanted: list[str], terms: list[str]) -> str:
    """CTEs up to ``middle``: the index tier over all documents."""
    return f"""{_HIDDEN}, {c._bm25(wanted, 'retrieval')},
best AS (SELECT * FROM ranked WHERE id NOT IN (SELECT id FROM hidden) ORDER BY rank DESC, target_type, id LIMIT 20),
rows AS (SELECT b.*, coalesce(o.confidence, 1.0) AS sure FROM best b LEFT JOIN observations o ON o.id = b.id),
scored AS (SELECT *, CAST(floor({c._hits(_PLACE, terms)} * 100 + sure * 20 + {c._RECENCY.format('updated_at', '20')}
             - ceil({c._TOKENS.format('(' + c._EXCERPT.format('text') + ')')} / 120.0) + 0.5) AS BIGINT) AS score, {c._hits(_PLACE, terms)} AS lexical FROM rows),
typed AS (SELECT *, row_number() OVER (PARTITION BY target_type ORDER BY {c._ORDER}) AS r FROM scored),
middle AS (SELECT target_type, id, path, lexical, score FROM (SELECT * FROM typed WHERE r <= 6 ORDER BY {c._ORDER} LIMIT 40))"""


def _middle(spark, sf_dir, request: str):
    docs = model.retrieval_documents(spark, sf_dir).drop("inactive")
    wanted = search.index_terms(request)
    notes = model.observations(spark, sf_dir)
    shown = lambda rows, *flags: rows.select("id", F.col("deleted"), (F.col("suppressed") if "suppressed" in rows.columns else F.lit(False)).alias("suppressed"))
    hidden = shown(model.sections(spark, sf_dir)).unionByName(shown(notes)).unionByName(shown(model.diaries(spark, sf_dir)))
    ranked = search.bm25(docs, wanted).select("target_type", "id", "rank")
    return search.by_index(search.index_rows(ranked, docs, notes, hidden, 20), request, 20, NOW)


@query("fts_tier", f"""
WITH {c._MODEL}, {_by_index_sql(c._INDEX, c.TERMS)}
SELECT target_type, id, path, CAST(lexical AS INTEGER) AS lexical, score FROM middle""")
def fts_tier(spark, sf_dir):
    """The best of the index with the confidence of their notes; what is hidden anywhere by its id is out."""
    return _middle(spark, sf_dir, c.QUERY).select("target_type", "id", "path", F.col("lexical").cast("int").alias("lexical"), "score")


#: Words of sections; of conversations only; and parts of words.
REQUESTS = ["onenble thereea", "eaanre isontilyed", "onann ntio"]


def _cascade_sql(request: str) -> str:
    wanted, terms = search.index_terms(request), search.query_terms(request)
    return f"""
SELECT '{request}' AS request, * FROM (
WITH {c._MODEL}, {c._VISIBLE}, files AS (SELECT * FROM visible WHERE target_type = 'section'),
first AS (WITH {c._bm25(wanted, 'files')} SELECT target_type, id FROM ranked ORDER BY rank DESC, target_type, id LIMIT 40),
second AS (WITH {_by_index_sql(wanted, terms)} SELECT target_type, id FROM middle),
notes AS (SELECT 'memory' AS target_type, id, text, created_at AS updated_at, confidence FROM observations WHERE NOT deleted
          UNION ALL SELECT 'diary', id, text, created_at, 1.0 FROM diaries WHERE NOT deleted),
newest AS (SELECT *, row_number() OVER (PARTITION BY target_type ORDER BY updated_at DESC, id) AS k FROM notes WHERE {_any('lower(text)', terms)}),
scored AS (SELECT *, CAST(floor({c._hits('text', terms)} * 100 + confidence * 20 + {c._RECENCY.format('updated_at', '20')}
             - ceil({c._TOKENS.format('(' + c._EXCERPT.format('text') + ')')} / 120.0) + 0.5) AS BIGINT) AS score FROM newest WHERE k <= 20),
typed AS (SELECT *, row_number() OVER (PARTITION BY target_type ORDER BY {c._ORDER}) AS r FROM scored),
last AS (SELECT target_type, id FROM (SELECT * FROM typed WHERE r <= 6 ORDER BY {c._ORDER} LIMIT 20) ORDER BY {c._ORDER} LIMIT 10),
t AS (SELECT *, 1 AS tier FROM first UNION ALL SELECT *, 2 FROM second UNION ALL SELECT *, 3 FROM last)
SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t))"""


@query("cascade_tiers", " UNION ALL ".join(map(_cascade_sql, REQUESTS)))
def cascade_tiers(spark, sf_dir):
    """Three requests, each answered by the first tier that has rows: sections, the index of everything, notes and diaries by parts of words."""
    out = None
    for request in REQUESTS:
        wanted = search.index_terms(request)

        def sections(wanted=wanted):
            docs = visible_documents(spark, sf_dir).filter("target_type = 'section'")
            return search.bm25(docs, wanted).orderBy(F.desc("rank"), "target_type", "id").limit(40).select("target_type", "id", F.lit(1).alias("tier"))

        def everything(request=request):
            return _middle(spark, sf_dir, request).select("target_type", "id", F.lit(2).alias("tier"))

        def words(request=request):
            o = relational.active(model.observations(spark, sf_dir), "deleted").select(F.lit("memory").alias("target_type"), "id", "text", F.col("created_at").alias("updated_at"), F.col("confidence").cast("double").alias("confidence"))
            d = relational.active(model.diaries(spark, sf_dir), "deleted").select(F.lit("diary").alias("target_type"), "id", "text", F.col("created_at").alias("updated_at"), F.lit(1.0).alias("confidence"))
            return search.by_words(o.unionByName(d), request, 10, NOW).select("target_type", "id", F.lit(3).alias("tier"))

        found = search.first_with_rows(spark, sections, everything, words).withColumn("request", F.lit(request))
        out = found if out is None else out.unionByName(found)
    return out


# Nested values ----------------------------------------------------------------------------------
#
# Each part is a package: its name and size decide what its manifest nests.

_PACKAGES = """
packages AS (
  SELECT p_partkey AS k, 'pkg/' || p_partkey || '/package.json' AS path,
         '{"name":"' || p_name || '"'
         || CASE p_partkey % 3 WHEN 0 THEN ',"main":"./src/' || p_size || '.js"' WHEN 1 THEN ',"main":7' ELSE '' END
         || CASE p_partkey % 4 WHEN 0 THEN ',"bin":"./cli.js"' WHEN 1 THEN ',"bin":{"a":"./bin/' || p_size || '.js","b":false,"c":"./bin/c.js"}' ELSE '' END
         || CASE p_partkey % 5 WHEN 0 THEN ',"exports":"./only.js"' WHEN 1 THEN ',"exports":{".":{"import":"./i' || p_size || '.mjs","require":["./r.cjs",null,{"node":{"deep":{"er":["./n' || p_partkey || '.js",3,true]}}}]}}'
                            WHEN 2 THEN ',"exports":[]' ELSE '' END
         || CASE p_partkey % 6 WHEN 0 THEN ',"workspaces":["packages/*","apps/' || p_size || '",5]' WHEN 1 THEN ',"workspaces":{"packages":["libs/*"]}' WHEN 2 THEN ',"workspaces":"no"' ELSE '' END
         || CASE WHEN p_partkey % 50 = 0 THEN '' ELSE '}' END AS text
  FROM part)"""


def _packages(spark, sf_dir):
    """The same manifests, put together from columns."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    key = k.cast("string")
    text = cat(
        '{"name":"', F.col("p_name"), '"', F.when(k % 3 == 0, cat(',"main":"./src/', size, '.js"')).when(k % 3 == 1, ',"main":7').otherwise(""),
        F.when(k % 4 == 0, ',"bin":"./cli.js"').when(k % 4 == 1, cat(',"bin":{"a":"./bin/', size, '.js","b":false,"c":"./bin/c.js"}')).otherwise(""),
        F.when(k % 5 == 0, ',"exports":"./only.js"').when(k % 5 == 1, cat(',"exports":{".":{"import":"./i', size, '.mjs","require":["./r.cjs",null,{"node":{"deep":{"er":["./n', key, '.js",3,true]}}}]}}')).when(k % 5 == 2, ',"exports":[]').otherwise(""),
        F.when(k % 6 == 0, cat(',"workspaces":["packages/*","apps/', size, '",5]')).when(k % 6 == 1, ',"workspaces":{"packages":["libs/*"]}').when(k % 6 == 2, ',"workspaces":"no"').otherwise(""),
        F.when(k % 50 == 0, "").otherwise("}"),
    )
    return table(spark, sf_dir, "part").select(k.alias("k"), cat("pkg/", key, "/package.json").alias("path"), text.alias("text"))


@query("exports_walk", f"""
WITH {_PACKAGES}, fine AS (SELECT path, CAST(text AS JSON) AS m FROM packages WHERE k % 50 <> 0),
entries AS (SELECT path, json_extract_string(m, '$.main') AS entry FROM fine WHERE json_type(m, '$.main') = 'VARCHAR'
            UNION SELECT path, json_extract_string(m, '$.bin') FROM fine WHERE json_type(m, '$.bin') = 'VARCHAR'
            UNION SELECT f.path, json_extract_string(t.value, '$') FROM fine f, json_each(f.m, '$.bin') t WHERE json_type(f.m, '$.bin') = 'OBJECT' AND t.type = 'VARCHAR'
            UNION SELECT f.path, json_extract_string(t.value, '$') FROM fine f, json_tree(f.m, '$.exports') t WHERE t.type = 'VARCHAR')
SELECT DISTINCT path, regexp_replace(entry, '^[.]/', '') AS entry FROM entries WHERE regexp_replace(entry, '^[.]/', '') <> ''""")
def exports_walk(spark, sf_dir):
    """The files that each part's package is entered by, from values of any depth."""
    return nested.entry_points(_packages(spark, sf_dir))


@query("workspace_globs", f"""
WITH {_PACKAGES}
SELECT path, CASE k % 6 WHEN 0 THEN 'apps/' || CAST(json_extract_string(CAST(text AS JSON), '$.workspaces[1]') AS VARCHAR)[6:] || '|packages/*' WHEN 1 THEN 'libs/*' ELSE '' END AS globs
FROM packages WHERE k % 50 <> 0""")
def workspace_globs(spark, sf_dir):
    found = nested.workspaces(_packages(spark, sf_dir))
    return found.select("path", F.array_join("globs", "|").alias("globs"))


_PROPS = """props AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '{"origin":"' || event_type || '","path":"a/' || user_id || '"}' WHEN 1 THEN '{"note":"\\"origin\\":\\"click\\"","in":{"origin":"click"}}'
                                 WHEN 2 THEN props ELSE '{"origin":"click' END AS p FROM events)"""


@query("json_fragment_filter", f"""
WITH {_PROPS} SELECT id FROM props WHERE id % 4 = 0 AND json_extract_string(CAST(p AS JSON), '$.origin') = 'click'""")
def json_fragment_filter(spark, sf_dir):
    """Events of one origin, by the property itself: neither nested nor quoted properties that look alike."""
    k, cat = F.col("event_id") % 4, F.concat
    p = F.when(k == 0, cat(F.lit('{"origin":"'), "event_type", F.lit('","path":"a/'), F.col("user_id").cast("string"), F.lit('"}'))).when(k == 1, F.lit('{"note":"\\"origin\\":\\"click\\"","in":{"origin":"click"}}'))
    p = p.when(k == 2, F.col("props")).otherwise(F.lit('{"origin":"click'))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), p.alias("p")).filter(nested.has_value(F.col("p"), "origin", "click")).select("id")


@query("target_entity_lists", """
WITH rows AS (SELECT conv_id AS id, list(role || ':' || turn ORDER BY turn) AS names FROM conversations GROUP BY conv_id)
SELECT id, unnest(names) AS entity, CAST(unnest(range(len(names))) AS INTEGER) AS position FROM rows WHERE id % 5 <> 3""")
def target_entity_lists(spark, sf_dir):
    """The entities that conversations list: names, or objects with an id, in a list of JSON; some lists are none."""
    turn = F.struct("turn", F.concat("role", F.lit(":"), F.col("turn").cast("string")).alias("name"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    one = F.transform("t", lambda x: F.when(x["turn"] % 2 == 0, F.concat(F.lit('"'), x["name"], F.lit('"'))).otherwise(F.concat(F.lit('{"kind":1,"id":"'), x["name"], F.lit('"}'))))
    text = F.when(F.col("conv_id") % 5 == 3, F.lit('{"id":"none"}')).otherwise(F.concat(F.lit("["), F.array_join(one, ","), F.lit("]")))
    return nested.listed_entities(rows.select(F.col("conv_id").alias("id"), text.alias("entities")))


# Suppressions -----------------------------------------------------------------------------------

_LEDGER = """ledger AS (SELECT path, '' AS anchor, content_hash FROM sections WHERE id % 4 = 1),
added AS (SELECT path, '' AS anchor, content_hash, CASE WHEN suppressed THEN 'toxic' ELSE 'poor' END AS reason, updated_at AS created_at FROM sections s
          WHERE (deleted OR suppressed) AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.path = s.path AND l.content_hash = s.content_hash))"""


def _suppressions(spark, sf_dir):
    s = model.sections(spark, sf_dir).withColumns({"anchor": F.lit(None).cast("string"), "forget_reason": F.when(F.col("suppressed"), "toxic").otherwise("poor")})
    ledger = s.filter("id % 4 = 1").select("path", F.lit("").alias("anchor"), "content_hash")
    return s, ledger, relational.new_suppressions(s, ledger)


@query("suppressions_from_select", f"WITH {c._MODEL}, {_LEDGER} SELECT * FROM added")
def suppressions_from_select(spark, sf_dir):
    """What a run has to remember of the sections that it clears, besides what the ledger knows."""
    return _suppressions(spark, sf_dir)[2]


@query("suppressed_again", f"""
WITH {c._MODEL}, {_LEDGER}, every AS (SELECT path, anchor, content_hash FROM ledger UNION ALL SELECT path, anchor, content_hash FROM added),
again AS (SELECT id, path, CASE WHEN id % 3 = 0 THEN sha256(text || '!') ELSE content_hash END AS content_hash FROM sections)
SELECT id FROM again a WHERE NOT EXISTS (SELECT 1 FROM every e WHERE e.path = a.path AND e.content_hash = a.content_hash)""")
def suppressed_again(spark, sf_dir):
    """The sections that come in when all files are read again, a third of them changed."""
    s, ledger, added = _suppressions(spark, sf_dir)
    again = s.withColumn("content_hash", F.when(F.col("id") % 3 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("content_hash")))
    return relational.unsuppressed(again, ledger.unionByName(added.select(*ledger.columns))).select("id")


# Names and decisions ----------------------------------------------------------------------------


@query("alias_first_match", f"""
WITH {c._GRAPH}, {c._ALIASES},
said AS (SELECT o_orderkey AS request_id, 0 AS position, upper(n_name) AS value, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
         UNION ALL SELECT o_orderkey, 1, c_name, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey
         UNION ALL SELECT o_orderkey, 2, 'customer:' || o_custkey, o_custkey FROM orders),
once AS (SELECT DISTINCT value FROM said),
forms AS (SELECT value, {c._ALIAS.format('value')} AS form FROM once),
found AS (SELECT value, id AS entity_id, 0 AS rank FROM once JOIN entities ON id = value
          UNION ALL SELECT f.value, a.entity_id, 1 FROM forms f JOIN aliases a ON a.value = f.form
          UNION ALL SELECT value, id, 2 FROM once JOIN entities ON lower(name) = lower(value)),
first AS (SELECT request_id, entity_id, min(position * 10 + rank) AS m FROM said JOIN found USING (value) GROUP BY request_id, entity_id)
SELECT request_id, entity_id, CAST(m // 10 AS INTEGER) AS position, CAST(m % 10 AS INTEGER) AS rank,
       CAST(row_number() OVER (PARTITION BY request_id ORDER BY m, entity_id) AS INTEGER) AS n FROM first""")
def alias_first_match(spark, sf_dir):
    """What each order's nation, customer's name and customer's id name, in the order of the first match."""
    t = lambda name: table(spark, sf_dir, name)
    bought = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    said = F.array(F.upper("n_name"), F.col("c_name"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")))
    values = bought.select(F.col("o_orderkey").alias("request_id"), F.posexplode(said).alias("position", "value")).filter("value is not null")
    e = model.entities(spark, sf_dir)
    return graph.first_matches(values, e, graph.aliases(e))


@query("decision_chain", """
WITH o AS (SELECT o_orderkey AS id, o_custkey, sum(CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS part FROM orders),
s AS (SELECT id, max(id) OVER (PARTITION BY o_custkey, part) AS stands, count(*) OVER (PARTITION BY o_custkey, part ORDER BY id DESC) - 1 AS steps FROM o)
SELECT id, stands, CAST(steps AS BIGINT) AS steps FROM s WHERE steps > 0""")
def decision_chain(spark, sf_dir):
    """Each order stands for a decision that the customer's next order supersedes, but for every sixth key: which one stands at the end."""
    o = table(spark, sf_dir, "orders")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    by = o.select(F.col("o_orderkey").alias("old"), after.alias("new")).filter("new is not null and new % 6 <> 0")
    return graph.standing(by)
