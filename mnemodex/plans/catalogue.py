"""Every registered query of the retrieval engine, by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemodex.functions import scores, text
from mnemodex.operators import durable, graph, projection, relational, search, sectioning
from mnemodex.sources import model
from mnemodex.sources.files import skip_reason
from mnemodex.sources.model import NOW, table
from mnemodex.streaming import events as stream

QUERY = "fix the idiot thonor in onnd and for stupid trash"
TERMS = search.query_terms(QUERY)
QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "search_results"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), and the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# SQL pieces -------------------------------------------------------------------------------------

_DAY = "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST({0} % 40 AS INTEGER))"
_MODEL = f"""
marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
sections AS (
  SELECT d.doc_id AS id, 'section' AS target_type,
         CASE d.doc_id % 5 WHEN 0 THEN 'src/' || source || '/f' || d.doc_id || '.ts'
                           WHEN 1 THEN 'src/' || source || '/f' || d.doc_id || '.test.ts'
                           WHEN 2 THEN 'docs/' || source || '/f' || d.doc_id || '.md'
                           WHEN 3 THEN '.agents/' || source || '/f' || d.doc_id || '.json'
                           ELSE 'lib/generated/' || source || '/f' || d.doc_id || '.ts' END AS path,
         CASE d.doc_id % 5 WHEN 0 THEN 'app_code' WHEN 1 THEN 'test_code' WHEN 2 THEN 'product_doc'
                           WHEN 3 THEN 'agent_config' ELSE 'generated' END AS source_role,
         text, sha256(text) AS content_hash, {_DAY.format("d.doc_id")} AS updated_at,
         coalesce(m.quality = 0, false) AS deleted, coalesce(m.toxic = 1, false) AS suppressed
  FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id),
observations AS (
  SELECT item_id AS id, ['fact','constraint','decision','preference','insight','procedure','issue'][CAST(item_id % 7 AS INTEGER) + 1] AS kind,
         text, (item_id % 5 + 1) / 5.0 AS confidence, {_DAY.format("item_id")} AS created_at, item_id % 11 = 0 AS deleted
  FROM benchmark),
diaries AS (
  SELECT conv_id AS id, array_to_string(list(coalesce(text, '') ORDER BY turn, role, text), chr(10)) AS text,
         {_DAY.format("conv_id")} AS created_at, conv_id % 13 = 0 AS deleted
  FROM conversations GROUP BY conv_id),
retrieval AS (
  SELECT target_type, id, path, source_role, text, updated_at, deleted OR suppressed AS inactive FROM sections
  UNION ALL SELECT 'memory', id, NULL, NULL, text, created_at, deleted FROM observations
  UNION ALL SELECT 'diary', id, NULL, NULL, text, created_at, deleted FROM diaries)"""
_SPACE = r"[ \t\n\x0B\f\r]+"
_WORDS = "list_filter(string_split_regex({0}, '" + _SPACE + "'), lambda w: w <> '')"
_TERMS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9_./-]+'), lambda t: length(t) >= 2)"
_TOKEN_ROWS = (
    "WITH l AS (SELECT doc_id, " + _TERMS.format("text") + " AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM l), "
    "f AS (SELECT doc_id, term, min(i) AS i FROM t GROUP BY doc_id, term), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)"
)
_SQUEEZE = "regexp_replace(regexp_replace({0}, '" + _SPACE + "', ' ', 'g'), '^ | $', '', 'g')"
_EXCERPT = "CASE WHEN len(" + _WORDS + ") > 90 THEN array_to_string(" + _WORDS + "[1:90], ' ') || '...' ELSE {0} END"
_TOKENS = "CAST(ceil(len(" + _WORDS + ") * CAST(1.33 AS DOUBLE)) AS BIGINT)"
_RECENCY = f"greatest(0, {{1}} - CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us({{0}})) / 86400000000.0) AS BIGINT))"


def _hits(column: str, wanted: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({column}), '{t}') THEN 1 ELSE 0 END" for t in wanted) + ")"


def _bm25(wanted: list[str], source: str) -> str:
    """CTEs counted, stats and ranked over a relation with target_type, id, text and more."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(wanted))
    df = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(wanted)))
    rank = " + ".join(f"greatest(1e-6, ln((s.n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * c.len / s.mean))" for i in range(len(wanted)))
    found = " OR ".join(f"f{i} > 0" for i in range(len(wanted)))
    return rf"""
tokens AS (SELECT *, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM {source}),
counted AS (SELECT * EXCLUDE (t), len(t) AS len, {tf} FROM tokens),
stats AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM counted),
ranked AS (SELECT c.*, {rank} AS rank FROM counted c, stats s WHERE {found})"""


_INDEX = search.index_terms(QUERY)
_VISIBLE = "visible AS (SELECT * FROM retrieval WHERE NOT inactive)"
_SCORE = (
    "CAST(floor(" + _hits("coalesce(path, '') || chr(10) || text", TERMS) + " * 100 + {vector} * 60 + 20 + " + _RECENCY.format("updated_at", "20")
    + " - ceil(" + _TOKENS.format("(" + _EXCERPT.format("text") + ")") + " / 120.0) + 0.5) AS BIGINT)"
)
_DELTA = "CASE WHEN source_role IN ('agent_reference','generated','agent_config') THEN -60 WHEN source_role IN ('app_code','test_code','package_config') THEN 15 WHEN source_role = 'product_doc' THEN -10 ELSE 0 END + CASE WHEN starts_with(coalesce(path,''),'src/') THEN 25 ELSE 0 END + CASE WHEN coalesce(path,'') LIKE '%.test.ts' THEN 10 ELSE 0 END"
_ORDER = "score DESC, updated_at DESC, target_type, id"


def visible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.retrieval_documents(spark, sf_dir).filter(~F.col("inactive")).drop("inactive")


# Text -------------------------------------------------------------------------------------------


@query("tokenize_terms", f"""{_TOKEN_ROWS}, x AS (SELECT doc_id, array_to_string(list(term ORDER BY n), ' ') AS terms, count(*) FILTER (n <= 8) AS n8 FROM r WHERE n <= 12 GROUP BY doc_id) SELECT d.doc_id, coalesce(x.terms, '') AS terms, coalesce(x.n8, 0) AS n8 FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id""")
def tokenize_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.terms(F.col("text")), " ").alias("terms"), F.size(text.terms(F.col("text"), 8)).cast("long").alias("n8"))


@query("fts_terms", f"""{_TOKEN_ROWS}, x AS (SELECT doc_id, array_to_string(list(regexp_replace(term, '[^a-z0-9_]', '', 'g') ORDER BY n) FILTER (regexp_replace(term, '[^a-z0-9_]', '', 'g') <> ''), ' OR ') AS e FROM r WHERE n <= 12 GROUP BY doc_id) SELECT d.doc_id, coalesce(x.e, '') AS expression FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id""")
def fts_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.match_terms(F.col("text")), " OR ").alias("expression"))


@query("lexical_score", f"""SELECT doc_id, CAST({_hits('text', TERMS)} AS INTEGER) AS hits FROM documents""")
def lexical_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.term_hits(F.col("text"), TERMS).alias("hits"))


@query("excerpt_trim", f"""SELECT doc_id, {_EXCERPT.format('text')} AS excerpt FROM documents""")
def excerpt_trim(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("token_estimate", f"""SELECT doc_id, {_TOKENS.format('text')} AS word_tokens, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS char_tokens FROM documents""")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.word_tokens(F.col("text")).alias("word_tokens"), text.char_tokens(F.col("text")).alias("char_tokens"))


@query("summary_text", f"""WITH x AS (SELECT doc_id, {_SQUEEZE.format('text')} AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 240 THEN rtrim(substr(s, 1, 237)) || '...' ELSE s END AS summary FROM x""")
def summary_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.summary(F.col("text")).alias("summary"))


_ALIAS = _SQUEEZE.format(r"regexp_replace(lower(regexp_replace(regexp_replace(replace({0}, '\', '/'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[_-]+', ' ', 'g')")


@query("alias_normalize", f"""SELECT p_partkey, {_ALIAS.format("p_name || 'HTTPServer_' || p_brand")} AS alias, replace({_ALIAS.format("p_name || 'HTTPServer_' || p_brand")}, ' ', '-') AS dashed FROM part""")
def alias_normalize(spark, sf_dir):
    name = F.concat("p_name", F.lit("HTTPServer_"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.alias_form(name).alias("alias"), F.replace(text.alias_form(name), F.lit(" "), F.lit("-")).alias("dashed"))


@query("slug", f"""SELECT doc_id, regexp_replace(regexp_replace(lower({_SQUEEZE.format('text')}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents""")
def slug(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.slug(F.col("text")).alias("slug"))


_SPLIT = r"list_filter(list_transform(string_split_regex(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: w <> '')"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("topics_top12", rf"""WITH {_MODEL},
w AS (SELECT id, unnest(list_concat({_SPLIT.format(r"regexp_replace(path, '\.[^.]+$', '')")}, {_SPLIT.format('substr(text, 1, 2000)')})) AS word FROM sections),
c AS (SELECT id, word, count(*) AS n FROM w WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY id, word),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS k FROM c)
SELECT id, array_to_string(list(word ORDER BY k), ',') AS topics FROM r WHERE k <= 12 GROUP BY id""")
def topics_top12(spark, sf_dir):
    return sectioning.topics(model.sections(spark, sf_dir).select("id", "path", "text"))


_SECRET_SQL = text.SECRET.replace("'", "''")


@query("note_quality", f"""SELECT doc_id, regexp_matches(text, '{_SECRET_SQL}') AS secret, len({_WORDS.format('text')}) >= 4 AS long_enough FROM documents""")
def note_quality(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.has_secret(F.col("text")).alias("secret"), (F.size(text.words(F.col("text"))) >= 4).alias("long_enough"))


def _redact_sql(x: str) -> str:
    for pattern, by in text.REDACTIONS:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return f"substr({x}, 1, 8000)"


@query("redact", f"""SELECT doc_id, {_redact_sql('text')} AS redacted FROM documents""")
def redact(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.redacted(F.col("text")).alias("redacted"))


@query("content_hash_ids", f"""WITH {_MODEL} SELECT id, content_hash, 'source_' || substr(sha256(path), 1, 32) AS source_id, 'section_' || substr(sha256(path || ':0:file:' || content_hash), 1, 32) AS section_id, sha256('model-a:' || text) AS embedding_hash FROM sections""")
def content_hash_ids(spark, sf_dir):
    s = model.sections(spark, sf_dir)
    return s.select("id", "content_hash", text.identifier("source", F.col("path")).alias("source_id"), text.identifier("section", F.col("path"), F.lit(0), F.lit("file"), F.col("content_hash")).alias("section_id"), F.sha2(F.concat(F.lit("model-a:"), "text"), 256).alias("embedding_hash"))


#: One path for each rule and a few that two rules fit.
SHAPES = [
    "src/app.ts", "src/app.test.ts", "docs/Guide.md", ".agents/skills/a.md", ".agents/a.json", "lib/generated/api.ts", "package.json", "sub/Cargo.toml", "tsconfig.json", ".github/ci.yml",
    ".specs/x.md", "notes/PLAN.md", "a.spec.js", "core/main.py", "LICENSE", "web/vendor/x.js", "x.min.js", "src/types.d.ts", "App.csproj", "deploy/Dockerfile", "q.sql", "conf/x.toml",
]
_SHAPES = "[" + ", ".join(f"'{s}'" for s in SHAPES) + "]"
_SHAPED = f"shaped AS (SELECT page_id, {_SHAPES}[CAST(page_id % {len(SHAPES)} AS INTEGER) + 1] AS path FROM pages)"


def _shaped(spark, sf_dir, shapes=SHAPES):
    at = (F.col("page_id") % len(shapes) + 1).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*[F.lit(s) for s in shapes]), at).alias("path"))


@query("source_role", rf"""
WITH {_SHAPED}, n AS (SELECT page_id, path, lower(path) AS p, regexp_extract(lower(path), '[^/]*$') AS f FROM shaped)
SELECT page_id,
       CASE WHEN regexp_matches(p, '/(generated|__generated__|vendor)/|\.min\.(js|css)$') THEN 'generated'
            WHEN regexp_matches(f, '^(package\.json|cargo\.toml|tsconfig\.json)$|\.(csproj|sln)$') THEN 'package_config'
            WHEN starts_with(p, '.github/') THEN 'tooling_config'
            WHEN starts_with(p, '.agents/skills/') THEN 'agent_reference'
            WHEN starts_with(p, '.agents/') THEN 'agent_config'
            WHEN starts_with(p, '.specs/') OR contains(p, 'plan.md') THEN 'implementation_plan'
            WHEN regexp_matches(p, '\.(test|spec)\.') THEN 'test_code'
            WHEN regexp_matches(f, '\.md$') THEN 'product_doc'
            WHEN regexp_matches(f, '\.(ts|py|js)$') THEN 'app_code' ELSE 'unknown' END AS source_role,
       CASE WHEN regexp_matches(p, '\.d\.ts$') THEN 'typescript_declaration' WHEN regexp_matches(p, '\.md$') THEN 'markdown'
            WHEN regexp_matches(p, 'dockerfile$') THEN 'dockerfile' WHEN regexp_matches(p, '\.ts$') THEN 'typescript'
            WHEN regexp_matches(p, '\.js$') THEN 'javascript' WHEN regexp_matches(p, '\.py$') THEN 'python'
            WHEN regexp_matches(p, '\.json$') THEN 'json'
            WHEN regexp_matches(p, '\.yml$') THEN 'yaml' WHEN regexp_matches(p, '\.toml$') THEN 'toml' ELSE 'unknown' END AS language,
       CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS module
FROM n""")
def source_role(spark, sf_dir):
    return _shaped(spark, sf_dir).select("page_id", text.source_role(F.col("path")).alias("source_role"), text.language(F.col("path")).alias("language"), text.top_module(F.col("path")).alias("module"))


#: Names of every kind, put below the folders of each page's url.
NAMES = [
    "build.gradle", "build.gradle.kts", "bunfig.toml", "Cargo.toml", "composer.json", "Gemfile", "go.mod", "package.json", "Package.swift", "pom.xml", "pubspec.yaml", "pyproject.toml", "settings.gradle",
    "tsconfig.json", "App.sln", "App.csproj", "analysis_options.yaml", "biome.json", "knip.json", "phpunit.xml", "turbo.json", "vite.config.ts", "vitest.config.ts", "tsup.config.ts", "eslint.config.js", "requirements.txt",
    "generated/a.ts", "__generated__/b.go", "vendor/c.php", "d.min.js", "e.min.css", "f.test.ts", "g.spec.rb", "h.md", "README.md", "plan.md", "i.mdx", "j.d.ts", "k.sh", "l.h", "m.hpp", "n.cs", "o.css", "p.dart", "q.htm",
    "r.mjs", "s.jsx", "t.jsdoc", "u.kts", "v.lua", "w.phtml", "x.sc", "y.swift", "z.tsx", "a.cts", "b.zig", "c.jsonc", "d.yml", "e.toml", "f.xml", "Dockerfile", "g.dockerfile", "h.sql", "LICENSE", "i.TXT", "j.Java", "k.rs", "l.py",
]
FOLDERS = ["", ".github/", ".agents/skills/", ".agents/", ".codex/", ".cursor/", ".specs/"]


@query("file_roles", rf"""
WITH names AS (SELECT unnest([{", ".join(f"'{n}'" for n in NAMES)}]) AS name), folders AS (SELECT unnest([{", ".join(f"'{f}'" for f in FOLDERS)}]) AS folder),
urls AS (SELECT DISTINCT ltrim(regexp_extract(coalesce(url, ''), '^[^:/]*://[^/?#]*(/[^?#]*/)', 1), '/') AS place FROM pages),
paths AS (SELECT folder || place || name AS path FROM urls, folders, names),
n AS (SELECT path, lower(path) AS p, regexp_extract(lower(path), '[^/]*$') AS f FROM paths)
SELECT path,
       CASE WHEN regexp_matches(p, '/(generated|__generated__|vendor)/|\.min\.(js|css)$') THEN 'generated'
            WHEN f IN ('build.gradle','build.gradle.kts','bunfig.toml','cargo.toml','composer.json','gemfile','go.mod','package.json','package.swift','pom.xml','pubspec.yaml','pyproject.toml','settings.gradle','tsconfig.json')
                 OR regexp_matches(f, '\.(csproj|sln)$') THEN 'package_config'
            WHEN f IN ('analysis_options.yaml','biome.json','knip.json','phpunit.xml','turbo.json','vite.config.ts','vitest.config.ts','tsup.config.ts') OR starts_with(p, '.github/') THEN 'tooling_config'
            WHEN starts_with(p, '.agents/skills/') THEN 'agent_reference'
            WHEN regexp_matches(p, '^\.(agents|codex|cursor)/') THEN 'agent_config'
            WHEN starts_with(p, '.specs/') OR contains(p, 'plan.md') THEN 'implementation_plan'
            WHEN regexp_matches(p, '\.(test|spec)\.') THEN 'test_code'
            WHEN regexp_matches(f, '\.md$') THEN 'product_doc'
            WHEN regexp_matches(f, '\.(sh|bash|zsh|c|h|cc|cpp|cxx|hpp|hh|hxx|cs|css|dart|go|html|htm|java|js|mjs|cjs|jsx|jsdoc|kt|kts|lua|php|phtml|py|rb|rs|scala|sc|swift|tsx|ts|mts|cts|zig)$') THEN 'app_code'
            ELSE 'unknown' END AS source_role,
       CASE WHEN regexp_matches(p, '\.d\.ts$') THEN 'typescript_declaration' WHEN regexp_matches(p, '\.mdx?$') THEN 'markdown' WHEN regexp_matches(p, 'dockerfile$') THEN 'dockerfile' WHEN regexp_matches(p, '\.xml$') THEN 'xml'
            WHEN regexp_matches(p, '\.(sh|bash|zsh)$') THEN 'bash' WHEN regexp_matches(p, '\.(c|h)$') THEN 'c' WHEN regexp_matches(p, '\.(cc|cpp|cxx|hpp|hh|hxx)$') THEN 'cpp' WHEN regexp_matches(p, '\.cs$') THEN 'csharp'
            WHEN regexp_matches(p, '\.css$') THEN 'css' WHEN regexp_matches(p, '\.dart$') THEN 'dart' WHEN regexp_matches(p, '\.go$') THEN 'go' WHEN regexp_matches(p, '\.html?$') THEN 'html' WHEN regexp_matches(p, '\.java$') THEN 'java'
            WHEN regexp_matches(p, '\.(js|mjs|cjs|jsx)$') THEN 'javascript' WHEN regexp_matches(p, '\.jsdoc$') THEN 'jsdoc' WHEN regexp_matches(p, '\.kts?$') THEN 'kotlin' WHEN regexp_matches(p, '\.lua$') THEN 'lua'
            WHEN regexp_matches(p, '\.(php|phtml)$') THEN 'php' WHEN regexp_matches(p, '\.py$') THEN 'python' WHEN regexp_matches(p, '\.rb$') THEN 'ruby' WHEN regexp_matches(p, '\.rs$') THEN 'rust' WHEN regexp_matches(p, '\.(scala|sc)$') THEN 'scala'
            WHEN regexp_matches(p, '\.swift$') THEN 'swift' WHEN regexp_matches(p, '\.tsx$') THEN 'tsx' WHEN regexp_matches(p, '\.(ts|mts|cts)$') THEN 'typescript' WHEN regexp_matches(p, '\.zig$') THEN 'zig'
            WHEN regexp_matches(p, '\.jsonc?$') THEN 'json' WHEN regexp_matches(p, '\.ya?ml$') THEN 'yaml' WHEN regexp_matches(p, '\.toml$') THEN 'toml' ELSE 'unknown' END AS language
FROM n""")
def file_roles(spark, sf_dir):
    """Role and language of a file of each name in each page's folder."""
    place = F.ltrim(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:/]*://[^/?#]*(/[^?#]*/)", 1), F.lit("/"))
    paths = table(spark, sf_dir, "pages").select(place.alias("place")).distinct()
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    paths = paths.select("place", each(FOLDERS).alias("folder")).select("place", "folder", each(NAMES).alias("name")).select(F.concat("folder", "place", "name").alias("path"))
    return paths.select("path", text.source_role(F.col("path")).alias("source_role"), text.language(F.col("path")).alias("language"))


@query("recency", f"""WITH {_MODEL} SELECT id, {_RECENCY.format('updated_at', '20')} AS search_boost, {_RECENCY.format('updated_at', '10')} AS warm_boost FROM sections""")
def recency(spark, sf_dir):
    s = model.sections(spark, sf_dir)
    return s.select("id", scores.recency(F.col("updated_at"), NOW, 20).alias("search_boost"), scores.recency(F.col("updated_at"), NOW, 10).alias("warm_boost"))


@query("retrieval_text", f"""WITH {_MODEL} SELECT id, 'role: ' || source_role || chr(10) || 'path: ' || path || chr(10) || 'topics: a, b' || chr(10) || chr(10) || text AS body FROM sections""")
def retrieval_text(spark, sf_dir):
    s = model.sections(spark, sf_dir)
    return s.select("id", text.retrieval_text(F.col("source_role"), F.col("path"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b")), F.col("text")).alias("body"))


@query("path_evidence", f"""WITH {_MODEL}, n AS (SELECT id, 'see `' || path || '` and (' || path || ') or "notes.md#x"' AS note FROM sections)
SELECT id, array_to_string(regexp_extract_all(note, '`([^`]{{2,120}})`', 1), '|') AS quoted, array_to_string(regexp_extract_all(note, '{text.PATH_LIKE.replace(chr(39), chr(39) * 2)}', 1), '|') AS paths FROM n""")
def path_evidence(spark, sf_dir):
    note = F.concat(F.lit("see `"), "path", F.lit("` and ("), "path", F.lit(') or "notes.md#x"'))
    s = model.sections(spark, sf_dir).select("id", note.alias("note"))
    return s.select("id", F.array_join(text.quoted_values(F.col("note")), "|").alias("quoted"), F.array_join(text.path_values(F.col("note")), "|").alias("paths"))


SKIPPED = [
    "a/node_modules/x", "conf/.env.local", "img/a.PNG", "logs/run.log", "logs/keep.log", "src/Generated/a.ts", "x/yarn.lock", "k/server.PEM", "lib/app.min.js", "docs/readme.md", ".git/config", "deep/dist/a.log", "tmp/cache/a.ts", "my.env", "node_modules.txt", "a/gen/x.ts", "gen/x.ts", "x/app.js.map", ".npmrc", "coverage.xml", "own/a.ts", "!own/b.ts", "api.pb.go", "p/a.min.mjs", "c/cert.crt",
]
_SKIPPED = "[" + ", ".join(f"'{s}'" for s in SKIPPED) + "]"


@query("skip_reasons", rf"""
WITH s AS (SELECT page_id, {_SKIPPED}[CAST(page_id % {len(SKIPPED)} AS INTEGER) + 1] AS path FROM pages)
SELECT page_id,
       CASE WHEN regexp_matches(lower(path), '(^|/)(node_modules|dist|\.git)(/|$)') THEN 'hard_directory'
            WHEN regexp_matches(lower(path), '/(generated|gen)/|\.map$|\.pb\.go$') THEN 'generated'
            WHEN regexp_matches(lower(path), '\.min\.m?js$') THEN 'minified'
            WHEN regexp_matches(lower(path), '(^|/)yarn\.lock$') THEN 'lockfile'
            WHEN regexp_matches(lower(path), '(^|/)(\.env(\.[^/]*)?|\.npmrc)$') THEN 'secret'
            WHEN regexp_matches(lower(path), '(^|/)coverage\.xml$') THEN 'ignored_file'
            WHEN regexp_matches(lower(path), '\.pem$') THEN 'secret'
            WHEN regexp_matches(lower(path), '\.(png|crt)$') THEN 'binary'
            WHEN regexp_matches(path, '\.log$') AND NOT regexp_matches(path, '(^|/)keep\.log$') OR starts_with(path, 'tmp/') THEN 'vcs_ignore'
            WHEN starts_with(path, 'own/') OR starts_with(path, '!own/') THEN 'project_ignore' END AS reason
FROM s""")
def skip_reasons(spark, sf_dir):
    return _shaped(spark, sf_dir, SKIPPED).select("page_id", skip_reason(F.col("path"), ["# logs", "*.log", "!keep.log", "/tmp/"], ["/own/", "!own/"]).alias("reason"))


@query("intent_flags", f"""SELECT doc_id, regexp_matches(lower(text), '{text.bounded(text.INTENTS['implementation'])}') AS implementation, regexp_matches(lower(text), '{text.bounded(text.INTENTS['needs_history'])}') AS history FROM documents""")
def intent_flags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.intent(F.col("text"), "implementation").alias("implementation"), text.intent(F.col("text"), "needs_history").alias("history"))


# Relational -------------------------------------------------------------------------------------


@query("active_filter", f"WITH {_MODEL} SELECT id, path FROM sections WHERE NOT deleted AND NOT suppressed")
def active_filter(spark, sf_dir):
    return relational.active(model.sections(spark, sf_dir), "deleted", "suppressed").select("id", "path")


@query("like_any", f"WITH {_MODEL} SELECT id FROM observations WHERE NOT deleted AND (lower(text) LIKE '%the%' OR lower(text) LIKE '%keit%')")
def like_any(spark, sf_dir):
    return relational.like_any(relational.active(model.observations(spark, sf_dir), "deleted"), "text", ["the", "keit"]).select("id")


@query("visibility_antijoin", f"WITH {_MODEL} SELECT target_type, id FROM retrieval r WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.id = r.id AND r.target_type = 'section' AND (s.deleted OR s.suppressed)) AND NOT EXISTS (SELECT 1 FROM observations o WHERE o.id = r.id AND r.target_type = 'memory' AND o.deleted)")
def visibility_antijoin(spark, sf_dir):
    s, o = model.sections(spark, sf_dir), model.observations(spark, sf_dir)
    gone = s.filter(F.col("deleted") | F.col("suppressed")).select("target_type", "id").unionByName(o.filter("deleted").select(F.lit("memory").alias("target_type"), "id"))
    return relational.visible(model.retrieval_documents(spark, sf_dir), gone, ["target_type", "id"]).select("target_type", "id")


@query("module_rollup", f"WITH {_MODEL} SELECT split_part(path, '/', 1) AS module_path, source_role, count(DISTINCT path) AS file_count, count(*) AS section_count FROM sections WHERE NOT deleted AND NOT suppressed GROUP BY 1, 2")
def module_rollup(spark, sf_dir):
    return relational.module_rollup(relational.active(model.sections(spark, sf_dir), "deleted", "suppressed"))


@query("warmup_modules", f"WITH {_MODEL}, m AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS module_path, count(DISTINCT path) AS file_count, count(*) AS section_count FROM sections GROUP BY 1) SELECT * FROM m ORDER BY section_count DESC, file_count DESC, module_path LIMIT 12")
def warmup_modules(spark, sf_dir):
    m = model.sections(spark, sf_dir).groupBy(F.substring_index("path", "/", 2).alias("module_path")).agg(F.countDistinct("path").alias("file_count"), F.count(F.lit(1)).alias("section_count"))
    return m.orderBy(F.desc("section_count"), F.desc("file_count"), "module_path").limit(12)


@query("memory_stats", f"WITH {_MODEL} SELECT 'sections' AS name, count(*) AS n FROM sections WHERE NOT deleted UNION ALL SELECT 'memories', count(*) FROM observations WHERE NOT deleted UNION ALL SELECT 'diaries', count(*) FROM diaries WHERE NOT deleted UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events")
def memory_stats(spark, sf_dir):
    live = lambda df: relational.active(df, "deleted")
    return relational.counts(sections=live(model.sections(spark, sf_dir)), memories=live(model.observations(spark, sf_dir)), diaries=live(model.diaries(spark, sf_dir)), embeddings=table(spark, sf_dir, "embeddings"), events=table(spark, sf_dir, "events"))


@query("metadata_files", f"WITH {_MODEL} SELECT DISTINCT path, source_role FROM sections WHERE source_role IN ('product_doc', 'package_config', 'agent_config')")
def metadata_files(spark, sf_dir):
    return model.sections(spark, sf_dir).filter(F.col("source_role").isin("product_doc", "package_config", "agent_config")).select("path", "source_role").distinct()


@query("json_explode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_explode(spark, sf_dir):
    props = F.from_json("props", "map<string,int>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(props).alias("key", "k")).filter("key = 'k' and k is not null").select("event_id", "k")


@query("backfill_antijoin", "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL")
def backfill_antijoin(spark, sf_dir):
    return docs(spark, sf_dir).join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id")


@query("two_key_targets", f"WITH {_MODEL} SELECT target_type, id, updated_at FROM retrieval WHERE (target_type = 'section' AND id = 3) OR (target_type = 'memory' AND id = 5) OR (target_type = 'diary' AND id = 7)")
def two_key_targets(spark, sf_dir):
    wanted = spark.createDataFrame([("section", 3), ("memory", 5), ("diary", 7)], "target_type string, id long")
    return model.retrieval_documents(spark, sf_dir).join(F.broadcast(wanted), ["target_type", "id"]).select("target_type", "id", "updated_at")


_SNAPSHOTS = "a AS (SELECT path, content_hash FROM sections WHERE id % 10 <> 1), b AS (SELECT path, CASE WHEN id % 10 = 2 THEN sha256(text || 'x') ELSE content_hash END AS content_hash FROM sections WHERE id % 10 <> 3)"
_DIFF = f"WITH {_MODEL}, {_SNAPSHOTS}, diff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.content_hash = b.content_hash THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.path = b.path) "


def _diff(spark, sf_dir):
    s = model.sections(spark, sf_dir)
    after = s.filter(F.col("id") % 10 != 3).withColumn("content_hash", F.when(F.col("id") % 10 == 2, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("content_hash")))
    return relational.snapshot_diff(s.filter(F.col("id") % 10 != 1), after)


@query("snapshot_diff", _DIFF + "SELECT * FROM diff")
def snapshot_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query("freshness", _DIFF + "SELECT count(*) FILTER (change <> 'unchanged') AS changed, CASE WHEN count(*) FILTER (change <> 'unchanged') > 0 THEN 'stale' ELSE 'fresh' END AS state FROM diff")
def freshness(spark, sf_dir):
    changed = F.sum((F.col("change") != "unchanged").cast("long"))
    return _diff(spark, sf_dir).agg(changed.alias("changed"), F.when(changed > 0, "stale").otherwise("fresh").alias("state"))


@query("dedupe_batch", f"WITH {_MODEL}, f AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS n FROM sections WHERE id % 2 = 0) SELECT id FROM f WHERE n = 1 AND content_hash NOT IN (SELECT content_hash FROM sections WHERE id % 2 = 1 AND NOT deleted)")
def dedupe_batch(spark, sf_dir):
    s = model.sections(spark, sf_dir)
    return relational.dedupe_batch(s.filter("id % 2 = 0"), relational.active(s.filter("id % 2 = 1"), "deleted"), "content_hash", "id").select("id")


@query("latest_wins", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, 'second', -2.0 FROM customer WHERE c_custkey % 7 = 0")
def latest_wins(spark, sf_dir):
    """Two changes of every third customer and of new ones: the later version wins, and what was there keeps its balance."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    keys = c.filter("c_custkey % 3 = 0").select("c_custkey").unionByName(c.filter("c_custkey % 7 = 0").select(F.expr("c_custkey + 10000000").alias("c_custkey")))
    change = lambda version, value: keys.select("c_custkey", F.lit(value).alias("c_mktsegment"), F.lit(-float(version)).alias("c_acctbal"), F.lit(version).alias("version"))
    changes = change(1, "zz first").unionByName(change(2, "second")).withColumn("c_acctbal", F.lit(-2.0))
    return relational.latest_wins(c, changes, ["c_custkey"], "version", keep=["c_acctbal"])


@query("soft_delete", f"WITH {_MODEL} SELECT id, deleted OR id % 6 = 0 AS deleted, CASE WHEN id % 6 = 0 AND NOT deleted THEN 'outdated' END AS forget_reason FROM observations")
def soft_delete(spark, sf_dir):
    return relational.mark(model.observations(spark, sf_dir), F.col("id") % 6 == 0, "deleted", "outdated").select("id", "deleted", "forget_reason")


@query("forget_by_query", f"WITH {_MODEL}, hit AS (SELECT id FROM observations WHERE NOT deleted AND lower(text) LIKE '%the%' ORDER BY created_at DESC, id LIMIT 10) SELECT o.id, o.deleted OR h.id IS NOT NULL AS deleted FROM observations o LEFT JOIN hit h ON h.id = o.id")
def forget_by_query(spark, sf_dir):
    return durable.forget(model.observations(spark, sf_dir), ["the"]).select("id", "deleted")


@query("save_outcomes", f"""WITH {_MODEL}, b AS (SELECT id, text, CASE WHEN regexp_matches(text, '{_SECRET_SQL}') THEN 'secret' WHEN len({_WORDS.format('text')}) < 4 THEN 'short' END AS bad FROM sections WHERE id % 3 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY text, bad IS NULL ORDER BY id) AS n FROM b)
SELECT id, CASE WHEN bad IS NOT NULL THEN bad WHEN n > 1 OR text IN (SELECT text FROM sections WHERE id % 3 = 0 AND NOT deleted) THEN 'duplicate' ELSE 'saved' END AS outcome FROM r""")
def save_outcomes(spark, sf_dir):
    s = model.sections(spark, sf_dir)
    return durable.judge_notes(s.filter("id % 3 <> 0").select("id", "text"), s.filter("id % 3 = 0").select("id", "text", "deleted"))


@query("semi_join_paths", f"WITH {_MODEL} SELECT DISTINCT path FROM sections WHERE id IN (SELECT doc_id FROM labels)")
def semi_join_paths(spark, sf_dir):
    return model.sections(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("path").distinct()


@query("union_fallback", f"WITH {_MODEL}, o AS (SELECT 'memory' AS target_type, id FROM observations WHERE NOT deleted AND lower(text) LIKE '%and%' ORDER BY created_at DESC, id LIMIT 20), d AS (SELECT 'diary' AS target_type, id FROM diaries WHERE NOT deleted AND lower(text) LIKE '%and%' ORDER BY created_at DESC, id LIMIT 20) SELECT * FROM o UNION ALL SELECT * FROM d")
def union_fallback(spark, sf_dir):
    def part(df, kind):
        return relational.like_any(relational.active(df, "deleted"), "text", ["and"]).orderBy(F.desc("created_at"), "id").limit(20).select(F.lit(kind).alias("target_type"), "id")

    return part(model.observations(spark, sf_dir), "memory").unionByName(part(model.diaries(spark, sf_dir), "diary"))


@query("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return stream.windowed_counts(table(spark, sf_dir, "events"))


@query("latest_event", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event(spark, sf_dir):
    return stream.latest_by_user(table(spark, sf_dir, "events"))


# Search -----------------------------------------------------------------------------------------


@query("bm25_topk", f"WITH {_MODEL}, {_VISIBLE}, {_bm25(_INDEX, 'visible')} SELECT target_type, id, round(rank, 6) AS rank FROM ranked ORDER BY ranked.rank DESC, target_type, id LIMIT 40")
def bm25_topk(spark, sf_dir):
    found = search.bm25(visible_documents(spark, sf_dir), _INDEX)
    return found.orderBy(F.desc("rank"), "target_type", "id").limit(40).select("target_type", "id", F.round("rank", 6).alias("rank"))


def _search_sql(per_type: int, limit: int, recall: bool) -> str:
    gate = "WHERE target_type <> 'diary'" if recall else ""
    delta = f"score + ({_DELTA})" if recall else "score"
    return f"""WITH {_MODEL}, {_VISIBLE}, {_bm25(_INDEX, 'visible')},
found AS (SELECT * FROM ranked ORDER BY rank DESC, target_type, id LIMIT {4 * limit}),
scored AS (SELECT *, {_hits("coalesce(path, '') || chr(10) || text", TERMS)} AS lexical, {_SCORE.format(vector="0")} AS score FROM found),
typed AS (SELECT *, row_number() OVER (PARTITION BY target_type ORDER BY {_ORDER}) AS r FROM scored),
pruned AS (SELECT * FROM typed WHERE r <= {per_type} ORDER BY {_ORDER} LIMIT {2 * limit}),
judged AS (SELECT * REPLACE ({delta} AS score) FROM pruned {gate})
SELECT target_type, id, path, CAST(lexical AS INTEGER) AS lexical, CAST(score AS BIGINT) AS score FROM judged ORDER BY {_ORDER} LIMIT {limit}"""


@query("search_results", _search_sql(6, 10, False))
def search_results(spark, sf_dir):
    """The flagship: ranked search over sections, notes and diaries."""
    return search.search(visible_documents(spark, sf_dir), QUERY, 10, NOW)


@query("recall_results", _search_sql(4, 20, True))
def recall_results(spark, sf_dir):
    return search.search(visible_documents(spark, sf_dir), QUERY, 20, NOW, mode="recall")


@query("prune_per_type", f"WITH {_MODEL}, s AS (SELECT target_type, id, updated_at, CAST(length(text) AS BIGINT) AS score FROM retrieval), t AS (SELECT *, row_number() OVER (PARTITION BY target_type ORDER BY {_ORDER}) AS r FROM s) SELECT target_type, id, score FROM t WHERE r <= 4 ORDER BY {_ORDER} LIMIT 20")
def prune_per_type(spark, sf_dir):
    rows = model.retrieval_documents(spark, sf_dir).select("target_type", "id", "updated_at", F.length("text").cast("long").alias("score"))
    return search.prune(rows, 4, 10).select("target_type", "id", "score")


_VECTOR = [((i * 37) % 19 - 9) / 10.0 for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in _VECTOR) + "]"
_NEAR = f"near AS (SELECT vec_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR_SQL}) AS distance FROM embeddings)"


@query("knn_exact", f"WITH {_NEAR} SELECT vec_id, round(distance, 6) AS distance FROM near ORDER BY near.distance, vec_id LIMIT 20")
def knn_exact(spark, sf_dir):
    return search.nearest(table(spark, sf_dir, "embeddings"), _VECTOR, 20).select("vec_id", F.round("distance", 6).alias("distance"))


_FRESH = "v AS (SELECT vec_id, 'section' AS target_type, vec_id % 4 <> 0 AS fresh, distance FROM near)"
_HYBRID = f"""
{_NEAR}, {_FRESH},
lexical AS (SELECT r.target_type, r.id, path, source_role, text, updated_at, CASE WHEN v.fresh THEN 1 - v.distance END AS vector
            FROM (SELECT * FROM ranked ORDER BY rank DESC, target_type, id LIMIT 40) r LEFT JOIN v ON v.vec_id = r.id AND v.target_type = r.target_type),
n AS (SELECT vec_id, greatest(0, least(1, 1 - distance / 2)) AS vector FROM near ORDER BY near.distance, vec_id LIMIT 40),
extra AS (SELECT d.target_type, d.id, d.path, d.source_role, d.text, d.updated_at, n.vector FROM visible d JOIN n ON n.vec_id = d.id AND d.target_type = 'section'
          WHERE NOT EXISTS (SELECT 1 FROM lexical l WHERE l.target_type = d.target_type AND l.id = d.id)),
every AS (SELECT * FROM lexical UNION ALL SELECT * FROM extra),
scored AS (SELECT *, {_hits("coalesce(path, '') || chr(10) || text", TERMS)} AS lexical, {_SCORE.format(vector="coalesce(vector, 0)")} AS score FROM every),
typed AS (SELECT *, row_number() OVER (PARTITION BY target_type ORDER BY {_ORDER}) AS r FROM scored),
pruned AS (SELECT * FROM typed WHERE r <= 6 ORDER BY {_ORDER} LIMIT 20)"""


def section_vectors(spark, sf_dir):
    """Vectors of sections, of model ``model-a``; every fourth is of a text that has changed since."""
    old = F.when(F.col("id") % 4 == 0, F.lit("model-a:old")).otherwise(F.concat(F.lit("model-a:"), "text"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    s = model.sections(spark, sf_dir).select("id", F.sha2(old, 256).alias("hash"))
    return v.join(s, "id", "left").select(F.lit("section").alias("target_type"), "id", F.lit("model-a").alias("model"), "hash", "embedding")


@query("hybrid_search", f"""WITH {_MODEL}, {_VISIBLE}, {_bm25(_INDEX, 'visible')}, {_HYBRID}
SELECT target_type, id, CAST(lexical AS INTEGER) AS lexical, round(vector, 6) AS vector, CAST(score AS BIGINT) AS score FROM pruned ORDER BY {_ORDER} LIMIT 10""")
def hybrid_search(spark, sf_dir):
    found = search.retrieve(visible_documents(spark, sf_dir), QUERY, 10, NOW, vectors=section_vectors(spark, sf_dir), vector=_VECTOR, model="model-a")
    return found.select("target_type", "id", "lexical", F.round("vector", 6).alias("vector"), "score")


@query("fallback_tiers", f"""
WITH {_MODEL},
t AS (SELECT 'section' AS target_type, id, 1 AS tier FROM sections WHERE length(text) > 40000 AND lower(text) LIKE '%the%'
      UNION ALL SELECT 'memory', id, 2 FROM observations WHERE NOT deleted AND lower(text) LIKE '%the%'
      UNION ALL SELECT 'diary', id, 3 FROM diaries)
SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def fallback_tiers(spark, sf_dir):
    """Very long sections, or else notes, or else diaries: whichever has rows first."""
    long = relational.like_any(model.sections(spark, sf_dir).filter(F.length("text") > 40_000), "text", ["the"]).select("target_type", "id")
    notes = relational.like_any(relational.active(model.observations(spark, sf_dir), "deleted"), "text", ["the"]).select(F.lit("memory").alias("target_type"), "id")
    last = model.diaries(spark, sf_dir).select(F.lit("diary").alias("target_type"), "id")
    return search.tiers(long, notes, last)


@query("vector_freshness", f"WITH {_MODEL} SELECT s.id, CASE WHEN e.vec_id IS NULL THEN 'needs_embedding' WHEN s.id % 4 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM sections s LEFT JOIN embeddings e ON e.vec_id = s.id")
def vector_freshness(spark, sf_dir):
    s = model.sections(spark, sf_dir)
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")).join(s.select("id", F.sha2(F.concat(F.when(F.col("id") % 4 == 0, "old:").otherwise("model-a:"), "text"), 256).alias("hash")), "id")
    now = F.sha2(F.concat(F.lit("model-a:"), "text"), 256)
    return s.join(stored, "id", "left").select("id", F.when(F.col("hash").isNull(), "needs_embedding").when(F.col("hash") != now, "stale").otherwise("fresh").alias("state"))


# Graph ------------------------------------------------------------------------------------------

_GRAPH = """
entities AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS name, 'region of nations' AS summary FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'nation of customers' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, c_mktsegment FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'supplier' FROM supplier),
keys AS (
  SELECT 'rn/' || n_nationkey AS id, 'region:' || n_regionkey AS subject_id, 'nation:' || n_nationkey AS object_id, n_nationkey AS k FROM nation
  UNION ALL SELECT 'nc/' || c_custkey, 'nation:' || c_nationkey, 'customer:' || c_custkey, c_custkey FROM customer
  UNION ALL SELECT 'ns/' || s_suppkey, 'nation:' || s_nationkey, 'supplier:' || s_suppkey, s_suppkey FROM supplier),
relations AS (
  SELECT id, subject_id, 'contains' AS predicate, object_id, CASE k % 10 WHEN 7 THEN 'superseded' WHEN 8 THEN 'invalidated' ELSE 'active' END AS status,
         TIMESTAMP '2024-01-01 00:00:00' AS valid_from,
         CASE WHEN k % 10 IN (7, 8) THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(k * 7 % 40 AS INTEGER)) END AS valid_to,
         CASE WHEN k % 10 = 7 THEN 'rel_earlier' END AS superseded_by,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(k * 3 % 40 AS INTEGER)) AS updated_at FROM keys)"""
_ALIASES = "aliases AS (SELECT DISTINCT id AS entity_id, unnest([" + ", ".join([_ALIAS.format("name"), f"replace({_ALIAS.format('name')}, ' ', '-')", f"replace({_ALIAS.format('name')}, ' ', '_')"]) + "]) AS value FROM entities)"


@query("entity_search", f"WITH {_GRAPH}, {_ALIASES}, s AS (SELECT e.id, e.name, CASE WHEN lower(name) IN ('asia', 'building') THEN 4 ELSE 0 END + CASE WHEN contains(lower(name), 'asia') OR contains(lower(name), 'building') THEN 3 ELSE 0 END + CASE WHEN contains(lower(summary), 'asia') OR contains(lower(summary), 'building') THEN 1 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM aliases a WHERE a.entity_id = e.id AND (contains(value, 'asia') OR contains(value, 'building'))) THEN 3 ELSE 0 END AS score FROM entities e) SELECT id, name, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 5")
def entity_search(spark, sf_dir):
    e = model.entities(spark, sf_dir)
    return graph.search_entities(e, graph.aliases(e), ["asia", "building"], 5)


@query("alias_match", f"WITH {_GRAPH}, {_ALIASES} SELECT DISTINCT v.value, a.entity_id FROM (SELECT c_name AS value FROM customer) v JOIN aliases a ON a.value = {_ALIAS.format('v.value')}")
def alias_match(spark, sf_dir):
    e = model.entities(spark, sf_dir)
    return graph.match_aliases(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), graph.aliases(e))


@query("neighbors_depth2", f"""WITH RECURSIVE {_GRAPH},
edges AS (SELECT subject_id AS src, object_id AS dst, id AS rel FROM relations WHERE status = 'active' UNION ALL SELECT object_id, subject_id, id FROM relations WHERE status = 'active'),
walk(origin_id, entity_id, depth, rel, seen) AS (
  SELECT e.id, e.id, 0, '', [e.id] FROM entities e WHERE e.type = 'region'
  UNION ALL SELECT w.origin_id, x.dst, w.depth + 1, x.rel, list_append(w.seen, x.dst) FROM walk w JOIN edges x ON x.src = w.entity_id WHERE w.depth < 2 AND NOT list_contains(w.seen, x.dst)),
named AS (SELECT w.*, row_number() OVER (PARTITION BY origin_id ORDER BY depth, e.name, w.rel, w.entity_id) AS n FROM walk w JOIN entities e ON e.id = w.entity_id WHERE depth > 0)
SELECT origin_id, entity_id, depth, rel AS relation_id, CAST(n AS INTEGER) AS n FROM named WHERE n <= 8""")
def neighbors_depth2(spark, sf_dir):
    e = model.entities(spark, sf_dir)
    return graph.walk(e.filter("type = 'region'").select(F.col("id").alias("origin_id")), model.relations(spark, sf_dir), e, 2, 8)


@query("history_ranked", f"""
WITH {_GRAPH}, o AS (SELECT id AS origin_id FROM entities WHERE type = 'nation'),
h AS (SELECT DISTINCT o.origin_id, r.* FROM o JOIN relations r ON (r.subject_id = o.origin_id OR r.object_id = o.origin_id) AND r.status IN ('superseded', 'invalidated')),
k AS (SELECT *, row_number() OVER (PARTITION BY origin_id ORDER BY updated_at DESC, id) AS k FROM h)
SELECT origin_id, k.id AS relation_id, predicate, status, valid_from, valid_to, s.name AS subject_name, t.name AS object_name,
       CAST(row_number() OVER (PARTITION BY origin_id ORDER BY valid_to DESC, valid_from DESC, k.id) AS INTEGER) AS n
FROM k JOIN entities s ON s.id = k.subject_id JOIN entities t ON t.id = k.object_id WHERE k <= 10""")
def history_ranked(spark, sf_dir):
    e = model.entities(spark, sf_dir)
    return graph.history(e.filter("type = 'nation'").select(F.col("id").alias("origin_id")), model.relations(spark, sf_dir), e, 10)


@query("supersede", f"""
WITH {_GRAPH}, hit AS (SELECT *, status = 'active' AND subject_id IN ('nation:1', 'nation:2') AS hit FROM relations)
SELECT id, CASE WHEN hit THEN 'superseded' ELSE status END AS status, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE valid_to END AS valid_to,
       CASE WHEN hit THEN 'decision:9' ELSE superseded_by END AS superseded_by FROM hit""")
def supersede(spark, sf_dir):
    by = spark.createDataFrame([("nation:1", "decision:9"), ("nation:2", "decision:9")], "subject_id string, decision_id string")
    return graph.supersede(model.relations(spark, sf_dir), by, NOW, alone=True).select("id", "status", "valid_to", "superseded_by")


@query("graph_delete", f"WITH {_GRAPH} SELECT id FROM relations WHERE subject_id NOT IN ('nation:3') AND object_id NOT IN ('nation:3')")
def graph_delete(spark, sf_dir):
    gone = model.entities(spark, sf_dir).filter("id = 'nation:3'")
    return graph.delete_entities(model.relations(spark, sf_dir), gone).select("id")


@query("graph_boost", "WITH r AS (SELECT o_custkey % 50 AS result_id, 'customer:' || o_custkey AS entity_id FROM orders), g AS (SELECT DISTINCT 'customer:' || c_custkey AS entity_id FROM customer WHERE c_nationkey < 3) SELECT result_id, count(DISTINCT r.entity_id) AS related, CAST(least(45, 15 * count(DISTINCT r.entity_id)) AS BIGINT) AS boost FROM r JOIN g ON g.entity_id = r.entity_id GROUP BY result_id")
def graph_boost(spark, sf_dir):
    customer = F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"))
    results = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("result_id"), customer.alias("entity_id"))
    known = table(spark, sf_dir, "customer").filter("c_nationkey < 3").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return graph.boosts(results, known)


@query("evidence_projection", f"WITH {_GRAPH}, {_ALIASES}, c AS (SELECT o_orderkey AS note_id, 'source' AS field, c_name AS value, 1.0 AS confidence FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey, 'tag', n_name, 0.8 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), m AS (SELECT c.note_id, a.entity_id, c.confidence, c.field, a.value AS form FROM c JOIN aliases a ON a.value = {_ALIAS.format('c.value')}) SELECT note_id, entity_id, CAST(max(confidence) AS DOUBLE) AS confidence, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields, array_to_string(list_sort(list(DISTINCT form)), ',') AS evidence FROM m GROUP BY note_id, entity_id")
def evidence_projection(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    bought = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    said = F.array(F.struct(F.lit("source").alias("field"), F.col("c_name").alias("value"), F.lit(1.0).alias("confidence")), F.struct(F.lit("tag").alias("field"), F.col("n_name").alias("value"), F.lit(0.8).alias("confidence")))
    both = bought.select(F.col("o_orderkey").alias("note_id"), F.explode(said).alias("e")).select("note_id", "e.*").filter("value is not null")
    return graph.strongest_evidence(both, graph.aliases(model.entities(spark, sf_dir)))


# Composites -------------------------------------------------------------------------------------


@query("warmup_guidance", None)
def warmup_guidance(spark, sf_dir):
    return durable.guidance(relational.active(model.observations(spark, sf_dir), "deleted"))


def _points(words: str, points: int) -> str:
    return f"CASE WHEN regexp_matches(lower(text), '{text.bounded(words)}') THEN {points} ELSE 0 END"


ORACLES["warmup_guidance"] = f"""WITH {_MODEL}, n AS (SELECT * FROM observations WHERE NOT deleted ORDER BY created_at DESC, id LIMIT 120),
g AS (SELECT id, CASE kind WHEN 'constraint' THEN 'constraint' WHEN 'decision' THEN 'decision' WHEN 'preference' THEN 'convention' END AS kind, text FROM n WHERE text IS NOT NULL),
s AS (SELECT *, CASE kind WHEN 'constraint' THEN 90 WHEN 'convention' THEN 70 ELSE 60 END + {_points(scores.GUIDANCE_STRONG, 18)} + {_points(scores.GUIDANCE_TOPIC, 8)} + CASE WHEN length(text) <= 180 THEN 8 WHEN length(text) > 280 THEN -12 ELSE 0 END + {_points(scores.GUIDANCE_PLAN, -20)} + CASE WHEN regexp_matches(lower(text), '^({scores.GUIDANCE_LOG_START})([^a-z0-9_]|$)') OR regexp_matches(lower(text), '{text.bounded(scores.GUIDANCE_LOG)}') THEN -80 ELSE 0 END AS score FROM g WHERE kind IS NOT NULL)
SELECT id, kind, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, CASE kind WHEN 'constraint' THEN 0 WHEN 'convention' THEN 1 ELSE 2 END, length(text), id LIMIT 8"""


@query("warmup_highlights", f"""WITH {_MODEL}, {_VISIBLE}, o AS (SELECT *, CASE target_type WHEN 'module' THEN 0 WHEN 'section' THEN 1 ELSE 2 END AS a, CASE source_role WHEN 'app_code' THEN 0 WHEN 'package_config' THEN 1 WHEN 'test_code' THEN 2 WHEN 'product_doc' THEN 3 ELSE 4 END AS b FROM visible),
f AS (SELECT * FROM o ORDER BY a, b, updated_at DESC, target_type, id LIMIT 40),
s AS (SELECT *, CASE target_type WHEN 'module' THEN 80 WHEN 'section' THEN 60 ELSE 40 END + CASE source_role WHEN 'app_code' THEN 35 WHEN 'package_config' THEN 30 WHEN 'test_code' THEN 25 WHEN 'product_doc' THEN 15 ELSE 5 END + {_RECENCY.format('updated_at', '10')} - ceil({_TOKENS.format('text')} / 160.0) AS score FROM f)
SELECT target_type, id, CAST(score AS BIGINT) AS score FROM s ORDER BY s.score DESC, a, b, updated_at DESC, target_type, id LIMIT 12""")
def warmup_highlights(spark, sf_dir):
    return durable.highlights(visible_documents(spark, sf_dir), NOW)


@query("token_budget", f"""WITH RECURSIVE {_MODEL}, s AS (SELECT id, CAST(length(text) // 40 + 1 AS BIGINT) AS cost, row_number() OVER (ORDER BY confidence DESC, id) AS n FROM observations),
f(n, id, used, kept) AS (SELECT n, id, cost, true FROM s WHERE n = 1 UNION ALL SELECT s.n, s.id, CASE WHEN f.used + s.cost <= 100 THEN f.used + s.cost ELSE f.used END, f.used + s.cost <= 100 FROM f JOIN s ON s.n = f.n + 1)
SELECT f.id, s.cost FROM f JOIN s ON s.n = f.n WHERE kept""")
def token_budget(spark, sf_dir):
    rows = model.observations(spark, sf_dir).select("id", (F.floor(F.length("text") / 40) + 1).cast("long").alias("cost"), "confidence")
    return search.within_budget(rows, "cost", [F.desc("confidence"), F.col("id")], 100).select("id", "cost")


@query("prefix_budget", f"WITH {_MODEL}, s AS (SELECT id, CAST(length(text) // 40 + 1 AS BIGINT) AS cost FROM observations), r AS (SELECT *, sum(cost) OVER (ORDER BY id) AS t FROM s) SELECT id, cost FROM r WHERE t <= 100")
def prefix_budget(spark, sf_dir):
    rows = model.observations(spark, sf_dir).select("id", (F.floor(F.length("text") / 40) + 1).cast("long").alias("cost"))
    return durable.prefix_budget(rows, "cost", [F.col("id")], 100)


@query("recall_quality", None)
def recall_quality(spark, sf_dir):
    return search.quality(recall_results(spark, sf_dir))


ORACLES["recall_quality"] = f"SELECT CASE WHEN max(score) >= 200 AND count(DISTINCT coalesce(path, CAST(id AS VARCHAR))) >= 2 THEN 'strong' WHEN max(score) >= 80 THEN 'partial' ELSE 'weak' END AS quality, count(DISTINCT coalesce(path, CAST(id AS VARCHAR))) AS targets FROM ({_search_sql(4, 20, True)})"


def _marked(spark, sf_dir, head: str):
    """Files whose lines are their documents' lines, every third of them marked."""
    lines = F.split("text", "\n")
    marked = F.array_join(F.transform(lines, lambda x, i: F.when(i % 3 == 1, F.concat(F.lit(head), x)).otherwise(x)), "\n")
    return docs(spark, sf_dir).select(F.concat(F.lit("docs/f"), F.col("doc_id").cast("string")).alias("path"), marked.alias("text"))


@query("markdown_sections", rf"""WITH l AS (SELECT 'docs/f' || doc_id AS path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT path, i, CASE WHEN i % 3 = 1 THEN '## ' || x ELSE x END AS x, sum(CASE WHEN regexp_matches(CASE WHEN i % 3 = 1 THEN '## ' || x ELSE x END, '^#{{1,6}}[ \t]+') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS part FROM l),
s AS (SELECT path, part, array_to_string(list(x ORDER BY i), chr(10)) AS content, first(x ORDER BY i) AS head FROM m GROUP BY path, part),
k AS (SELECT path, content, head, part FROM s WHERE {_SQUEEZE.format('content')} <> '')
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY part) - 1 AS INTEGER) AS index, CASE WHEN regexp_extract(head, '^#{{1,6}}[ \t]+([^\n]*)', 1) <> '' THEN regexp_replace(regexp_replace(lower({_SQUEEZE.format("regexp_extract(head, '^#{{1,6}}[ ]+([^' || chr(10) || ']*)', 1)").replace('{{', '{').replace('}}', '}')}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') ELSE 'file' END AS anchor, len({_WORDS.format('content')}) AS n_words FROM k""")
def markdown_sections(spark, sf_dir):
    return sectioning.markdown(_marked(spark, sf_dir, "## ")).select("path", "index", "anchor", F.size(text.words(F.col("content"))).cast("long").alias("n_words"))


@query("code_sections", None)
def code_sections(spark, sf_dir):
    return sectioning.code(_marked(spark, sf_dir, "export function f")).select("path", "index", "anchor", "start_line", "end_line")


ORACLES["code_sections"] = rf"""WITH l AS (SELECT 'docs/f' || doc_id AS path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT path, i, CASE WHEN i % 3 = 1 THEN 'export function f' || x ELSE x END AS x FROM l),
s AS (SELECT *, regexp_extract(x, '{sectioning.DECLARATION}', 2) AS symbol FROM m),
p AS (SELECT *, sum(CASE WHEN symbol <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS part FROM s),
g AS (SELECT path, part, coalesce(max(nullif(symbol, '')), 'file') AS anchor, min(i) + 1 AS start_line, max(i) + 1 AS end_line, array_to_string(list(x ORDER BY i), chr(10)) AS content FROM p GROUP BY path, part)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY part) - 1 AS INTEGER) AS index, anchor, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM g WHERE {_SQUEEZE.format('content')} <> ''"""


@query("json_sections", """
SELECT 'e/' || event_id || '.json' AS path, x.i AS index, x.anchor, x.content
FROM (SELECT *, unnest([{'i': 0, 'anchor': 'k', 'content': json_extract_string(props, '$.k')}, {'i': 1, 'anchor': 'type', 'content': event_type},
                        {'i': 2, 'anchor': 'user', 'content': CAST(user_id AS VARCHAR)}]) AS x FROM events WHERE event_id % 2 = 0)
UNION ALL SELECT 'e/' || event_id || '.json', 0, 'file', '[' || user_id || ']' FROM events WHERE event_id % 2 = 1""")
def json_sections(spark, sf_dir):
    whole = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "type": "'), "event_type", F.lit('", "user": '), F.col("user_id").cast("string"), F.lit("}"))
    body = F.when(F.col("event_id") % 2 == 0, whole).otherwise(F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]")))
    return sectioning.json_keys(table(spark, sf_dir, "events").select(F.concat(F.lit("e/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), body.alias("text")))


@query("recall_package", None)
def recall_package(spark, sf_dir):
    """The recalled rows that fit the budget, with excerpts, each target once."""
    found = recall_results(spark, sf_dir)
    texts = visible_documents(spark, sf_dir).select("target_type", "id", "text")
    rows = texts.join(F.broadcast(found), ["target_type", "id"]).withColumn("excerpt", text.excerpt(F.col("text"))).drop("text")
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("target_type", "path", F.substring("excerpt", 1, 120)).orderBy(F.desc("score"), "id"))).filter("_n = 1").drop("_n")
    costed = once.withColumn("cost", F.ceil(F.length("excerpt") / 4).cast("long"))
    return search.within_budget(costed, "cost", [F.desc("score"), F.col("target_type"), F.col("id")], 2000)


# Extraction -------------------------------------------------------------------------------------


@query("count_by_type", f"WITH {_MODEL} SELECT target_type, count(*) AS n, count(*) FILTER (NOT inactive) AS active FROM retrieval GROUP BY target_type")
def count_by_type(spark, sf_dir):
    rows = model.retrieval_documents(spark, sf_dir)
    return rows.groupBy("target_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("inactive")).alias("active"))


@query("section_lines", rf"""WITH {_MODEL} SELECT id, 'text section from ' || path || '#a: ' || substr(trim(string_split(regexp_replace(text, '^\s+', ''), chr(10))[1], ' '), 1, 120) AS line FROM sections""")
def section_lines(spark, sf_dir):
    return model.sections(spark, sf_dir).select("id", projection.section_line(F.lit("text"), F.col("path"), F.lit("a"), F.col("text")).alias("line"))


@query("module_topics", f"WITH {_MODEL} SELECT id, array_to_string(list_filter(string_split_regex(lower(path), '[/._-]+'), lambda w: length(w) > 2)[1:8], ',') AS topics FROM sections")
def module_topics(spark, sf_dir):
    return model.sections(spark, sf_dir).select("id", F.array_join(projection.module_topics(F.col("path")), ",").alias("topics"))


@query("taxonomy", rf"""WITH {_MODEL}, p AS (SELECT string_split(path, '/') AS parts FROM sections), n AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS depth FROM p),
d AS (SELECT DISTINCT array_to_string(parts[1:depth], '/') AS node, depth FROM n) SELECT node, CASE WHEN depth > 1 THEN regexp_replace(node, '/[^/]*$', '') END AS parent, string_split(node, '/')[-1] AS name, CAST(depth AS INTEGER) AS depth FROM d""")
def taxonomy(spark, sf_dir):
    return projection.taxonomy(model.sections(spark, sf_dir))


@query("taxonomy_siblings", """
WITH n AS (SELECT n_nationkey AS id, n_regionkey AS parent, n_name AS name FROM nation
           UNION ALL SELECT n_nationkey + 100, n_regionkey, lower(n_name) FROM nation
           UNION ALL SELECT n_nationkey + 200, n_regionkey + 1, n_name FROM nation
           UNION ALL SELECT r_regionkey + 300, NULL, r_name FROM region UNION ALL SELECT r_regionkey + 400, NULL, lower(r_name) FROM region)
SELECT a.id, b.id AS sibling FROM n a JOIN n b ON a.parent IS NOT DISTINCT FROM b.parent AND lower(a.name) = lower(b.name) AND a.id <> b.id""")
def taxonomy_siblings(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = lambda df, ident, parent, name: df.selectExpr(f"{ident} as id", f"{parent} as parent", f"{name} as name")
    nodes = row(nation, "n_nationkey", "n_regionkey", "n_name").unionByName(row(nation, "n_nationkey + 100", "n_regionkey", "lower(n_name)")).unionByName(row(nation, "n_nationkey + 200", "n_regionkey + 1", "n_name"))
    nodes = nodes.unionByName(row(region, "r_regionkey + 300", "cast(null as int)", "r_name")).unionByName(row(region, "r_regionkey + 400", "cast(null as int)", "lower(r_name)"))
    return projection.siblings(nodes)


@query("suppressed_ingest", f"WITH {_MODEL}, gone AS (SELECT path, content_hash FROM sections WHERE suppressed OR deleted) SELECT id FROM sections s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.path = s.path AND g.content_hash = s.content_hash)")
def suppressed_ingest(spark, sf_dir):
    s = model.sections(spark, sf_dir)
    return relational.without(s, s.filter("suppressed or deleted"), ["path", "content_hash"]).select("id")


@query("run_actions", _DIFF + "SELECT path, CASE change WHEN 'deleted' THEN 'clear' WHEN 'unchanged' THEN 'keep' ELSE 'read' END AS changed_mode, CASE change WHEN 'deleted' THEN 'clear' ELSE 'read' END AS full_mode, CASE change WHEN 'deleted' THEN 'clear' WHEN 'added' THEN 'read' ELSE 'keep' END AS resume_mode FROM diff")
def run_actions(spark, sf_dir):
    diff = _diff(spark, sf_dir)
    parts = [projection.plan_run(diff, m).withColumnRenamed("action", f"{m}_mode") for m in ("changed", "full", "resume")]
    return parts[0].join(parts[1], "path").join(parts[2], "path")


@query("affected_modules", _DIFF + "SELECT DISTINCT split_part(path, '/', 1) AS module_path FROM diff WHERE change <> 'unchanged'")
def affected_modules(spark, sf_dir):
    return projection.affected_modules(_diff(spark, sf_dir))


_FILE_ID = "'ent_' || substr(sha256('file:' || " + _ALIAS.format("path") + "), 1, 32)"
_SYMBOL_ID = "'ent_' || substr(sha256('symbol:' || " + _ALIAS.format("(path || '#' || anchor)") + "), 1, 32)"
_SYMBOLS = "marked AS (SELECT path, 'sym' || id % 7 AS anchor, CASE WHEN id % 2 = 0 THEN 'symbol' ELSE 'file' END AS anchor_type FROM sections)"


def _symbols(spark, sf_dir):
    return model.sections(spark, sf_dir).select("path", F.concat(F.lit("sym"), (F.col("id") % 7).cast("string")).alias("anchor"), F.when(F.col("id") % 2 == 0, "symbol").otherwise("file").alias("anchor_type"))


@query("file_graph_nodes", f"WITH {_MODEL}, {_SYMBOLS} SELECT {_FILE_ID} AS id, 'file' AS type, path AS name, path FROM (SELECT DISTINCT path FROM marked) UNION ALL SELECT {_SYMBOL_ID}, 'symbol', anchor, path FROM (SELECT DISTINCT path, anchor FROM marked WHERE anchor_type = 'symbol')")
def file_graph_nodes(spark, sf_dir):
    return projection.file_graph(_symbols(spark, sf_dir))[0]


@query("file_graph_edges", f"WITH {_MODEL}, {_SYMBOLS}, e AS (SELECT DISTINCT {_FILE_ID} AS subject_id, 'defines' AS predicate, {_SYMBOL_ID} AS object_id FROM marked WHERE anchor_type = 'symbol') SELECT 'rel_' || substr(sha256(subject_id || ':' || predicate || ':' || object_id), 1, 32) AS id, * FROM e")
def file_graph_edges(spark, sf_dir):
    return projection.file_graph(_symbols(spark, sf_dir))[1]


@query("vector_parity", "SELECT len(embedding) AS dimensions, count(*) AS vectors, count(DISTINCT vec_id) AS targets FROM embeddings GROUP BY 1")
def vector_parity(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("long").alias("dimensions")).agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("vec_id").alias("targets"))


@query("stale_sources", f"WITH {_MODEL} SELECT id, epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at) > 240 * 3600000000 AS stale FROM sections")
def stale_sources(spark, sf_dir):
    return model.sections(spark, sf_dir).select("id", projection.stale(F.col("updated_at"), NOW, 240).alias("stale"))


@query("json_lists", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|' || user_id ELSE '' END AS items FROM events")
def json_lists(spark, sf_dir):
    listed = F.concat(F.lit('["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]'))
    raw = F.when(F.col("event_id") % 3 == 0, listed).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[broken "), "event_type")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(projection.string_list(raw), "|").alias("items"))


@query("export_rows", f"WITH {_MODEL} SELECT id, kind, sha256(text) AS content_hash, CAST(confidence AS DOUBLE) AS confidence FROM observations WHERE NOT deleted")
def export_rows(spark, sf_dir):
    return relational.active(model.observations(spark, sf_dir), "deleted").select("id", "kind", F.sha2("text", 256).alias("content_hash"), F.col("confidence").cast("double").alias("confidence"))


@query("result_entities", f"WITH {_GRAPH}, {_ALIASES}, r AS (SELECT o_orderkey AS result_id, c_name AS value FROM orders JOIN customer ON c_custkey = o_custkey) SELECT DISTINCT r.result_id, a.entity_id FROM r JOIN aliases a ON a.value = {_ALIAS.format('r.value')}")
def result_entities(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    results = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("result_id"), F.col("c_name").alias("value"))
    met = graph.match_aliases(results.select("value").distinct(), graph.aliases(model.entities(spark, sf_dir)))
    return results.join(met, "value").select("result_id", "entity_id").distinct()


_HEX = "'0123456789abcdef'"


@query("embedded_texts", f"""
WITH w AS (SELECT doc_id, md5(unnest({_WORDS.format('lower(text)')})) AS m FROM documents),
b AS (SELECT doc_id, (instr({_HEX}, substr(m, 1, 1)) - 1) * 16 + instr({_HEX}, substr(m, 2, 1)) - 1 AS d FROM w),
v AS (SELECT doc_id, d % 64 AS bucket, sum(CASE WHEN d >= 128 THEN 1 ELSE -1 END) AS n FROM b GROUP BY ALL),
s AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM v GROUP BY doc_id)
SELECT v.doc_id, CAST(bucket AS INTEGER) AS bucket, round(n / size, 6) AS value FROM v JOIN s ON s.doc_id = v.doc_id WHERE n <> 0""")
def embedded_texts(spark, sf_dir):
    return projection.hash_vectors(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")).select(F.col("id").alias("doc_id"), "bucket", F.round("value", 6).alias("value"))


# Packages ---------------------------------------------------------------------------------------


@query("primary_targets", f"SELECT coalesce(path, target_type || ':' || id) AS target, max(score) AS score FROM ({_search_sql(4, 20, True)}) GROUP BY 1 ORDER BY score DESC, target LIMIT 5")
def primary_targets(spark, sf_dir):
    return search.primary_targets(recall_results(spark, sf_dir))


@query("evidence_counts", f"SELECT target_type, count(*) AS n FROM ({_search_sql(6, 10, False)}) GROUP BY 1")
def evidence_counts(spark, sf_dir):
    return search_results(spark, sf_dir).groupBy("target_type").agg(F.count(F.lit(1)).alias("n"))


@query("graph_context", f"""WITH RECURSIVE {_GRAPH},
edges AS (SELECT subject_id AS src, object_id AS dst, id AS rel FROM relations WHERE status = 'active' UNION ALL SELECT object_id, subject_id, id FROM relations WHERE status = 'active'),
walk(origin_id, entity_id, depth, rel, seen) AS (
  SELECT e.id, e.id, 0, '', [e.id] FROM entities e WHERE e.type = 'nation' AND e.id < 'nation:2'
  UNION ALL SELECT w.origin_id, x.dst, w.depth + 1, x.rel, list_append(w.seen, x.dst) FROM walk w JOIN edges x ON x.src = w.entity_id WHERE w.depth < 2 AND NOT list_contains(w.seen, x.dst)),
named AS (SELECT w.*, row_number() OVER (PARTITION BY origin_id ORDER BY depth, e.name, w.rel, w.entity_id) AS n FROM walk w JOIN entities e ON e.id = w.entity_id WHERE depth > 0),
once AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY depth, origin_id, n) AS k FROM named WHERE n <= 8)
SELECT rel AS relation_id, origin_id, entity_id, depth, greatest(1, 10 - 2 * depth) AS score FROM once WHERE k = 1""")
def graph_context(spark, sf_dir):
    e = model.entities(spark, sf_dir)
    return graph.context(e.filter("type = 'nation' and id < 'nation:2'").select(F.col("id").alias("origin_id")), model.relations(spark, sf_dir), e)


@query("project_status", _DIFF + ", c AS (SELECT count(*) FILTER (change <> 'unchanged') AS changed FROM diff) SELECT (SELECT count(*) FROM sections WHERE NOT deleted AND NOT suppressed) AS sections, (SELECT count(DISTINCT path) FROM sections WHERE NOT deleted AND NOT suppressed) AS files, c.changed, CASE WHEN c.changed > 0 THEN 'stale' ELSE 'fresh' END AS state FROM c")
def project_status(spark, sf_dir):
    live = relational.active(model.sections(spark, sf_dir), "deleted", "suppressed").agg(F.count(F.lit(1)).alias("sections"), F.countDistinct("path").alias("files"))
    # One row each: joined on a constant key.
    return live.withColumn("k", F.lit(1)).join(freshness(spark, sf_dir).withColumn("k", F.lit(1)), "k").drop("k")
