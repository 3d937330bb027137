"""Text rules of the engine as Column functions: tokenizers, excerpts, slugs, aliases, topics, roles, detectors."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are never topics.
STOP_WORDS = ["and", "are", "const", "export", "for", "from", "function", "import", "into", "return", "that", "the", "this", "type", "with"]

#: Words of an excerpt: 120 tokens at 1.33 a word.
EXCERPT_WORDS = 90

SPACE = r"[ \t\n\x0B\f\r]+"


def bounded(words: str) -> str:
    """A pattern of whole ASCII words; look-arounds are avoided, so that every regex engine reads it alike."""
    return rf"(^|[^a-z0-9_])({words})([^a-z0-9_]|$)"


def terms(query: Column, most: int = 12, keep: str = "a-z0-9_./-") -> Column:
    """First ``most`` different lower-cased tokens of at least two characters."""
    return F.slice(F.array_distinct(F.filter(F.split(F.lower(query), f"[^{keep}]+"), lambda t: F.length(t) >= 2)), 1, most)


def match_terms(query: Column) -> Column:
    """What of each term the text index looks up: only ``[a-z0-9_]``."""
    return F.filter(F.transform(terms(query), lambda t: F.regexp_replace(t, "[^a-z0-9_]", "")), lambda t: t != "")


def term_hits(text: Column, wanted: list[str]) -> Column:
    """How many of the given terms occur in the text, each counted once."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in wanted], F.lit(0))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def excerpt(text: Column, most: int = EXCERPT_WORDS) -> Column:
    """The text if it has at most ``most`` words, else the first of them and dots."""
    return F.when(F.size(words(text)) > most, F.concat(F.array_join(F.slice(words(text), 1, most), " "), F.lit("..."))).otherwise(text)


def word_tokens(text: Column) -> Column:
    return F.ceil(F.size(words(text)) * F.lit(1.33).cast("double")).cast("long")


def char_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def summary(text: Column) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) > 240, F.concat(F.rtrim(F.substring(flat, 1, 237)), F.lit("..."))).otherwise(flat)


def alias_form(value: Column) -> Column:
    """The form under which names are compared: camel case parted, separators as spaces, lower case."""
    x = F.regexp_replace(squeeze(value), r"\\", "/")
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    x = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")
    return squeeze(F.regexp_replace(F.lower(x), "[_-]+", " "))


def alias_variants(value: Column) -> Column:
    plain = alias_form(value)
    return F.array_distinct(F.array(plain, F.replace(plain, F.lit(" "), F.lit("-")), F.replace(plain, F.lit(" "), F.lit("_"))))


def path_aliases(path: Column) -> Column:
    """The names of a path: itself, its file name, and that without its ending."""
    name = F.substring_index(path, "/", -1)
    return F.array_distinct(F.array_compact(F.array(path, name, F.regexp_replace(name, r"(.)\.[^.]+$", "$1"))))


def symbol_aliases(path: Column, symbol: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(symbol, F.concat(path, F.lit("#"), symbol))))


def target_label(path: Column, ident: Column, anchor: Column) -> Column:
    """The path, or else the id, and the anchor where there is one."""
    place = F.coalesce(path, ident.cast("string"))
    return F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(place, F.lit("#"), anchor)).otherwise(place)


def json_object(column: Column) -> Column:
    """A map of a JSON object's top-level values as text; what is malformed, a list or null is null."""
    return F.when(F.trim(column).startswith("{") & F.json_object_keys(column).isNotNull(), F.from_json(column, "map<string,string>"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(squeeze(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def split_words(text: Column) -> Column:
    parted = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.transform(F.split(parted, "[^A-Za-z0-9]+"), F.lower), lambda w: w != "")


def topic_words(path: Column, text: Column) -> Column:
    stem = F.regexp_replace(path, r"\.[^.]+$", "")
    every = F.concat(split_words(stem), split_words(F.substring(text, 1, 2000)))
    return F.filter(every, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))


#: What a stored note must not contain.
SECRET = r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{12,}"

#: What an error log hides, and by what.
REDACTIONS = [
    (r"(?i)([\"']?(?:api[_-]?key|token|secret|password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?)[^\s\"',}]+", "$1[REDACTED]"),
    (r"(?i)(bearer\s+)[a-z0-9._~+/-]+", "$1[REDACTED]"),
    (r"(?i)sk-[a-z0-9_-]{16,}", "[REDACTED]"),
]


def has_secret(text: Column) -> Column:
    return text.rlike(SECRET)


def redacted(text: Column, most: int = 8000) -> Column:
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return F.substring(text, 1, most)


def quoted_values(text: Column) -> Column:
    """Values in back quotes, 2 to 120 characters long."""
    return F.regexp_extract_all(text, F.lit("`([^`]{2,120})`"), F.lit(1))


#: What looks like a path, optionally with a symbol.
PATH_LIKE = r"(?:^|[\s(\"'=])([A-Za-z0-9_.@/-]+/[A-Za-z0-9_.@/-]+|[A-Za-z0-9_.@/-]+\.(?:css|go|html|js|json|jsx|md|mdx|py|rs|scss|sql|toml|ts|tsx|txt|yaml|yml)(?:#[A-Za-z0-9_$.-]+)?)"


def path_values(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATH_LIKE), F.lit(1))


#: Words that tell what a request is about.
INTENTS = {
    "allows_diary": "continue|resume|history|previous|last time|already tried|debug|blocked|why failed|follow up",
    "implementation": "add|build|change|fix|implement|improve|patch|refactor|test|update",
    "prefers_agent": "agent|skill|prompt|mcp|reference|docs?",
    "needs_history": "history|historical|previous|prior|old|before|changed|why|superseded|invalidated|replaced|migration|attempt|rollback|decision",
}


def intent(query: Column, name: str) -> Column:
    return F.lower(query).rlike(bounded(INTENTS[name]))


# Files that configure packages and tools, and the endings of each language.
PACKAGE_FILES = [
    "build.gradle", "build.gradle.kts", "bunfig.toml", "cargo.toml", "composer.json", "gemfile", "go.mod", "package.json", "package.swift", "pom.xml", "pubspec.yaml", "pyproject.toml", "settings.gradle",
    "tsconfig.json",
]
TOOLING_FILES = ["analysis_options.yaml", "biome.json", "knip.json", "phpunit.xml", "turbo.json", "vite.config.ts", "vitest.config.ts", "tsup.config.ts"]
CODE_LANGUAGES = {
    "bash": ["sh", "bash", "zsh"], "c": ["c", "h"], "cpp": ["cc", "cpp", "cxx", "hpp", "hh", "hxx"], "csharp": ["cs"], "css": ["css"], "dart": ["dart"], "go": ["go"], "html": ["html", "htm"], "java": ["java"],
    "javascript": ["js", "mjs", "cjs", "jsx"], "jsdoc": ["jsdoc"], "kotlin": ["kt", "kts"], "lua": ["lua"], "php": ["php", "phtml"], "python": ["py"], "ruby": ["rb"], "rust": ["rs"], "scala": ["scala", "sc"],
    "swift": ["swift"], "tsx": ["tsx"], "typescript": ["ts", "mts", "cts"], "zig": ["zig"],
}
DATA_LANGUAGES = {"json": ["json", "jsonc"], "yaml": ["yaml", "yml"], "toml": ["toml"]}

# The folders, names and endings in ``language`` and ``source_role``.


def _ending(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)


def language(path: Column) -> Column:
    """The language that a path's ending names, in order of precedence."""
    low, ending = F.lower(path), _ending(path)
    out = F.when(low.endswith(".d.ts"), "typescript_declaration").when(ending.isin("md", "mdx"), "markdown")
    out = out.when(low.endswith("dockerfile"), "dockerfile").when(ending == "xml", "xml")
    for name, endings in {**CODE_LANGUAGES, **DATA_LANGUAGES}.items():
        out = out.when(ending.isin(endings), name)
    return out.otherwise("unknown")


def source_role(path: Column) -> Column:
    """What part a file has in its project; the first rule that fits."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    within = lambda *parts: reduce(or_, [F.contains(low, F.lit(p)) for p in parts])
    starts = lambda *parts: reduce(or_, [low.startswith(p) for p in parts])
    ends = lambda x, *parts: reduce(or_, [x.endswith(p) for p in parts])
    return (
        F.when(within("/generated/", "/__generated__/", "/vendor/") | ends(low, ".min.js", ".min.css"), "generated")
        .when(name.isin(PACKAGE_FILES) | ends(name, ".csproj", ".sln"), "package_config")
        .when(name.isin(TOOLING_FILES) | starts(".github/"), "tooling_config")
        .when(starts(".agents/skills/"), "agent_reference")
        .when(starts(".agents/", ".codex/", ".cursor/"), "agent_config")
        .when(starts(".specs/") | within("plan.md"), "implementation_plan")
        .when(within(".test.", ".spec."), "test_code")
        .when(name.endswith(".md"), "product_doc")
        .when(_ending(path).isin([e for endings in CODE_LANGUAGES.values() for e in endings]), "app_code")
        .otherwise("unknown")
    )


def top_module(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def retrieval_text(role: Column, path: Column, anchor: Column, topics: Column, content: Column) -> Column:
    """Labelled lines, an empty line, the content; parts that are null or empty have no line."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    head = F.concat_ws("\n", line("role", role), line("path", path), line("anchor", anchor), line("topics", F.array_join(topics, ", ")))
    return F.concat(head, F.lit("\n\n"), content)


def identifier(prefix: str, *parts: Column) -> Column:
    """Deterministic id: the prefix and the first 32 hexadecimal digits of the parts' SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 32))
