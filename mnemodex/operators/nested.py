"""JSON values of any depth, as VARIANT: filters by a part of an object, all strings below a value, and what a package's manifest declares in nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark parses no JSON that is nested deeper; such text is no JSON to ``try_parse_json``.
DEEPEST = 1000


def has_value(json: Column, key: str, value: str) -> Column:
    """True where the JSON object ``json`` has ``key`` with the string ``value``; no other text, key or nesting that looks alike is hit. Null, or no JSON: false."""
    parsed = F.try_parse_json(json)
    return F.coalesce((F.schema_of_variant(parsed).startswith("OBJECT")) & (F.try_variant_get(parsed, f"$['{key}']", "string") == value) & (F.schema_of_variant(F.try_variant_get(parsed, f"$['{key}']", "variant")) == "STRING"), F.lit(False))


def _below(v: Column) -> Column:
    """The elements of a list, or the values of an object; null for anything else. (``schema_of_variant`` would go down all levels.)"""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), _members(v))


def _members(v: Column) -> Column:
    return F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))


def _text(v: Column) -> Column:
    """``v`` if it is a string, else null."""
    return F.when(_below(v).isNull() & (F.schema_of_variant(v) == "STRING"), F.variant_get(v, "$", "string"))


def _strings(v: Column) -> Column:
    """All strings at or below the VARIANT ``v``, as an array: level by level within the row, so neither rows nor levels are limited."""
    json = F.to_json(v)
    # No value has more levels than brackets. The state is copied once for each step, so steps that can have nothing to do are left out.
    levels = F.least(F.lit(DEEPEST), F.length(json) - F.length(F.translate(json, "{[", ""))) + 1
    state = lambda level, found: F.struct(level.alias("level"), found.alias("found"))

    def step(all: Column, _: Column) -> Column:
        lists, texts = (F.array_compact(F.transform(all["level"], of)) for of in (_below, _text))
        return F.when(F.size(all["level"]) == 0, all).otherwise(state(F.flatten(lists), F.concat(all["found"], texts)))

    return F.aggregate(F.sequence(F.lit(1), levels), state(F.array(v), F.array().cast("array<string>")), step, lambda all: all["found"])


def strings(rows: DataFrame) -> DataFrame:
    """(id, value): every string at or below ``v`` of (id, v), v a VARIANT; one row for each place. Keys, numbers, nulls and truth values are none."""
    return rows.filter("v is not null").select("id", F.explode(_strings(F.col("v"))).alias("value"))


def entry_points(manifests: DataFrame) -> DataFrame:
    """(path, entry): the files that a package.json (path, text) is entered by: ``main``, ``bin`` (a file, or one for each command) and all files in ``exports``, however nested; without ./ before them."""
    v = manifests.select("path", F.try_parse_json("text").alias("m")).filter(_members(F.col("m")).isNotNull())
    part = lambda key: F.try_variant_get("m", f"$.{key}", "variant")
    one = v.select("path", F.explode(F.array(_text(part("main")), _text(part("bin")))).alias("entry"))
    commands = v.select("path", F.explode(_members(part("bin"))).alias("value")).select("path", _text(F.col("value")).alias("entry"))
    nested = strings(v.select(F.col("path").alias("id"), part("exports").alias("v"))).select(F.col("id").alias("path"), F.col("value").alias("entry"))
    every = one.unionByName(commands).unionByName(nested).filter("entry is not null")
    return every.select("path", F.regexp_replace("entry", r"^\./", "").alias("entry")).filter("entry <> ''").distinct()


def workspaces(manifests: DataFrame) -> DataFrame:
    """(path, globs): the strings of ``workspaces`` of a package.json, a list or an object with the list ``packages``, sorted; none for anything else."""
    v = manifests.select("path", F.try_parse_json("text").alias("m")).filter(F.schema_of_variant("m").startswith("OBJECT"))
    listed = F.coalesce(F.try_variant_get("m", "$.workspaces", "array<variant>"), F.try_variant_get("m", "$.workspaces.packages", "array<variant>"))
    texts = F.filter(F.transform(listed, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string"))), lambda x: x.isNotNull())
    return v.select("path", F.array_sort(F.coalesce(texts, F.array().cast("array<string>"))).alias("globs"))


def listed_entities(rows: DataFrame) -> DataFrame:
    """(id, entity, position): the entities that sections or modules list in ``entities`` (JSON): a string each, or an object with an ``id``; others are passed over."""
    v = rows.select("id", F.try_variant_get(F.try_parse_json("entities"), "$", "array<variant>").alias("list"))
    each = v.select("id", F.posexplode("list").alias("position", "e"))
    kind = F.schema_of_variant("e")
    name = F.when(kind == "STRING", F.variant_get("e", "$", "string")).when(kind.startswith("OBJECT"), F.try_variant_get("e", "$.id", "string"))
    return each.select("id", name.alias("entity"), "position").filter("entity is not null")
