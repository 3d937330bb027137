"""Files cut into sections: Markdown by heading, JSON by key, code by declaration, other text whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemodex.functions import text
from mnemodex.operators import symbols

#: A line that declares something in code; the name is the second group.
DECLARATION = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface|type|const|let|var|def)\s+([A-Za-z_$][A-Za-z0-9_$]*)"


def _blank(content: Column) -> Column:
    return F.trim(F.regexp_replace(content, text.SPACE, " ")) == ""


def markdown(files: DataFrame) -> DataFrame:
    """(path, index, anchor, content): cut before each heading; what stands before the first is ``file``. Blank pieces go.

    The pieces are numbered in the row, so nothing is shuffled.
    """
    pieces = F.filter(F.split("text", r"(?m)(?=^#{1,6}[ \t]+)"), lambda x: ~_blank(x))
    heading = F.regexp_extract("content", r"^#{1,6}[ \t]+([^\n]*)", 1)
    anchor = F.when(heading != "", text.slug(heading)).otherwise("file")
    return files.select("path", F.posexplode(pieces).alias("index", "content")).select("path", "index", anchor.alias("anchor"), "content")


def json_keys(files: DataFrame) -> DataFrame:
    """(path, index, anchor, content): a section for each top-level key of an object; anything else is one section, ``file``."""
    keys = F.json_object_keys("text")
    values = F.from_json("text", "map<string,string>")
    one = F.array(F.struct(F.lit("file").alias("anchor"), F.col("text").alias("content")))
    many = F.transform(keys, lambda k: F.struct(k.alias("anchor"), F.coalesce(F.element_at(values, k), F.lit("null")).alias("content")))
    sections = F.when(F.size(keys) > 0, many).otherwise(one)
    return files.filter(F.coalesce(F.trim("text"), F.lit("")) != "").select("path", F.posexplode(sections).alias("index", "s")).select("path", "index", "s.anchor", "s.content")


def code(files: DataFrame) -> DataFrame:
    """(path, index, anchor, start_line, end_line, content): cut at each line that declares a symbol; the lines before the first are ``file``.

    Lines are cut and put together in the row, so nothing is shuffled.
    """
    once = F.transform(F.array(F.split("text", "\n")), lambda x: F.struct(x.alias("lines"), F.transform(x, lambda l: F.regexp_extract(l, DECLARATION, 2)).alias("symbols")))
    rows = files.select("path", F.inline(once))
    declared = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == 1) | (F.element_at("symbols", i) != ""))
    rows = rows.select("path", "lines", "symbols", declared.alias("starts"))
    ends = F.concat(F.transform(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), lambda s: s - 1), F.array(F.size("lines")))

    def part(start: Column, end: Column) -> Column:
        symbol = F.nullif(F.element_at("symbols", start), F.lit(""))
        return F.struct(F.coalesce(symbol, F.lit("file")).alias("anchor"), start.alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", start, end - start + 1), "\n").alias("content"))

    parts = F.filter(F.zip_with("starts", ends, part), lambda p: ~_blank(p["content"]))
    return rows.select("path", F.posexplode(parts).alias("index", "p")).select("path", "index", "p.*")


def by_symbols(files: DataFrame) -> DataFrame:
    """(path, index, anchor, content): a section for each symbol, so methods are in their class's section and their own; a file without one is one section."""
    found = symbols.symbols(files).select("path", "index", "anchor", "content")
    bare = files.join(found.select("path"), "path", "left_anti")
    return found.unionByName(bare.select("path", F.lit(0).alias("index"), F.lit("file").alias("anchor"), F.col("text").alias("content")))


def sections(files: DataFrame, nested: bool = False) -> DataFrame:
    """(id, path, index, anchor, content, content_hash, tokens) of every file (path, text), cut as its ending says; code at lines that declare, or ``nested`` by its symbols."""
    files = files.filter(F.coalesce(F.trim("text"), F.lit("")) != "").withColumn("_l", text.language(F.col("path")))
    by = {"markdown": markdown, "json": json_keys}
    made = [cutter(files.filter(F.col("_l") == name)) for name, cutter in by.items()]
    cut = by_symbols if nested else code
    made.append(cut(files.filter(text.source_role(F.col("path")).isin("app_code", "test_code") & ~F.col("_l").isin(*by))).select("path", "index", "anchor", "content"))
    rest = files.filter(~F.col("_l").isin(*by) & ~text.source_role(F.col("path")).isin("app_code", "test_code"))
    made.append(rest.select("path", F.lit(0).alias("index"), F.lit("file").alias("anchor"), F.col("text").alias("content")))
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    digest = F.sha2("content", 256)
    return out.select(text.identifier("section", F.col("path"), F.col("index"), F.col("anchor"), digest).alias("id"), "path", "index", "anchor", "content", digest.alias("content_hash"), text.word_tokens(F.col("content")).alias("tokens"))


def topics(files: DataFrame, most: int = 12) -> DataFrame:
    """(id, topics) from (id, path, text): the most frequent words of path and text, by count, then alphabet. Files without one are left out.

    Words are counted in the row: sorted, they are runs of equal words.
    """
    words = files.select("id", F.inline(F.transform(F.array(F.array_sort(text.topic_words(F.col("path"), F.col("text")))), lambda w: F.struct(w.alias("words"))))).filter(F.size("words") > 0)
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: (i == 1) | (F.element_at("words", i) != F.element_at("words", F.greatest(i - 1, F.lit(1)))))
    words = words.select("id", "words", starts.alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("words") + 1))
    counted = F.zip_with("starts", ends, lambda s, e: F.struct((s - e).alias("n"), F.element_at("words", s).alias("word")))
    best = F.slice(F.array_sort(counted), 1, most)
    return words.select("id", F.array_join(F.transform(best, lambda x: x["word"]), ",").alias("topics"))
