"""Symbols of code with braces: each declaration is an interval of lines, and methods lie inside their class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that declare a symbol, and its kind.
KINDS = {"function": "function", "func": "function", "fn": "function", "fun": "function", "class": "class", "interface": "interface", "struct": "struct", "enum": "enum",
         "trait": "trait", "module": "module", "namespace": "module", "mod": "module", "type": "type"}
#: Kinds whose bodies have methods.
HOLDERS = ["class", "interface", "struct", "enum", "trait"]
_MODIFIER = r"(?:(?:export|default|declare|abstract|async|public|private|protected|internal|static|final|sealed|partial|open|data|pub|unsafe|const)[ \t]+){0,6}"
_CONTROL = "if|else|for|while|switch|catch|do|try|return|throw|new|await|typeof|super|" + "|".join(KINDS)
_DECLARED = rf"^[ \t]*{_MODIFIER}({'|'.join(KINDS)})\b[ \t]*\*?[ \t]+([A-Za-z_$][\w$]*)"
_RECEIVER = r"^[ \t]*func[ \t]*\([^)\n]{0,200}\)[ \t]*([A-Za-z_]\w*)"
_METHOD = rf"^[ \t]*(?!(?:{_CONTROL})\b)(?:[\w$<>\[\].?]+[ \t]+){{0,6}}?[*#]?([A-Za-z_$][\w$]*)(?:<[^>\n]{{0,200}}>)?[ \t]*(?=\()"
#: What a text is cut into: comments and strings, whose brackets don't count, declarations at the start of a line, brackets, semicolons and line ends.
_TOKEN = "(?m)" + "|".join([
    r"//[^\n]*", r"/\*[\s\S]*?\*/", r'"[^\n]*?(?<!\\)(?:\\\\)*+"', r"'[^\n]*?(?<!\\)(?:\\\\)*+'", r"`[\s\S]*?(?<!\\)(?:\\\\)*+`",
    r"<\{[^{}\n]*\}>", r"(?<=\))[ \t]*:[ \t]*\{[^{}\n]*\}(?=[^\n;]*\{)",  # braces of types
    _RECEIVER, _DECLARED, _METHOD, r"[{}()\[\];\n]",
])


def tokens(files: DataFrame) -> DataFrame:
    """(path, lines, pos, token, line, level) of the braces, semicolons and declarations of ``files`` (path, text).

    The level counts the open brackets of any kind before a token; a closing brace has that of its opening one. Texts are parted by path once; everything after stays there.
    """
    rows = files.select("path", "text").filter("text is not null").repartition("path")
    rows = rows.select("path", F.size(F.split("text", "\n")).alias("lines"), F.posexplode(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    step = F.when(F.col("token").isin("{", "(", "["), 1).when(F.col("token").isin("}", ")", "]"), -1).otherwise(0)
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    line = F.coalesce(F.sum(passed).over(before), F.lit(0)) + 1
    level = F.coalesce(F.sum(step).over(before), F.lit(0)) + F.least(step, F.lit(0))
    placed = rows.select("path", "lines", "pos", "token", line.cast("int").alias("line"), level.cast("int").alias("level"))
    return placed.filter(F.col("token").isin("{", "}", ";") | F.col("token").rlike(r"^[ \t]*[#*A-Za-z_$]"))


def _kind(token: Column) -> Column:
    word = F.regexp_extract(token, _DECLARED, 1)
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(token.isin("{", "}", ";"), None).when(token.rlike(_RECEIVER), "method").when(word != "", F.try_element_at(kinds, word)).otherwise("member")


def symbols(files: DataFrame) -> DataFrame:
    """(path, index, anchor, kind, parent, exported, start_line, end_line, content) of the declarations in ``files`` (path, text; a path is there once).

    A declaration starts its line and lasts to the end of its body: the first brace at its own level, unless a semicolon or another declaration comes first. Functions
    without a body aren't listed, other kinds end at the semicolon or their own line. A name before parentheses is a method if the braces around it are a class's (or the like).
    ``parent`` is the innermost declaration around, ``exported`` holds for what lies in an exported one, too. Bodies that are never closed last to the end of the file.
    Literal regular expressions and templates within templates are read as plain text; null texts and texts without a declaration have no rows.
    """
    later = Window.partitionBy("path", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    found = tokens(files).withColumn("kind", _kind(F.col("token")))
    found = found.withColumn("close", F.last(F.when(F.col("token") == "}", F.struct("pos", "line")), True).over(later))
    stop = F.struct("token", "pos", "line", F.coalesce("close.pos", F.lit(2**31 - 1)).alias("end"), F.coalesce("close.line", "lines").alias("end_line"))
    found = found.withColumn("next", F.last(F.when(F.col("kind").isNotNull() | F.col("token").isin("{", ";"), stop), True).over(later))
    # The brace that a declaration is directly in: the last one that opens a level below, if it is open still.
    inner = found.withColumn("below", F.when(F.col("token") == "{", F.col("level")).otherwise(F.col("level") - 1)).filter("kind is not null or token = '{'")
    earlier = Window.partitionBy("path", "below").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    around = F.last(F.when(F.col("token") == "{", F.struct("pos", F.coalesce("close.pos", F.lit(2**31 - 1)).alias("end"))), True).over(earlier)
    inner = inner.withColumn("around", around).filter("kind is not null")

    token, body, semicolon = F.col("token"), F.coalesce(F.col("next.token") == "{", F.lit(False)), F.coalesce(F.col("next.token") == ";", F.lit(False))
    name = F.coalesce(*[F.nullif(F.regexp_extract(token, p, g), F.lit("")) for p, g in ((_RECEIVER, 1), (_DECLARED, 2))], F.regexp_extract(token, r"([A-Za-z_$][\w$]*)(?:<[^>]*>)?[ \t]*$", 1))
    one = F.struct(
        "pos", name.alias("anchor"), "kind", token.rlike(r"^[ \t]*export\b").alias("exported"), F.col("line").alias("start_line"),
        F.when(body, F.col("next.end_line")).when(semicolon, F.col("next.line")).otherwise(F.col("line")).alias("end_line"),
        F.when(body, F.col("next.pos")).alias("open"), F.when(body, F.col("next.end")).otherwise(F.col("pos")).alias("end"),
        F.when(F.col("around.end") > F.col("pos"), F.col("around.pos")).alias("around"),
    )
    listed = inner.filter(body | ~F.col("kind").isin("function", "method", "member")).groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("all"))
    holders = F.transform(F.filter("all", lambda x: x["kind"].isin(HOLDERS) & x["open"].isNotNull()), lambda x: x["open"])
    listed = listed.withColumn("holders", holders)
    real = F.filter("all", lambda x: (x["kind"] != "member") | F.coalesce(F.array_contains("holders", x["around"]), F.lit(False)))
    listed = listed.select("path", real.alias("all")).select("path", "all", F.posexplode("all").alias("index", "s"))
    outer = F.filter("all", lambda x: (x["open"] < F.col("s.pos")) & (x["end"] > F.col("s.pos")))
    listed = listed.select(
        "path", "index", "s.anchor", F.when(F.col("s.kind") == "member", "method").otherwise(F.col("s.kind")).alias("kind"),
        F.try_element_at(F.transform(outer, lambda x: x["anchor"]), F.lit(-1)).alias("parent"), (F.col("s.exported") | F.exists(outer, lambda x: x["exported"])).alias("exported"), "s.start_line", "s.end_line",
    )
    texts = files.select("path", "text").filter("text is not null").repartition("path")
    content = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return listed.join(texts.hint("merge"), "path").select(*listed.columns, content.alias("content"))
