"""Queries over file trees: symbols of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemodex.operators import symbols
from mnemodex.plans.catalogue import query
from mnemodex.sources.model import table

# A file for each customer: a class with a method for each of their orders, with braces in strings, comments and types, and a type after it.


@query("code_symbols", """
WITH m AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
c AS (SELECT c_custkey, 'src/c' || c_custkey || '.ts' AS path, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer)
SELECT path, CAST(0 AS INTEGER) AS index, 'C' || c_custkey AS anchor, 'class' AS kind, NULL AS parent, true AS exported, CAST(1 AS INTEGER) AS start_line, CAST(4 * n + 2 AS INTEGER) AS end_line FROM c
UNION ALL SELECT path, CAST(k AS INTEGER), 'm' || o_orderkey, 'method', 'C' || c_custkey, true, CAST(4 * k - 2 AS INTEGER), CAST(4 * k + 1 AS INTEGER) FROM c JOIN m ON o_custkey = c_custkey
UNION ALL SELECT path, CAST(n + 1 AS INTEGER), 'T' || c_custkey, 'type', NULL, false, CAST(4 * n + 3 AS INTEGER), CAST(4 * n + 5 AS INTEGER) FROM c""")
def code_symbols(spark, sf_dir):
    """Classes, their methods and types with their lines, from the text alone."""
    key = F.col("o_orderkey").cast("string")
    method = F.concat(F.lit("    async m"), key, F.lit("(a: { b: number }): { c: string } {\n        const s = \"} "), "o_orderpriority", F.lit("\" // {\n        send(s, `{\n`) }"))
    methods = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", method.alias("m")))).alias("ms"))
    body = F.transform(F.coalesce("ms", F.array().cast("array<struct<o_orderkey:bigint,m:string>>")), lambda x: F.concat(x["m"], F.lit("\n")))
    name = F.col("c_custkey").cast("string")
    whole = F.concat(F.lit("export class C"), name, F.lit(" {\n"), F.array_join(body, ""), F.lit("}\ntype T"), name, F.lit(" = {\n    k: number\n}\n"))
    files = table(spark, sf_dir, "customer").join(methods, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.concat(F.lit("src/c"), name, F.lit(".ts")).alias("path"), whole.alias("text"))
    return symbols.symbols(files).drop("content")
