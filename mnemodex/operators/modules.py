"""What is derived of a project as a whole: module rows and texts, the graph of modules, packages and commands, key files, warm-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemodex.functions import text
from mnemodex.operators import durable, projection, relational
from mnemodex.operators.graph import relation_id

MODULE = ["id", "path", "source_role", "package_name", "summary", "file_count", "section_count", "imports", "topics", "entities", "text"]


def module_id(path: Column, role: Column) -> Column:
    return text.identifier("module", path, role)


def module_entity(path: Column, role: Column) -> Column:
    return text.identifier("ent", F.concat(F.lit("module:"), path, F.lit("#"), role))


def module_rows(sections: DataFrame) -> DataFrame:
    """A row for each top-level module and role of ``sections`` (path, source_role): counts, summary, topics, entity and the text that is searched."""
    rows = relational.module_rollup(sections).withColumnRenamed("module_path", "path")
    summary = F.concat(F.col("file_count").cast("string"), F.lit(" files, "), F.col("section_count").cast("string"), F.lit(" sections"))
    out = rows.withColumn("summary", summary).withColumn("topics", projection.module_topics(F.col("path")))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    body = F.concat_ws("\n", line("module", F.col("path")), line("role", F.col("source_role")), line("summary", F.col("summary")), line("topics", F.array_join("topics", ", ")))
    none = F.array().cast("array<string>")
    made = {"id": module_id(F.col("path"), F.col("source_role")), "package_name": F.lit(None).cast("string"), "imports": none, "entities": F.array(module_entity(F.col("path"), F.col("source_role"))), "text": body}
    return out.withColumns(made).select(*MODULE)


def rebuilt(before: DataFrame, sections: DataFrame, changed: DataFrame) -> DataFrame:
    """``before`` with the rows of the ``changed`` modules (module_path) made anew; those that have no section left go."""
    of = changed.select(F.col("module_path").alias("path")).distinct()
    new = module_rows(sections.join(of, text.top_module(sections["path"]) == of["path"], "left_semi"))
    return relational.without(before, of, ["path"]).select(*MODULE).unionByName(new)


def package_rows(manifests: DataFrame) -> DataFrame:
    """A module row for each manifest (path, name, manager, dependencies, scripts); 80 dependencies are listed as imports, 24 as topics."""
    deps = F.slice(F.coalesce("dependencies", F.array().cast("array<string>")), 1, 80)
    role = F.lit("package_config")
    summary = F.concat("manager", F.lit(", "), F.size(deps).cast("string"), F.lit(" deps"))
    topics = F.array_compact(F.concat(F.array(F.lit("package"), F.col("name"), F.col("manager")), F.slice(deps, 1, 24)))
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    body = F.concat_ws("\n", line("module", F.col("path")), line("role", role), line("package", F.col("name")), line("package manager", F.col("manager")), line("dependencies", F.array_join(deps, ", ")), line("summary", summary))
    ident = text.identifier("module", F.lit("package"), F.col("path"), F.coalesce("name", F.lit("")))
    one = F.lit(1).cast("long")
    return manifests.select(ident.alias("id"), "path", role.alias("source_role"), F.col("name").alias("package_name"), summary.alias("summary"), one.alias("file_count"), (one - 1).alias("section_count"), deps.alias("imports"), topics.alias("topics"), F.array(module_entity(F.col("path"), role)).alias("entities"), body.alias("text"))


def _edges(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.distinct().select(relation_id(F.col("subject_id"), F.col("predicate"), F.col("object_id")).alias("id"), "subject_id", "predicate", "object_id")


def module_graph(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, path) of modules and files, and an edge ``contains`` from each module to each of its files."""
    rows = sections.select("path", text.top_module(F.col("path")).alias("module"), F.coalesce("source_role", F.lit("unknown")).alias("role")).distinct()
    node = module_entity(F.col("module"), F.col("role"))
    file = projection.entity_id("file", F.col("path"))
    nodes = rows.select(node.alias("id"), F.lit("module").alias("type"), F.col("module").alias("name"), F.col("module").alias("path")).unionByName(rows.select(file.alias("id"), F.lit("file").alias("type"), F.col("path").alias("name"), "path"))
    return nodes.distinct(), _edges(rows.select(node.alias("subject_id"), F.lit("contains").alias("predicate"), file.alias("object_id")))


def metadata_graph(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of manifests (path, name, dependencies, scripts): a package uses its dependencies and contains its commands, which use it; its module contains it."""
    package = lambda name: projection.entity_id("package", name)
    named = manifests.filter(F.coalesce("name", F.lit("")) != "")
    deps = named.select("name", "path", F.explode("dependencies").alias("dependency"))
    commands = named.select("name", "path", F.explode("scripts").alias("script"))
    command = projection.entity_id("command", F.concat("path", F.lit("#"), "script"))
    node = lambda rows, ident, kind, name: rows.select(ident.alias("id"), F.lit(kind).alias("type"), name.alias("name"), "path")
    home = module_entity(F.col("path"), F.lit("package_config"))
    nodes = node(named, package(F.col("name")), "package", F.col("name")).unionByName(node(deps, package(F.col("dependency")), "package", F.col("dependency"))).unionByName(node(commands, command, "command", F.col("script"))).unionByName(node(manifests, home, "module", F.col("path")))
    # A package that several manifests name is one node, of the first path.
    nodes = nodes.groupBy("id", "type", "name").agg(F.min("path").alias("path"))
    edge = lambda rows, subject, predicate, target: rows.select(subject.alias("subject_id"), F.lit(predicate).alias("predicate"), target.alias("object_id"))
    edges = _edges(
        edge(deps, package(F.col("name")), "uses_package", package(F.col("dependency"))), edge(commands, package(F.col("name")), "contains", command),
        edge(commands, command, "uses_package", package(F.col("name"))), edge(named, home, "contains", package(F.col("name"))),
    )
    return nodes, edges


#: What a project's metadata is read from, besides package files.
METADATA = r"(^|/)readme[^/]*$|\.csproj$|^\.agents/|^\.codex/|^\.cursor/|^docs/|(^|/)(package\.json|composer\.json|pubspec\.yaml|pyproject\.toml|requirements\.txt|go\.mod|cargo\.toml|pom\.xml|build\.gradle|gemfile)$"


def tells_of_project(path: Column) -> Column:
    return F.lower(path).rlike(METADATA)


def of_module(path: Column, module: str) -> Column:
    """Whether a path lies in a top-level module; ``.`` is what lies in no folder."""
    return F.instr(path, "/") == 0 if module == "." else path.startswith(f"{module}/")


def key_files(highlights: DataFrame, manifests: DataFrame, most: int = 12) -> DataFrame:
    """(n, path): the paths of the highlights (position, path), then those of manifests, each once."""
    every = highlights.filter("path is not null").select(F.lit(0).alias("of"), "position", "path").unionByName(manifests.select(F.lit(1).alias("of"), F.lit(0).alias("position"), "path"))
    first = every.groupBy("path").agg(F.min(F.struct("of", "position", "path")).alias("at")).orderBy("at").limit(most)
    return first.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("at")).alias("n"), "path")


def warm_up(docs: DataFrame, sections: DataFrame, notes: DataFrame, now: str, budget: int = 2000, base: str = "") -> DataFrame:
    """(part, position, ref, line, cost): what a session begins with, within the budget of characters / 4 that ``base`` leaves.

    Guidance, then highlights, then modules; lines are taken in this order up to the first that doesn't fit. Without
    any document there is one line that says so.
    """
    guided = durable.guidance(notes).join(notes.select("id", F.col("text").alias("body")), "id")
    order = Window.partitionBy(F.lit(1))  # short lists
    parts = [
        guided.select(F.lit("guidance").alias("part"), F.row_number().over(order.orderBy(F.desc("score"), "id")).alias("position"), F.col("id").cast("string").alias("ref"), F.concat("kind", F.lit(": "), text.summary(F.col("body"))).alias("line")),
    ]
    high = durable.highlights(docs, now).join(docs.select("target_type", "id", "path", F.col("text").alias("body")), ["target_type", "id"])
    label = text.target_label(F.col("path"), F.col("id"), F.lit(None).cast("string"))
    parts.append(high.select(F.lit("highlight").alias("part"), F.row_number().over(order.orderBy(F.desc("score"), "target_type", "id")).alias("position"), label.alias("ref"), F.concat(label, F.lit(": "), F.substring(text.squeeze(F.col("body")), 1, 120)).alias("line")))
    rows = module_rows(sections).orderBy(F.desc("section_count"), F.desc("file_count"), "path", "source_role").limit(12)
    parts.append(rows.select(F.lit("module").alias("part"), F.row_number().over(order.orderBy(F.desc("section_count"), F.desc("file_count"), "path", "source_role")).alias("position"), F.col("path").alias("ref"), F.concat("path", F.lit(" ("), "source_role", F.lit("): "), "summary").alias("line")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rank = F.when(F.col("part") == "guidance", 0).when(F.col("part") == "highlight", 1).otherwise(2)
    costed = every.withColumn("cost", text.char_tokens(F.col("line"))).withColumn("_rank", rank)
    left = max(0, budget - -(-len(base) // 4))
    return durable.prefix_budget(costed, "cost", [F.col("_rank"), F.col("position")], left).drop("_rank")
