"""Near duplicates among vectors: an exact metric range join on the unit sphere.

A cosine of at least c means a distance of at most sqrt(2 - 2c) between the unit
vectors. Pivots cut the vectors into cells (nearest pivot). The triangle inequality
tells which vectors may have a partner in another cell; those are copied there,
and every cell is then joined on its own. Cells that hold many vectors are
joined block by block, so that no task depends on how crowded a cell is, and tiles of a block whose distances
to a point differ by more than the radius are passed over.

Pivots are taken farthest-first from a sample, each far from those before it. How many are used is chosen on the
sample, from the copies they would make and the comparisons they would leave: where vectors lie in groups, many; where
all are about equally far from each other, so that no bound excludes anything, one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemodex.llm.common import cut
from mnemodex.llm.components import connected_components
from mnemodex.llm.vectors import matrix, usable

CELL, MOST_PIVOTS = 64, 1024
#: Vectors of the sample that pivots are taken from, and its most bytes; comparisons that cost as much as a copy.
SAMPLE, SAMPLE_BYTES, COPY = 4096, 32_000_000, 4096
#: Bytes of the vectors that a task compares a block of a cell's own vectors with; that block has a quarter of them.
BLOCK_BYTES = 16_000_000
TILE = 1024
#: Distances are taken a little larger than they are, so that rounding never hides a partner.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the squares of huge or tiny components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _reach(cosine: np.ndarray, apart: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors with these cosines to the pivots: the home cell, and the cells in which a partner may live."""
    home = cosine.argmax(axis=1)
    every = np.arange(len(cosine))
    own = cosine[every, home]
    far, near = np.sqrt(np.maximum(0, 2 - 2 * cosine)), np.sqrt(np.maximum(0, 2 - 2 * own))
    # Triangle inequality, and the distance to the plane between the two pivots.
    go = far - near[:, None] <= 2 * radius + SLACK
    go &= own[:, None] - cosine <= (radius + SLACK) * apart[home] + SLACK
    go[every, home] = True
    return home, go


def _apart(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))


def choose_pivots(sample: np.ndarray, n: int, radius: float) -> np.ndarray:
    """Pivots from ``sample`` (unit vectors) for a table of ``n`` vectors, a row each.

    The first ones of the farthest-first order are the pivots; their number is the power of two at which a vector's copies and
    its comparisons, both estimated on the sample, cost least.
    """
    order, far = [0], 1 - sample @ sample[0]
    while len(order) < min(MOST_PIVOTS, -(-len(sample) // 4), max(1, n // CELL)):
        order.append(int(far.argmax()))
        far = np.minimum(far, 1 - sample @ sample[order[-1]])
    cosine = sample @ sample[order].T
    costs, k = {}, 1
    while k <= len(order):
        home, go = _reach(cosine[:, :k], _apart(sample[order[:k]]), radius)
        compared = (np.bincount(home, minlength=k) / len(sample)) @ (go.sum(axis=0) / len(sample))
        costs[k] = n * compared + COPY * go.sum() / len(sample)
        k *= 2
    best = min(costs, key=costs.get)
    return sample[order[: best if costs[best] < 0.7 * costs[1] else 1]]  # cells that exclude next to nothing are not worth their copies


def _cells(pivots: np.ndarray, radius: float):
    """Arrow batches (class, v) become (class, v, cell, home): the home cell, and each cell in which a partner may live."""
    apart = _apart(pivots)

    def run(batches):
        for batch in batches:
            home, go = _reach(_unit(matrix(batch.column("v"))) @ pivots.T, apart, radius)
            row, cell = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(cell == home[row])], names=["class", "v", "cell", "home"])

    return run


def _join(cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        """Links of one (cell, home block, other block): per home row the number of linked copies, and one edge to each local component."""
        ids, copies = rows["class"].to_numpy(), rows["copies"].to_numpy()
        left, right = rows["left"].to_numpy(zero_copy_only=False), rows["right"].to_numpy(zero_copy_only=False)
        x = _unit(matrix(rows["v"]))
        low = x.astype(np.float32)
        label, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        # By the distance to the first row: vectors within the radius of each other have distances within it.
        away = np.sqrt(np.maximum(0, 2 - 2 * x @ x[0])) if len(x) else np.empty(0)
        a, b = (rows[np.argsort(away[rows], kind="stable")] for rows in (np.nonzero(left)[0], np.nonzero(right)[0]))
        reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
        for i in range(0, len(a), TILE):
            for j in range(0, len(b), TILE):
                ra, rb = a[i : i + TILE], b[j : j + TILE]
                if away[ra[0]] - away[rb[-1]] > reach or away[rb[0]] - away[ra[-1]] > reach:
                    continue
                p, q = np.nonzero(low[ra] @ low[rb].T >= cosine - 1e-4)
                p, q = ra[p], rb[q]
                keep = ids[p] != ids[q]
                p, q = p[keep], q[keep]
                for s in range(0, len(p), 1 << 18):  # the pairs that single precision lets through, in double precision
                    u, v = p[s : s + (1 << 18)], q[s : s + (1 << 18)]
                    fine = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                    u, v = u[fine], v[fine]
                    np.add.at(count, u, copies[v])
                    while len(u):  # local components: smaller labels flow along the links until nothing changes
                        small = np.minimum(label[u], label[v])
                        if (label[u] == small).all() and (label[v] == small).all():
                            break
                        np.minimum.at(label, label[u], small)
                        np.minimum.at(label, label[v], small)
                        while (label != label[label]).any():
                            label = label[label]
        linked = (count > 0) | (label != np.arange(len(ids)))
        return pa.table({"class": ids[linked], "root": ids[label[linked]], "links": count[linked]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors``.

    Two vectors link if their cosine, in double precision, is at least ``cosine``. Vectors
    that are null, empty, zero, or hold null or non-finite components link with
    nothing; neither do vectors of different lengths. Rows with equal vectors form a class, and classes
    are joined; a class with n rows gives each of them n - 1 links. Rows with a null id
    count as partners, but their own row has component_id null and kept false if no id
    can be reached. ``component_id`` is the smallest id that can be reached, itself included.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    # Single precision travels as it is; a task turns it into double precision, exactly.
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")) & F.exists("v", lambda x: x != 0), F.col("v")))
    # A class: equal vectors. Its number is a hash of the vector and what tells equal hashes apart.
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = cut(rows.filter("h is not null").groupBy("h", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.size("v").alias("dim")).withColumn("class", F.monotonically_increasing_id()))
    sizes = [r[0] for r in classes.select("dim").distinct().collect()]
    n = classes.count()
    links = None
    for dim in sizes:  # vectors of one table have one length; others are rare and joined among themselves
        same = classes.filter(F.col("dim") == dim)
        size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        sample = np.array([r[0] for r in same.orderBy(F.xxhash64("h"), "class").limit(size).select("v").collect()])
        pivots = choose_pivots(_unit(sample), n, radius)
        cells = same.select("class", "v").mapInArrow(_cells(pivots, radius), f"class long, v {kind}, cell int, home boolean")
        cells = cells.join(same.select("class", "copies"), "class")
        placed = cells.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("members"))
        cells = cells.join(F.broadcast(placed), "cell")  # at most MOST_PIVOTS rows
        block = max(4, BLOCK_BYTES // (8 * dim))
        homes, members = F.ceil(F.col("homes") / (block // 4)).cast("int"), F.ceil(F.col("members") / block).cast("int")
        i = F.when(F.col("home"), F.pmod(F.xxhash64("class"), homes).cast("int"))
        j = F.pmod(F.xxhash64("class", F.lit(5)), members).cast("int")
        cells = cells.withColumn("i", i).withColumn("j", j)
        # A home row meets every block of members, and every member meets each block of home rows.
        pairs = F.array_union(
            F.when(F.col("home"), F.transform(F.sequence(F.lit(0), members - 1), lambda y: F.struct(F.col("i").alias("x"), y.alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>")),
            F.when(F.col("homes") > 0, F.transform(F.sequence(F.lit(0), F.greatest(homes - 1, F.lit(0))), lambda x: F.struct(x.alias("x"), F.col("j").alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>")),
        )
        dealt = cells.withColumn("p", F.explode(pairs)).select("cell", F.col("p.x").alias("bx"), F.col("p.y").alias("by"), "class", "v", "copies", (F.col("home") & (F.col("i") == F.col("p.x"))).alias("left"), (F.col("j") == F.col("p.y")).alias("right"))
        dealt = dealt.groupBy("cell", "bx", "by").applyInArrow(_join(cosine), "class long, root long, links long")
        links = dealt if links is None else links.unionByName(dealt)
    if links is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    links = cut(links)
    components = connected_components(links, "class", "root")
    per_class = links.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.join(components.withColumnRenamed("node", "class"), "class", "left").join(per_class, "class", "left")
    named = named.select("h", "v", "copies", "least", F.coalesce("component", "class").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    small = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(small, "component").select(F.col("h").alias("_h"), F.col("v").alias("_v"), (F.col("copies") - 1 + F.col("links")).alias("links"), "component_id")
    joined = rows.join(named, (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("h").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
