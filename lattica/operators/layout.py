"""Places of nodes for a drawing: layers by longest paths, and a layout by forces.

Both are rounds of joins and aggregates over tables written between them; no group of nodes is gathered. Defined results: self loops and edges to unknown nodes don't count; an edge that stands twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .algorithms import strong_components
from .merge import sequential_ids


def _links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    known = nodes.select("id").distinct()
    return edges.where("src <> dst").select("src", "dst").distinct().join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def layers(nodes: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(id, layer): the number of edges of the longest path that ends at the node, when each strongly connected component is one node.

    A round settles a layer. More layers than ``rounds`` raise.
    """
    links = materialize(_links(nodes, edges), "links")
    part = materialize(strong_components(nodes.select("id").distinct(), links), "parts")
    end = lambda x: part.select(F.col("id").alias(x), F.col("component").alias(f"{x}_c"))
    left = links.join(end("src"), "src").join(end("dst"), "dst").where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct()
    left, rest, done = materialize(left, "left"), materialize(part.select("component").distinct(), "rest"), None
    for layer in range(rounds):
        first = materialize(rest.join(left.select(F.col("dst").alias("component")).distinct(), "component", "left_anti").withColumn("layer", F.lit(layer).cast("long")), "first")
        done = first if done is None else materialize(done.unionByName(first), "done")
        if left.isEmpty():
            break
        rest = materialize(rest.join(first, "component", "left_anti"), "rest")
        left = materialize(left.join(first.select(F.col("component").alias("src")), "src", "left_anti").select("src", "dst"), "left")
    else:
        raise RuntimeError(f"more than {rounds} layers")
    return part.join(done, "component").select("id", "layer")


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (id, layer, ..) with x: the middle of the node's share of its layer, in the given order."""
    numbered = materialize(sequential_ids(rows, ["layer", *by, "id"], "i"), "numbered")
    sizes = numbered.groupBy("layer").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    return materialize(numbered.join(sizes, "layer").select("id", "layer", ((F.col("i") - F.col("first") + 0.5) / F.col("n")).alias("x")), "placed")


def layered(nodes: DataFrame, edges: DataFrame, sweeps: int = 4) -> DataFrame:
    """(id, x, y): y is the layer, x the place in it from 0 to 1. Sweeps order each layer by the mean place of what its nodes are linked to, in turn of their predecessors and of their successors; nodes without any keep theirs."""
    links = materialize(_links(nodes, edges), "links")
    at = _placed(layers(nodes, edges), [])
    for turn in range(sweeps):
        own, other = ("dst", "src") if turn % 2 == 0 else ("src", "dst")
        mean = links.join(at.select(F.col("id").alias(other), "x"), other).groupBy(F.col(own).alias("id")).agg(F.round(F.avg("x"), 9).alias("mean"))
        at = _placed(at.join(mean, "id", "left").select("id", "layer", F.coalesce("mean", "x").alias("mean")), ["mean"])
    return at.select("id", "x", F.col("layer").cast("double").alias("y"))


def crossings_of(at: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the mean horizontal length of the edges of a layered layout, which falls with their crossings."""
    end = lambda x: at.select(F.col("id").alias(x), F.col("x").alias(f"{x}_x"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").agg(F.avg(F.abs(F.col("src_x") - F.col("dst_x"))).alias("length"))


#: Cells on a side of the grid whose sums stand for the nodes in them.
GRID = 8


def force(nodes: DataFrame, edges: DataFrame, rounds: int = 30, seed: int = 1) -> DataFrame:
    """(id, x, y): linked nodes draw each other, all others push; a node is pushed by the middle of each cell of a grid, by as much as nodes are in it, not by each node.

    The grid has GRID x GRID cells over all nodes, so what every node meets is one row of bounded size. Steps get shorter from round to round. Places are scaled to 0 .. 1.
    """
    links = materialize(_links(nodes, edges), "links")
    unit = lambda salt: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    at = materialize(nodes.select("id").distinct().select("id", unit(1).alias("x"), unit(2).alias("y")), "at")
    n = max(1, at.count())
    k = (1.0 / n) ** 0.5
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = materialize(both, "both")
    cell = lambda c: F.least(F.floor(F.col(c) * GRID), F.lit(GRID - 1)).cast("int")
    for turn in range(rounds):
        at = at.withColumns({"cx": cell("x"), "cy": cell("y")})
        cells = at.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).agg(F.collect_list(F.struct("cx", "cy", "n", "sx", "sy")).alias("cells"))  # GRID * GRID cells

        def push(c):
            own = (c["cx"] == F.col("cx")) & (c["cy"] == F.col("cy"))
            m = c["n"] - own.cast("int")
            dx, dy = F.col("x") - (c["sx"] - own.cast("int") * F.col("x")) / m, F.col("y") - (c["sy"] - own.cast("int") * F.col("y")) / m
            f = F.when(m > 0, m * k * k / (dx * dx + dy * dy + 1e-6)).otherwise(0.0)
            return F.struct(F.when(m > 0, dx * f).otherwise(0.0).alias("x"), F.when(m > 0, dy * f).otherwise(0.0).alias("y"))

        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        pushed = at.crossJoin(F.broadcast(cells)).withColumn("p", F.aggregate(F.transform("cells", push), zero, lambda s, v: F.struct((s["x"] + v["x"]).alias("x"), (s["y"] + v["y"]).alias("y"))))  # one row of cells
        end = lambda s: at.select(F.col("id").alias(s), F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"))  # noqa: B023, E731
        drawn = both.join(end("src"), "src").join(end("dst"), "dst").withColumns({"dx": F.col("dst_x") - F.col("src_x"), "dy": F.col("dst_y") - F.col("src_y")}).withColumn("d", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
        drawn = drawn.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("dx") * F.col("d") / k).alias("ax"), F.sum(F.col("dy") * F.col("d") / k).alias("ay"))
        moved = pushed.select("id", "x", "y", "p").join(drawn, "id", "left").withColumns({"mx": F.col("p.x") + F.coalesce("ax", F.lit(0.0)), "my": F.col("p.y") + F.coalesce("ay", F.lit(0.0))})
        size, step = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2), 0.1 * (1 - turn / rounds) + 0.002
        scale = F.when(size > step, step / size).otherwise(1.0)
        moved = materialize(moved.select("id", (F.col("x") + F.col("mx") * scale).alias("x"), (F.col("y") + F.col("my") * scale).alias("y")), "moved")
        box = moved.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])  # one row
        inside = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")), F.lit(0.5))
        at = materialize(moved.crossJoin(F.broadcast(box)).select("id", inside("x").alias("x"), inside("y").alias("y")), "at")
    return at


def stretch(at: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the root mean square length of the edges over that of the distances between all nodes, 1 for places at random."""
    end = lambda s: at.select(F.col("id").alias(s), F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"))
    long = edges.join(end("src"), "src").join(end("dst"), "dst").agg(F.avg((F.col("src_x") - F.col("dst_x")) ** 2 + (F.col("src_y") - F.col("dst_y")) ** 2).alias("e"))
    wide = at.agg((2 * (F.var_pop("x") + F.var_pop("y"))).alias("w"))
    return long.crossJoin(F.broadcast(wide)).select(F.sqrt(F.try_divide("e", "w")).alias("stretch"))
