"""Connected components of an edge table, as repeated joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.storage import Scratch


def _jumped(parents: DataFrame, keep: Scratch) -> DataFrame:
    """Each node's root: parents of parents until none changes."""
    while True:
        up = parents.select(F.col("node").alias("p"), F.col("parent").alias("pp"))
        parents = parents.withColumnRenamed("parent", "p").join(up, "p", "left")
        parents = keep.written(parents.select("node", F.coalesce("pp", "p").alias("parent"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "roots")
        if parents.filter("moved").isEmpty():
            return parents.drop("moved")
        parents = parents.drop("moved")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows parents to
    their roots and contracts the edges; rounds grow with the logarithm of the
    component's size. Minima combine before the shuffle, and joins run between
    written tables, so that a node with very many edges is split. The result is a table
    of ``scratch``; what was written on the way is freed.
    """
    keep = Scratch(edges.sparkSession)
    edges = keep.written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    out = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = keep.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("parent")), "parents")
        roots = _jumped(parents, keep)
        if out is None:
            out = roots.select("node", F.col("parent").alias("component"))
        else:
            up = roots.select(F.col("node").alias("component"), "parent")
            out = keep.written(out.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "components")
        a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        edges = edges.join(a, "a").join(b, "b").filter("ra <> rb")
        edges = keep.written(edges.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
    out = out if out is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = (scratch or Scratch(edges.sparkSession)).written(out, "components")
    keep.free()
    return out
