"""Bounded walks over ownership edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import staged


def tree(edges: DataFrame, roots: DataFrame, depth: int, down: bool = True) -> DataFrame:
    """(root, node, depth): nodes reached from the roots, each at its least depth, no deeper than ``depth``.

    Every level is one join of the frontier with the edges and an anti-join with
    what was reached before; cycles end there, and so does the walk where nothing
    new is found. Levels are staged, so plans do not nest.
    """
    if not 1 <= depth <= 20:
        raise ValueError("depth must be from 1 to 20")
    step = edges.select(F.col("dst" if down else "src").alias("node"), F.col("src" if down else "dst").alias("next"))
    reached = frontier = staged(roots.select(F.col("key").alias("root"), F.col("key").alias("node"), F.lit(0).alias("depth")), "roots")
    for level in range(1, depth + 1):
        found = frontier.join(step, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = staged(found.join(reached.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(level).alias("depth")), "level")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def coverage(reached: DataFrame, edges: DataFrame, depth: int, down: bool = True) -> DataFrame:
    """Per root of a ``tree``: nodes, edges that led to a node reached before, and nodes without a recorded parent.

    Every edge out of a node above the last level was followed once, and each node
    but the root was new once; all other steps are cycle edges.
    """
    step = edges.select(F.col("dst" if down else "src").alias("node"), F.col("src" if down else "dst").alias("next")).distinct()
    out = step.groupBy("node").agg(F.count("*").alias("out"))
    parents = edges.where("rel = 'subsidiary_of'").select(F.col("src").alias("node")).distinct().withColumn("known", F.lit(1))
    seen = reached.join(out, "node", "left").join(parents, "node", "left")
    followed = F.sum(F.when(F.col("depth") < depth, F.coalesce("out", F.lit(0))).otherwise(0))
    return seen.groupBy("root").agg(F.count("*").alias("nodes"), (followed - (F.count("*") - 1)).alias("cycle_edges"), F.count_if(F.col("known").isNull()).alias("without_parent"))


def parent_status(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether an entity has a parent, several, or none recorded."""
    parents = edges.where("rel = 'subsidiary_of'").groupBy(F.col("src").alias("key")).agg(F.countDistinct("dst").alias("parents"))
    status = F.when(F.col("parents").isNull(), "none_recorded").when(F.col("parents") > 1, "conflict").otherwise("consolidated")
    return entities.join(parents, "key", "left").select("key", status.alias("parent_status"))


def neighbourhood(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges out of and into the keys, with their direction."""
    out = edges.join(keys.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("src").alias("key"), F.lit("out").alias("dir"), "rel", F.col("dst").alias("other"))
    into = edges.join(keys.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("key"), F.lit("in").alias("dir"), "rel", F.col("src").alias("other"))
    return out.union(into)
