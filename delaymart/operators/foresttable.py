"""The forest as a table, scored in the plan.

A fitted forest is read from its saved folder as one row per tree node: (tree, node,
feature, threshold, left, right, value, gain, weight). A row is scored by walking all
trees down level by level: each step joins every (row, tree) with its node and goes
left if the feature is at most the threshold. After ``depth`` steps each (row, tree) is
at a leaf, and the prediction is the mean of the leaves' values.

It is a second, independent way to the same numbers: the fitted model's own scorer
and importances can be checked against it row by row, and the node table can be
queried with SQL.

Scale: the node table is bounded by trees x 2^(depth+1) rows, whatever the input
is, and is broadcast only if its counted rows are few; else the joins shuffle. With
it broadcast, a row becomes one per tree and walks without a shuffle; the mean is
summed in each task before the only one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymart import schema as S

BROADCAST_ROWS = 1 << 20


def node_table(spark: SparkSession, model_dir: str, features: Sequence[str]) -> DataFrame:
    """The nodes of a saved pipeline's last stage, read as Parquet: a leaf has no
    feature and is its own child, so a walk may take more steps than a tree is deep."""
    stages = spark.read.text(f"{model_dir}/metadata").select(
        F.from_json("value", "uid string, paramMap struct<stageUids: array<string>>").alias("m")).select("m.paramMap.stageUids")
    uids = stages.first()[0]
    data = spark.read.parquet(f"{model_dir}/stages/{len(uids) - 1}_{uids[-1]}/data")
    n = data.select("treeID", "nodeData.*")
    names = F.array(*[F.lit(c) for c in features])
    leaf = F.col("leftChild") < 0
    return n.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(~leaf, names[F.col("split.featureIndex")]).alias("feature"),
        F.when(~leaf, F.col("split.featureIndex")).alias("at"),
        F.when(~leaf, F.element_at("split.leftCategoriesOrThreshold", 1)).alias("threshold"),
        F.when(leaf, F.col("id")).otherwise(F.col("leftChild")).alias("left"),
        F.when(leaf, F.col("id")).otherwise(F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"), F.when(~leaf, F.col("gain")).alias("gain"),
        F.col("impurityStats")[0].alias("weight"))


def walk(rows: DataFrame, nodes: DataFrame, features: Sequence[str], depth: int,
         keys: Sequence[str] = (S.ENTITY, "DATE")) -> DataFrame:
    """(keys, walked): the mean over trees of the leaf that each row reaches.

    Every (row, tree) starts at the tree's root and is joined with its node ``depth``
    times. The joins are on (tree, node) with the node table, broadcast as its
    counted size allows; the only shuffle is the final mean, summed in each task."""
    n = nodes.count()
    side = F.broadcast if n <= BROADCAST_ROWS else (lambda d: d)
    trees = nodes.where("node = 0").count()     # numbered from 0
    vector = F.array(*[F.col(c).cast("double") for c in features])
    at = rows.select(*keys, vector.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
                     F.lit(0).alias("node"))
    step = side(nodes.select("tree", "node", "at", "threshold", "left", "right"))
    for _ in range(depth):
        # A leaf has no feature and stays where it is.
        goes = F.when(F.col("at").isNull() | (F.element_at("_x", F.coalesce(F.col("at"), F.lit(0)) + 1) <= F.col("threshold")),
                      F.col("left")).otherwise(F.col("right"))
        at = at.join(step, ["tree", "node"]).select(*keys, "_x", "tree", goes.alias("node"))
    leaves = side(nodes.select("tree", "node", "value"))
    return at.join(leaves, ["tree", "node"]).groupBy(*keys).agg(F.avg("value").alias("walked"))


def importances(nodes: DataFrame) -> DataFrame:
    """M10 from the nodes: per tree, each feature's gain times the node's weight and
    scaled to add up to 1; then the mean over trees, scaled again."""
    per = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
    total = per.groupBy("tree").agg(F.sum("g").alias("all"))
    scaled = per.join(total, "tree").where("all > 0").groupBy("feature").agg(F.sum(F.col("g") / F.col("all")).alias("w"))
    every = scaled.agg(F.sum("w").alias("all"))
    return scaled.crossJoin(F.broadcast(every)).select("feature", (F.col("w") / F.col("all")).alias("walked_importance"))
