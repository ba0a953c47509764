"""Connected components of a link table by alternating large and small stars.

Every step rewires links towards the smallest node of a neighbourhood, with a
map-side minimum per node, until the links are stars: each node is then linked to
the smallest node of its component. Links stay in written tables; the driver
sees their count and whether they are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymart.llm.common import cut, small


def _state(links: DataFrame) -> tuple[int, bool]:
    """The number of links, and whether no larger end is also a smaller one and
    each has one link; both in one job."""
    ends = (links.select(F.col("b").alias("node"), F.lit(1).alias("larger"), F.lit(0).alias("smaller"))
            .unionByName(links.select(F.col("a").alias("node"), F.lit(0).alias("larger"), F.lit(1).alias("smaller"))))
    per = ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller"))
    off = (F.col("larger") > 1) | ((F.col("larger") > 0) & (F.col("smaller") > 0))
    count, bad = per.agg(F.sum("larger"), F.count(F.when(off, 1))).first()
    return count or 0, not bad


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node with a link, comp being the smallest node
    it reaches, from links (u, v) in any direction; loops are ignored."""
    links = cut(links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
                .where("a < b").distinct(), "links")
    while True:
        count, stars = _state(links)
        if stars:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (both.join(small(low, 2 * count, 16), "a").where("b > a")
                 .select(F.col("m").alias("a"), "b").where("a < b"))
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        near = large.join(small(low, count, 16), "b")
        links = cut(near.select(F.col("m").alias("a"), "b")
                    .unionByName(near.select(F.col("m").alias("a"), F.col("a").alias("b")))
                    .where("a < b").distinct(), "links", [links])
    return (links.select(F.col("b").alias("node"), F.col("a").alias("comp"))
            .unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()))
