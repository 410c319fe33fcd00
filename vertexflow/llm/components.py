"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import heavy_keys, join_keyed
from .common import drop_path, staged


def _with_least(pairs: DataFrame) -> tuple[DataFrame, str]:
    """Adds m, the least of u and its neighbours. A hub's links are summed in their tasks and meet the minimum there, too."""
    least, path = staged(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "least")
    return join_keyed(pairs, least.drop("n"), ["u"], heavy_keys(least, ["u"])), path


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node of its component) of every node that has a link.

    Each round connects the larger neighbours of a node to its least one, then the node
    and its smaller neighbours to the least of those; it ends when every link leads to
    a root. Links may repeat and lead to themselves; rounds are staged in the shared folder.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs, path = staged(pairs, "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, one = _with_least(both)
        large, two = staged(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        small, three = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new, new_path = staged(small, "links")
        # Every node below exactly one other that is itself below none: stars around roots.
        tops = new.select("v").distinct().withColumnRenamed("v", "u")
        open_ = new.join(tops, "u", "left_semi").limit(1).count() or new.groupBy("u").count().where("count > 1").limit(1).count()
        for p in (path, one, two, three):
            drop_path(spark, p)
        pairs, path = new, new_path
        if not open_:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
