"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.sources.stages import stage_table


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Smallest node that each linked node can reach: columns node, component.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours too. Each is one aggregate and one join on the links; the
    number of rounds grows with the logarithm of the longest path. Every round is written out, so that
    a lost executor costs one round. No links give no rows.
    """
    links = edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
    links = stage_table(links.where("hi > lo").distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = links.join(least, links["lo"] == least["u"]).select("hi", F.col("m").alias("lo"))
        large = stage_table(large.where("hi > lo").distinct(), "large")
        low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        joined = large.join(low, large["hi"] == low["u"])
        small = joined.select(F.explode(F.array(
            F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        after = stage_table(small.where("hi > lo").distinct(), "links")
        tails = after.agg(F.count("*").alias("n"), F.countDistinct("hi").alias("d"),
                          F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s"))
        before = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s"))
        now, was = tails.first(), before.first()
        links = after
        if (now["n"], now["s"]) == (was["n"], was["s"]):
            break
    nodes = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return nodes.unionByName(roots)
