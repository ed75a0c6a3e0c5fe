"""Connected components of links, by alternating large and small stars.

Kiveris et al., "Connected components in MapReduce and beyond", SoCC 2014. Every step is an
aggregation (combined before its shuffle) and a join, so a node with very many links is split like any
skewed key; the links stay as many or become fewer, and the number of steps grows with the logarithm of the
number of nodes. Only counts reach the driver. A step over `FEW` links or fewer (a megabyte) is one task without shuffles:
many small shuffles cost more files than data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, discard

#: Links that one task handles.
FEW = 1 << 16


def _ordered(links: DataFrame) -> DataFrame:
    """Links as (u, v) with u > v, each once."""
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _stars(links: DataFrame, few: bool) -> DataFrame:
    one = lambda x: x.coalesce(1) if few else x
    both = one(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # the links of each node to the lowest of its neighbours; nodes without higher neighbours keep theirs through the other end
    large = _ordered(large)
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return _ordered(one(small))


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node with a link to another.

    links: u, v, in either direction and any number of times. Null ends and links of a node to itself are left out.
    """
    frame = cut(_ordered(links.where("u is not null and v is not null")))
    mark = lambda x: x.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    was = None
    while True:
        now = mark(frame)
        if now == was or now[0] == 0:
            return frame.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(frame.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        was, last = now, frame
        frame = cut(_stars(last, now[0] <= FEW))
        discard(last)
