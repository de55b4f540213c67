"""Connected components by repeated contraction, without collecting links."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.session import durable


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(u long, v long).

    Each round sends a node to the least of itself and its neighbours, in an
    order that changes by round, and contracts the links. The number of links
    falls by a constant factor a round in expectation, so the rounds grow with
    the logarithm of the longest chain. Rounds are kept as checkpoints.
    """
    rng = random.Random(7)
    links = durable(links.select("u", "v").where("u <> v").distinct())
    labels = durable(links.select(F.col("u").alias("node")).union(links.select("v")).distinct().withColumn("label", F.col("node")))
    while not links.isEmpty():
        salt = F.lit(rng.getrandbits(63))
        both = links.union(links.select("v", "u"))
        to = durable(
            both.groupBy("u")
            .agg(F.min(F.col("v").bitwiseXOR(salt)).alias("m"))
            .select("u", F.least("m", F.col("u").bitwiseXOR(salt)).bitwiseXOR(salt).alias("m"))
        )
        labels = durable(
            labels.join(to.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("m", "label").alias("label"))
        )
        links = durable(
            links.join(to, "u")
            .select(F.col("m").alias("a"), F.col("v"))
            .join(to.withColumnRenamed("u", "v"), "v")
            .select(F.col("a").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
    return labels
