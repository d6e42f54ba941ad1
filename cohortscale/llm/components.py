"""Connected components of links between documents, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscale.session import cut_lineage


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return others.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, component_id) of every linked document; the component is its least id.

    Rounds go on until the edges stay the same; a round is a few joins on the links and is stored,
    so neither links nor components meet in one place. A node with very many links is left to
    partial sums and the adaptive skew join. Links with a NULL end or to oneself are none.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = cut_lineage(edges), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionAll(
                edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id"))
            ).distinct()
        edges, before = cut_lineage(_small(_large(edges))), now
