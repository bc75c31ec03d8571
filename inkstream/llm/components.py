"""Connected components of a link table, by rounds of minimum neighbours on a graph that shrinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm._common import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, class): the smallest node that links lead to, for every node that has a link.

    In each round every node moves to the least of itself, its neighbours and their own least neighbours; links between
    nodes that have met are dropped, equal links become one, and the next round works on what is left. A node of very
    many links is one key of a pre-aggregated minimum; nothing is collected. Rounds are about the logarithm of the
    longest chain, each a table in the shared folder; at the end the moves are put together from the last to the first.
    """
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    moves, read = [], []
    while True:
        edges = stored(edges, "links")
        for done in read:
            discard(done)
        if moves and edges.isEmpty():
            break
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        near = stored(ends.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("to")), "labels")
        jump = near.join(near.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to"))
        moves.append(stored(jump, "labels"))
        read = [edges, near]
        to = lambda end: moves[-1].select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
        edges = edges.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()

    def composed(later: DataFrame, earlier: DataFrame) -> DataFrame:
        further = later.select(F.col("node").alias("to"), F.col("to").alias("far"))
        return earlier.join(further, "to", "left").select("node", F.coalesce("far", "to").alias("to"))

    found = stored(reduce(composed, reversed(moves)), "components")
    for done in (edges, *moves):
        discard(done)
    return found.select("node", F.col("to").alias("class"))
