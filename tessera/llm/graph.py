"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node and component, its smallest node, for every node of an edge.

    Each round contracts the graph: a node is merged into the one of least hash among itself and its neighbours, and only
    edges between merged nodes go on. Hashes change from round to round, so a path or a grid loses a constant
    part of its nodes each time and a star all of them; edges are joined once a round and soon few. Rounds are written; only
    whether an edge is left comes to the driver. A node with very many edges is summed up before the exchange,
    and joins on it are split by Spark's skew handling.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    merged: list[DataFrame] = []
    while True:
        ways = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
        into = ways.groupBy("x").agg(F.min(F.struct(F.xxhash64("y", F.lit(len(merged))).alias("h"), "y")).alias("m"))
        into = written(into.select("x", F.least(F.struct(F.xxhash64("x", F.lit(len(merged))).alias("h"), F.col("x").alias("y")), "m")["y"].alias("p")), "merged")
        merged.append(into)
        if edges.isEmpty():
            break
        a = into.withColumnsRenamed({"x": "a", "p": "pa"})
        b = into.withColumnsRenamed({"x": "b", "p": "pb"})
        joined = edges.join(a, "a").join(b, "b").filter("pa <> pb")
        edges = written(joined.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    # a node's last name: follow the rounds
    names = merged[0].withColumnsRenamed({"x": "node", "p": "c"})
    for into in merged[1:]:
        names = names.join(into, F.col("c") == F.col("x"), "left").select("node", F.coalesce("p", "c").alias("c"))
    names = written(names, "names")
    least = names.groupBy("c").agg(F.min("node").alias("component"))
    return written(names.join(least, "c").select("node", "component"), "components")
