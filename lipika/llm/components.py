"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.session import remove, scratch


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of an edge table ``(a, b)``; root is the component's least node.

    No neighbour list is ever gathered: each step is a minimum with partial counts and a
    join, so a node with very many links costs no more than its rows. Steps are written
    to the shared folder, which cuts lineage. Loops and nulls in the edges are ignored;
    no edges give no rows.
    """
    spark = edges.sparkSession
    current, path = _write(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before or not state["n"]:
            break
        before = state
        after, new_path = _write(_small_star(_large_star(current)), "edges")
        remove(spark, path)
        current, path = after, new_path
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
