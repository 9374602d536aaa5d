"""Connected components of a table of links, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dwellspark.session import cut_lineage, cuts_deleted, delete_folder, new_folder


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for links ``a, b``: the smallest node that can be reached.

    Alternates two steps until nothing changes: every node's larger neighbours, then its
    smaller ones, are linked to its smallest neighbour. Links only get smaller ends, and
    no step emits more links than it reads, so a node with very many links does not make
    pairs of them. A round is a few shuffles; their number grows with the logarithm of the
    longest path. Each round is written to the shared folder, so that a lost executor
    costs a re-read, and only two sums of each reach the driver.
    """
    spark = links.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        df.write.parquet(path := new_folder(spark, "links"))
        return spark.read.schema("a bigint, b bigint").parquet(path), path

    edges, path = written(links.select("a", "b").filter("a <> b").distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # every node's larger neighbours, and itself, to its smallest neighbour
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # (written, so that the join shuffles both sides anew and Spark can split a node of very many links)
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # then every node's smaller neighbours, and itself, to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = cut_lineage(down.groupBy("a").agg(F.min("b").alias("m")))
        moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        used = path
        edges, path = written(moved.filter("a <> b").distinct())
        delete_folder(spark, used)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
