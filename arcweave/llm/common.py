"""What the training-data operators share: shared tables, cutting lineage and linking nodes to components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.sources.lineage import cut, shared_folder

__all__ = ["connected_components", "cut", "drop_folder", "shared_folder", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read from there; it stays until the folder is cleared.

    For what is as large as the corpus: a checkpoint isn't compressed, and is read whole where a
    table's columns are read one by one.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long): root is the component's least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step gives every
    node's neighbours to the least of them, so a component of any shape becomes one star in a
    number of rounds that grows with the logarithm of its size. Only minima per node are
    aggregated (before the shuffle), neighbours are never gathered into a list, and the join
    back to a node with many neighbours is an ordinary one that adaptive execution can split.
    Edges of a node to itself, and nulls, are dropped; no edges give no rows.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return (
            df.where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )

    def state(df: DataFrame) -> tuple:
        return tuple(
            df.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
            ).first()
        )

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        return pairs.join(least, "a")

    current = cut(oriented(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    seen = state(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            star(both)
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        )
        lower = oriented(large)
        small = star(lower)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        following = cut(oriented(small))
        now = state(following)
        current = following
        if now == seen:
            return _stars(current)
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _stars(current)


def _stars(pairs: DataFrame) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
