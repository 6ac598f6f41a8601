"""Exact nearest neighbours, for one query or many, and an approximate search by random projections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.functions.scalars import cosine, dot, l2_squared, text_embedding

METRICS = {"l2": l2_squared, "cosine": cosine}


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, distance) of the k nearest, ties by id; each partition keeps its own k. Other dimensions don't match."""
    if not 1 <= k <= 1000:
        raise ValueError("k must be within 1 to 1000")
    at = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.where(F.size(vec_col) == len(query)).select(id_col, METRICS[metric](F.col(vec_col), at).alias("distance"))
    return near.orderBy("distance", id_col).limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id", vec_col: str = "embedding", block: int = 1000, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank) of each query's k nearest, for a stated set of queries.

    Queries go out in blocks of ``block``, each broadcast (its size is the block's) and compared
    with all vectors where they lie. Each partition keeps only its best k of a query before
    anything moves.
    """
    if not 1 <= k <= 1000:
        raise ValueError("k must be within 1 to 1000")
    wanted = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query"))
    n = wanted.count()
    parts = max(1, -(-n // block))
    out = None
    own = vectors.select(id_col, vec_col).withColumn("part", F.spark_partition_id())
    for b in range(parts):
        some = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b)
        pairs = own.join(F.broadcast(some), F.size(vec_col) == F.size("query"))
        if exclude_self:
            pairs = pairs.where(F.col(id_col) != F.col("query_id"))
        near = pairs.select("query_id", id_col, METRICS[metric](F.col(vec_col), F.col("query")).alias("distance"), "part")
        best = Window.partitionBy("query_id", "part").orderBy("distance", id_col)
        final = Window.partitionBy("query_id").orderBy("distance", id_col)
        near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
        near = near.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", id_col, "distance", "rank")
        out = near if out is None else out.unionByName(near)
    return out


def find_similar(vectors: DataFrame, of, k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest others of a stored vector, by cosine."""
    return knn_batch(vectors, vectors.where(F.col(id_col) == of), k, "cosine", id_col, vec_col, exclude_self=True)


def text_knn(texts: DataFrame, query: str, k: int, dim: int = 16, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, distance) of the k texts whose hashed embeddings are nearest to that of ``query``, by cosine; null texts don't match."""
    held = texts.where(F.col(text_col).isNotNull()).select(id_col, text_embedding(F.col(text_col), dim).alias("embedding"))
    at = texts.sparkSession.range(1).select(text_embedding(F.lit(query), dim).alias("e")).first().e
    return knn(held, list(at), k, "cosine", id_col)


def fitted_bucket(vectors: DataFrame, query: list[float], k: int, sample: int = 1000, id_col: str = "id", vec_col: str = "v") -> float:
    """Two spreads, by a random projection, of what lies between the query and the k-th nearest of ``sample`` rows, those with the least hashed ids.

    The k-th nearest of all rows is no farther, so a projection puts it into the query's bucket
    with a chance of 0.6 or more, and one of five does with 0.99.
    """
    rows = vectors.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vec_col).collect()
    near = sorted(math.dist(r[0], query) for r in rows)
    width = 2 * near[min(k, len(near)) - 1] / math.sqrt(len(query)) if near else 0.0
    return width or 1.0


def approximate_knn(
    vectors: DataFrame, query: list[float], k: int, metric: str = "l2", bucket: float | None = None, tables: int = 5, id_col: str = "id", vec_col: str = "embedding"
) -> DataFrame:
    """(id, distance) near ``query`` by random projections of all rows; may miss some, or come out below k.

    ``bucket`` is fitted on a bounded sample if it isn't given (see ``fitted_bucket``). By cosine,
    vectors are compared at length one, where half the squared distance is the cosine's. Rows of
    another dimension or with nulls, and by cosine those of length zero, don't match.
    """
    if not 1 <= k <= 1000:
        raise ValueError("k must be within 1 to 1000")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    own, at = F.col(vec_col).cast("array<double>"), [float(x) for x in query]
    fits = (F.size(vec_col) == len(query)) & ~F.exists(vec_col, lambda x: x.isNull())
    length = F.lit(1.0)
    if metric == "cosine":
        at = [x / (math.hypot(*at) or 1.0) for x in at]
        length = F.sqrt(dot(own, own))
        fits = fits & (length > 0)
    # What doesn't fit has zeros until it is left out, as filters that Catalyst infers may see it before.
    scaled = F.element_at(F.transform(F.array(length), lambda n: F.transform(own, lambda x: x / n)), 1)  # the length once a row
    even = F.when(fits, scaled).otherwise(F.array_repeat(F.lit(0.0), len(query)))
    held = vectors.where(F.coalesce(fits, F.lit(False))).select(id_col, even.alias("v"))
    width = fitted_bucket(held, at, k, id_col=id_col) if bucket is None else bucket
    held = held.select(id_col, array_to_vector("v").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=1)
    model = model.fit(vectors.sparkSession.createDataFrame([(Vectors.dense(at),)], ["v"]))  # it learns the dimension alone
    near = model.approxNearestNeighbors(held, Vectors.dense(at), k, distCol="near")
    # As the exact search tells distances: squared for l2.
    return near.select(id_col, (F.pow("near", F.lit(2)) / (2 if metric == "cosine" else 1)).alias("distance"))
