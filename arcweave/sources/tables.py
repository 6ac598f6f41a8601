"""The star-schema tables as a hypergraph. Tables are opened when a query asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.sources.graph import Edge, Graph
from arcweave.sources.keys import keyed, shown

PREFIXES = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "order": "o_"}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "order": "o_orderkey"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(kind: str, key: str) -> Column:
    return shown(kind, F.col(key))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: read(spark, sf_dir, name)
    key = lambda name, kind, column: keyed(name, kind, F.col(column))

    def entity(name: str) -> DataFrame:
        df = t("orders" if name == "order" else name)
        return df.select(*key("id", name, KEYS[name]), *[F.col(c).alias(c.removeprefix(PREFIXES[name])) for c in df.columns])

    def placed() -> Edge:
        named = {"o_totalprice": "totalprice", "o_orderstatus": "status", "o_orderpriority": "priority"}
        df = t("orders").select(
            *key("edge_id", "placed", "o_orderkey"), *key("buyer", "customer", "o_custkey"), *key("order", "order", "o_orderkey"),
            F.col("o_orderdate").cast("timestamp").alias("orderdate"), *[F.col(c).alias(n) for c, n in named.items()],
        )
        return Edge(df, ["buyer", "order"])

    def line() -> Edge:
        named = {"l_quantity": "quantity", "l_extendedprice": "price", "l_returnflag": "returnflag"}
        df = t("lineitem").select(
            *key("order", "order", "l_orderkey"), *key("part", "part", "l_partkey"), *key("supplier", "supplier", "l_suppkey"), *[F.col(c).alias(n) for c, n in named.items()]
        )
        return Edge(df, ["order", "part", "supplier"])

    def in_nation() -> Edge:
        """Members are of two kinds, so their ids are strings."""
        parts = [t(k).select(ident(k, KEYS[k]).alias("member"), *key("nation", "nation", PREFIXES[k] + "nationkey")) for k in ("customer", "supplier")]
        return Edge(parts[0].unionByName(parts[1]), ["member", "nation"])

    def in_region() -> Edge:
        return Edge(t("nation").select(*key("nation", "nation", "n_nationkey"), *key("region", "region", "n_regionkey")), ["nation", "region"])

    def contains() -> Edge:
        df = t("part").where("p_partkey >= 1")
        return Edge(df.select(*keyed("parent", "part", F.floor(F.col("p_partkey") / 3)), *key("child", "part", "p_partkey")), ["parent", "child"])

    def ring() -> Edge:
        df = t("part").where("p_partkey < 500")
        return Edge(df.select(*key("parent", "part", "p_partkey"), *keyed("child", "part", (F.col("p_partkey") * 7 + 3) % 500)), ["parent", "child"])

    return Graph(
        entities={n: lambda n=n: entity(n) for n in KEYS},
        edges={"placed": placed, "line": line, "in_nation": in_nation, "in_region": in_region, "contains": contains, "ring": ring},
        entity_logs={"usr": lambda: user_log(spark, sf_dir)},
        commits=lambda: t("events").select((F.col("event_id") + 1).alias("tx"), F.col("ts").cast("timestamp").alias("ts")),
    )


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a version of its user; an error deletes."""
    return read(spark, sf_dir, "events").select(
        *keyed("id", "user", F.col("user_id")), (F.col("event_id") + 1).alias("tx"), (F.col("event_type") == "error").alias("is_tombstone"), F.col("value"), F.col("event_type").alias("kind")
    )


def cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): k -> (k * 7 + 3) mod N over all N parts."""
    parts = read(spark, sf_dir, "part").select("p_partkey")
    n = parts.agg(F.count(F.lit(1)).alias("n"))
    return parts.crossJoin(F.broadcast(n)).select(ident("part", "p_partkey").alias("src"), shown("part", (F.col("p_partkey") * 7 + 3) % F.col("n")).alias("dst"))
