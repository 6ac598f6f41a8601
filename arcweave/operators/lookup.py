"""Reads that an index would answer: by property, by range, the highest, by external key, by adjacency, by page."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.sources.graph import Graph
from arcweave.sources.keys import is_id, visible


def property_lookup(df: DataFrame, prop: str, value: Any) -> DataFrame:
    """Rows whose property is the value; a null value matches nothing."""
    return df.where(F.col(prop) == F.lit(value)) if value is not None else df.limit(0)


def property_range(df: DataFrame, prop: str, low: Any = None, high: Any = None) -> DataFrame:
    """Rows whose property is within both bounds, ends included; None leaves an end open, null properties never match."""
    df = df.where(F.col(prop).isNotNull())
    if low is not None:
        df = df.where(F.col(prop) >= F.lit(low))
    return df if high is None else df.where(F.col(prop) <= F.lit(high))


def property_top_k(df: DataFrame, prop: str, k: int, key: str = "id") -> DataFrame:
    """The ``k`` rows with the highest property, ties by key; nulls are none."""
    return df.where(F.col(prop).isNotNull()).orderBy(F.col(prop).desc(), key).limit(k)


def external_key(df: DataFrame, prop: str, value: Any, key: str = "id") -> DataFrame:
    """(key): the smallest key of the rows with the value; null if there is none."""
    return property_lookup(df, prop, value).agg(F.min(key).alias(key))


def type_count(df: DataFrame) -> DataFrame:
    """(n): rows of a type; no column is read."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def overview(graph: Graph, entity: str) -> DataFrame:
    """(edge, role, n): in how many edges of each type the entity fills each role; roles that it never fills have no row."""
    out = None
    for name, edge in graph.edges.items():
        for role in edge.roles:
            repeated = edge.df.schema[role].dataType.typeName() == "array"
            hit = F.array_contains(role, entity) if repeated else is_id(edge.df, role, entity)
            own = edge.df.where(hit).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("edge"), F.lit(role).alias("role"), "n")
            out = own if out is None else out.unionByName(own)
    return out.where("n > 0")


def page(df: DataFrame, key: str, limit: int, after: Any = None) -> DataFrame:
    """The next ``limit`` rows in the order of ``key`` (unique), after the cursor ``after`` (None: the first page).

    The cursor is the last key of the page before, so a page costs no more than the first one.
    Pages of one snapshot (``Graph.at`` a transaction) don't shift under later writes.
    """
    df = df.select(*visible(df.columns))
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def pages(df: DataFrame, key: str, limit: int):
    """Every page as a list of rows, each fetched when it is asked for."""
    after = None
    while rows := page(df, key, limit, after).collect():
        yield rows
        after = rows[-1][key]
        if len(rows) < limit:
            return
