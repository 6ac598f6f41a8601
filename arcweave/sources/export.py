"""Sinks: JSON lines, Arrow, dense vectors, text tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.sources.graph import Graph
from arcweave.sources.keys import visible


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def arrow_batches(df: DataFrame, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """The table's batches, of at most ``rows`` rows, on the driver; for results that fit there."""
    yield from df.toArrow().to_batches(max_chunksize=rows)


def vector_matrix(df: DataFrame, dim: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, embedding), all of one dimension, or an error when it runs."""
    ok = F.assert_true(F.size(vec_col) == dim, F.lit(f"an embedding isn't of dimension {dim}"))
    return df.where(F.col(vec_col).isNotNull()).withColumn("__ok", ok).where(F.col("__ok").isNull()).select(id_col, vec_col)


def dictionaries(graph: Graph) -> dict[str, DataFrame]:
    """types (id, name, kind), roles and properties (id, name): a graph's names, numbered from 1 in their order.

    Names are schema, not data: no table is read for them.
    """
    kinds = {n: "entity" for n in graph.entities} | {n: "edge" for n in graph.edges}
    held, edges = [df for _, df in graph.entities.items()], [e for _, e in graph.edges.items()]
    roles = {r for e in edges for r in e.roles}
    props = {c for df in held for c in visible(df.columns) if c != "id"} | {p for e in edges for p in e.props}
    spark = (held or [e.df for e in edges])[0].sparkSession
    numbered = lambda names: [(k, n) for k, n in enumerate(sorted(names), 1)]
    return {
        "types": spark.createDataFrame([(k, n, kinds[n]) for k, n in numbered(kinds)], "id int, name string, kind string"),
        "roles": spark.createDataFrame(numbered(roles), "id int, name string"),
        "properties": spark.createDataFrame(numbered(props), "id int, name string"),
    }


def stream_lines(df: DataFrame, most: int | None = None) -> Iterator[str]:
    """A header {"columns", "truncated"}, then each row as a JSON array, one partition at a time on the driver.

    With ``most`` at most as many rows come, and truncated tells whether there are more.
    """
    cut = most is not None and len(df.limit(most + 1).select(F.lit(1)).collect()) > most
    yield json.dumps({"columns": df.columns, "truncated": cut})
    rows = df if most is None else df.limit(most)
    # Values of several types in one array, each as JSON by itself.
    one = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(?s:(.*))\}$', "$1")
    for row in rows.select(F.concat(F.lit("["), F.concat_ws(",", *map(one, df.columns)), F.lit("]"))).toLocalIterator():
        yield row[0]


def as_text(df: DataFrame, kind: str = "tsv", most: int = 1000) -> str:
    """At most ``most`` rows as tsv, csv, markdown or html."""
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(most).collect()]
    head = df.columns
    if kind in ("tsv", "csv"):
        sep = "\t" if kind == "tsv" else ","
        quote = lambda v: '"' + v.replace('"', '""') + '"' if kind == "csv" and any(c in v for c in ',"\n') else v
        return "\n".join(sep.join(map(quote, r)) for r in [head, *rows]) + "\n"
    if kind == "markdown":
        cell = lambda v: v.replace("|", "\\|").replace("\n", " ")
        return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in [head, ["---"] * len(head), *rows]) + "\n"
    if kind == "html":
        esc = lambda v: v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        row = lambda r, t: "<tr>" + "".join(f"<{t}>{esc(v)}</{t}>" for v in r) + "</tr>"
        return "<table>" + row(head, "th") + "".join(row(r, "td") for r in rows) + "</table>"
    raise ValueError(kind)
