"""Recursive patterns: breadth-first reachability over an edge table, for many starts at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.errors import QueryError
from arcweave.plans.language import MAX_DEPTH
from arcweave.sources.lineage import cut


#: Edges that a task may hold whole; larger graphs are walked by joins.
HELD = 200_000


def closure(edges: DataFrame, starts: DataFrame, least: int = 0, most: int | None = None, held: int = HELD) -> DataFrame:
    """Distinct (start, end) with ``end`` in ``least`` to ``most`` steps of ``edges`` (src, dst) from ``start``.

    Step d gives all targets of edges that leave nodes first reached at d - 1, seen before or
    not. most=None goes on until nothing new is reached, and is an error beyond MAX_DEPTH steps.

    Of at most ``held`` edges every task gets all, and walks its starts by itself: one job,
    whatever the depth. Otherwise each step is a join on the frontier and an anti-join with what
    was visited, cut once; a search from 0 or 1 steps keeps nothing but what is new in each.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    starts = starts.select(F.col(starts.columns[0]).alias("start")).where("start IS NOT NULL").distinct()
    few = edges.limit(held + 1).toArrow() if held else None
    if few is not None and few.num_rows <= held:
        return _walked(few, starts, least, most)
    return _joined(edges, starts, least, most)


def _walked(edges: pa.Table, starts: DataFrame, least: int, most: int | None) -> DataFrame:
    after: dict = {}
    for s, d in zip(edges.column("src").to_pylist(), edges.column("dst").to_pylist()):
        after.setdefault(s, []).append(d)
    shared = starts.sparkSession.sparkContext.broadcast(after)
    cap = MAX_DEPTH if most is None else most
    kind = starts.schema["start"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = shared.value
        for batch in batches:
            for start in batch.column(0).to_pylist():
                seen, frontier, out = {start}, [start], {start} if least == 0 else set()
                for depth in range(1, cap + 1):
                    reached = {d for s in frontier for d in after.get(s, ())}
                    if depth >= least:
                        out |= reached
                    frontier = reached - seen
                    if not frontier:
                        break
                    seen |= frontier
                n, over = len(out), bool(frontier) and most is None
                made = list(out)
                yield pa.RecordBatch.from_arrays([pa.array([start] * n, batch.schema.field(0).type), pa.array(made, batch.schema.field(0).type), pa.array([over] * n, pa.bool_())], names=["start", "end", "over"])
                if over and not n:
                    yield pa.RecordBatch.from_arrays([pa.array([start], batch.schema.field(0).type), pa.array([None], batch.schema.field(0).type), pa.array([True], pa.bool_())], names=["start", "end", "over"])

    schema = T.StructType([T.StructField("start", kind), T.StructField("end", kind), T.StructField("over", T.BooleanType())])
    found = starts.mapInArrow(run, schema)
    if most is None:
        found = cut(found)
        if not found.where("over").isEmpty():
            raise QueryError("recursion_depth_exceeded", f"nodes remain after {cap} steps")
    return found.select("start", "end")


def _joined(edges: DataFrame, starts: DataFrame, least: int, most: int | None) -> DataFrame:
    cap = MAX_DEPTH if most is None else most
    frontier = cut(starts.withColumn("node", F.col("start")))
    # From one step on a start is only reached if an edge leads back to it.
    visited = frontier if least != 1 else None
    out = [frontier.select("start", F.col("node").alias("end"))] if least == 0 else []
    for depth in range(1, cap + 1):
        reached = frontier.join(edges, frontier.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        if least > 1:
            reached = cut(reached)
            if depth >= least:
                out.append(reached.select("start", F.col("node").alias("end")))
        new = reached if visited is None else reached.join(visited, ["start", "node"], "left_anti")
        new = cut(new)
        if least <= 1:
            out.append(new.select("start", F.col("node").alias("end")))
        frontier = new.where("node <> start")
        if frontier.isEmpty():
            break
        visited = new if visited is None else visited.unionByName(new)
    else:
        if most is None:
            raise QueryError("recursion_depth_exceeded", f"nodes remain after {cap} steps")
    if not out:
        return frontier.select("start", F.col("node").alias("end")).limit(0)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    # What is new in each step is distinct already.
    return whole if least <= 1 else whole.distinct()


def closure_of_successors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct (start, end) with ``end`` in any number of steps, where each src has one dst at most.

    Path doubling: round k adds what lies 2**k steps on, so rounds grow with the logarithm of the
    longest path, and no depth is too large. Both tables stay as long as edges and result.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    jump = cut(edges)
    if not jump.groupBy("src").count().where("count > 1").isEmpty():
        raise ValueError("a node has more than one successor")
    reached = cut(starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumn("end", F.col("start")))
    size = reached.count()
    while True:
        far = reached.join(jump, reached.end == jump.src).select("start", F.col("dst").alias("end"))
        reached = cut(reached.unionByName(far).distinct())
        now = reached.count()
        if now == size:
            return reached
        size = now
        on = jump.select(F.col("src").alias("dst"), F.col("dst").alias("on"))
        jump = cut(jump.join(on, "dst").select("src", F.col("on").alias("dst")))
