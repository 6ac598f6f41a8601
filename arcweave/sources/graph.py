"""The hypergraph as typed tables: entities by type, N-ary edges by type, and versions of either.

An entity table has ``id`` and one typed column a property. An edge table has one column a role
(the filler's id; an array where a role repeats) and one a property; ``edge_id`` is optional. A
version log has ``id`` (or ``edge_id``), ``tx``, ``is_tombstone`` and the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.errors import QueryError
from arcweave.sources.keys import is_id, kind_of, visible


def snapshot(log: DataFrame, tx: int | None = None, key: str = "id") -> DataFrame:
    """What is live at ``tx`` (None: latest): of each key the newest version, a tombstone winning ties.

    One partial and one final aggregate by key; re-assertion after a tombstone revives.
    """
    seen = log if tx is None else log.where(F.col("tx") <= tx)
    rest = [c for c in visible(log.columns) if c not in (key, "tx", "is_tombstone")]
    newest = seen.groupBy(key).agg(F.max_by(F.struct("tx", "is_tombstone", *rest), F.struct("tx", "is_tombstone")).alias("v"))
    return newest.where(~F.col("v.is_tombstone")).select(key, F.col("v.tx").alias("tx"), *[F.col(f"v.`{c}`").alias(c) for c in rest])


@dataclass
class Edge:
    df: DataFrame
    roles: list[str]

    @property
    def props(self) -> list[str]:
        return [c for c in visible(self.df.columns) if c not in (*self.roles, "edge_id", "tx")]

    def of(self, entity: str) -> Edge:
        """The edges that ``entity`` fills some role of; a role that isn't repeated is asked by its native key."""
        hit = F.lit(False)
        for role in self.roles:
            repeated = isinstance(self.df.schema[role].dataType, T.ArrayType)
            hit = hit | (F.array_contains(role, entity) if repeated else is_id(self.df, role, entity))
        return Edge(self.df.where(hit), self.roles)

    def degrees(self) -> DataFrame:
        """(filler, degree): edges by filler. Where one role holds the kind, edges are counted by native key and shown at the end."""
        parts = []
        kinds = [kind_of(self.df, r) for r in self.roles]
        if "edge_id" not in self.df.columns or None in kinds or len(set(kinds)) < len(kinds):
            return self.incidence().groupBy("filler").agg(F.count_distinct("edge_id").alias("degree"))
        for role, kind in zip(self.roles, kinds):
            counted = self.df.groupBy(F.col(f"{role}__key").alias("k")).agg(F.count_distinct("edge_id__key" if kind_of(self.df, "edge_id") else "edge_id").alias("degree"))
            parts.append(counted.where("k IS NOT NULL").select(F.concat(F.lit(f"{kind}:"), F.col("k").cast("string")).alias("filler"), "degree"))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def incidence(self) -> DataFrame:
        """(edge_id, role, ord, filler), one row for each filler."""

        def fillers(role: str) -> Column:
            repeated = isinstance(self.df.schema[role].dataType, T.ArrayType)
            return F.transform(F.col(role) if repeated else F.array(role), lambda x, k: F.struct(F.lit(role).alias("role"), k.alias("ord"), x.alias("filler")))

        return self.df.select("edge_id", F.explode(F.concat(*map(fillers, self.roles))).alias("i")).select("edge_id", "i.role", "i.ord", "i.filler").where("filler IS NOT NULL")


class Lazy(dict):
    """Tables by name; one that is given as a function is opened when it is asked for."""

    def __getitem__(self, name):
        value = super().__getitem__(name)
        if isinstance(value, (DataFrame, Edge)):
            return value
        self[name] = value = value()
        return value

    def items(self):
        return [(name, self[name]) for name in self]

    def __or__(self, other) -> Lazy:
        return Lazy({**{n: dict.__getitem__(self, n) for n in self}, **{n: dict.__getitem__(other, n) for n in other}})


@dataclass
class Graph:
    entities: dict[str, DataFrame | Callable] = field(default_factory=dict)
    edges: dict[str, Edge | Callable] = field(default_factory=dict)
    entity_logs: dict[str, DataFrame | Callable] = field(default_factory=dict)
    edge_logs: dict[str, Edge | Callable] = field(default_factory=dict)
    commits: DataFrame | Callable | None = None  # (tx, ts)
    sizes: dict[str, int] = field(default_factory=dict)  # known row counts, for the planner

    def __post_init__(self):
        self.entities, self.edges, self.entity_logs, self.edge_logs = (Lazy(x) for x in (self.entities, self.edges, self.entity_logs, self.edge_logs))

    def size(self, name: str) -> float:
        """For the planner: the rows that are known, else the bytes that the plan's statistics say (of files: their sizes)."""
        if name in self.sizes:
            return self.sizes[name]
        df = self.entities[name] if name in self.entities else self.edges[name].df
        return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def tx_at(self, when) -> int:
        """The highest transaction committed at ``when`` or before (a timestamp Column)."""
        if self.commits is None:
            raise QueryError("timestamp_unavailable", "the graph has no commits")
        commits = self.commits if isinstance(self.commits, DataFrame) else self.commits()
        tx = commits.where(F.col("ts") <= when).agg(F.max("tx").alias("tx")).first().tx
        if tx is None:
            raise QueryError("timestamp_unavailable", "nothing was committed by then")
        return tx

    def at(self, as_of: int | str | None) -> Graph:
        """Static tables and the logs' state as of a transaction, or a time (RFC 3339 or microseconds)."""
        if as_of is None and not (self.entity_logs or self.edge_logs):
            return self
        tx = as_of
        if isinstance(as_of, str):
            text = as_of.strip()
            when: Column = F.timestamp_micros(F.lit(int(text))) if text.lstrip("-").isdigit() else F.try_to_timestamp(F.lit(text))
            tx = self.tx_at(when)
        entities = self.entities | Lazy({n: lambda n=n: snapshot(self.entity_logs[n], tx).drop("tx") for n in self.entity_logs})
        edges = self.edges | Lazy({n: lambda n=n: Edge(snapshot(self.edge_logs[n].df, tx, "edge_id").drop("tx"), self.edge_logs[n].roles) for n in self.edge_logs})
        return Graph(entities, edges, commits=self.commits, sizes=self.sizes)
