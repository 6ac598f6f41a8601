"""Writing queries as new versions: delete, set, merge and create, in this order, each a transaction of its own."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.errors import QueryError
from arcweave.plans.compiler import Compiler, validate
from arcweave.plans.language import Lit, Pattern, Query, Ref, Var, parse
from arcweave.sources.graph import Edge, Graph, snapshot
from arcweave.sources.keys import visible
from arcweave.sources.lineage import cut
from arcweave.sources.store import Store, uuid7


def next_tx(log: DataFrame) -> int:
    return (log.agg(F.max("tx").alias("tx")).first().tx or 0) + 1


def tombstones(log: DataFrame, ids: DataFrame, tx: int, key: str = "id") -> DataFrame:
    """A tombstone for each distinct id."""
    log = log.select(*visible(log.columns))
    gone = ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    rest = [f for f in log.schema.fields if f.name not in (key, "tx", "is_tombstone")]
    made = gone.select(key, F.lit(tx).cast("long").alias("tx"), F.lit(True).alias("is_tombstone"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    return made.select(*log.columns)


def copy_forward(live: DataFrame, log: DataFrame, changes: DataFrame, prop: str, tx: int, key: str = "id") -> DataFrame:
    """A new whole version of each live record in ``changes`` (id, value), with one property replaced."""
    log = log.select(*visible(log.columns))
    one = changes.groupBy(key).agg(F.max("value").alias("__value"))
    kind = log.schema[prop].dataType
    new = live.drop("tx").join(one, key).withColumn(prop, F.col("__value").cast(kind)).drop("__value")
    return new.withColumn("tx", F.lit(tx).cast("long")).withColumn("is_tombstone", F.lit(False)).select(*log.columns)


def upsert_missing(live: DataFrame, log: DataFrame, rows: DataFrame, on: list[str], tx: int, key: str = "id") -> DataFrame:
    """Versions for the rows that no live record equals in ``on``."""
    log = log.select(*visible(log.columns))
    new = rows.join(live.select(*on), on, "left_anti")
    for f in log.schema.fields:
        if f.name not in new.columns and f.name not in ("tx", "is_tombstone"):
            new = new.withColumn(f.name, F.lit(None).cast(f.dataType))
    return new.withColumn("tx", F.lit(tx).cast("long")).withColumn("is_tombstone", F.lit(False)).select(*log.columns)


def _record(graph: Graph, p: Pattern, first: dict, tx: int) -> tuple[str, dict]:
    values = {}
    for name, term in p.bindings:
        if isinstance(term, Var):
            if term.name not in first:
                raise QueryError("unbound_variable_at_exec", f"?{term.name}")
            values[name] = first[term.name]
        elif isinstance(term, (Lit, Ref)):
            values[name] = term.value if isinstance(term, Lit) else term.id
        else:
            raise QueryError("anonymous_term_in_filter", f"{p.type}.{name} needs a value")
    key = "id" if p.type in graph.entity_logs else "edge_id"
    return key, values | {key: uuid7(), "tx": tx, "is_tombstone": False}


class Writing:
    """A writing query, clause by clause, over the logs as they are after the clause before."""

    def __init__(self, spark: SparkSession, graph: Graph, query: Query):
        self.spark, self.graph, self.query = spark, graph, query
        logs = {n: (graph.entity_logs[n], "id") for n in graph.entity_logs} | {n: (graph.edge_logs[n].df, "edge_id") for n in graph.edge_logs}
        # What is written has ids as text, so the logs are read by these.
        self.logs = {n: (df.select(*visible(df.columns)), key) for n, (df, key) in logs.items()}
        self.tx = max((next_tx(df) for df, _ in self.logs.values()), default=1) - 1
        self.held = graph.at(None)
        self.first: dict = {}
        self.bound: DataFrame | None = None
        self.compiler = Compiler(spark, self.held)
        self.new: list[dict[str, list[DataFrame]]] = []  # by transaction

    def log_of(self, var: str) -> list[str]:
        names = self.compiler.types.get(var, set()) & self.logs.keys()
        if not names:
            raise QueryError("type_not_indexed", f"?{var} has no versioned type")
        return sorted(names)

    def begin(self) -> None:
        self.tx += 1
        self.new.append({})

    def add(self, name: str, rows: DataFrame) -> None:
        log, key = self.logs[name]
        self.logs[name] = (log.unionByName(rows), key)
        self.new[-1].setdefault(name, []).append(rows)

    def live(self, name: str) -> DataFrame:
        """As of the clauses before this one."""
        log, key = self.logs[name]
        return snapshot(log, None, key).drop("tx")

    def run(self) -> Writing:
        query = self.query
        if query.patterns:
            validate(query, self.held)
            found = self.compiler.bindings(query)
            self.bound = cut(found if query.limit is None else found.limit(query.limit))
            # The first row is the least one by its columns, whatever the order of tasks.
            row = self.bound.agg(F.min(F.struct(*[F.col(f"`{c}`") for c in self.bound.columns])).alias("r")).first().r
            self.first = row.asDict() if row is not None else {}
        if query.deletes:
            self.begin()
            for var in query.deletes:
                for name in self.log_of(var):
                    log, key = self.logs[name]
                    self.add(name, tombstones(log, self.bound.select(var), self.tx, key))
        if query.sets:
            self.begin()
            for path, term in query.sets:
                for name in self.log_of(path.var):
                    log, key = self.logs[name]
                    value = F.col(term.name) if isinstance(term, Var) else F.lit(term.value if isinstance(term, Lit) else term.id)
                    changes = self.bound.select(F.col(path.var).alias(key), value.alias("value"))
                    self.add(name, copy_forward(self.live(name), log, changes, path.prop, self.tx, key))
        if self.first or not query.patterns:
            for patterns, merged in ((query.merges, True), (query.creates, False)):
                if patterns:
                    self.begin()
                for p in patterns:
                    self.record(p, merged)
        return self

    def record(self, p: Pattern, merged: bool) -> None:
        if p.type not in self.logs:
            raise QueryError("unknown_type", p.type)
        log, key = self.logs[p.type]
        _, record = _record(self.graph, p, self.first, self.tx)
        df = self.spark.createDataFrame([tuple(record.get(f.name) for f in log.schema)], log.schema)
        if merged:
            live, on = self.live(p.type), [n for n, _ in p.bindings]
            same = live
            for name in on:
                same = same.where(F.col(name).eqNullSafe(F.lit(record[name])))
            there = same.agg(F.min(key).alias("k")).first().k
            if there is not None:
                record[key] = there
            df = upsert_missing(live, log, df, on, self.tx, key)
        self.add(p.type, df)
        if p.var:
            self.first[p.var] = record[key]
            self.compiler.types.setdefault(p.var, set()).add(p.type)

    def after(self) -> Graph:
        entities = dict(self.graph.entity_logs) | {n: log for n, (log, key) in self.logs.items() if key == "id"}
        edges = dict(self.graph.edge_logs) | {n: Edge(log, self.graph.edge_logs[n].roles) for n, (log, key) in self.logs.items() if key == "edge_id"}
        return replace(self.graph, entity_logs=entities, edge_logs=edges)

    def rows(self) -> DataFrame | None:
        """What the query returns, by the state after its writes: a row for each match, or one for what was made."""
        if not self.query.returns:
            return None
        made = {p.var: self.first[p.var] for p in (*self.query.merges, *self.query.creates) if p.var and p.var in self.first}
        df = self.bound if self.bound is not None else self.spark.range(1).select(F.lit(1).alias("__one"))
        df = df.select("*", *[F.lit(v).alias(k) for k, v in made.items()])
        state = Compiler(self.spark, self.after().at(None))
        state.types = self.compiler.types
        return state.project(self.query, df)


def execute(spark: SparkSession, graph: Graph, source: str) -> Graph:
    """The graph after a writing query; see ``execute_query``."""
    return execute_query(spark, graph, source)[0]


def execute_query(spark: SparkSession, graph: Graph, source: str) -> tuple[Graph, DataFrame | None]:
    """The graph after a writing query, and the rows of its ``return``, aggregates included (None without one).

    New records take variables from the first matched row, which is the least by its columns; set
    and delete apply to every matched row, of which ``limit`` takes some before anything is
    written. Each kind of clause is a transaction. Types that are written must have logs.
    """
    done = Writing(spark, graph, parse(source)).run()
    return done.after(), done.rows()


def commit(store: Store, source: str) -> tuple[list[int], DataFrame | None]:
    """A writing query on a store: its transactions' numbers once they are committed, and its rows.

    The store's types must not be written by others meanwhile, else it is a conflict.
    """
    base = store.last_tx()
    done = Writing(store.spark, store.graph(), parse(source)).run()
    rows, numbers = done.rows(), []
    rows = cut(rows) if rows is not None else None
    for parts in done.new:
        transaction = store.begin(reads=sorted(store.schemas))
        transaction.base = numbers[-1] if numbers else base
        for name, own in parts.items():
            for part in own:
                transaction._add(name, part)
        numbers.append(transaction.commit(0))
    return numbers, rows


def merge_graphs(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``a`` and those of ``b`` whose key is new; columns of either, but those whose names begin with ``$``."""
    a, b = (df.select(*[c for c in df.columns if not c.startswith("$")]) for df in (a, b))
    return a.unionByName(b.join(a.select(key), key, "left_anti"), allowMissingColumns=True)
