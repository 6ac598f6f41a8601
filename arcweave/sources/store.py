"""A store of versions in a folder: transactions, conflicts, change cursors, backups.

Each commit writes its rows to folders of their own, then creates a marker named by its number,
which can be created once: whoever comes second has a conflict. Rows without a marker are seen by
nobody, so a lost writer leaves only files. Markers say when, and which folders of which types
hold the commit's rows.
"""

from __future__ import annotations

import json
import secrets
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.errors import QueryError
from arcweave.sources.graph import Edge, Graph

MARKER = "tx long, ts_us long, folders array<struct<type: string, path: string>>"


def uuid7(now_ms: int | None = None) -> str:
    """A UUID of version 7: 48 bits of milliseconds, then chance; later ones sort after earlier ones."""
    ms = time.time_ns() // 1_000_000 if now_ms is None else now_ms
    rand = secrets.randbits(74)
    value = (ms & (2**48 - 1)) << 80 | 0x7 << 76 | (rand >> 62) << 64 | 0b10 << 62 | rand & (2**62 - 1)
    return str(uuid.UUID(int=value))


@dataclass
class Store:
    spark: SparkSession
    path: str
    schemas: dict[str, T.StructType] = field(default_factory=dict)  # of each type's log
    roles: dict[str, list[str]] = field(default_factory=dict)  # of the types that are edges

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> DataFrame:
        """(tx, ts_us, folders) of every commit."""
        place, fs = self._fs(f"{self.path}/commits")
        if not fs.exists(place):
            return self.spark.createDataFrame([], MARKER)
        return self.spark.read.schema(MARKER).json(f"{self.path}/commits")

    def last_tx(self) -> int:
        place, fs = self._fs(f"{self.path}/commits")
        return max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(place) if s.getPath().getName().endswith(".json")), default=0) if fs.exists(place) else 0

    def begin(self, reads: list[str] | None = None) -> Transaction:
        """A transaction on the latest snapshot; with ``reads`` it fails if one of these types has been written by its end."""
        return Transaction(self, self.last_tx(), reads)

    def folders(self, name: str, since: int = 0, upto: int | None = None) -> list[str]:
        own = self.commits().where(F.col("tx") > since)
        own = own if upto is None else own.where(F.col("tx") <= upto)
        return [r.path for r in own.select("tx", F.explode("folders").alias("f")).where(F.col("f.type") == name).orderBy("tx").select("f.path").collect()]

    def log(self, name: str, since: int = 0, upto: int | None = None) -> DataFrame:
        """The versions of a type that were committed after ``since`` and up to ``upto``."""
        places = self.folders(name, since, upto)
        if not places:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.path}/{p}" for p in places])

    def graph(self) -> Graph:
        entities = {n: lambda n=n: self.log(n) for n in self.schemas if n not in self.roles}
        edges = {n: lambda n=n: Edge(self.log(n), self.roles[n]) for n in self.roles}
        return Graph(entity_logs=entities, edge_logs=edges, commits=lambda: self.commits().select("tx", F.timestamp_micros("ts_us").alias("ts")))

    def tail(self, cursor: int, most: int = 1000) -> tuple[dict[str, DataFrame], int]:
        """The versions of the ``most`` commits after ``cursor`` by type, and the cursor to go on from.

        A cursor older than what is kept (see ``compact``) is an error: the follower starts anew.
        """
        first = self.commits().agg(F.min("tx")).first()[0]
        if first is not None and cursor + 1 < first:
            raise QueryError("cursor_pruned", f"commits before {first} are gone")
        upto = min(cursor + most, self.last_tx())
        return {n: self.log(n, cursor, upto) for n in self.schemas}, max(cursor, upto)

    def compact(self, keep: int | None = 1, floor: int | None = None) -> None:
        """Rewrite the logs as one commit's folders, with each record's newest ``keep`` versions and those from ``floor`` on."""
        from arcweave.operators.timetravel import retain

        last, made, old = self.last_tx(), [], self.commits().select("tx").collect()
        for name in self.schemas:
            own = f"data/{name}/{uuid7()}"
            retain(self.log(name), keep, floor, "edge_id" if name in self.roles else "id").write.parquet(f"{self.path}/{own}")
            made.append({"type": name, "path": own})
        self._mark(last, made, replace=True)
        for r in old:
            if r.tx != last:
                place, fs = self._fs(f"{self.path}/commits/{r.tx:020d}.json")
                fs.delete(place, False)

    def backup(self, target: str) -> int:
        """Copy the markers as of now and the folders that they name; gives the last transaction."""
        last = self.last_tx()
        for r in self.commits().where(F.col("tx") <= last).collect():
            for f in r.folders:
                self._copy(f"{self.path}/{f.path}", f"{target}/{f.path}")
            self._copy(f"{self.path}/commits/{r.tx:020d}.json", f"{target}/commits/{r.tx:020d}.json")
        return last

    def _copy(self, source: str, target: str) -> None:
        (a, fa), (b, fb) = self._fs(source), self._fs(target)
        fb.mkdirs(b.getParent())
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, self.spark._jsc.hadoopConfiguration())

    def _mark(self, tx: int, folders: list[dict], replace: bool = False) -> bool:
        place, fs = self._fs(f"{self.path}/commits/{tx:020d}.json")
        try:
            out = fs.create(place, replace)
        except Exception as error:  # the JVM's: the marker is there
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        out.write(bytearray(json.dumps({"tx": tx, "ts_us": time.time_ns() // 1000, "folders": folders}).encode()))
        out.close()
        return True


class Transaction:
    def __init__(self, store: Store, base: int, reads: list[str] | None):
        self.store, self.base, self.reads, self.held, self.open = store, base, reads, {}, True

    def put(self, name: str, rows: DataFrame) -> Transaction:
        """Versions of whole records (tx and is_tombstone are set at the commit)."""
        return self._add(name, rows.withColumn("is_tombstone", F.lit(False)))

    def delete(self, name: str, ids: DataFrame) -> Transaction:
        key = "edge_id" if name in self.store.roles else "id"
        return self._add(name, ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("is_tombstone", F.lit(True)))

    def _add(self, name: str, rows: DataFrame) -> Transaction:
        if not self.open:
            raise QueryError("transaction_closed", "begin another")
        if name not in self.store.schemas:
            raise QueryError("unknown_type", name)
        self.held.setdefault(name, []).append(rows)
        return self

    def rollback(self) -> None:
        self.open, self.held = False, {}

    def commit(self, retries: int = 5) -> int:
        """The transaction's number. Rows are written once; a number that was taken meanwhile is followed by the next.

        With reads, a commit after the base that wrote one of those types is a conflict instead.
        """
        if not self.open:
            raise QueryError("transaction_closed", "begin another")
        self.open, folders, store = False, [], self.store
        for attempt in range(retries + 1):
            tx = store.last_tx() + 1
            written = {f.type for r in store.commits().where(F.col("tx") > self.base).collect() for f in r.folders} if self.reads and tx > self.base + 1 else set()
            if written & set(self.reads or []):
                raise QueryError("conflict", f"{', '.join(sorted(written & set(self.reads)))} written since {self.base}")
            folders = []
            for name, parts in self.held.items():
                own, schema = f"data/{name}/{uuid7()}", store.schemas[name]
                for rows in parts:
                    have = set(rows.columns)
                    columns = [F.lit(tx).cast("long").alias("tx") if f.name == "tx" else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
                    rows.select(*columns).write.mode("append").parquet(f"{store.path}/{own}")
                folders.append({"type": name, "path": own})
            if store._mark(tx, folders):
                return tx
        raise QueryError("conflict", f"{retries + 1} numbers were taken meanwhile")


def restore(spark: SparkSession, source: str, target: str, schemas: dict, roles: dict | None = None) -> Store:
    """A store in ``target`` from a backup."""
    held = Store(spark, source, schemas, roles or {})
    held.backup(target)
    return Store(spark, target, schemas, roles or {})
