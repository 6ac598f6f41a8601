"""Histories, differences and retention over a version log (id, tx, is_tombstone, properties)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.sources.graph import snapshot
from arcweave.sources.keys import is_id, visible
from arcweave.sources.lineage import cut


def read_as_of(log: DataFrame, key: str, tx: int | None = None, id_col: str = "id") -> DataFrame:
    """One row: status live, deleted or missing, the transaction, and the properties if live."""
    own = log.where(is_id(log, id_col, key))
    own = own if tx is None else own.where(F.col("tx") <= tx)
    rest = [c for c in visible(log.columns) if c not in (id_col, "tx", "is_tombstone")]
    newest = own.agg(F.max_by(F.struct("tx", "is_tombstone", *rest), F.struct("tx", "is_tombstone")).alias("v"))
    status = F.when(F.col("v").isNull(), "missing").when(F.col("v.is_tombstone"), "deleted").otherwise("live")
    return newest.select(F.lit(key).alias(id_col), status.alias("status"), F.col("v.tx").alias("tx"), *[F.when(~F.col("v.is_tombstone"), F.col(f"v.`{c}`")).alias(c) for c in rest])


def versions(log: DataFrame, key: str | None = None, id_col: str = "id") -> DataFrame:
    """The version chain, one row for each transaction of an id (a tombstone wins a tie)."""
    own = log if key is None else log.where(is_id(log, id_col, key))
    rest = [c for c in visible(log.columns) if c not in (id_col, "tx", "is_tombstone")]
    one = own.groupBy(id_col, "tx").agg(F.max_by(F.struct("is_tombstone", *rest), "is_tombstone").alias("v"))
    return one.select(id_col, "tx", "v.*")


def history(log: DataFrame, prop: str, id_col: str = "id") -> DataFrame:
    """(id, tx, value, deleted): where a property's value changed, and where the record was deleted."""
    w = Window.partitionBy(id_col).orderBy("tx")
    value = F.when(~F.col("is_tombstone"), F.col(prop))
    own = versions(log, id_col=id_col).select(id_col, "tx", value.alias("value"), F.col("is_tombstone").alias("deleted"))
    before = own.withColumn("n", F.row_number().over(w)).withColumn("was", F.lag("value").over(w)).withColumn("gone", F.lag("deleted").over(w))
    changed = (F.col("n") == 1) | ~F.col("value").eqNullSafe(F.col("was")) | (F.col("deleted") != F.col("gone"))
    return before.where(changed).select(id_col, "tx", "value", "deleted")


def diff(log: DataFrame, before: int, after: int, props: list[str], id_col: str = "id") -> DataFrame:
    """(id, change, field, old, new) between two transactions; field is null for added and removed."""
    a = snapshot(log, before, id_col).select(F.col(id_col), F.struct(*props).alias("a"))
    b = snapshot(log, after, id_col).select(F.col(id_col), F.struct(*props).alias("b"))
    both = a.join(b, id_col, "full_outer")
    fields = F.array(*[F.struct(F.lit(p).alias("field"), F.col(f"a.{p}").cast("string").alias("old"), F.col(f"b.{p}").cast("string").alias("new")) for p in props])
    changed = F.filter(fields, lambda f: ~f["old"].eqNullSafe(f["new"]))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select(id_col, kind.alias("change"), F.explode(F.when(kind == "changed", changed).otherwise(whole)).alias("f")).select(id_col, "change", "f.field", "f.old", "f.new")


def retain(log: DataFrame, keep: int | None, floor: int | None = None, id_col: str = "id") -> DataFrame:
    """The log with each id's newest ``keep`` versions (None: all), and any from transaction ``floor`` on."""
    if keep is None:
        return log.select(*visible(log.columns))
    w = Window.partitionBy(id_col).orderBy(F.col("tx").desc(), F.col("is_tombstone").desc())
    kept = F.col("__r") <= keep
    if floor is not None:
        kept = kept | (F.col("tx") >= floor)
    return log.select(*visible(log.columns)).withColumn("__r", F.row_number().over(w)).where(kept).drop("__r")


def tx_time(commits: DataFrame, tx: int) -> DataFrame:
    return commits.where(F.col("tx") == tx).select("tx", "ts")


def growth(df: DataFrame, at: str) -> DataFrame:
    """(at, n, total): new rows of each value of ``at`` and all up to it.

    Counts are sorted in ranges, each summed by itself; what lies before a range, a number each,
    is added. So no task holds all values, however fine ``at`` is. Nulls come first.
    """
    counts = df.groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counts.repartitionByRange(F.col(at).asc_nulls_first()).withColumn("__p", F.spark_partition_id()))
    sums = ranged.groupBy("__p").agg(F.sum("n").alias("__s"))
    before = sums.withColumn("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    here = Window.partitionBy("__p").orderBy(F.col(at).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("total", F.sum("n").over(here)).join(F.broadcast(before), "__p").select(at, "n", (F.col("total") + F.col("__b")).alias("total"))
