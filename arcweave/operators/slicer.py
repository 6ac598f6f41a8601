"""A composable pipeline: select, filter, group, aggregate, having, sort, limit."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.errors import QueryError
from arcweave.sources.keys import visible
from arcweave.sources.lineage import cut


def percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row a group: each name of ``wanted`` (column, p) exact, linear between neighbours (R-7).

    Values of a group are counted, sorted in ranges over (group, value) and counted up within each
    range; a range's own groups, one row each, carry the counts of the ranges before. So a group
    of any size is spread over tasks. Null values don't count; a group without any, and p outside
    (0, 1], give null.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).drop("__n") if keys else df.sparkSession.range(1).select()
    held = groups.select(*[F.col(k) for k in keys], F.struct(F.lit(1), *[F.col(k) for k in keys]).alias("__g"))
    for column in sorted({c for c, _ in wanted.values()}):
        own = df.select(F.struct(F.lit(1), *[F.col(k) for k in keys]).alias("__g"), F.col(column).cast("double").alias("__v")).where("__v IS NOT NULL")
        counts = own.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__c"))
        ranged = cut(counts.repartitionByRange("__g", "__v").withColumn("__p", F.spark_partition_id()))
        sums = ranged.groupBy("__g", "__p").agg(F.sum("__c").alias("__s"))
        over = Window.partitionBy("__g")
        sums = sums.select("__g", "__p", (F.sum("__s").over(over.orderBy("__p")) - F.col("__s")).alias("__b"), F.sum("__s").over(over).alias("__n"))
        here = Window.partitionBy("__g", "__p").orderBy("__v")
        upto = ranged.withColumn("__u", F.sum("__c").over(here)).join(sums, ["__g", "__p"])
        last = F.col("__b") + F.col("__u")  # values up to and with this one; the places are last - c to last - 1
        told = []
        for name, (c, p) in wanted.items():
            if c == column and 0 < p <= 1:
                at = (F.col("__n") - 1) * F.lit(float(p))
                for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
                    told.append(F.max(F.when((place < last) & (place >= last - F.col("__c")), F.col("__v"))).alias(f"__{name}_{end}"))
                told.append(F.max(at - F.floor(at)).alias(f"__{name}_part"))
        if told:
            held = held.join(upto.groupBy("__g").agg(*told), "__g", "left")
    made = [
        (F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_part") if 0 < p <= 1 else F.lit(None).cast("double")).alias(n)
        for n, (_, p) in wanted.items()
    ]
    return held.select(*[F.col(k) for k in keys], *made)


def saturating_sum(df: DataFrame, col: str) -> Column:
    """The sum of a column; of whole numbers it stops at the ends of a long instead of failing."""
    kind = df.schema[col].dataType if isinstance(col, str) and col in df.columns else None
    if not isinstance(kind, T.IntegralType):
        return F.sum(col)
    whole = F.sum(F.col(col).cast("decimal(38,0)"))
    low, high = (F.lit(x).cast("decimal(38,0)") for x in ("-9223372036854775808", "9223372036854775807"))
    return F.when(whole.isNotNull(), F.greatest(low, F.least(high, whole)).cast("long"))


@dataclass(frozen=True)
class Pipeline:
    columns: tuple = ()
    where: tuple = ()
    keys: tuple = ()
    aggs: tuple = ()
    after: tuple = ()
    order: tuple = ()
    most: int | None = None

    def select(self, *columns: str | Column) -> Pipeline:
        return replace(self, columns=self.columns + columns)

    def filter(self, condition: Column) -> Pipeline:
        return replace(self, where=self.where + (condition,))

    def group_by(self, *keys: str | Column) -> Pipeline:
        return replace(self, keys=self.keys + keys)

    def aggregate(self, **aggs: tuple) -> Pipeline:
        """name=("count"|"sum"|"avg"|"min"|"max", column) or ("percentile", column, p)."""
        return replace(self, aggs=self.aggs + tuple(aggs.items()))

    def having(self, condition: Column) -> Pipeline:
        return replace(self, after=self.after + (condition,))

    def sort(self, column: str, ascending: bool = True) -> Pipeline:
        return replace(self, order=self.order + ((column, ascending),))

    def limit(self, n: int) -> Pipeline:
        return replace(self, most=n)

    def aggregated(self, df: DataFrame) -> DataFrame:
        made, wanted = [], {}
        for name, (func, col, *rest) in self.aggs:
            makers = {"count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "sum": lambda c: saturating_sum(df, c)}
            if func == "percentile":
                wanted[name] = (col, rest[0])
            elif func in makers:
                made.append(makers[func](col).alias(name))
            else:
                raise QueryError("unknown_aggregate", func)
        # Keys that are expressions become columns, so that both ways have the same groups.
        keys = [k if isinstance(k, str) else f"__k{i}" for i, k in enumerate(self.keys)]
        shown = [k if isinstance(k, str) else df.select(k).columns[0] for k in self.keys]
        df = df.withColumns({n: k for n, k in zip(keys, self.keys) if not isinstance(k, str)})
        whole = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *made).where("__n > 0").drop("__n")
        if wanted:
            found = percentiles(df, keys, wanted).withColumnsRenamed({k: f"__r_{k}" for k in keys})
            both = F.lit(True)
            for k in keys:
                both = both & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
            whole = whole.join(found, both) if keys else whole.crossJoin(F.broadcast(found))  # a row each
        names = [n for n, _ in self.aggs]
        return whole.select(*[F.col(f"`{k}`").alias(s) for k, s in zip(keys, shown)], *[F.col(f"`{n}`") for n in names])

    def run(self, df: DataFrame) -> DataFrame:
        """Nulls are a group, are skipped by aggregates, and come first in ascending order."""
        for condition in self.where:
            df = df.where(condition)
        if self.aggs:
            df = self.aggregated(df)
        elif self.after:
            raise QueryError("having_without_aggregate", "having needs an aggregate")
        elif self.columns:
            df = df.select(*self.columns)
        for condition in self.after:
            df = df.where(condition)
        if self.order:
            df = df.orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in self.order])
        return df if self.most is None else df.limit(self.most)


def dense_column(df: DataFrame, col: str) -> DataFrame:
    """count, sum and mean of a numeric column's values."""
    x = F.col(col).cast("double")
    return df.agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"))


def pivot(df: DataFrame, row: str, col: str, value: str | None = None, fill: float | None = 0) -> DataFrame:
    """Counts (or sums of ``value``) by row and column, one output column a value of ``col``."""
    made = df.groupBy(row).pivot(col).agg(F.count(F.lit(1)) if value is None else F.sum(value))
    return made if fill is None else made.fillna(fill)


def pivot_margins(df: DataFrame, row: str, col: str, value: str | None = None) -> DataFrame:
    """(row, col, value, level) with totals; level is 0 for cells, 1 and 2 for totals of a row, a column, 3 for all."""
    made = F.count(F.lit(1)).cast("double") if value is None else F.sum(value)
    return df.cube(row, col).agg(made.alias("value"), F.grouping_id().cast("int").alias("level"))


def pivot_dimensions(df: DataFrame, rows: list[str], cols: list[str], func: str = "count", value: str | None = None) -> DataFrame:
    """Any aggregate by several row and column keys; a column a combination, named `a / b`, nulls where it has no rows."""
    made = {"count": F.count, "sum": lambda c: saturating_sum(df, c), "avg": F.avg, "min": F.min, "max": F.max}
    if func not in made:
        raise QueryError("unknown_aggregate", func)
    name = F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in cols])
    return df.withColumn("__col", name).groupBy(*rows).pivot("__col").agg(F.count(F.lit(1)) if value is None else made[func](value))


def version_columns(log: DataFrame, kind: str = "entity", key: str = "id") -> DataFrame:
    """The log with each version's kind, primary_id, tx_assert, and tx_supersede (the next version's, null for the latest)."""
    after = F.lead("tx").over(Window.partitionBy(key).orderBy("tx", "is_tombstone"))
    return log.select("*", F.lit(kind).alias("__kind"), after.alias("tx_supersede")).select(
        F.col("__kind").alias("kind"), F.col(key).alias("primary_id"), F.col("tx").alias("tx_assert"), "tx_supersede", *[c for c in visible(log.columns) if c not in (key, "tx", "kind")]
    )


def histogram(df: DataFrame, col: str, bounds: list[float]) -> DataFrame:
    """(le, n): how many values are at most each bound, the last one infinite; nulls don't count."""
    every = [*bounds, float("inf")]
    counts = df.where(F.col(col).isNotNull()).agg(*[F.coalesce(F.sum((F.col(col) <= b).cast("long")), F.lit(0)).alias(f"c{k}") for k, b in enumerate(every)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"c{k}").alias("n")) for k, b in enumerate(every)])).alias("h")).select("h.le", "h.n")


def coarsen(df: DataFrame, col: str, keep: int = 18, other: str = "Other", value: str | None = None) -> DataFrame:
    """Counts of the ``keep`` most frequent values (ties: the smaller first), the rest together; with ``value`` its low, high and total."""
    more = [F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total")] if value else []
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"), *more)
    top = counts.orderBy(F.col("n").desc(), col).limit(keep).select(F.col(col).alias("top"))
    joined = counts.join(F.broadcast(top), F.col(col) == F.col("top"), "left")
    again = [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")] if value else []
    return joined.groupBy(F.coalesce("top", F.lit(other)).alias(col)).agg(F.sum("n").alias("n"), *again)
