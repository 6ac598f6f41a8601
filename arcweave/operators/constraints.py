"""Constraints on records, stated in code or read from a table, and who may do what."""

from __future__ import annotations

import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.errors import QueryError
from arcweave.functions.scalars import type_hint


def wrong_tag(df: DataFrame, prop: str, tag: str) -> Column:
    """Whether a property that is there has another type than ``tag`` (as ``type_hint`` names them).

    A column of one type answers for all its rows; a column ``<prop>__tag``, where a property's
    type differs by row, answers for each.
    """
    if f"{prop}__tag" in df.columns:
        return F.col(prop).isNotNull() & (F.col(f"{prop}__tag") != F.lit(tag))
    return F.col(prop).isNotNull() & F.lit(type_hint(prop, df.schema[prop].dataType) != tag)


def violations(tables: dict[str, DataFrame], constraints: DataFrame, key: str = "id") -> DataFrame:
    """(type, key, prop, kind): the records that break a constraint.

    constraints: type, prop, kind (``required`` or ``value_tag``), tag (for the latter). Rows of
    unknown types, or without one of type, prop and kind, are passed over, as are other kinds; a
    missing property breaks no tag. They are a schema's rules, so they are read on the driver.
    """
    out = None
    for rule in constraints.where("type IS NOT NULL AND prop IS NOT NULL AND kind IN ('required', 'value_tag')").distinct().orderBy("type", "prop", "kind").collect():
        if rule.type not in tables or rule.kind == "value_tag" and rule.tag is None:
            continue
        df = tables[rule.type]
        if rule.prop not in df.columns:
            broken = F.lit(rule.kind == "required")
        else:
            broken = F.col(rule.prop).isNull() if rule.kind == "required" else wrong_tag(df, rule.prop, rule.tag)
        own = df.where(broken).select(F.lit(rule.type).alias("type"), F.col(key).cast("string").alias("key"), F.lit(rule.prop).alias("prop"), F.lit(rule.kind).alias("kind"))
        out = own if out is None else out.unionByName(own)
    return out if out is not None else constraints.select("type", F.lit(None).cast("string").alias("key"), "prop", "kind").limit(0)


def check(tables: dict[str, DataFrame], constraints: DataFrame, key: str = "id") -> None:
    """An error, naming one record, if a constraint is broken."""
    first = violations(tables, constraints, key).orderBy("type", "key", "prop", "kind").first()
    if first is not None:
        raise QueryError("missing_required_property" if first.kind == "required" else "wrong_value_tag", f"{first.type} {first.key}: {first.prop}")


def allowed(requests: DataFrame, capabilities: DataFrame, now) -> DataFrame:
    """``requests`` (subject, action, target) with ``allowed``: some grant has the subject, the action or `*`, the target or `*`, and hasn't expired (0 never does).

    Requests are asked by subject and each of the four combinations, so the join is on equality.
    """
    live = capabilities.where((F.col("expires_at") == 0) | (F.col("expires_at") > F.lit(now))).select("subject", "action", "target").distinct()
    asked = requests.select("subject", "action", "target").distinct()
    either = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.lit("*"))))
    forms = asked.select("*", either("action").alias("a")).select("*", either("target").alias("t"))
    granted = forms.join(live.select("subject", F.col("action").alias("a"), F.col("target").alias("t")), ["subject", "a", "t"]).select("subject", "action", "target").distinct()
    return requests.join(granted.withColumn("allowed", F.lit(True)), ["subject", "action", "target"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def principal_of(principals: DataFrame, token: str, key: str = "id") -> str | None:
    """The key of the principal with the token, the last by key if several have it; compared in constant time."""
    found = principals.where(F.sha2("token", 256) == F.sha2(F.lit(token), 256)).select(key, "token").orderBy(F.col(key).desc())
    return next((r[key] for r in found.collect() if hmac.compare_digest(r.token, token)), None)
