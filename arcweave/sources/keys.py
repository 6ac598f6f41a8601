"""Ids that are a kind and a native key: shown as ``kind:key``, filtered and joined by the key.

A column of such ids has a hidden companion, its name and ``__key``, with the key alone; the
column's metadata says which kind it is. Filters on the companion reach the Parquet scan, and
joins move eight bytes instead of a string. Columns without a companion are plain strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX = "__key"
KIND = "arcweave_kind"


def shown(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def keyed(name: str, kind: str, key: Column) -> list[Column]:
    """The id column ``name`` and its companion."""
    return [shown(kind, key).alias(name, metadata={KIND: kind}), key.cast("long").alias(name + SUFFIX)]


def kind_of(df: DataFrame, name: str) -> str | None:
    """The kind of the ids in a column that has its companion."""
    return df.schema[name].metadata.get(KIND) if name + SUFFIX in df.columns else None


def visible(columns: list[str]) -> list[str]:
    return [c for c in columns if not c.endswith(SUFFIX)]


def key_in(kind: str, literal: str) -> int | None:
    """The native key that ``literal`` names in ``kind``, if it is one."""
    head, _, rest = literal.partition(":")
    return int(rest) if head == kind and rest.isascii() and rest.removeprefix("-").isdigit() and str(int(rest)) == rest and abs(int(rest)) < 2**63 else None


def is_id(df: DataFrame, name: str, literal: str) -> Column:
    """Whether the column's id is ``literal``, asked of the native key where there is one."""
    kind = kind_of(df, name)
    if kind is None:
        return F.col(f"`{name}`") == F.lit(literal)
    key = key_in(kind, literal)
    return F.lit(False) if key is None else F.col(f"`{name}{SUFFIX}`") == F.lit(key)
