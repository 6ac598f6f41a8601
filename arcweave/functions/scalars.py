"""Scalar functions as Column expressions (and one Arrow function, a hash of bytes in turn)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ts_bucket(ts: Column, interval_us: int, origin_us: int = 0) -> Column:
    """The start of the bucket of ``interval_us`` that holds ``ts``, counted from the origin; identity if not positive."""
    ts = ts.cast("timestamp")
    if interval_us <= 0:
        return ts
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us - F.lit(origin_us), F.lit(interval_us)))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(float(np.finfo(np.float32).eps)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def polyline_km(lat: Column, lon: Column, trace: Column) -> Column:
    """The least distance to a vertex of ``trace``, an array of struct(lat, lon)."""
    return F.array_min(F.transform(trace, lambda p: haversine_km(lat, lon, p["lat"], p["lon"])))


def display(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("∅"))


def contains_ci(col: Column, needle: str) -> Column:
    return F.lower(display(col)).contains(needle.lower())


def label(columns: list[str], names: tuple[str, ...] = ("name", "title", "label"), strings: tuple[str, ...] = ()) -> Column:
    """The first of the naming columns that is there and not null, else the first of ``strings`` (a type's string properties), else ''."""
    return F.coalesce(*[F.col(n) for n in (*names, *strings) if n in columns], F.lit(""))


def threshold(col: Column, steps: list[tuple[float, str]], other: str) -> Column:
    out = F.lit(other)
    for least, name in reversed(steps):
        out = F.when(col > least, F.lit(name)).otherwise(out)
    return out


def first_match(col: Column, needles: list[tuple[str, str]]) -> Column:
    """The name of the first needle that ``col`` holds in any case; else itself, or Unknown for null."""
    out = F.coalesce(col, F.lit("Unknown"))
    for needle, name in reversed(needles):
        out = F.when(F.lower(col).contains(needle.lower()), F.lit(name)).otherwise(out)
    return out


def min_max(col: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col - low) / (high - low))))


def type_hint(col: str, kind: T.DataType) -> str:
    return {"long": "i64", "integer": "i64", "double": "f64", "float": "f64", "string": "string", "boolean": "bool", "timestamp": "timestamp", "binary": "bytes"}.get(kind.typeName(), kind.typeName())


def fnv1a64(text: str) -> int:
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return h


def normal_id(col: Column) -> Column:
    """An id as the shards' hash takes it: without hyphens, in lower case."""
    return F.lower(F.replace(col, F.lit("-"), F.lit("")))


def shard_of(key: str, shards: int) -> int:
    """The shard of an entity's id, or of an edge's first filler."""
    return fnv1a64(key.replace("-", "").lower()) % shards


@F.pandas_udf(T.LongType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """``fnv1a64`` of each text's normal id, as a signed long; whole columns at a time, byte by byte."""
    own = [None if t is None else t.replace("-", "").lower().encode() for t in texts]
    sizes = np.array([len(b) if b is not None else 0 for b in own], dtype=np.int64)
    data = np.frombuffer(b"".join(b for b in own if b), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    h = np.full(len(own), 0xCBF29CE484222325, dtype=np.uint64)
    for k in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        h[at] = (h[at] ^ data[starts[at] + k].astype(np.uint64)) * np.uint64(0x100000001B3)
    return pd.Series(h.view(np.int64)).astype(object).where([b is not None for b in own], None)


def text_embedding(text: Column, dim: int = 16) -> Column:
    """``dim`` buckets of hashed code points and pairs of them in lower case, of length one (all zero for none).

    A code point c goes to the bucket c * 2654435761 mod 2**32 mod ``dim``, a pair (a, b) that of
    a * 31 + b.
    """
    bucket = lambda x: F.pmod(F.pmod(x, F.lit(2**32)) * F.lit(2654435761) % F.lit(2**32), F.lit(dim))
    # Code points from the big-endian 32 bits of each.
    chars = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))

    def told(own: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(own) - 2), lambda k: F.get(own, k) * 31 + F.get(own, k + 1))
        grams = F.concat(own, F.when(F.size(own) > 1, pairs).otherwise(F.array().cast("array<bigint>")))

        def normal(found: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(found, lambda g: g == b)).cast("double"))
            return F.element_at(F.transform(F.array(sums), lambda v: F.transform(v, lambda x: (x / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-9))).cast("float"))), 1)

        return F.element_at(F.transform(F.array(F.transform(grams, bucket)), normal), 1)

    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(chars), told), 1))


def format_decimal(mantissa: Column, scale: int) -> Column:
    """A whole number as a decimal with ``scale`` digits after the point, zeros filled in."""
    if scale == 0:
        return mantissa.cast("string")
    digits = F.abs(mantissa.cast("decimal(38,0)")).cast("string")
    digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(scale + 1)), F.lit("0"))
    whole = F.concat(F.substring_index(F.concat(F.left(digits, F.length(digits) - scale), F.lit("|")), "|", 1), F.lit("."), F.right(digits, F.lit(scale)))
    return F.concat(F.when(mantissa < 0, F.lit("-")).otherwise(F.lit("")), whole)


def rescale(value: Column, scale: int) -> Column:
    """A decimal at a wider scale, all digits kept; an error where 38 digits don't hold it."""
    return value.cast(f"decimal(38,{scale})")


def cell(col: Column, kind: T.DataType) -> Column:
    """What a table shows: nothing for null, decimals with all their digits, the size of what has no text."""
    if isinstance(kind, T.BinaryType):
        return F.when(col.isNull(), F.lit("")).otherwise(F.concat(F.lit("<"), F.octet_length(col).cast("string"), F.lit(" bytes>")))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.to_json(col), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))


def to_tagged(col: Column, kind: T.DataType) -> Column:
    """A value as JSON with its type's name: {"t": "i64", "v": ...}; null for null."""
    return F.when(col.isNotNull(), F.to_json(F.struct(F.lit(type_hint("", kind)).alias("t"), col.cast("string").alias("v"))))


def from_tagged(text: Column, kind: T.DataType) -> Column:
    """The value back; null where the tag is another type's."""
    own = F.from_json(text, "t string, v string")
    return F.when(own["t"] == type_hint("", kind), own["v"].cast(kind))


def category_place(col: Column, values: list) -> Column:
    """Where a category lies on an axis from 0 to 1, in the order of ``values``; 0.5 of a single one, null for others."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), col) - 1
    return F.when(at < 0, F.lit(None)).when(F.lit(len(values) == 1), F.lit(0.5)).otherwise(at / max(1, len(values) - 1))


def importance_layout(count: Column, most: Column, angle: Column, year: Column, middle: float, spread: float = 1.0, step: float = 1.0) -> Column:
    """struct(x, y, z): the more counts the nearer to the centre (by logarithm), around it by ``angle`` (0 to 1), and up by year."""
    r = F.lit(spread) * (1 - F.log1p(count.cast("double")) / F.log1p(most.cast("double")))
    turn = angle * (2 * np.pi)
    return F.struct((r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"), ((year - F.lit(middle)) * step).alias("z"))
