"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits. Each bit position has a non-zero vector m(i) of F2^4 (for radius 3),
and each non-zero v of F2^4 gives a table whose mask keeps the bits with <m(i), v> = 1. The
vectors of at most three differing bits span at most three dimensions, so some v is orthogonal
to all of them: in that table the two fingerprints agree on every kept bit. All pairs within the
radius therefore collide in one of the 15 tables (Pagh, "Locality-sensitive hashing without
false negatives", 2016). Each mask keeps 32 to 36 bits, so chance collisions are rare.

Copies count once: only distinct fingerprints go into the tables. A bucket is compared pair by
pair while it has at most ``bucket_limit`` members. A larger one is dealt out again by the same
construction over the bits that its table ignores, 15 smaller tables with a quarter of the bits
free; as members are distinct, such a bucket holds at most 2**(free bits) of them whatever the
input, and is linked by looking up each member's neighbours in a table of that size. No pair is
lost in either way, and no task holds a bucket that grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import connected_components, cut

SEED = 42


def covering_vectors(radius: int, bits: list[int]) -> dict[int, int]:
    """The vector m(i) of each bit position: the non-zero ones of F2^(radius + 1) in turn."""
    return {b: 1 + k % (2 ** (radius + 1) - 1) for k, b in enumerate(bits)}


def covering_masks(radius: int, bits: list[int] | None = None) -> list[int]:
    """For each table the mask of the bits that it keeps, of ``bits`` (all 64)."""
    vectors = covering_vectors(radius, list(range(64)) if bits is None else bits)
    return [
        sum(1 << b for b, m in vectors.items() if (m & v).bit_count() & 1)
        for v in range(1, 2 ** (radius + 1))
    ]


def free_bits(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of a text's ``width``-word shingles; 0 if it has no words."""
    words = text.lower().split() if text else []  # bytes: only A-Z and \x20\x09-\x0D are meant
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(joined, SEED)]
    else:
        ends, at = [], -1
        for word in words:
            at += len(word) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[:-1])]
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])]
    found = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 1 << 16):
        block = found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row; a null text has the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _roots_by_pairs(members: np.ndarray, radius: int) -> np.ndarray:
    """Index of each member's root, comparing all pairs; for a bounded number of members."""
    roots = np.arange(len(members))
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= radius
    while True:
        least = np.where(near, roots[None, :], len(members)).min(axis=1)
        least = least[least]
        if np.array_equal(least, roots):
            return roots
        roots = least


def _roots_by_lookup(members: np.ndarray, radius: int, free: list[int]) -> np.ndarray:
    """The same for distinct members that differ in the bits ``free`` only, by their neighbours' places."""
    place = np.zeros(len(members), dtype=np.int64)
    for k, b in enumerate(free):
        place |= (members >> np.uint64(b) & np.uint64(1)).astype(np.int64) << k
    at = np.full(1 << len(free), -1, dtype=np.int32)
    at[place] = np.arange(len(members), dtype=np.int32)
    one = [1 << k for k in range(len(free))]
    flips = {0}
    for _ in range(radius):
        flips |= {f ^ o for f in flips for o in one}
    flips.discard(0)
    roots = np.arange(len(members))
    while True:
        least = roots.copy()
        for flip in flips:
            other = at[place ^ flip]
            there = other >= 0
            least[there] = np.minimum(least[there], least[other[there]])
        least = least[least]
        if np.array_equal(least, roots):
            return roots
        roots = least


def links(distinct: DataFrame, radius: int = 3, bucket_limit: int = 1024) -> DataFrame:
    """Edges (a, b) that connect what is within ``radius``, from distinct fingerprints ``fp``.

    Within each bucket only the edges of members to their local root come out: at most as many
    as members, with the components that all the pairs would have.
    """
    masks = covering_masks(radius)
    inner = [[outer | m for m in covering_masks(radius, free_bits(outer))] for outer in masks]

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def dealt(df: DataFrame, tables: list[int], tag: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for k, m in enumerate(tables)])
        out = df.select("fp", *([F.col("t").alias("outer")] if tag else [F.lit(0).alias("outer")]), F.explode(keys).alias("e"))
        return out.select("fp", "outer", F.col("e.t").alias("t"), F.col("e.k").alias("k"))

    def grouped(df: DataFrame, second: bool) -> DataFrame:
        def emit(members: np.ndarray, outer: int, t: int) -> list[np.ndarray]:
            members = np.sort(members)
            if len(members) <= bucket_limit:
                roots = _roots_by_pairs(members, radius)
            else:
                roots = _roots_by_lookup(members, radius, free_bits(inner[outer][t]))
            moved = roots != np.arange(len(members))
            return [members[moved].view(np.int64), members[roots[moved]].view(np.int64)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, over = None, [], False
            out_a: list = []
            out_b: list = []
            out_t: list = []

            def close() -> None:
                if key is not None and not over:
                    members = np.concatenate(held)
                    if len(members) > 1:
                        a, b = emit(members, key[0], key[1])
                        out_a.append(a), out_b.append(b), out_t.append(np.full(len(a), -1, dtype=np.int32))

            def spill(rows: np.ndarray, t: int) -> None:
                rows = rows.view(np.int64)
                out_a.append(rows), out_b.append(rows), out_t.append(np.full(len(rows), t, dtype=np.int32))

            def flush() -> Iterator[pa.RecordBatch]:
                if out_a:
                    arrays = [pa.array(np.concatenate(x)) for x in (out_a, out_b, out_t)]
                    out_a.clear(), out_b.clear(), out_t.clear()
                    yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "t"])

            for batch in batches:
                fp, outer, t, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                if not len(fp):
                    continue
                fp = fp.view(np.uint64)
                cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(t) != 0) | (np.diff(outer) != 0)) + 1
                starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(fp)]
                for s, e in zip(starts, ends):
                    own = (int(outer[s]), int(t[s]), int(k[s]))
                    if own != key:
                        close()
                        key, held, over = own, [], False
                    if over:
                        spill(fp[s:e], own[1])
                        continue
                    held.append(fp[s:e])
                    if not second and sum(map(len, held)) > bucket_limit:
                        for rows in held:
                            spill(rows, own[1])
                        held, over = [], True
                yield from flush()
            close()
            yield from flush()

        # A bucket's rows meet in one task in this order; it holds bucket_limit of them at most
        # (in the second round all, of which there are no more than 2**free).
        return (
            df.repartition("outer", "t", "k")
            .sortWithinPartitions("outer", "t", "k")
            .mapInArrow(run, "a long, b long, t int")
        )

    first = cut(grouped(dealt(distinct.select("fp"), masks, ""), False))
    found = first.where("t < 0").select("a", "b")
    large = first.where("t >= 0").select(F.col("a").alias("fp"), "t")
    if not large.isEmpty():
        again = None
        for outer in range(len(masks)):
            part = dealt(large.where(F.col("t") == outer), inner[outer], "outer")
            again = part if again is None else again.unionByName(part)
        found = found.unionByName(grouped(again, True).select("a", "b"))
    return found


def _classes(distinct: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """(fp, least): of each fingerprint the smallest ``least`` in its component, from ``distinct`` (fp, least)."""
    roots = connected_components(links(distinct, radius, bucket_limit))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("of")), "root").select("fp", F.col("of").alias("least"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, bucket_limit: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; more columns are ignored).

    Two rows are linked if their fingerprints differ in ``radius`` bits or fewer; component_id is
    the smallest doc_id reachable. Null and wordless texts have the fingerprint zero and are
    linked like any other. A null doc_id has a row too; it takes part in links but is never the
    smallest, unless its component has no other (component_id is then null). Repeated rows come
    out as often as they go in. An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, width))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = _classes(distinct, radius, bucket_limit).withColumnRenamed("least", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = 3, radius: int = 3, bucket_limit: int = 1024) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns), one of each component of ``near_duplicates``.

    Rows are judged by themselves, not by their ids: the row that stays has the smallest doc_id of
    its component, of these the text with the smallest hash, of equal texts the first row by its
    columns as JSON. Rows without a doc_id all stay, as they can't stand for a group.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"))
    marked = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where("doc_id IS NOT NULL")
        .transform(lambda df: _marked(df, width))
    )
    distinct = cut(marked.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.count(F.lit(1)).alias("n")))
    best = _classes(distinct.select("fp", "least"), radius, bucket_limit)
    # Of most documents nothing is like them: only the others' (doc_id, h) are told which go, and which come more than once.
    judged = marked.join(best, "fp").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h") == F.col("least")).alias("stays"))
    judged = cut(judged.where("n > 1 OR NOT stays").select(F.struct("doc_id", "h").alias("__own"), "stays"))
    named = docs.withColumn("__own", own)
    rest = named.join(judged.select("__own"), "__own", "left_anti").select(*docs.columns)
    again = named.join(judged.where("stays").select("__own"), "__own", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = again.groupBy("__own").agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("__row"))
    return rest.unionByName(one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, fp): ``fingerprints`` beside the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(2).cast(pa.binary()).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "h", "fp"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), "text").mapInArrow(run, "doc_id long, h long, fp long")
