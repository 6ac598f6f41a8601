"""Benchmark decontamination with an FM-index over each shard of the training text.

A shard is a run of documents of about ``shard_words`` words. Its words become symbols: the
benchmark's vocabulary is the alphabet and any other word is a break that no phrase can cross
(neighbouring breaks are kept once, as are document ends). Breaks differ from one another, so
suffixes are compared as far as the next break and their order is total. The index holds the
Burrows-Wheeler transform in a levelwise wavelet tree with its rank directory, and the suffix
positions of every ``sample``-th symbol and of each symbol after a break. All test phrases go
through backward search together; their occurrences are located by walking to a sampled
position; the spans are merged.

Documents are read where they lie: nothing is shuffled. The benchmark is cut into pieces that
overlap by a window less a word, so that no item is too long, and pieces are dealt into blocks of
about ``block_bytes`` of text. Tasks build the blocks; each goes out as a broadcast of its own
(about ten times its text), and a worker holds one at a time: it reads a block from the
executor's disk, scans the shard and lets it go. So memory, on the driver as well, doesn't grow
with the benchmark.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import cut

WINDOW = 10
#: What separates words becomes a space, A-Z becomes a-z; digits, a-z and all beyond ASCII stay.
FOLD = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class WaveletTree:
    """Ranks of symbols in a sequence; level by level from the highest bit, zeros before ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        current = symbols
        for level in range(bits - 1, -1, -1):
            bit = (current >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(current) - int(self.ones[-1][-1]))
            current = np.concatenate([current[~bit], current[bit]])
        starts = np.flatnonzero(np.diff(current, prepend=-1))
        self.start = np.zeros(1 << bits, dtype=np.int64)  # where each symbol's run begins at the bottom
        self.start[current[starts]] = starts

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` (one that occurs) stands before ``at``."""
        for depth, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[depth][at]
            at = np.where(symbol >> level & 1, self.zeros[depth] + ones, at - ones)
        return at - self.start[symbol]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes in order; 0 is a break, and breaks count by their place. The last symbol is a break."""
    n = len(symbols)
    breaks = symbols == 0
    key = np.where(breaks, np.cumsum(breaks), symbols.astype(np.int64) + int(breaks.sum()))
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.diff(key[order], prepend=-1))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(head, np.diff(head, append=n))
    step = 1
    at = np.arange(n)
    while True:
        # Only suffixes that still tie with another are sorted again, by what follows after `step`.
        group = rank[order[at]]
        same = group[1:] == group[:-1]
        tied = np.zeros(len(at), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        at, group = at[tied], group[tied]
        if not len(at):
            return order
        own = order[at]
        key = group * n + rank[own + step]
        new = np.argsort(key, kind="stable")
        own, key = own[new], key[new]
        order[at] = own
        head = np.flatnonzero(np.diff(key, prepend=-1))
        rank[own] = np.repeat(at[head], np.diff(head, append=len(at)))
        step *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = 32):
        """symbols: 0 for a break, the last one a break."""
        n, top = len(symbols), int(symbols.max(initial=0))
        order = suffix_order(symbols)
        self.n, self.last = n, symbols[order - 1]  # the transform; before the first stands the last, a break
        self.tree = WaveletTree(self.last, max(1, top.bit_length()))
        counts = np.bincount(symbols, minlength=top + 1)
        self.counts, self.below = counts, np.concatenate([[0], np.cumsum(counts)[:-1]])
        sampled = (order % sample == 0) | (self.last == 0)
        self.sampled = sampled
        self.place = np.cumsum(sampled) - 1
        self.position = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``phrases`` (all of one length) its range [low, high) of suffixes."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, j]
            there = np.flatnonzero((low < high) & (symbol < len(self.counts)))
            there = there[self.counts[symbol[there]] > 0]
            new_low, new_high = np.zeros_like(low), np.zeros_like(high)
            c = symbol[there]
            new_low[there] = self.below[c] + self.tree.rank(c, low[there])
            new_high[there] = self.below[c] + self.tree.rank(c, high[there])
            low, high = new_low, new_high
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each of the suffixes ``rows``, by walking back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            own = rows[walking]
            c = self.last[own]
            rows[walking] = self.below[c] + self.tree.rank(c, own)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.position[self.place[rows]] + steps


class Block(NamedTuple):
    """Part of a benchmark: its words' symbols, its phrases by length and the items of each phrase."""

    symbol: dict[bytes, int]
    phrases: list[np.ndarray]  # each n x length
    first: list[np.ndarray]  # for each phrase where its items begin in `items`, and one more
    items: list[np.ndarray]
    names: list[str]


def build_block(items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> Block:
    symbol: dict[bytes, int] = {}
    names = sorted({i for i, _ in items if i is not None})
    number = {name: k for k, name in enumerate(names)}
    windows: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[np.ndarray]] = {}
    for name, text in items:
        words = words_of(text)
        if not words:
            continue
        own = np.array([symbol.setdefault(w, len(symbol) + 1) for w in words], dtype=np.int32)
        length = min(window, len(own))
        rows = np.lib.stride_tricks.sliding_window_view(own, length)
        windows.setdefault(length, []).append(rows)
        owners.setdefault(length, []).append(np.full(len(rows), -1 if name is None else number[name], dtype=np.int32))
    phrases, first, of = [], [], []
    for length in sorted(windows):
        rows, own = np.concatenate(windows.pop(length)), np.concatenate(owners.pop(length))
        order = np.lexsort([own, *rows.T[::-1]])
        rows, own = rows[order], own[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        # An item counts once for a phrase; one without a name hits but isn't listed.
        listed = (own >= 0) & (new | np.concatenate([[True], own[1:] != own[:-1]]))
        phrases.append(rows[new])
        first.append(np.concatenate([[0], np.cumsum(listed)])[np.append(np.flatnonzero(new), len(rows))])
        of.append(own[listed])
    return Block(symbol, phrases, first, of, names)


class Hits(NamedTuple):
    n_words: int
    spans: list[tuple[int, int]]  # merged, in words, end excluded
    items: list[str]


def scan(texts: list[list[bytes]], blocks: Iterable[Block]) -> list[Hits]:
    """What of the benchmark occurs in each document of one shard, given as words. One block is held at a time."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    cover = np.zeros(int(begins[-1]) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        get = block.symbol.get
        raw = np.fromiter((get(w, 0) for t in texts for w in (*t, b"")), dtype=np.int64, count=int(lengths.sum()) + len(texts))
        if not block.phrases or not raw.any():
            continue
        origin = np.flatnonzero((raw != 0) | (np.concatenate([[1], raw[:-1]]) != 0))  # one break of a run
        index = FMIndex(raw[origin])
        for phrases, first, of in zip(block.phrases, block.first, block.items):
            low, high = index.search(phrases)
            size = high - low
            which = np.repeat(np.arange(len(phrases)), size)
            if not len(which):
                continue
            rows = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            # Back to words: each document before the place has added one end mark.
            place = origin[index.locate(rows)]
            doc = np.searchsorted(begins[:-1] + np.arange(len(texts)), place, side="right") - 1
            word = place - doc
            np.add.at(cover, word, 1)
            np.add.at(cover, word + phrases.shape[1], -1)
            many = first[which + 1] - first[which]
            owner = of[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[which], many)]
            for d, k in np.unique(np.stack([np.repeat(doc, many), owner], axis=1), axis=0).tolist():
                items[d].add(block.names[k])
    hit = np.cumsum(cover[:-1]) > 0
    out = []
    for d in range(len(texts)):
        own = np.diff(hit[begins[d] : begins[d + 1]].astype(np.int8), prepend=0, append=0)
        spans = list(zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist()))
        out.append(Hits(int(lengths[d]), spans, sorted(items[d])))
    return out


_WORD = re.compile(rb"[^\x20]+")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between them; what follows a span stays."""
    ends = [m.span() for m in _WORD.finditer(text.translate(FOLD))]
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at : ends[s][0]])
        at = ends[e - 1][1]
    return b"".join([*kept, text[at:]])


def pieces(text: str | None, window: int, words: int) -> list[str]:
    """``text`` in runs of ``words`` words and a window less one: they have its windows, and no others."""
    own = words_of(text.encode()) if text is not None else []
    starts = range(0, max(1, len(own) - window + 1), words)
    return [b" ".join(own[s : s + words + window - 1]).decode() for s in starts]


def _blocks(benchmark: DataFrame, block_bytes: int, window: int) -> list[Broadcast]:
    """Broadcast variables of pickled Blocks, one after another; each holds a share of the pieces' hash range."""
    words = max(window, block_bytes // 64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = pieces(text, window, words)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, pa.string())], names=["id", "text"])

    items = cut(benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(split, "id string, text string").distinct())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / block_bytes))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(build_block(held, window))], pa.binary())], names=["block"])

        current, held = None, []
        for batch in batches:
            for part, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and part != current:
                    yield told(held)
                    held = []
                current = part
                held.append((item, text.encode()))
        if held:
            yield told(held)

    dealt = items.select(F.pmod(F.xxhash64("id", "text"), F.lit(parts)).alias("part"), "id", "text").repartition(parts, "part").sortWithinPartitions("part", "id", "text")
    # One partition after another, so the driver holds few blocks at a time.
    made = cut(dealt.mapInArrow(build, "block binary"))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(bytes(row.block)) for row in made.toLocalIterator()]


class _Shared:
    """The blocks of a benchmark in a worker; a single one is kept, of more each is read again and let go."""

    def __init__(self, blocks: list[Broadcast]):
        self.blocks = blocks
        self.kept: Block | None = None

    def __iter__(self) -> Iterator[Block]:
        if len(self.blocks) == 1:
            if self.kept is None:
                self.kept = self._read(self.blocks[0])
            yield self.kept
            return
        for own in self.blocks:
            yield self._read(own)

    @staticmethod
    def _read(own: Broadcast) -> Block:
        block = pickle.loads(own.value)
        # The worker would keep the value for as long as it lives; its file stays.
        own.__dict__.pop("_value", None)
        return block


def _shards(batches: Iterator[pa.RecordBatch], text_at: int, shard_words: int) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Slices of the batches with their texts and words, of about ``shard_words`` words at most."""
    for batch in batches:
        texts = batch.column(text_at).cast(pa.binary()).to_pylist()
        begin, words, count = 0, [], 0
        for k, text in enumerate(texts):
            words.append(words_of(text))
            count += len(words[-1])
            if count >= shard_words or k == len(texts) - 1:
                yield batch.slice(begin, k + 1 - begin), texts[begin : k + 1], words
                begin, words, count = k + 1, [], 0


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = 1_000_000, block_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row of ``docs`` (doc_id, text; other columns are ignored).

    spans are the merged word ranges [start, end) in which some window of ``benchmark`` (item_id,
    text) occurs: ``window`` consecutive words of an item, or all the words of a shorter one.
    items are the distinct item_ids with occurring windows, as sorted strings. Null, empty and
    wordless texts have no words, spans or items, and such benchmark items match nothing. An item
    without an id hits but isn't listed. Repeated rows come out as often as they go in.
    """
    blocks = _blocks(benchmark, block_bytes, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _Shared(blocks)
        for batch, _, words in _shards(batches, 1, shard_words):
            found = scan(words, shared)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h.n_words for h in found], pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in h.spans] for h in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([h.items for h in found], pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "spans", "items"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = 1_000_000, block_bytes: int = 2 << 20) -> DataFrame:
    """``docs``, all its columns, without the benchmark's passages; n_chars follows the text.

    A row without a hit is untouched. A row of whose words none is left goes.
    """
    blocks, at, count_at = _blocks(benchmark, block_bytes, window), docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _Shared(blocks)
        for batch, texts, words in _shards(batches, at, shard_words):
            found = scan(words, shared)
            new, chars, keep = list(texts), [None] * len(texts), []
            for k, hits in enumerate(found):
                if hits.spans:
                    new[k] = without(texts[k], hits.spans)
                    chars[k] = len(new[k].decode())
                keep.append(not hits.spans or sum(e - s for s, e in hits.spans) < hits.n_words)
            arrays = list(batch.columns)
            kind = batch.schema.field(at).type
            arrays[at] = pa.array(new, pa.binary()).cast(kind)
            if count_at is not None:
                old = batch.column(count_at)
                arrays[count_at] = pa.array([o if c is None else c for o, c in zip(old.to_pylist(), chars)], old.type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``find``: counts, and the item list's SHA-256."""
    found = find(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), m AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, phrase)
), h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM m)) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
