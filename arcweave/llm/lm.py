"""Cross-entropy difference scoring (Moore and Lewis, 2010).

Two bigram models, of a target (the rows that labels call good) and of the background, share one
vocabulary: every word of the corpus. Words, bigrams and both models' counts come from all
documents and grow with them. The background is all rows; matched models (``matched``, as the
query has them) are of the rows that are good and of those that aren't, the larger model's counts
are scaled to the size of the smaller, so that smoothing weighs alike in both, and no row is
scored by its own counts: they are left out of its own model's bigrams, contexts and words.

The ``common`` most frequent words only say how a bigram is counted, not whether. Bigrams of two
common words have tables of ``common`` squared counts as single floats that are sent to the tasks
(8 MB at 1,024). All others go by key to the task of a word in them that isn't common: it has at most a
share of 1 in ``common`` of all tokens, so no key is hot. There the counts of the word and of its
bigrams meet, and what they add to each document's loss goes back to the document. Words that
aren't common are told apart by 63 bits of a hash (10**9 words: one pair in 18 runs is taken for
one word).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import cut
from arcweave.llm.decontaminate import words_of

OTHER, START = 0, 1
WEIGHT = 20.0
RARE = 1 << 63  # set in the codes of words that aren't common


def count_words(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word binary, n) over all texts; each task sums up what it sees before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                for word in words_of(text):
                    found[word] = found.get(word, 0) + 1
                if len(found) > flush:
                    yield told(found)
                    found = {}
        yield told(found)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame, size: int = 1024) -> dict[bytes, int]:
    """The ``size`` - 2 most frequent words of ``counted`` (ties: the smaller first) and their symbols."""
    top = counted.orderBy(F.col("n").desc(), "word").limit(size - 2).collect()
    return {bytes(r.word): k for k, r in enumerate(top, 2)}


def symbols(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    get = vocabulary.get
    return np.fromiter((get(w, OTHER) for w in words), dtype=np.int64, count=len(words))


def pairs(own: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([[START], own[:-1]]) * size + own if len(own) else own


def good_rows(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(1))


def count_pairs(docs: DataFrame, labels: DataFrame, vocabulary: dict[bytes, int], size: int) -> np.ndarray:
    """[2, size, size] counts of bigrams: of all rows, of the rows that ``labels`` calls good."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [symbols(words_of(t), shared.value).astype("<u2").tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "symbols"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size * size), dtype=np.int64)
        for batch in batches:
            for blob, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, times = np.unique(pairs(np.frombuffer(blob, dtype="<u2").astype(np.int64), size), return_counts=True)
                total[0, own] += times
                if mark:
                    total[1, own] += times
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], names=["pair", "n", "good"])

    # The join decides which rows are good; it moves symbols of two bytes, not texts, and sorts
    # both sides at any size, as labels grow with the documents.
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, symbols binary").join(good_rows(labels).hint("merge"), "doc_id", "left")
    counted = marked.select("symbols", "good").mapInArrow(count, "pair long, n long, good long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toArrow()
    out = np.zeros((2, size * size))
    at = counted.column("pair").to_numpy()
    out[0, at], out[1, at] = counted.column("n").to_numpy(), counted.column("good").to_numpy()
    return out.reshape(2, size, size)


class Models(NamedTuple):
    """Counts of the target, then of the background, over common words; what a task needs of them."""

    words: dict[bytes, int]
    width: int
    slots: int
    pair: np.ndarray  # [model, before * width + word]
    one: np.ndarray  # [model, word]
    before: np.ndarray  # [model, word as the one before]
    total: np.ndarray
    scale: np.ndarray  # what a count of each model weighs
    hold: bool  # a row's own counts are left out

    def share(self, k: int, count: np.ndarray) -> np.ndarray:
        """A word's share, each of ``slots`` symbols counted once more."""
        return (self.scale[k] * count + 1.0) / (self.scale[k] * self.total[k] + self.slots)

    def context(self, k: int, count: np.ndarray) -> np.ndarray:
        return np.log2(self.scale[k] * count + WEIGHT)

    def bigram(self, k: int, count: np.ndarray, share: np.ndarray) -> np.ndarray:
        """-log2 P(word | before) is ``context`` less this."""
        return np.log2(self.scale[k] * count + WEIGHT * share)


def within(key: np.ndarray) -> np.ndarray:
    """How often each place's key occurs."""
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    return times[at]


class Codes(dict):
    """Symbols of common words; of others OTHER if the vocabulary ends there, else a hash of 63 bits."""

    def __init__(self, common: dict[bytes, int], bounded: bool):
        super().__init__(common)
        self.bounded = bounded

    def __missing__(self, word: bytes) -> int:
        code = self[word] = OTHER if self.bounded else xxhash.xxh64_intdigest(word) | RARE
        return code


def planes(values: np.ndarray) -> bytes:
    """Byte by byte, so that Spark's compression finds the equal ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplaned(blob: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def runs(*keys: np.ndarray) -> np.ndarray:
    """The number of the run of equal keys that each place is in."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.diff(runs(*keys), prepend=-1))


def packed(t: np.ndarray, other: np.ndarray, flags: np.ndarray) -> bytes:
    """Rows in the order of (``t``, ``other``): each word with its number of pairs, each pair with its number of rows, then the flags."""
    pair = starts(t, other)
    t, other, times = t[pair], other[pair], np.diff(pair, append=len(t))
    word = starts(t)
    pairs_of = np.diff(word, append=len(t))
    rare = other >= np.uint64(RARE)
    sizes = np.array([len(word), len(pair), rare.sum()], dtype="<u4")
    columns = [t[word], pairs_of.astype("<u4"), times.astype("<u4"), other[rare], other[~rare], flags]
    return sizes.tobytes() + np.packbits(rare).tobytes() + b"".join(map(planes, columns))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, pairs, rares = np.frombuffer(blob[:12], "<u4").tolist()
    at = 12 + (pairs + 7) // 8
    rare = np.unpackbits(np.frombuffer(blob[12:at], np.uint8), count=pairs).astype(bool)

    def column(n: int, dtype: str) -> np.ndarray:
        nonlocal at
        begin, at = at, at + n * np.dtype(dtype).itemsize
        return unplaned(blob[begin:at], dtype)

    t, pairs_of, times = column(words, "<u8"), column(words, "<u4"), column(pairs, "<u4")
    other = np.empty(pairs, dtype="<u8")
    other[rare] = column(rares, "<u8")
    other[~rare] = column(pairs - rares, "<u8")
    return np.repeat(np.repeat(t, pairs_of), times), np.repeat(other, times), unplaned(blob[at:], "<u4")


def rare_terms(t: np.ndarray, other: np.ndarray, good: np.ndarray, last: np.ndarray, doc: np.ndarray, models: Models) -> np.ndarray:
    """[2, rows]: what each row adds to the target's and the background's loss of its document.

    A row is an occurrence of a word ``t`` after ``other``, or, if width <= other < 2 * width, of
    the common word other - width after ``t``; such a row has the word's number in its own
    document above the lower 32 bits. All rows of a ``t`` are there.
    """
    width = np.uint64(models.width)
    plain = other < np.uint64(RARE)
    own_b = np.where(plain, other >> np.uint64(32), np.uint64(0)).astype(np.int64)
    other = np.where(plain, other & np.uint64(0xFFFFFFFF), other)
    order = np.lexsort((doc, other, t) if models.hold else (other, t))
    t, other, good, last, doc, own_b = t[order], other[order], good[order], last[order], doc[order], own_b[order]
    word, pair, follows = runs(t), runs(t, other), (other >= width) & (other < width + width)
    b = (other[follows] - width).astype(np.int64)
    own_pair = own_word = own_before = np.zeros(1)
    if models.hold:
        own_pair = within(runs(t, other, doc))
        _, both = np.unique(np.unique(doc, return_inverse=True)[1] + word * len(t), return_inverse=True)
        own_word = np.bincount(both, weights=~follows)[both]
        own_before = np.bincount(both, weights=~follows & ~last)[both]
    out = np.empty((2, len(t)))
    marks = [good.astype(np.float64), 1.0 - good if models.hold else np.ones(len(t))]
    for k, mark in enumerate(marks):
        own = mark if models.hold else np.zeros(1)  # of rows in this model their own counts go
        of_pair = np.bincount(pair, weights=mark)[pair] - own * own_pair
        of_word = np.bincount(word, weights=mark * ~follows)[word] - own * own_word
        before = np.bincount(word, weights=mark * (~follows & ~last))[word] - own * own_before
        of_word[follows] = models.one[k][b] - (own * own_b)[follows] if models.hold else models.one[k][b]
        out[k, order] = np.where(follows | last, 0.0, models.context(k, before)) - models.bigram(k, of_pair, models.share(k, of_word))
    return out


def models_of(counts: np.ndarray, words: dict[bytes, int], width: int, slots: int, matched: bool) -> Models:
    """From [2, width, width] counts of all rows and of the good ones."""
    both = np.stack([counts[1], counts[0] - counts[1] if matched else counts[0]])
    total = both.sum(axis=(1, 2))
    scale = total.min() / total if matched and total.min() > 0 else np.ones(2)
    return Models(words, width, slots, both.reshape(2, -1).astype(np.float32), both.sum(axis=1), both.sum(axis=2), total, scale, matched)


def score(docs: DataFrame, labels: DataFrame, size: int | None = None, common: int = 1024, chunk: int = 1 << 21, matched: bool = False) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of ``docs`` (doc_id, text).

    ``size`` bounds the vocabulary, with one symbol for all words beyond it; None: it has all
    words. ``common`` (65,536 at most, as ``size``) and ``chunk``, the tokens that a task
    handles at once, change no result. ``matched``: see above; a row's own words stay in the
    model's total alone.

    Losses are bits a token; score is their difference, lower for texts more like the target. A
    text without words (null, empty) has no tokens and null losses. Without any good row the
    target model knows only its smoothing. Labels of unknown rows and null labels don't count, a
    row that any label calls good is good. Repeated rows come out, and count, as often as they
    go in.
    """
    bounded = size is not None
    counted = cut(count_words(docs))
    width = size if bounded else common
    words = vocabulary(counted, width)
    counts = count_pairs(docs, labels, words, width)
    slots = size if bounded else counted.count() + 2
    models = models_of(counts, words, width, slots, matched)
    spark = docs.sparkSession
    # Rows of one dealt part are held at once: there are more parts as there are more tokens.
    parts = max(int(counts[0].sum()) // 1_000_000 + 1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(models)
    names, schema = ["part", "chunk", "kind", "blob"], "part int, chunk long, kind int, blob binary"

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        codes, number = Codes(models.words, bounded), TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (doc_id, good, n) of the chunk's documents
        seen: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids, good, n = (list(x) for x in zip(*held))
            n = np.array(n, dtype=np.int64)
            code, doc = np.concatenate(seen), np.repeat(np.arange(len(n), dtype=np.uint32), n)
            ends = np.cumsum(n)[n > 0]
            first, last = np.zeros(len(code), dtype=bool), np.zeros(len(code), dtype=bool)
            first[ends - n[n > 0]] = last[ends - 1] = True
            prev = np.concatenate([code[:1], code[:-1]])
            prev[first] = START
            b_common, a_common = code < width, prev < width
            both, rare_b, rare_a = b_common & a_common, ~b_common, b_common & ~a_common
            mixed = rare_b & a_common
            near = both | mixed  # after a common word
            a, where = prev[near].astype(np.int64), doc[near].astype(np.int64)
            pair = (prev[both] * np.uint64(width) + code[both]).astype(np.int64)
            mark = np.array(good, dtype=np.float64)[doc]
            own_a = own_pair = np.zeros(1)
            own_b = np.zeros(len(code), dtype=np.int64)
            if models.hold:
                own_a, own_pair = within(where * width + a), within(doc[both].astype(np.int64) * width * width + pair)
                own_b[b_common] = within(doc[b_common].astype(np.int64) * width + code[b_common].astype(np.int64))
            base = []
            for k, of in enumerate((mark, 1.0 - mark)):
                of = of if models.hold else np.zeros(len(code))
                context = models.context(k, models.before[k][a] - of[near] * own_a)
                share = models.share(k, models.one[k][code[both].astype(np.int64)] - of[both] * own_b[both])
                bigram = models.bigram(k, models.pair[k][pair] - of[both] * own_pair, share)
                base.append(np.bincount(where, weights=context, minlength=len(n)) - np.bincount(doc[both], weights=bigram, minlength=len(n)))
            flags = doc << np.uint32(2) | np.array(good, dtype=np.uint32)[doc] << np.uint32(1) | last
            t = np.concatenate([code[rare_b], prev[rare_a]])
            other = np.concatenate([prev[rare_b], code[rare_a] + np.uint64(width) + (own_b[rare_a].astype(np.uint64) << np.uint64(32))])
            flags = np.concatenate([flags[rare_b], flags[rare_a]]).astype(np.uint32)
            order = np.lexsort((other, t))
            t, other, flags = t[order], other[order], flags[order]
            # Parts are ranges of the hash, so they are in this order too.
            part = ((t >> np.uint64(32) & np.uint64(0x7FFFFFFF)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, dtype=np.int64)
            rows = [
                (int(part[s]), number, 1, packed(t[s:e], other[s:e], flags[s:e]))
                for s, e in zip(edges, edges[1:])
            ]
            null = np.array([i is None for i in ids], dtype=np.uint8)
            whole = [np.array([i or 0 for i in ids], dtype=np.int64), n, *base]
            rows.append((number % parts, number, 0, b"".join(x.tobytes() for x in whole) + null.tobytes()))
            return told(rows)

        tokens = 0
        for batch in batches:
            for doc_id, good, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                own = words_of(text)
                seen.append(np.fromiter(map(codes.__getitem__, own), dtype=np.uint64, count=len(own)))
                held.append((doc_id, good or 0, len(own)))
                tokens += len(own)
                if tokens >= chunk or len(held) >= chunk:
                    yield close()
                    number, tokens = number + 1, 0
                    held.clear(), seen.clear()
                if len(codes) > 500_000:
                    codes = Codes(models.words, bounded)
        if held:
            yield close()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value

        def close(part: int, held: list[tuple]) -> pa.RecordBatch:
            cols = [unpacked(blob) for _, blob in held]
            size_of = [len(c[0]) for c in cols]
            t, other, flags = (np.concatenate(c) for c in zip(*cols))
            whose = (flags >> np.uint32(2)).astype(np.uint64) + np.repeat(np.arange(len(cols), dtype=np.uint64) << np.uint64(32), size_of)
            terms = rare_terms(t, other, flags >> np.uint32(1) & np.uint32(1), (flags & np.uint32(1)).astype(bool), whose, models)
            rows, s = [], 0
            for (number, _), n in zip(held, size_of):
                doc = flags[s : s + n] >> np.uint32(2)
                there, slot = np.unique(doc, return_inverse=True)
                sums = [np.bincount(slot, weights=x[s : s + n]).astype(np.float32) for x in terms]
                rows.append((part, number, 1, planes(there.astype(np.uint32)) + sums[0].tobytes() + sums[1].tobytes()))
                s += n
            return told(rows)

        current, held = None, []
        for batch in batches:
            for part, number, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if held and part != current:
                    yield close(current, held)
                    held = []
                current = part
                if kind:
                    held.append((number, blob))
                else:
                    yield told([(part, number, 0, blob)])
        if held:
            yield close(current, held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(whole: bytes, sums: np.ndarray) -> pa.RecordBatch:
            n = len(whole) // 33
            ids, tokens = np.frombuffer(whole[: 8 * n], "<i8"), np.frombuffer(whole[8 * n : 16 * n], "<i8")
            base, null = np.frombuffer(whole[16 * n : 32 * n], "<f8").reshape(2, n), np.frombuffer(whole[32 * n :], np.uint8).astype(bool)
            none = tokens == 0
            a, b = (base + sums) / np.maximum(tokens, 1)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null), pa.array(tokens), *(pa.array(x, mask=none) for x in (a, b, a - b))],
                names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )

        # A chunk's own row comes first (kind 0).
        current, whole, sums = None, b"", np.zeros((2, 0))
        for batch in batches:
            for _, number, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if number != current:
                    if current is not None:
                        yield close(whole, sums)
                    current, whole, sums = number, blob, np.zeros((2, len(blob) // 33))
                if kind:
                    n = len(blob) // 12
                    doc = unplaned(blob[: 4 * n], "<u4")
                    sums[:, doc] += np.frombuffer(blob[4 * n :], "<f4").reshape(2, n)
        if current is not None:
            yield close(whole, sums)

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(good_rows(labels).hint("merge"), "doc_id", "left").select("doc_id", "good", "text")
    dealt = marked.mapInArrow(deal, schema).repartition("part").sortWithinPartitions("part").mapInArrow(weigh, schema)
    return dealt.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(
        gather, "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    )
