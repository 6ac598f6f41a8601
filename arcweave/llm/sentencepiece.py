"""SentencePiece BPE encoding by suffix-array matching, and decoding.

A batch's distinct segments (a word with the spaces before it) are concatenated and indexed with
a suffix array, ordered as far as the longest piece. Every piece of the vocabulary is looked up
in it by binary search; its range holds all its occurrences. These are the edges of the
segments' lattices; sorted by position, they are relaxed from left to right: at each position
the one edge stays whose piece byte-pair merging would leave standing after the piece kept at
the edge's start. Two neighbouring pieces are left standing if no merge across their border
comes before the merges that made them, which walking back the two pieces' own merges tells.
The result is the library's own segmentation, id for id.

Segments never share a piece, so a segment seen before is not indexed again: each worker keeps a
bounded memory of them. Spaces in a row are the one case in which merges tie on their score;
such segments are merged one by one, by score and then from the left.

The model file is read on the driver; tasks get its tables (32,000 pieces).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
SLICE = 2 << 20
AT_ONCE = 40_000  # segments indexed together


class Vocabulary:
    """A BPE model's pieces as bytes (a space for the word mark), ranks, merges and bytes' ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.piece: list[bytes] = [model.id_to_piece(i).encode().replace(MARK, b" ") for i in range(n)]
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.id_of = {self.piece[i]: i for i in normal}
        self.rank = np.full(n + 1, -1.0)
        self.rank[normal] = [-model.get_score(i) for i in normal]
        self.unknown = n  # a code point that is no piece: it never merges and is told as bytes
        if any(re.search(rb"[^ ] |\n|%b%b" % (_LETTER, _POINT), self.piece[i]) for i in normal):
            raise ValueError("a piece with a space after another character, a line end, or punctuation after a letter would join segments")
        self.dummy = model.encode("a", out_type=str)[0].encode().startswith(MARK)
        pairs, left, right = {}, np.full(n + 1, -1), np.full(n + 1, -1)
        for i in normal:
            own, text = self.piece[i], self.piece[i].decode()
            at = 0
            for c in text[:-1]:
                at += len(c.encode())
                a, b = self.id_of.get(own[:at]), self.id_of.get(own[at:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = i
        self.pairs = pairs
        made = np.full(n + 1, -1.0)  # when byte-pair merging makes each piece; -1: a single code point
        usable = []
        for i in sorted(normal, key=lambda i: (len(self.piece[i]), i)):
            split = self.last_merge(self.piece[i])
            if split is None:
                continue  # merging never leaves this piece standing
            usable.append(i)
            if split:
                left[i], right[i] = split
                made[i] = max(self.rank[i], made[split[0]], made[split[1]])
        self.left, self.right, self.made = left, right, made
        self.usable = np.array(usable)
        codes = np.array(sorted(pairs), dtype=np.int64)
        self.pair_code, self.pair_piece = codes, np.array([pairs[c] for c in codes.tolist()], dtype=np.int64)
        self.order()

    def order(self) -> None:
        """Pieces in the order of their bytes, as big-endian keys of eight bytes each."""
        texts = sorted((self.piece[i], i) for i in self.usable.tolist())
        self.sorted_id = np.array([i for _, i in texts])
        self.sorted_len = np.array([len(t) for t, _ in texts])
        self.words = max(1, -(-int(self.sorted_len.max()) // 8))
        padded = b"".join(t.ljust(8 * self.words, b"\0") for t, _ in texts)
        self.keys = np.frombuffer(padded, dtype=">u8").reshape(len(texts), self.words).astype(np.uint64)

    def merges(self, text: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """Ids after byte-pair merging, best score first, then leftmost; and the last merge's two pieces."""
        ids = [self.id_of.get(c.encode(), self.unknown) for c in text.decode()]
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        alive, heap, n, last = [True] * len(ids), [], self.unknown + 1, None

        def offer(a: int, b: int) -> None:
            made = self.pairs.get(ids[a] * n + ids[b])
            if made is not None:
                heapq.heappush(heap, (self.rank[made], a, b, ids[a], ids[b], made))

        for k in range(len(ids) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, x, y, made = heapq.heappop(heap)
            if not (alive[a] and alive[b] and ids[a] == x and ids[b] == y and after[a] == b):
                continue
            ids[a], alive[b], last = made, False, (x, y)
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [i for i, ok in zip(ids, alive) if ok], last

    def last_merge(self, piece: bytes):
        """The two pieces whose merge makes ``piece``; () for a single code point; None if others are left."""
        ids, last = self.merges(piece)
        if len(ids) != 1:
            return None
        return last or ()

    def stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves ``a`` and ``b`` standing side by side (arrays of pieces)."""
        good = np.ones(len(a), dtype=bool)
        end_a, end_b = np.full(len(a), np.inf), np.full(len(a), np.inf)  # when each goes into a larger piece
        open_ = np.arange(len(a))
        x, y = a.copy(), b.copy()
        while len(open_):
            code = x[open_] * (self.unknown + 1) + y[open_]
            at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
            joined = self.pair_code[at] == code
            z = self.pair_piece[at]
            when = np.maximum(self.rank[z], np.maximum(self.made[x[open_]], self.made[y[open_]]))
            bad = joined & (when < end_a[open_]) & (when <= end_b[open_])
            good[open_[bad]] = False
            # Take back the later of the two pieces' last merges; of equal ones the left came first.
            ma, mb = self.made[x[open_]], self.made[y[open_]]
            go = ~bad & ((ma >= 0) | (mb >= 0))
            take_a = go & (ma > mb)
            take_b = go & ~take_a
            own = open_[take_a]
            end_a[own], x[own] = self.made[x[own]], self.right[x[own]]
            own = open_[take_b]
            end_b[own], y[own] = self.made[y[own]], self.left[y[own]]
            open_ = open_[go]
        return good


def suffix_array(text: bytes, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of ``text`` by their first 8 * ``words`` bytes, and those bytes as keys, in that order.

    A zero byte ends a segment, and what follows it doesn't count.
    """
    raw = np.frombuffer(text + b"\0" * (8 * words), dtype=np.uint8)
    n = len(text)
    ends = np.flatnonzero(raw == 0)
    room = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n + 8 * words)  # bytes left in the segment
    key = np.zeros(n + 8 * words, dtype=np.uint64)
    for k in range(8):
        key[: len(key) - k] |= np.where(room[: len(key) - k] > k, raw[k:], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    keys = [np.where(room[8 * w : 8 * w + n] > 0, key[8 * w : 8 * w + n], 0) if w == 0 else np.where(room[:n] > 8 * w, key[8 * w : 8 * w + n], 0) for w in range(words)]
    used = [w for w in range(words) if keys[w].any()]
    order = np.argsort(keys[0], kind="stable")
    if len(used) > 1:
        # Ties on the first eight bytes alone are sorted further.
        k0 = keys[0][order]
        same = k0[1:] == k0[:-1]
        tied = np.zeros(n, dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        own = order[at]
        order[at] = own[np.lexsort([keys[w][own] for w in reversed(used)])]
    return order, [k[order] for k in keys]


def occurrences(vocabulary: Vocabulary, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece) of every occurrence of every piece in ``text``, by binary search."""
    order, keys = suffix_array(text, vocabulary.words)
    low, high = np.zeros(len(vocabulary.keys), dtype=np.int64), np.full(len(vocabulary.keys), len(order), dtype=np.int64)
    for w in range(vocabulary.words):
        rest = vocabulary.sorted_len - 8 * w
        own = np.flatnonzero((rest > 0) & (low < high))
        if not len(own):
            break
        first = vocabulary.keys[own, w]
        last = first | np.where(rest[own] >= 8, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.minimum(rest[own], 7).astype(np.uint64)))
        if w == 0:
            low[own], high[own] = np.searchsorted(keys[0], first, "left"), np.searchsorted(keys[0], last, "right")
        else:
            for k, f, t in zip(own.tolist(), first, last):
                part = keys[w][low[k] : high[k]]
                low[k], high[k] = low[k] + np.searchsorted(part, f, "left"), low[k] + np.searchsorted(part, t, "right")
    size = np.maximum(high - low, 0)
    rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    return order[rows], np.repeat(np.arange(len(size)), size)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, memory: int = 150_000):
        self.vocabulary, self.memory = vocabulary, memory
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)

    def __getstate__(self):
        return self.vocabulary, self.memory

    def __setstate__(self, state):
        self.__init__(*state)

    def segments(self, text: bytes) -> list[bytes]:
        text = text.replace(MARK, b" ")
        return _SEGMENT.findall(b" " + text if self.vocabulary.dummy and text else text)

    def _relax(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after another, and how many each has."""
        v = self.vocabulary
        lengths = np.array([len(s) for s in segments], dtype=np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        text = b"\0".join([*segments, b""])
        position, which = occurrences(v, text)
        piece, length = v.sorted_id[which], v.sorted_len[which]
        # A code point that is no piece gets an edge of its own.
        raw = np.frombuffer(text, dtype=np.uint8)
        head = np.flatnonzero((raw & 0xC0) != 0x80)
        width = np.diff(head, append=len(raw))
        covered = np.zeros(len(raw), dtype=bool)
        single = v.made[piece] < 0
        covered[position[single]] = True
        alone = (raw[head] != 0) & ~covered[head]
        position, piece, length = np.concatenate([position, head[alone]]), np.concatenate([piece, np.full(alone.sum(), v.unknown)]), np.concatenate([length, width[alone]])
        end = position + length
        level = end - np.repeat(begin, lengths + 1)[position]
        order = np.lexsort((-length, level))
        position, piece, end, level = position[order], piece[order], end[order], level[order]
        last = np.full(len(raw) + 1, -1, dtype=np.int64)  # the piece kept at each end
        size = np.zeros(len(raw) + 1, dtype=np.int64)
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[begin] = True
        n = v.unknown + 1
        bounds = np.flatnonzero(np.diff(level, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            s, p, e = position[a:b], piece[a:b], end[a:b]
            good = first[s].copy()
            inner = np.flatnonzero(~good & (last[s] >= 0))
            if len(inner):
                pairs, back = np.unique(last[s[inner]] * n + p[inner], return_inverse=True)
                good[inner] = v.stands(pairs // n, pairs % n)[back]
            s, p, e = s[good][::-1], p[good][::-1], e[good][::-1]  # the longest of an end's edges is written last
            last[e], size[e] = p, e - s
        ends = begin + lengths
        counts, levels, at = np.zeros(len(segments), dtype=np.int64), [], ends.copy()
        active = np.flatnonzero(at > begin)
        while len(active):
            levels.append((active, last[at[active]]))
            counts[active] += 1
            at[active] -= size[at[active]]
            active = active[at[active] > begin[active]]
        ids, stop = np.zeros(int(counts.sum()), dtype=np.int32), np.cumsum(counts)
        for k, (own, p) in enumerate(levels):
            ids[stop[own] - 1 - k] = p
        return ids, counts

    def _told(self, segment: bytes, ids: list[int]) -> list[int]:
        """``ids`` with the bytes of code points that are no piece."""
        v, out, at = self.vocabulary, [], 0
        for i in ids:
            if i == v.unknown:
                width = next(w for w in range(1, 5) if at + w == len(segment) or segment[at + w] & 0xC0 != 0x80)
                out += [v.byte_id[c] for c in segment[at : at + width]]
                at += width
            else:
                out.append(i)
                at += len(v.piece[i])
        return out

    def learn(self, segments: list[bytes]) -> None:
        v = self.vocabulary
        plain = [s for s in segments if b"  " not in s and b"\0" not in s]
        odd = [s for s in segments if b"  " in s or b"\0" in s]
        done = [self._relax(plain[k : k + AT_ONCE]) for k in range(0, len(plain), AT_ONCE)]
        ids = np.concatenate([np.zeros(0, dtype=np.int32), *(x for x, _ in done)])
        counts = np.concatenate([np.zeros(0, dtype=np.int64), *(n for _, n in done)])
        if odd:
            more = [v.merges(s)[0] for s in odd]
            ids = np.concatenate([ids, *(np.array(x, dtype=np.int32) for x in more)])
            counts = np.concatenate([counts, [len(x) for x in more]])
        if (ids == v.unknown).any():
            stop = np.cumsum(counts)
            some = np.flatnonzero(np.add.reduceat(np.concatenate([ids == v.unknown, [False]]), np.concatenate([[0], stop[:-1]])) * (counts > 0))
            parts, done = [], 0
            both = plain + odd
            for k in some.tolist():
                a, b = int(stop[k] - counts[k]), int(stop[k])
                told = self._told(both[k], ids[a:b].tolist())
                parts += [ids[done:a], np.array(told, dtype=np.int32)]
                counts[k], done = len(told), b
            ids = np.concatenate([*parts, ids[done:]])
        known = len(self.place)
        self.place.update(zip(plain + odd, range(known, known + len(counts))))
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if len(self.place) > self.memory:
            self.forget()
        parts = [self.segments(t) for t in texts]
        new = list(set().union(*parts).difference(self.place))
        if new:
            self.learn(new)
        number = np.array([len(p) for p in parts], dtype=np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(number.sum()))
        size = self.start[at + 1] - self.start[at]
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[at], size)
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[rows], np.diff(total[np.concatenate([[0], np.cumsum(number)])])


#: ASCII letters and digits and the code points U+00C0 to U+07FF, no piece of which goes on with ASCII punctuation.
_LETTER = rb"(?:[A-Za-z0-9]|[\xc3-\xdf][\x80-\xbf])"
_POINT = rb"[!-/:-@\[-`{-~]"
_OTHER = rb"(?:\xc2[\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3}|[\0-\x09\x0b-\x1f\x7f])"
_SEGMENT = re.compile(rb" *(?:%b+(?:%b|%b%b*)*|(?:%b|%b%b*)+)| +|\n" % (_POINT, _LETTER, _OTHER, _POINT, _LETTER, _OTHER, _POINT))


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> bytes:
    text = b"".join([vocabulary.told[i] for i in ids])
    return text[1:] if vocabulary.dummy and text[:1] == b" " else text


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or b"")
        if size >= SLICE or k == len(texts) - 1:
            yield begin, k + 1
            begin, size = k + 1, 0


def prepared(model: str) -> Vocabulary:
    vocabulary = Vocabulary(model)
    vocabulary.told = list(vocabulary.piece)
    for value, i in vocabulary.byte_id.items():
        vocabulary.told[i] = bytes([value])
    for i in range(len(vocabulary.told)):
        if vocabulary.rank[i] < 0 and i not in set(vocabulary.byte_id.values()):
            vocabulary.told[i] = b""  # control pieces
    return vocabulary


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, token_ids, n_tokens, decoded_sha256, round_trip) for each row of ``docs`` (doc_id, text).

    token_ids are the ids of the whole text, null for a null text and empty for an empty one; both
    have n_tokens 0 and a round trip, and a null text has no digest.
    decoded_sha256 is the digest of the text decoded from them, round_trip whether it is the
    text itself: true but for texts with U+2581, which the model cannot tell from a space, as in
    the library. Repeated rows come out as often as they go in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(prepared(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in _slices(texts):
                encoder, own = shared.value, texts[a:b]
                ids, counts = encoder.encode([t or b"" for t in own])
                stop = np.cumsum(counts)
                decoded = [decode_ids(encoder.vocabulary, ids[e - n : e].tolist()) for e, n in zip(stop.tolist(), counts.tolist())]
                missing = np.array([t is None for t in own])
                offsets = pa.array(np.concatenate([[0], stop]).astype(np.int32), mask=np.concatenate([missing, [False]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                        pa.array(counts),
                        pa.array([None if t is None else hashlib.sha256(d).hexdigest() for t, d in zip(own, decoded)], pa.string()),
                        pa.array([(t or b"") == d for t, d in zip(own, decoded)]),
                    ],
                    names=["doc_id", "token_ids", "n_tokens", "decoded_sha256", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, token_ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"
    )


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null for null."""
    shared = tokens.sparkSession.sparkContext.broadcast(prepared(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if ids is None else decode_ids(shared.value, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, text string")
