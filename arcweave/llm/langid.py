"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary (a path, read on the
driver and sent to the tasks; 32,000 short strings). A word's probability in a language sums
over all its segmentations into pieces, by a forward pass over its lattice; a text's is the
product over its words. Sums are of logarithms, so a word of any length keeps its score. The
probabilities are fitted by expectation-maximisation over the same lattices, on a bounded sample
of labelled rows (``sample_per_lang`` distinct texts of each language, those with the least
hashes); prediction reads whole texts, and each distinct word's lattice once a batch.

Words are maximal runs of letters (Unicode's category L and the marks on them), in lower case,
with the vocabulary's word mark in front; what isn't a letter, as a digit or a half, doesn't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_ASCII = re.compile(r"[a-z]+")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
#: Positions of words' lattices that are held at once; a longer word is scored by itself.
CELLS = 500_000


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return _ASCII.findall(low) if low.isascii() else _WORD.findall(low)


class Lattice:
    """Edges of words' segmentations. Piece 0 stands for any code point that is no piece itself."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        self.trie: dict = {}
        for number, piece in enumerate(pieces, 1):
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = number

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of all edges, by end."""
        flat: list[int] = []
        put, trie = flat.extend, self.trie
        for w, word in enumerate(words):
            n = len(word)
            for start in range(n):
                node, end, alone = trie, start, 0
                while end < n:
                    node = node.get(word[end])
                    if node is None:
                        break
                    end += 1
                    piece = node.get("")
                    if piece is not None:
                        put((w, start, end, piece))
                        alone |= end == start + 1
                if not alone:
                    put((w, start, start + 1, 0))
        found = np.array(flat, dtype=np.int32).reshape(-1, 4)
        found = found[np.argsort(found[:, 2], kind="stable")]
        return found[:, 0], found[:, 1], found[:, 2], found[:, 3]


def _passed(word: np.ndarray, at: np.ndarray, to: np.ndarray, piece: np.ndarray, logs: np.ndarray, log_p: np.ndarray, order: range) -> np.ndarray:
    """``logs`` [word, position, language] filled in ``order``: each ``to`` sums over its edges what ``at`` has times its piece's share.

    Edges are in the order of ``to``, and of ``word`` among those of one ``to``.
    """
    bounds = np.searchsorted(to, np.arange(logs.shape[1] + 1))
    for t in order:
        own = slice(bounds[t], bounds[t + 1])
        if own.start == own.stop:
            continue
        w = word[own]
        step = logs[w, at[own]] + log_p[piece[own]]
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        top = np.maximum.reduceat(step, starts, axis=0)
        # Where nothing leads here the top is minus infinity, and so is the sum.
        base = np.where(np.isfinite(top), top, 0.0)
        rest = np.exp(step - np.repeat(base, np.diff(starts, append=len(w)), axis=0))
        with np.errstate(divide="ignore"):
            logs[w[starts], t] = base + np.log(np.add.reduceat(rest, starts, axis=0))
    return logs


def log_forward(edges: tuple, lengths: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """[word, position, language]: the logarithm of the probability of the first ``position`` code points."""
    word, start, end, piece = edges
    logs = np.full((len(lengths), int(lengths.max(initial=0)) + 1, log_p.shape[1]), -np.inf)
    logs[:, 0] = 0
    return _passed(word, start, end, piece, logs, log_p, range(1, logs.shape[1]))


def log_backward(edges: tuple, lengths: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """[word, position, language]: the logarithm of the probability of what follows ``position``."""
    word, start, end, piece = edges
    order = np.lexsort((word, start))
    logs = np.full((len(lengths), int(lengths.max(initial=0)) + 1, log_p.shape[1]), -np.inf)
    logs[np.arange(len(lengths)), lengths] = 0
    return _passed(word[order], end[order], start[order], piece[order], logs, log_p, range(logs.shape[1] - 2, -1, -1))


def forward(edges: tuple, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``log_forward`` as probabilities, for words short enough to have any."""
    return np.exp(log_forward(edges, lengths, np.log(p)))


def backward(edges: tuple, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.exp(log_backward(edges, lengths, np.log(p)))


def packs(words: list[str]) -> Iterator[list[int]]:
    """The places of ``words`` in groups of like length, so that their lattices side by side have at most CELLS positions."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    held: list[int] = []
    for k in order:
        if held and (len(held) + 1) * (len(words[k]) + 1) > CELLS:
            yield held
            held = []
        held.append(k)
    if held:
        yield held


def long_score(lattice: Lattice, word: str, log_p: np.ndarray) -> np.ndarray:
    """The last row of ``log_forward`` for one word of any length, holding only what pieces can reach."""
    reach = lattice.longest
    logs = [np.full(log_p.shape[1], -np.inf) for _ in range(reach + 1)]
    logs[0] = np.zeros(log_p.shape[1])
    for start in range(len(word)):
        here, node, alone = logs[0], lattice.trie, False
        for end in range(start, min(len(word), start + reach)):
            node = node.get(word[end])
            if node is None:
                break
            if (piece := node.get("")) is not None:
                logs[end - start + 1] = np.logaddexp(logs[end - start + 1], here + log_p[piece])
                alone |= end == start
        if not alone:
            logs[1] = np.logaddexp(logs[1], here + log_p[0])
        logs = [*logs[1:], np.full(log_p.shape[1], -np.inf)]
    return logs[0]


def fit(lattice: Lattice, words: list[str], counts: np.ndarray, rounds: int = 3, smooth: float = 0.02) -> np.ndarray:
    """Piece probabilities [piece, language] from words and their counts [word, language]."""
    log_p = np.full((lattice.size, counts.shape[1]), -np.log(lattice.size))
    groups = list(packs(words))
    for _ in range(rounds):
        expected = np.full_like(log_p, smooth)
        for at in groups:
            own = [words[k] for k in at]
            lengths = np.array([len(w) for w in own])
            edges = lattice.edges(own)
            alpha, beta = log_forward(edges, lengths, log_p), log_backward(edges, lengths, log_p)
            word, start, end, piece = edges
            whole = alpha[np.arange(len(own)), lengths]
            share = np.exp(alpha[word, start] + log_p[piece] + beta[word, end] - whole[word]) * counts[at][word]
            for k in range(log_p.shape[1]):
                expected[:, k] += np.bincount(piece, weights=share[:, k], minlength=lattice.size)
        log_p = np.log(expected / expected.sum(axis=0))
    return np.exp(log_p)


class Model:
    """Piece probabilities and priors of ``langs``, with a bounded memory of words scored before."""

    def __init__(self, pieces: list[str], langs: list[str], p: np.ndarray, prior: np.ndarray, memory: int = 300_000):
        self.pieces, self.langs, self.p, self.prior, self.memory = pieces, langs, p, prior, memory
        self.lattice: Lattice | None = None
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    def __getstate__(self):
        return (self.pieces, self.langs, self.p, self.prior, self.memory)

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, words: list[str]) -> None:
        if self.lattice is None:
            self.lattice = Lattice(self.pieces)
            with np.errstate(divide="ignore"):
                self.log_p = np.log(self.p)
        for at in range(0, len(words), 20_000):
            own = words[at : at + 20_000]
            found = np.empty((len(own), len(self.langs)))
            for places in packs(own):
                some = [own[k] for k in places]
                lengths = np.array([len(w) + 1 for w in some])
                if lengths.max() > CELLS // 25:
                    found[places] = [long_score(self.lattice, MARK + w, self.log_p) for w in some]
                else:
                    found[places] = log_forward(self.lattice.edges([MARK + w for w in some]), lengths, self.log_p)[np.arange(len(some)), lengths]
            self.known.update(zip(own, range(len(self.scores), len(self.scores) + len(own))))
            self.scores = np.concatenate([self.scores, found])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.known) > self.memory:
            self.known, self.scores = {}, np.zeros((0, len(self.langs)))
        words = [words_of(t) for t in texts]
        self._learn(list({w for own in words for w in own} - self.known.keys()))
        get, out = self.known.__getitem__, []
        for own in words:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.scores[np.fromiter(map(get, own), dtype=np.int64, count=len(own))].sum(axis=0) + self.prior
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(docs: DataFrame, vocabulary: str = VOCABULARY, sample_per_lang: int = 600, longest: int = 4096) -> Model:
    """A model from ``docs``'s rows whose crc32(doc_id) mod 4 is not 2, with a lang and a doc_id.

    Priors count all those rows. The sample has at most ``sample_per_lang`` distinct texts of each
    language, those with the least hashes, however often a text or a doc_id is repeated; words of
    more than ``longest`` code points are left out of the sample's counts (never of predictions).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    size = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(size)
    pieces = read_pieces(vocabulary)
    if not langs:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    # Hashes below twice the share that is wanted; of these, copies gone, the least.
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, 2 * sample_per_lang / size[lang]) * 2**62)))])
    hashed = rows.select("lang", F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)).alias("h"), "text").where(F.col("h") <= share[F.col("lang")])
    least = Window.partitionBy("lang").orderBy("h")
    sample = hashed.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("r", F.row_number().over(least)).where(F.col("r") <= sample_per_lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in words_of(text):
                    if len(word) <= longest:
                        found[lang, word] = found.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([MARK + k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    # Bounded by the sample.
    counted = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("word", "lang").toArrow()
    words: dict[str, int] = {}
    at = [words.setdefault(w, len(words)) for w in counted.column("word").to_pylist()]
    counts = np.zeros((len(words), len(langs)))
    counts[at, [langs.index(x) for x in counted.column("lang").to_pylist()]] = counted.column("n").to_numpy()
    prior = np.log(np.array([size[x] for x in langs], dtype=float))
    return Model(pieces, langs, fit(Lattice(pieces), list(words), counts), prior - np.log(sum(size.values())))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text).

    lang_pred is `und`, with score 0, if text is null or has no letter, or if the model has
    learned no language; else score is the language's posterior probability. held_out is false
    for a null doc_id. Repeated rows come out as often as they go in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [x for at in range(0, len(texts), 500) for x in shared.value.predict(texts[at : at + 500])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
