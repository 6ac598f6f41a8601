from __future__ import annotations

import itertools
import zlib

import numpy as np

from arcweave.llm import langid


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", langid.MARK, langid.MARK + "a"]
    lattice = langid.Lattice(pieces)
    rng = np.random.default_rng(0)
    p = rng.random((lattice.size, 2))
    words = [langid.MARK + "abab", langid.MARK + "cab", langid.MARK]
    lengths = np.array([len(w) for w in words])
    edges = lattice.edges(words)
    alpha, beta = langid.forward(edges, lengths, p), langid.backward(edges, lengths, p)

    def brute(word):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at, parts = 0, []
            for k, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[at:k])
                    at = k
            ids = [pieces.index(x) + 1 if x in pieces else 0 if len(x) == 1 else None for x in parts]
            if None not in ids:
                total += np.prod([p[i] for i in ids], axis=0)
        return total

    for w, word in enumerate(words):
        assert np.allclose(alpha[w, len(word)], brute(word)) and np.allclose(beta[w, 0], brute(word))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.predict(docs, langid.train(docs)).alias("p").join(docs.alias("d"), "doc_id").select("p.*", "d.lang", "d.n_chars").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    long = [r for r in found if r.held_out and r.n_chars > 60]
    assert sum(r.lang_pred == r.lang for r in long) / len(long) > 0.97


def test_nulls_empty_and_odd_texts(docs_of):
    rows = [(1, "der und die das nicht", "de"), (3, "the and of with that", "en"), (5, None), (None, "x und", None), (6, ""), (7, "12 3!? _"), (8, "the und " * 30_000), (8, "z" * 500), (9, "中文", "zh")]
    docs = docs_of(rows, extra=True)
    found = langid.predict(docs, langid.train(docs)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[5].lang_pred == by[6].lang_pred == by[7].lang_pred == "und" and by[5].score == 0
    assert by[None].held_out is False and all(0 <= r.score <= 1 for r in found)
    empty = docs_of([])
    assert langid.predict(empty, langid.train(empty)).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, langid.train(empty)).collect()} == {"und"}


def brute_logs(pieces, p, word):
    """log P(word) in each language by exact fractions over positions, whatever its length."""
    from fractions import Fraction

    place = {x: k for k, x in enumerate(pieces, 1)}
    out = []
    for lang in range(p.shape[1]):
        alpha = [Fraction(1)]
        for end in range(1, len(word) + 1):
            total = Fraction(0)
            for start in range(max(0, end - max(map(len, pieces))), end):
                part = word[start:end]
                if part in place or len(part) == 1:
                    total += alpha[start] * Fraction(float(p[place.get(part, 0), lang]))
            alpha.append(total)
        out.append(sum(np.log(float(x)) if 1e-300 < float(x) else -np.inf for x in alpha[-1:]) if float(alpha[-1]) > 1e-300 else alpha[-1])
    return out


def test_long_words_keep_their_score():
    pieces = ["a", "ab", "ba", "aba", langid.MARK]
    lattice, rng = langid.Lattice(pieces), np.random.default_rng(1)
    p = rng.random((lattice.size, 2))
    word = langid.MARK + "".join(rng.choice(list("abx"), 60))
    want = brute_logs(pieces, p, word)
    assert np.allclose(langid.long_score(lattice, word, np.log(p)), want)
    assert np.allclose(langid.log_forward(lattice.edges([word]), np.array([len(word)]), np.log(p))[0, -1], want)
    # Far below what a float can hold, both ways agree and stay finite.
    p *= 1e-11
    word = langid.MARK + "ж" * 3000
    both = [langid.long_score(lattice, word, np.log(p)), langid.log_forward(lattice.edges([word]), np.array([len(word)]), np.log(p))[0, -1]]
    assert np.isfinite(both[0]).all() and np.allclose(*both)
    model = langid.Model(pieces, ["x", "y"], p, np.log([0.5, 0.5]))
    lang, score = model.predict(["ж" * 100_000])[0]
    assert lang == "xy"[int(p[0].argmax())] and 0.99 < score <= 1


def test_only_letters_are_letters():
    assert langid.words_of("½ ² ① ⅷ 12_3 ٣") == [] and langid.words_of("a½b É́x_naïve 中文ⅷ") == ["a", "b", "é́x", "naïve", "中文"]


def test_whole_query_matches_brute_force(docs_of):
    """Training counts, priors and predictions by plain Python on a fixture that the sample holds whole."""
    rng = np.random.default_rng(5)
    own = {"en": "the of and that cat dogs running".split(), "de": "der und nicht daß häuser katze gehen".split()}
    rows = [(k, " ".join(rng.choice(own[lang], rng.integers(1, 12))) + f" {k}½", lang) for k, lang in enumerate(["en", "de", "de"] * 12)]
    rows += [(100, "½ ²", "en"), (101, None, "de"), (102, "ohne sprache", None), (None, "the der", "en"), (3, rows[3][1], "de")]
    docs = docs_of(rows, extra=True)
    found = {(r.doc_id, r.held_out): (r.lang_pred, r.score) for r in langid.predict(docs, langid.train(docs)).collect()}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    seen = [(d, t, x) for d, t, x in rows if d is not None and t is not None and x and not held(d)]
    langs = sorted({x for *_, x in seen})
    texts = {(x, t) for _, t, x in seen}
    words = sorted({w for _, t in texts for w in langid.words_of(t)})
    counts = np.array([[sum(langid.words_of(t).count(w) for x, t in texts if x == lang) for lang in langs] for w in words], dtype=float)
    pieces = langid.read_pieces(langid.VOCABULARY)
    lattice = langid.Lattice(pieces)
    p = langid.fit(lattice, [langid.MARK + w for w in words], counts)
    prior = [np.log(sum(x == lang for *_, x in seen) / len(seen)) for lang in langs]
    for d, text, _ in rows:
        lang, score = found[d, held(d)]
        own = langid.words_of(text)
        if not own:
            assert (lang, score) == ("und", 0.0)
            continue
        logs = np.sum([langid.long_score(lattice, langid.MARK + w, np.log(p)) for w in own], axis=0) + prior
        assert lang == langs[int(np.argmax(logs))] and abs(score - 1 / np.exp(logs - logs.max()).sum()) < 1e-6


def test_sample_is_bounded_by_texts(docs_of):
    """A text or a doc_id that is repeated takes one place in the sample."""
    rows = [(1, "the cat", "en")] * 400 + [(1, f"the cat number {'abcdefgh'[k % 8]}", "en") for k in range(80)] + [(4, "der hund", "de")]
    model = langid.train(docs_of(rows), sample_per_lang=3)
    assert model.langs == ["de", "en"] and np.allclose(np.exp(model.prior), [1 / 481, 480 / 481])
