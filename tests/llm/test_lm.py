from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from arcweave.llm import lm


def brute(rows, labels, size):
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for i, (_, t) in enumerate(rows)}
    total = Counter(w for own in words.values() for w in own)
    top = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0].encode()))[: size - 2]]
    number = {w: k for k, w in enumerate(top, 2)}
    good = {d for d, q in labels if q == 1 and d is not None}
    seqs = {i: [1, *(number.get(w, 0) for w in own)] for i, own in words.items()}

    def model(keep):
        two, one, before = Counter(), Counter(), Counter()
        for i in keep:
            for a, b in zip(seqs[i], seqs[i][1:]):
                two[a, b] += 1
                one[b] += 1
                before[a] += 1
        n = sum(one.values()) + size
        return lambda a, b: -math.log2((two[a, b] + 20 * (one[b] + 1) / n) / (before[a] + 20))

    target, background = model([i for i, (d, _) in enumerate(rows) if d in good]), model(range(len(rows)))
    out = []
    for i, (d, _) in enumerate(rows):
        steps = list(zip(seqs[i], seqs[i][1:]))
        x = [sum(m(a, b) for a, b in steps) / len(steps) for m in (target, background)] if steps else [None, None]
        out.append((d, len(steps), *x))
    return out


def test_matches_brute_force(spark, docs_of):
    rows = [(1, "The cat and the dog, the END"), (2, "a cat a dog a cat"), (2, "a cat a dog a cat"), (3, None), (4, " "), (5, "rare words only once é"), (None, "the cat")]
    marks = [(1, 1), (1, 0), (2, 0), (None, 1), (5, None), (99, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    for size in (5, 64):
        found = sorted(map(tuple, lm.score(docs_of(rows, extra=True), labels, size).collect()), key=str)
        for have, want in zip(found, sorted(brute(rows, marks, size), key=str)):
            assert have[:2] == want[:2]
            assert want[2] is None and have[2:] == (None, None, None) or all(abs(h - w) < 1e-4 for h, w in zip(have[2:], [*want[2:], want[2] - want[3]]))
    assert lm.score(docs_of([]), labels).collect() == []


def test_good_rows_score_lower(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    means = {r.quality: r.m for r in lm.score(docs, labels).join(labels, "doc_id").groupBy("quality").avg("score").withColumnRenamed("avg(score)", "m").collect()}
    assert means[1] < means[0]


def test_every_word_counts(spark, docs_of):
    """More words than any fixed vocabulary of 1,024; most documents have some of their own."""
    rng = random.Random(3)
    rows = [(d, " ".join(["the", "of", *(f"w{rng.randrange(1 << rng.randint(1, 14))}" for _ in range(90)), "the", f"own{d}"])) for d in range(60)]
    rows += [(90, "the of solo"), (91, "the of w1"), (92, "solo"), (92, "solo"), (93, None), (None, "tail tail tail")]
    marks = [(d, d % 3 == 0) for d in range(95)]
    labels = spark.createDataFrame([(d, int(q)) for d, q in marks], "doc_id long, quality int")
    size = len({w for _, t in rows for w in (t or "").split()}) + 2
    assert size > 1100
    want = sorted(brute(rows, marks, size), key=str)
    for given in ({}, {"common": 8, "chunk": 500}):
        found = sorted(map(tuple, lm.score(docs_of(rows, extra=True), labels, **given).collect()), key=str)
        assert [f[:2] for f in found] == [w[:2] for w in want]
        assert all(w[2] is None and f[2] is None or abs(f[2] - w[2]) < 1e-4 and abs(f[3] - w[3]) < 1e-4 for f, w in zip(found, want))


def brute_matched(rows, labels):
    """Each row by models of all other rows, the larger scaled to the smaller; only the totals keep the row's own words."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for _, t in rows]
    slots = len({w for own in words for w in own}) + 2
    good = {d for d, q in labels if q == 1 and d is not None}
    side = [0 if d in good else 1 for d, _ in rows]
    total = [sum(len(w) for w, s in zip(words, side) if s == k) for k in (0, 1)]
    scale = [min(total) / n if min(total) else 1.0 for n in total]
    out = []
    for i, (d, _) in enumerate(rows):
        sums = [0.0, 0.0]
        for k in (0, 1):
            two, one, before = Counter(), Counter(), Counter()
            for j, own in enumerate(words):
                if j != i and side[j] == k:
                    for a, b in zip([None, *own], own):
                        two[a, b] += 1
                        one[b] += 1
                        before[a] += 1
            f = scale[k]
            for a, b in zip([None, *words[i]], words[i]):
                share = (f * one[b] + 1) / (f * total[k] + slots)
                sums[k] -= math.log2((f * two[a, b] + 20 * share) / (f * before[a] + 20))
        n = len(words[i])
        out.append((d, n, *((s / n for s in sums) if n else (None, None))))
    return out


def test_matched_models_leave_each_row_out(spark, docs_of):
    rng = random.Random(4)
    rows = [(d, " ".join(["the", *(f"w{rng.randrange(1 << rng.randint(1, 9))}" for _ in range(rng.randint(0, 40))), f"own{d}", "w1 w1 w1"])) for d in range(40)]
    rows += [rows[3], (50, rows[4][1]), (51, None), (51, " "), (None, "tail w1 tail"), (52, "solo")]
    for marks in ([(d, int(d % 3 == 0)) for d in range(60)], [(d, 1) for d in range(60)] + [(None, 1)], []):
        labels = spark.createDataFrame(marks, "doc_id long, quality int")
        want = sorted(brute_matched(rows, marks), key=str)
        for given in ({}, {"common": 8, "chunk": 100}):
            found = sorted(map(tuple, lm.score(docs_of(rows, extra=True), labels, matched=True, **given).collect()), key=str)
            assert [f[:2] for f in found] == [w[:2] for w in want]
            for f, w in zip(found, want):
                assert w[2] is None and f[2:] == (None, None, None) or all(abs(a - b) < 1e-4 for a, b in zip(f[2:], [*w[2:], w[2] - w[3]])), (f, w)


def test_packed_rows_come_back():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 8, 9, 1000):
        t = rng.integers(0, 5, n).astype(np.uint64) | np.uint64(lm.RARE)
        other = rng.integers(0, 9, n).astype(np.uint64) | np.where(rng.random(n) < 0.5, np.uint64(lm.RARE), np.uint64(0))
        order = np.lexsort((other, t))
        rows = t[order], other[order], rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert all(np.array_equal(x, y) for x, y in zip(lm.unpacked(lm.packed(*rows)), rows))
