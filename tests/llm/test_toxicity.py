from __future__ import annotations

import numpy as np

from arcweave.llm import toxicity as tox


def test_chain_uses_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 30)) < 0.3).astype(np.float32)
    y = (x[:, 0] > 0) & (x[:, 1] > 0)
    targets = np.stack([x[:, 2] > 0, y, y | (x[:, 2] > 0)], axis=1)
    weights, out = tox.fit_chain(x, targets, np.arange(600) % tox.FOLDS)
    assert [len(w) for w in weights] == [31, 32, 33]
    # Each row's probability comes from models that haven't seen it.
    own = np.arange(600) % tox.FOLDS == 1
    w = tox.logistic(x[~own], targets[~own, 0].astype(float))
    assert np.allclose(out[own, 0], tox.sigmoid(x[own] @ w[:-1] + w[-1]))
    assert ((out[:, 2] > 0.5) == targets[:, 2]).mean() > 0.97


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    chain = tox.train(docs, labels.where("doc_id % 5 > 0"))
    rows = tox.predict(docs, chain).join(labels.where("doc_id % 5 = 0").withColumnRenamed("toxic", "label"), "doc_id").collect()
    caught = [r.rejected for r in rows if r.label == 1]
    wrong = [r.rejected for r in rows if r.label == 0]
    print(chain.threshold, sum(caught), len(caught), sum(wrong), len(wrong))
    assert sum(caught) / len(caught) > 0.95 and sum(wrong) / len(wrong) < 0.01


def test_nulls_empty_and_no_labels(spark, docs_of):
    rows = [(k, f"nice words here {k} " + ("vile rotten" if k % 3 == 0 else "calm")) for k in range(60)]
    docs = docs_of([*rows, (100, None), (101, ""), (None, "vile rotten"), (102, "calm " * 50_000), (3, rows[3][1])], extra=True)
    marks = [(k, int(k % 3 == 0)) for k in range(60)] + [(None, 1), (5, None), (999, 1), (4, 0), (4, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    chain = tox.train(docs, labels)
    found = tox.predict(docs, chain).collect()
    assert len(found) == 65 and all(r.rejected == (r.doc_id is None or r.doc_id < 60 and r.doc_id % 3 == 0) for r in found)
    kept = tox.keep_clean(docs, chain)
    assert kept.columns == docs.columns and kept.count() == 43
    none = tox.train(docs, labels.limit(0))
    assert not any(r.rejected for r in tox.predict(docs, none).collect())
    assert tox.predict(docs_of([]), tox.train(docs_of([]), labels)).collect() == []


def test_no_out_of_fold_input_has_seen_its_row():
    """A fold's features and models are those that its rows' absence leaves."""
    rng = np.random.default_rng(2)
    x = (rng.random((400, 12)) < 0.4).astype(np.float32)
    y = np.stack([x[:, 0] > 0, x[:, 1] > 0, (x[:, 0] > 0) | (x[:, 1] > 0)], axis=1)
    fold, seen = np.arange(400) % tox.FOLDS, rng.random((tox.FOLDS, 12)) < 0.6
    weights, out = tox.fit_chain(x, y, fold, seen, 10)
    assert [len(w) for w in weights] == [11, 12, 13]
    done = np.zeros((400, 0))
    for k in range(3):
        for f in range(tox.FOLDS):
            own, full = fold == f, np.hstack([x[:, seen[f]], done])
            w = tox.logistic(full[~own], y[~own, k].astype(float))
            assert np.allclose(out[own, k], tox.sigmoid(full[own] @ w[:-1] + w[-1]))
        done = out[:, : k + 1]


def test_sample_is_bounded(spark, docs_of):
    rows = [(7, f"same id other text {k}") for k in range(500)] + [(k, f"vile text {k}" if k % 2 else f"calm text {k}") for k in range(100, 160)]
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, toxic int")
    seen = []
    real = tox.numbered
    try:
        tox.numbered = lambda texts: seen.append(list(texts)) or real(seen[-1])
        tox.train(docs_of(rows), labels, sample=10)
        tox.train(docs_of(rows), labels)
    finally:
        tox.numbered = real
    assert [len(x) for x in seen] == [10, 61]


def test_features_are_whole_code_points():
    assert tox.features_of({"Größen".encode(), "ДУРНОЙ".encode(), b"vileness"}) == {
        "größen".encode(), "^4größ".encode(), "^5größe".encode(), "дурной".encode(), "^4дурн".encode(), "^5дурно".encode(), b"vileness", b"^4vile", b"^5vilen",
    }


def test_whole_query_matches_brute_force(spark, sf_dir):
    """Probabilities and decisions of every row by plain sums over the chain's weights."""
    import math
    import re

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = tox.train(docs, labels)
    place = {f.decode(): k for k, f in enumerate(chain.features)}
    by = {r.doc_id: r for r in tox.predict(docs, chain).collect()}
    for d, text in docs.select("doc_id", "text").collect():
        words = {w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))}
        own = {place[f] for w in words for f in (w, *(f"^{n}{w[:n]}" for n in (4, 5) if len(w) > n)) if f in place}
        before = []
        for w in chain.weights:
            z = w[-1] + sum(w[k] for k in own) + sum(a * p for a, p in zip(w[len(place) :], before))
            before.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        r = by[d]
        assert all(abs(a - b) < 1e-6 for a, b in zip(before, (r.severe, r.varied, r.toxic))) and r.rejected == (r.toxic >= chain.threshold)
