from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from arcweave.llm import decontaminate as dc


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = []
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        windows += [(str(name), tuple(w[i : i + size])) for i in range(len(w) - size + 1)] if size else []
    out = []
    for d, text in docs:
        w, hit, names = words(text), set(), set()
        for name, p in windows:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    names.add(name)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Größe", "x1", "a", "été", "in", "q9"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([25, 10, 9, 3, 40, 0, 12])]
    items += [(7, None), (8, "..."), (4, items[4][1]), (10, items[0][1][20:])]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            own = [rng.choice([*vocabulary, "other", "No"]) for _ in range(rng.randint(0, 30))]
            parts.append(" ".join(own))
            if rng.random() < 0.4:
                parts.append(re.sub(" ", rng.choice([" ", ", ", "\n"]), rng.choice(items)[1] or "").upper())
        docs.append((d, ". ".join(parts)))
    return [*docs, (100, None), (101, ""), (102, "!?"), (103, docs[5][1]), (103, docs[5][1])], items


def test_report_matches_brute_force(spark, docs_of):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.report(docs_of(docs, extra=True), bench).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs, items)
    small = dc.find(docs_of(docs), bench, shard_words=50, block_bytes=100).collect()
    assert sorted((r.doc_id, sum(s.end - s.start for s in r.spans), len(r["items"])) for r in small) == sorted((b[0], b[2], b[3]) for b in brute(docs, items))


def test_index_order_and_location():
    rng = np.random.default_rng(1)
    symbols = np.concatenate([rng.integers(0, 4, 400), [0]])
    order = dc.suffix_order(symbols)

    def key(i):
        out = []
        while symbols[i]:
            out.append((1, int(symbols[i])))
            i += 1
        return [*out, (0, i)]

    assert order.tolist() == sorted(range(len(symbols)), key=key)
    index = dc.FMIndex(symbols, sample=7)
    assert index.locate(np.arange(len(symbols))).tolist() == order.tolist()
    low, high = index.search(np.array([[1, 2, 3], [3, 3, 3], [9, 1, 1]]))
    for p, lo, hi in zip(([1, 2, 3], [3, 3, 3], [9, 1, 1]), low, high):
        assert sorted(order[lo:hi]) == [i for i in range(len(symbols)) if symbols[i : i + 3].tolist() == p]


def test_remove_cuts_spans_and_keeps_the_rest(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    passage = "One, two three four five six seven eight nine ten"
    docs = docs_of([(1, f"Before it. {passage}. After."), (2, "clean  text."), (3, passage), (4, None)], extra=True)
    found = {r.doc_id: (r.text, r.n_chars) for r in dc.remove(docs, bench).collect()}
    assert found == {1: ("Before it. . After.", 19), 2: ("clean  text.", 12), 4: (None, 0)}
    assert dc.remove(docs_of([]), bench).collect() == [] == dc.report(docs_of([]), bench).collect()
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in dc.report(docs, none).collect())


def test_pieces_have_the_windows_of_their_item():
    rng = random.Random(9)
    for n in (0, 1, 9, 10, 11, 19, 20, 21, 55):
        own = [rng.choice("abcdefgh") for _ in range(n)]
        size = min(10, n)
        whole = {tuple(own[i : i + size]) for i in range(n - size + 1)} if n else set()
        for words_each in (10, 13, 100):
            parts = [words(p) for p in dc.pieces(" ".join(own), 10, words_each)]
            assert {tuple(p[i : i + size]) for p in parts for i in range(len(p) - size + 1) if size} == whole
            assert all(len(p) <= words_each + 9 for p in parts)


def test_a_worker_holds_one_block_at_a_time(spark):
    bench = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(200))) for k in range(50)], "item_id long, text string")
    blocks = dc._blocks(bench, 4000, 10)
    assert len(blocks) > 5
    shared = dc._Shared(blocks)
    seen = []
    for block in shared:
        seen.append(sum(map(len, block.phrases)))
        assert not any("_value" in b.__dict__ for b in blocks)
    assert sum(seen) == 50 * 191 and max(seen) < 3 * sum(seen) / len(seen)
