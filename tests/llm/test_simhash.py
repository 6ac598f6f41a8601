from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from arcweave.llm import simhash


def brute(rows, radius=3):
    prints = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    out = {}
    for i, (d, _) in enumerate(rows):
        out[d] = (f"{prints[i]:016x}", min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]))
    return out


def sample_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows, n = [], 100
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 60, 300]))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            if own and rng.random() < 0.6:
                own[rng.randrange(len(own))] = rng.choice(vocabulary).upper()
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(own)))
            n -= 1
    return [*rows, (200, None), (201, ""), (202, " \x0b ")]


def test_covering_masks_meet_every_pair_within_the_radius():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15 and all(m.bit_count() >= 32 for m in masks)
    rng = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(not m & flips for m in masks)
    free = simhash.free_bits(masks[3])
    inner = simhash.covering_masks(3, free)
    for _ in range(1000):
        flips = sum(1 << b for b in rng.sample(free, 3))
        assert any(not m & flips for m in inner)


def test_rows_match_brute_force(docs_of):
    rows = sample_rows()
    for limit in (1024, 2):  # 2: all larger buckets are dealt out again
        found = simhash.near_duplicates(docs_of(rows, extra=True), bucket_limit=limit).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == brute(rows)


def test_lookup_and_pairs_give_the_same_roots():
    rng = np.random.default_rng(0)
    free = list(range(3, 40, 3))
    picked = rng.choice(1 << len(free), 300, replace=False)
    members = np.sort(np.array([sum(1 << free[k] for k in range(len(free)) if p >> k & 1) for p in picked], dtype=np.uint64))
    for radius in (1, 2, 3):
        assert np.array_equal(simhash._roots_by_pairs(members, radius), simhash._roots_by_lookup(members, radius, free))


def test_empty_nulls_and_repeats(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    found = simhash.near_duplicates(docs_of([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "z")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]


def test_rows_are_judged_by_themselves(docs_of):
    rows = [
        (1, "a first text of some words"), (2, "a first text of some words"), (2, "quite another text altogether here"),
        (3, "one of two unrelated texts"), (3, "the other one, nothing alike at all"), (4, "twice the same row"), (4, "twice the same row"),
        (None, "a first text of some words"), (None, "a first text of some words"), (5, None), (6, ""), (0, "twice the same row"),
    ]
    docs = docs_of(rows, extra=True).selectExpr("*", "'y' AS least_", "array(1) AS list")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, rows[0][1]), (2, rows[2][1]), (3, rows[3][1]), (3, rows[4][1]), (None, rows[0][1]), (None, rows[0][1]), (5, None), (0, "twice the same row")], key=str
    )
    many = sample_rows()
    assert {r.doc_id for r in simhash.keep_one(docs_of(many)).collect()} == {c for _, c in brute(many).values()}
    assert simhash.keep_one(docs_of([])).collect() == []
