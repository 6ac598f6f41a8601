from __future__ import annotations

import re

import numpy as np

from arcweave.llm import license as lic


def brute(text, model):
    """license, probability, similarity, paragraph, candidates by plain Python."""
    place = {g: k for k, g in enumerate(model.grams)}
    sure, seen, count = [], False, 0
    for k, p in enumerate((text or "").split("\n") if text is not None else []):
        if not re.search(lic.PATTERN, p):
            continue
        count += 1
        own = lic.ngrams_of(p)
        z = model.bias + sum((model.weights[place[g]] for g in own if g in place), np.zeros(len(model.classes)))
        at = int(z.argmax())
        family = model.classes[at]
        near = max((len(own & set(t)) / len(t) for t in model.templates.get(family, [])), default=0.0)
        seen |= family != lic.OTHER
        if family != lic.OTHER and near >= lic.CONFIRMED:
            sure.append((-1 / np.exp(z - z[at]).sum(), k, family, near))
    if sure:
        p, k, family, near = min(sure, key=lambda x: (round(x[0], 9), x[1]))
        return family, -p, near, k, count
    return "unknown" if seen else "none", None, None, None, count


def test_variants_of_templates_and_other_lines():
    model = lic.train()
    texts, labels = lic._examples(99)
    right = total = wrong = 0
    for text, label in zip(texts, labels):
        found = brute(text, model)[0]
        if model.classes[label] == lic.OTHER:
            wrong += found not in ("none", "unknown")
        else:
            total += 1
            right += found == model.classes[label]
    assert right / total > 0.9 and wrong <= 6


def test_matches_brute_force(docs_of):
    model = lic.train()
    rows = [(k, f"Some prose.\n{t}\nMore prose about nothing") for k, t in enumerate(t for own in lic.TEMPLATES.values() for t in own)]
    rows += [(200 + k, t) for k, t in enumerate(lic.OTHERS)] + [(300, None), (301, ""), (302, "mit der Zeit"), (303, "word " * 40_000 + "licensed under the MIT license"), (None, "Licensed under CC BY-NC 4.0."), (304, "x\n" * 5000), (305, "license"), (305, "license")]
    found = lic.scan(docs_of(rows, extra=True), model).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for d, text in rows:
        family, p, near, k, count = brute(text, model)
        r = by[d]
        assert (r.license, r.paragraph, r.n_candidates) == (family, k, count), (text, r)
        assert p is None or abs(r.probability - p) < 1e-4 and abs(r.similarity - near) < 1e-9
    assert [r.license for d in range(3) for r in [by[d]]] == ["MIT"] * 3 and by[None].license == "CC-BY-NC"
    assert by[300].n_paragraphs == 0 and by[301].n_paragraphs == 1 and by[302].license == "none"
    assert lic.scan(docs_of([])).collect() == []


def test_planted_lines_are_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = {r.doc_id for r in docs.where("text LIKE '%icensed under%' OR text LIKE '%Released under the MIT%'").collect()}
    assert {r.doc_id for r in lic.scan(docs).where("license NOT IN ('none', 'unknown')").collect()} == wanted


def test_unlisted_licences_are_unknown(docs_of):
    lines = ["ISC License", "Boost Software License 1.0", "Licensed under the zlib/libpng license", "Permission is hereby granted under MIT terms", "SPDX-License-Identifier: EUPL-1.2", "Released under the WTFPL license."]
    plain = ["mit der Zeit", "She drives with a licence", "You need a fishing license to fish in this lake.", "der Zug kam mit Verspätung"]
    found = {r.doc_id: r.license for r in lic.scan(docs_of(list(enumerate(lines + plain)))).collect()}
    assert [found[k] for k in range(len(found))] == ["unknown"] * len(lines) + ["none"] * len(plain)


def test_the_gate_lets_through_what_has_an_ngram_of_the_model():
    model = lic.train()
    held = set(model.grams)
    texts = [*lic._examples(5)[0][::7], *lic.OTHERS, "LICENSED,under", "xlicensed y", "the free-software", "nothing at all", ""]
    for t in texts:
        assert bool(re.search(lic.PATTERN, t)) == bool(lic.ngrams_of(t) & held), t


def test_held_out_templates_keep_their_class():
    """Whole templates that no variant of was learned: seldom told as another family (12 of 46 as their own, 6 as another, else as unknown or none)."""
    right = wrong = total = 0
    lines = lic._lines()
    for fold in range(3):
        learned = [(lic.ngrams_of(v), k) for j, (t, k) in enumerate(lines) if j % 3 != fold for v in lic._variants(lic.random.Random(j), t, 8)]
        grams, w = lic._fit([own for own, _ in learned], [k for _, k in learned], 200, 1e-4)
        held = [(t, k) for j, (t, k) in enumerate(lines) if j % 3 == fold and k < len(lic.TEMPLATES)]
        told = (lic._matrix([lic.ngrams_of(t) for t, _ in held], grams) @ w).argmax(axis=1)
        total += len(held)
        right += sum(a == k for a, (_, k) in zip(told, held))
        wrong += sum(a != k and a < len(lic.TEMPLATES) for a, (_, k) in zip(told, held))
    assert wrong < 0.15 * total and right > wrong
