from __future__ import annotations

import hashlib
import re

from arcweave.llm import fingerprint as fp


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def brute_tree(text):
    leaves = [[md5(r) for r in re.findall(fp.LEAF, p)] or [md5(p)] for p in text.split("\n")]
    paragraphs = [md5("".join(x)) for x in leaves]
    sections = [md5("".join(paragraphs[k : k + 16])) for k in range(0, len(paragraphs), 16)]
    root = hashlib.sha256("".join(sections).encode()).hexdigest()
    return root, f"{root}:{'.'.join(s[:16] for s in sections)}", {d[:8] for x in leaves for d in x}, paragraphs


def brute(rows):
    order = sorted(rows, key=lambda r: r[1] or "")
    order = sorted(order, key=lambda r: -(r[0] if r[0] is not None else -(10**18)))
    texts = [t or "" for _, t in order]
    out = []
    for k, (d, _) in enumerate(order):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = brute_tree(t), brute_tree(e), brute_tree(nxt)
        near = lambda x, y: 1.0 if x[0] == y[0] else len(x[2] & y[2]) / len(x[2] | y[2])
        p = [*a[3]], [*b[3]]
        first = next((i for i in range(max(map(len, p))) if p[0][i : i + 1] != p[1][i : i + 1]), None)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a[1], b[1], near(a, b), near(a, c), first))
    return sorted(out, key=str)


def test_matches_brute_force(docs_of, monkeypatch):
    rows = [(k * 7 % 101, "\n".join(f"line {j} of text {k % 9} goes  on and on for a while, então" for j in range(k % 40))) for k in range(60)]
    rows += [(500, None), (501, ""), (502, "  "), (503, "é" * 7), (None, "no id"), (None, "another"), (400, "twice"), (400, "twice"), (504, "w " * 30_000)]
    for per in (4096, 5):
        monkeypatch.setattr(fp, "ROWS_PER_RANGE", per)
        monkeypatch.setattr(fp, "FAN", 256 if per == 4096 else 4)
        assert sorted(map(tuple, fp.compare(docs_of(rows, extra=True)).collect()), key=str) == brute(rows)


def test_single_row_and_no_rows(docs_of):
    assert sorted(map(tuple, fp.compare(docs_of([(1, "a b\nc")])).collect()), key=str) == brute([(1, "a b\nc")])
    assert fp.compare(docs_of([])).collect() == []
