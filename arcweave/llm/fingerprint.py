"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words.

A text's paragraphs are its lines; a paragraph's leaves are runs of eight words with the spaces
around them, so that nothing is left out. A leaf's digest is the MD5 of its text, a paragraph's
that of its leaves' digests, a section's (16 paragraphs) that of its paragraphs' digests, and the
root the SHA-256 of the sections' digests. Equal texts have equal roots; where roots differ, the
first differing section, and in it the first differing paragraph, show where the edit begins.
The likeness of two trees is the share of their distinct leaves that both have: equal branches
have equal leaves, so it needs no alignment.

All of it is DataFrame expressions. Each text moves once, to be sorted next to its successor.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION = 16
LEAF = r" *[^ ]+(?: +[^ ]+){0,7} *"
ROWS_PER_RANGE = 4096
FAN = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tree(text: Column) -> Column:
    """struct(root, sections, paragraphs, leaves): digests in hex, leaves as the numbers of their first 32 bits."""

    def leaves(paragraph: Column) -> Column:
        return let(
            F.regexp_extract_all(paragraph, F.lit(LEAF), 0),
            lambda runs: F.transform(F.when(F.size(runs) == 0, F.array(paragraph)).otherwise(runs), lambda run: F.md5(run)),
        )

    def above(digests: Column) -> Column:
        return let(
            F.transform(digests, lambda own: F.md5(F.array_join(own, ""))),
            lambda paragraphs: let(
                F.transform(
                    F.sequence(F.lit(0), F.floor((F.size(paragraphs) - 1) / SECTION).cast("int")),
                    lambda k: F.md5(F.array_join(F.slice(paragraphs, k * SECTION + 1, F.lit(SECTION)), "")),
                ),
                lambda sections: F.struct(
                    F.sha2(F.array_join(sections, ""), 256).alias("root"),
                    F.transform(sections, lambda s: F.substring(s, 1, 16)).alias("sections"),
                    F.transform(paragraphs, lambda p: F.substring(p, 1, 16)).alias("paragraphs"),
                    F.transform(F.flatten(digests), lambda d: F.conv(F.substring(d, 1, 8), 16, 10).cast("long")).alias("leaves"),
                ),
            ),
        )

    return let(F.transform(F.split(text, "\n", -1), leaves), above)


def printed(t: Column) -> Column:
    return F.concat(t["root"], F.lit(":"), F.array_join(t["sections"], "."))


def likeness(a: Column, b: Column) -> Column:
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a["leaves"], b["leaves"])) / F.size(F.array_union(a["leaves"], b["leaves"]))
    )


def first_difference(a: Column, b: Column) -> Column:
    """The first differing paragraph, from 0: by the first differing section, then in it; null if none differs."""

    def first(x: Column, y: Column, low: Column, high: Column) -> Column:
        return F.element_at(F.filter(F.sequence(low, high), lambda k: ~F.get(x, k).eqNullSafe(F.get(y, k))), 1)

    longest = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    return F.when(a["root"] != b["root"], let(
        first(a["sections"], b["sections"], F.lit(0), longest),
        lambda s: first(a["paragraphs"], b["paragraphs"], s * SECTION, s * SECTION + SECTION - 1).cast("long"),
    ))


def with_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id) with ``range``: rows of a higher range have higher ids, about ROWS_PER_RANGE rows each.

    There are 65,536 ranges at most; their bounds are quantiles of doc_id, two levels of FAN
    each, so that a row needs few comparisons. A null doc_id is below all others.
    """
    n = docs.count()
    wanted = min(FAN * FAN, max(1, n // ROWS_PER_RANGE))
    bounds: list[int] = []
    if wanted > 1:
        shares = [k / wanted for k in range(1, wanted)]
        bounds = sorted(set(docs.select(F.percentile_approx("doc_id", shares, max(10_000, 4 * wanted)).alias("q")).first().q or []))
    groups = [bounds[k : k + FAN - 1] for k in range(0, len(bounds), FAN)] or [[]]
    coarse = [bounds[k + FAN - 1] for k in range(0, len(bounds), FAN) if k + FAN - 1 < len(bounds)]
    upper, lower = (F.from_json(F.lit(json.dumps(x)), t) for x, t in ((coarse, "array<bigint>"), (groups, "array<array<bigint>>")))
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("doc_id")))
    ranged = docs.withColumn("group", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(below(upper)))
    return ranged.withColumn(
        "range", F.when(F.col("group") < 0, F.lit(-1)).otherwise(F.col("group") * FAN + below(F.get(lower, F.least(F.col("group"), F.lit(len(groups) - 1)))))
    ).drop("group")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tree, next, next_tree): each row with the next one's text, doc_id descending.

    After the last comes the first; a null doc_id comes after all others, and rows of one doc_id
    go by text. Each range is sorted by itself. The first row of each range also closes the range
    before it (a copy, marked as one), and the very first closes the last.
    """
    rows = with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    tops = rows.groupBy("range").agg(F.max("doc_id").alias("doc_id"))
    order = sorted((r.range for r in tops.select("range").collect()), reverse=True)  # 65,537 numbers at most
    closes = F.from_json(F.lit(json.dumps({str(b): a for a, b in zip(order, order[1:] + order[:1])})), "map<string, int>")
    heads = (
        rows.join(F.broadcast(tops.withColumnRenamed("range", "own").withColumnRenamed("doc_id", "top")), F.col("range").eqNullSafe(F.col("own")) & F.col("doc_id").eqNullSafe(F.col("top")), "left_semi")
        .groupBy("range")
        .agg(F.min("text").alias("text"))
        .select(closes[F.col("range").cast("string")].alias("range"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("copy"))
    )
    whole = rows.select("range", "doc_id", "text", F.lit(False).alias("copy")).unionByName(heads).withColumn("tree", tree(F.col("text")))
    by = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    return whole.withColumn("next", F.lead(F.struct("text", "tree")).over(by)).where(~F.col("copy")).select("doc_id", "text", "tree", "next")


def compare(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its fingerprint, and how like it others are.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's. edit_paragraph is where the two differ first, null if they don't.
    A null text is empty; an empty text has one empty paragraph. Repeated rows come out as often
    as they go in, each followed by the next; a single row is followed by itself.
    """
    paired = with_next(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", "tree", "next")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars").cast("int") - half)), F.substr(F.col("next.text"), F.lit(1), half))
    changed = paired.select("doc_id", "n_chars", "tree", F.col("next.tree").alias("next_tree"), let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), tree(e).alias("tree"))).alias("e"))
    return changed.select(
        "doc_id",
        "n_chars",
        F.col("e.sha").alias("edited_sha256"),
        printed(F.col("tree")).alias("fingerprint"),
        printed(F.col("e.tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("e.tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        first_difference(F.col("tree"), F.col("e.tree")).alias("edit_paragraph"),
    )


def _sql_tree(source: str) -> str:
    """CTEs <source>_l, _p and _t: leaves, paragraphs and the tree of each row of <source> (doc_id, text)."""
    return rf"""
{source}_l AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda p: CASE WHEN len(regexp_extract_all(p, '{LEAF}')) = 0 THEN [md5(p)]
    ELSE list_transform(regexp_extract_all(p, '{LEAF}'), lambda r: md5(r)) END) AS digests FROM {source}
), {source}_p AS (
  SELECT doc_id, list_transform(digests, lambda d: md5(array_to_string(d, ''))) AS paragraphs, list_transform(flatten(digests), lambda d: d[1:8]) AS leaves FROM {source}_l
), {source}_s AS (
  SELECT doc_id, paragraphs, leaves, list_transform(range(0, (len(paragraphs) - 1) // {SECTION} + 1), lambda k: md5(array_to_string(paragraphs[k * {SECTION} + 1:k * {SECTION} + {SECTION}], ''))) AS sections FROM {source}_p
), {source}_t AS (
  SELECT doc_id, paragraphs, leaves, sha256(array_to_string(sections, '')) AS root,
    sha256(array_to_string(sections, '')) || ':' || array_to_string(list_transform(sections, lambda s: s[1:16]), '.') AS printed FROM {source}_s
)"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
e AS (SELECT doc_id, substring(text, 1, length(text) - length(text) // 2) || substring(next, 1, length(text) // 2) AS text FROM n),
{_sql_tree("d")}, {_sql_tree("e")}
SELECT n.doc_id, CAST(length(n.text) AS BIGINT) AS n_chars, sha256(e.text) AS edited_sha256, a.printed AS fingerprint, b.printed AS edited_fingerprint,
  CASE WHEN a.root = b.root THEN 1.0 ELSE len(list_intersect(a.leaves, b.leaves)) / len(list_distinct(a.leaves || b.leaves)) END AS near_edited,
  CASE WHEN a.root = c.root THEN 1.0 ELSE len(list_intersect(a.leaves, c.leaves)) / len(list_distinct(a.leaves || c.leaves)) END AS near_next,
  CAST(CASE WHEN a.root <> b.root THEN list_min(list_filter(range(0, greatest(len(a.paragraphs), len(b.paragraphs))), lambda k: a.paragraphs[k + 1] IS DISTINCT FROM b.paragraphs[k + 1])) END AS BIGINT) AS edit_paragraph
FROM n JOIN e USING (doc_id) JOIN d_t a USING (doc_id) JOIN e_t b USING (doc_id) JOIN d_t c ON c.doc_id = n.next_id
"""
