from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from arcweave.functions import scalars as S
from arcweave.operators import slicer, timetravel, vector, views
from arcweave.operators.recursion import closure_of_successors
from arcweave.operators.slicer import Pipeline
from arcweave.sources import export
from arcweave.sources.graph import Edge, snapshot
from arcweave.streaming import feed


def test_percentile_and_nulls(spark):
    df = spark.range(1, 101).select(F.col("id").alias("x"), (F.col("id") % 2).alias("k")).unionByName(spark.createDataFrame([(None, None)], "x long, k long"))
    one = Pipeline().aggregate(p50=("percentile", "x", 0.5), p95=("percentile", "x", 0.95), none=("percentile", "x", 0.0), n=("count", "x")).run(df).first()
    assert (one.p50, one.p95, one.none, one.n) == (50.5, 95.05, None, 100)
    grouped = Pipeline().group_by("k").aggregate(s=("sum", "x")).sort("k").run(df).collect()
    assert [(r.k, r.s) for r in grouped] == [(None, None), (0, 2550), (1, 2500)]
    assert Pipeline().aggregate(n=("count", "x")).run(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        Pipeline().having(F.lit(True)).run(df)


def test_buckets_before_the_epoch(spark):
    df = spark.createDataFrame([(-1,), (0,), (25,), (None,)], "us long").select(S.ts_bucket(F.timestamp_micros("us"), 10, 3).alias("b"))
    assert [r.b for r in df.select(F.unix_micros("b").alias("b")).collect()] == [-7, -7, 23, None]


def test_mvcc_ties_and_revival(spark):
    log = spark.createDataFrame([("a", 1, False, 1), ("a", 2, True, None), ("a", 3, False, 3), ("b", 2, False, 7), ("b", 2, True, None)], "id string, tx long, is_tombstone boolean, v int")
    live = lambda tx: sorted((r.id, r.v) for r in snapshot(log, tx).collect())
    assert (live(0), live(1), live(2), live(None)) == ([], [("a", 1)], [], [("a", 3)])
    status = lambda key, tx: timetravel.read_as_of(log, key, tx).first().status
    assert (status("a", 2), status("a", 3), status("zz", None), status("b", 9)) == ("deleted", "live", "missing", "deleted")
    assert timetravel.retain(log, 1, floor=2).count() == 4


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 2.0, 3.0])], "id long, embedding array<float>")
    assert [(r.id, r.distance) for r in vector.knn(v, [1.0, 0.0], 3).collect()] == [(2, 0.0), (3, 0.0), (1, 2.0)]
    batch = vector.knn_batch(v, v, 1, "cosine", block=2, exclude_self=True).collect()
    assert {(r.query_id, r.id) for r in batch} == {(1, 2), (2, 3), (3, 2)}
    assert vector.approximate_knn(v.where("id < 4"), [1.0, 0.1], 2).count() == 2
    with pytest.raises(ValueError):
        vector.knn(v, [1.0, 0.0], 0)
    with pytest.raises(Exception, match="dimension"):
        export.vector_matrix(v, 2).collect()


def test_views(spark):
    edges = Edge(spark.createDataFrame([("e1", "a", ["b", "b"]), ("e2", "a", ["c"]), ("e3", "c", None)], "edge_id string, x string, y array<string>"), ["x", "y"])
    i = edges.incidence()
    assert i.count() == 5 or i.count() == 6
    assert {(r.filler, r.degree) for r in views.degrees(i).collect()} >= {("a", 2), ("b", 1)}
    start = spark.createDataFrame([("a",)], "s string")
    assert {r.node for r in views.traverse([i], start).collect()} == {"b", "c"}
    kinds = {(r.source, r.target, r.kind) for r in views.projection(i).collect()}
    assert ("a", "c", "link") in kinds and ("e1", "a", "spoke") in kinds
    page = views.browse(spark.createDataFrame([("1", "Ax"), ("2", "bx"), ("3", "c")], "id string, name string"), needle="X", sort="name", limit=1).collect()
    assert [(r.id, r.total) for r in page] == [("1", 2)]
    assert views.record_360(type("G", (), {"entities": {"t": spark.createDataFrame([("a", 1)], "id string, n int")}, "edges": {"e": edges}}), "t", "a")["e"].count() == 3


def test_scalars(spark):
    row = spark.range(1).select(S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("km"), S.min_max(F.lit(3.0), F.lit(1.0), F.lit(5.0)).alias("m"), S.first_match(F.lit("Radial Velocity"), [("radial", "RV")]).alias("f"), S.text_embedding(F.lit("abc")).alias("e")).first()
    assert abs(row.km - math.pi * 6371 / 2) < 1e-6 and row.m == 0.5 and row.f == "RV" and abs(sum(x * x for x in row.e) - 1) < 1e-6
    assert S.fnv1a64("") == 0xCBF29CE484222325 and S.fnv1a64("a") == 0xAF63DC4C8601EC8C


def test_exports(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, t string")
    assert export.as_text(df, "csv") == "id,t\n1,a|b\n2,\n" and "a\\|b" in export.as_text(df, "markdown") and "<td>1</td>" in export.as_text(df, "html")
    assert sum(b.num_rows for b in export.arrow_batches(df, 1)) == 2
    assert slicer.pivot(df, "id", "t").count() == 2


def test_change_feed_stream(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, False), ("b", 2, True), ("b", 2, True), ("c", 3, False)], "id string, tx long, is_tombstone boolean")
    log.write.parquet(str(tmp_path / "log"))
    target = str(tmp_path / "copy")

    def go():
        q = feed.follow(feed.subscribe(spark, str(tmp_path / "log"), log.schema, 1), target, str(tmp_path / "cp"))
        q.awaitTermination(60)
        return sorted((r.id, r.tx) for r in spark.read.parquet(target).collect())

    assert go() == [("b", 2), ("c", 3)]
    spark.createDataFrame([("d", 4, False)], log.schema).write.mode("append").parquet(str(tmp_path / "log"))
    assert go() == [("b", 2), ("c", 3), ("d", 4)]


def test_nearest_over_whole_tables(spark):
    left = spark.createDataFrame([(k, float(v)) for k, v in enumerate([-5, 0, 1, 2.5, 4, 4, 99])] + [(50, None)], "c int, x double")
    right = spark.createDataFrame([(7, 0.0), (3, 0.0), (9, 2.0), (8, 3.0), (5, 50.0), (None, 1.0), (1, None)], "k int, y double")
    found = {r.c: r.k for r in views.nearest(left, right, "x", "y", "k").collect()}
    assert found == {0: 3, 1: 3, 2: 3, 3: 8, 4: 8, 5: 8, 6: 5, 50: None}
    assert {r.k for r in views.nearest(left, right.limit(0), "x", "y", "k").collect()} == {None}


def test_nearest_goes_through_many_distinct_values_once(spark):
    import bisect
    import time

    n = 60_000
    left = spark.range(n).select(F.col("id").alias("c"), (F.col("id") * 7919 % n / 8).alias("x"))
    right = spark.range(n // 4).select(F.col("id").alias("k"), (F.col("id") * 7 % n / 2 + 0.0625).alias("y"))
    began = time.time()
    found = {r.c: r.k for r in views.nearest(left, right, "x", "y", "k").collect()}
    assert time.time() - began < 40
    ys = sorted((r.y, r.k) for r in right.collect())
    for c in range(0, n, 997):
        x = c * 7919 % n / 8
        at = bisect.bisect(ys, (x, -1))
        assert found[c] == min((abs(x - y), k) for y, k in ys[max(at - 2, 0) : at + 2])[1]
    assert len(found) == n


def test_closure_goes_through_the_whole_cycle(spark):
    edges = spark.createDataFrame([(str(k), str((k * 7 + 3) % 20000)) for k in range(20000)] + [("a", "b"), ("b", None)], "src string, dst string")
    starts = spark.createDataFrame([("1",), ("2",), ("a",), ("z",)], "s string")
    want, at = {("a", "a"), ("a", "b"), ("z", "z")}, 0
    for s in (1, 2):
        at = s
        while (str(s), str(at)) not in want:
            want.add((str(s), str(at)))
            at = (at * 7 + 3) % 20000
    assert len(want) > 2 * 64  # further than the steps of the language's recursion
    assert sorted(map(tuple, closure_of_successors(edges, starts).collect())) == sorted(want)
    with pytest.raises(ValueError):
        closure_of_successors(edges.unionByName(edges.limit(1).withColumn("dst", F.lit("q"))), starts)


def test_closure_by_joins_and_within_tasks_agree(spark):
    from arcweave.operators.recursion import closure

    edges = spark.createDataFrame([(a, b) for a, b in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), (None, "q"), ("y", None)]], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("d",), ("x",), ("zz",), (None,)], "s string")
    for least, most in ((0, None), (1, None), (0, 1), (2, 3), (2, 2), (0, 0), (1, 2), (3, 9)):
        one, many = (sorted(map(tuple, closure(edges, starts, least, most, held).collect())) for held in (100, 0))
        assert one == many, (least, most)


def test_store_commits_conflicts_and_cursors(spark, tmp_path):
    from arcweave.errors import QueryError
    from arcweave.operators import writes
    from arcweave.sources.store import Store, restore, uuid7

    schema = spark.createDataFrame([], "id string, tx long, is_tombstone boolean, name string, n long").schema
    store = Store(spark, str(tmp_path / "db"), {"person": schema})
    people = spark.createDataFrame([("a", "Ann", 1), ("b", "Bob", 2)], "id string, name string, n long")
    assert store.last_tx() == 0 and store.begin().put("person", people).commit() == 1
    late = store.begin(reads=["person"])
    assert store.begin().delete("person", people.where("id = 'b'").select("id")).commit() == 2
    with pytest.raises(QueryError) as e:
        late.put("person", people).commit()
    assert e.value.code == "conflict" and store.last_tx() == 2
    gone = store.begin().put("person", people)
    gone.rollback()
    with pytest.raises(QueryError):
        gone.commit()
    numbers, rows = writes.commit(store, 'match person(name: ?x) as ?p set ?p.n = 9 create person(name: ?x, n: 4) as ?r merge person(name: "Cid", n: 3) as ?q return ?p.n')
    assert numbers == [3, 4, 5] and [tuple(r) for r in rows.collect()] == [(9,)]
    live = {(r.name, r.n) for r in store.graph().at(None).entities["person"].collect()}
    assert live == {("Ann", 9), ("Cid", 3), ("Ann", 4)}
    assert {r.name for r in store.graph().at(1).entities["person"].collect()} == {"Ann", "Bob"}
    numbers, rows = writes.commit(store, 'create person(name: "Dee", n: 5) as ?d return ?d.name, ?d.n')
    assert numbers == [6] and [tuple(r) for r in rows.collect()] == [("Dee", 5)]
    live.add(("Dee", 5))
    cursor, seen = 0, 0
    while (step := store.tail(cursor, 2))[1] > cursor:
        seen += step[0]["person"].count()
        cursor = step[1]
    assert (cursor, seen) == (6, store.log("person").count())
    copy = restore(spark, store.path, str(tmp_path / "copy"), store.schemas)
    store.compact()
    assert {(r.name, r.n) for r in store.graph().at(None).entities["person"].collect()} == live == {(r.name, r.n) for r in copy.graph().at(None).entities["person"].collect()}
    with pytest.raises(QueryError):
        store.tail(1)
    ids = [uuid7(1000 + k) for k in range(5)]
    assert ids == sorted(ids) and all(i[14] == "7" and i[19] in "89ab" for i in ids)


def test_pages_constraints_principals_and_lines(spark):
    from arcweave.errors import QueryError
    from arcweave.operators import constraints, lookup

    df = spark.range(23).withColumnRenamed("id", "k")
    assert [[r.k for r in p] for p in lookup.pages(df, "k", 10)] == [[*range(10)], [*range(10, 20)], [20, 21, 22]]
    rules = spark.createDataFrame([("t", "name", "required", None), ("t", "n", "value_tag", "string")], "type string, prop string, kind string, tag string")
    good = spark.createDataFrame([("1", "x", "5")], "id string, name string, n string")
    constraints.check({"t": good}, rules)
    for bad, code in ((good.withColumn("name", F.lit(None).cast("string")), "missing_required_property"), (good.withColumn("n", F.lit(5)), "wrong_value_tag"), (good.withColumn("n__tag", F.lit("i64")), "wrong_value_tag")):
        with pytest.raises(QueryError) as e:
            constraints.check({"t": bad}, rules)
        assert e.value.code == code
    who = spark.createDataFrame([("p1", "s3cret"), ("p2", "s3cret"), ("p3", None)], "id string, token string")
    assert constraints.principal_of(who, "s3cret") == "p2" and constraints.principal_of(who, "nope") is None
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.2, 10.0), (3, 50.0, 0.0), (4, None, 0.0)], "p int, lat double, lon double")
    lines = spark.createDataFrame([("b", [(10.0, 10.1), (60.0, 0.0)]), ("a", [(10.0, 9.9), (10.3, 10.0)])], "id string, trace array<struct<lat: double, lon: double>>")
    assert {r.p: r.id for r in views.nearest_line(points, lines, 31.0).collect()} == {1: "a", 2: "a", 3: None, 4: None}


def test_scalar_texts(spark):
    rows = spark.createDataFrame([(0,), (5,), (-5,), (12345,), (-100,), (None,)], "n long")
    assert [r.t for r in rows.select(S.format_decimal(F.col("n"), 2).alias("t")).collect()] == ["0.00", "0.05", "-0.05", "123.45", "-1.00", None]
    ids = spark.createDataFrame([("AB-c",), ("abc",), ("",), (None,)], "t string").select(S.fnv1a("t").alias("h")).collect()
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    assert [r.h for r in ids] == [signed(S.fnv1a64("abc"))] * 2 + [signed(S.fnv1a64("")), None]
    one = spark.range(1).select(S.category_place(F.lit("b"), ["a", "b", "c"]).alias("p"), S.importance_layout(F.lit(9), F.lit(9), F.lit(0.25), F.lit(2001), 2000.0).alias("l"), S.text_embedding(F.lit("")).alias("e")).first()
    assert one.p == 0.5 and abs(one.l.x) < 1e-9 and one.l.z == 1.0 and set(one.e) == {0.0}


def test_percentiles_of_a_hot_group(spark):
    df = spark.range(0, 5000).selectExpr("CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS g", "double(id * 7 % 5000) AS v", "id % 3 AS w").unionByName(spark.createDataFrame([(None, 1.0, 1), ("c", None, 2)], "g string, v double, w long"))
    got = {r.g: (r.p, r.q, r.n) for r in Pipeline().group_by("g").aggregate(p=("percentile", "v", 0.37), n=("count", "w"), q=("percentile", "w", 1.0)).run(df).collect()}
    want = {r.g: (r.p, r.q, r.n) for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.37)).alias("p"), F.percentile("w", F.lit(1.0)).alias("q"), F.count("w").alias("n")).collect()}
    assert got.keys() == want.keys() and all(a == b or all(x == y or abs(x - y) < 1e-9 for x, y in zip(a, b)) for a, b in ((got[k], want[k]) for k in want))


def test_approximate_search_finds_nine_in_ten(spark, sf_dir):
    held = spark.read.parquet(f"{sf_dir}/../sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding").cache()
    queries = [r.embedding for r in held.where("id % 100 = 0").orderBy("id").collect()]
    for metric in ("l2", "cosine"):
        found, far = 0, 0.0
        for q in queries:
            want = {r.id: r.distance for r in vector.knn(held, q, 10, metric).collect()}
            got = {r.id: r.distance for r in vector.approximate_knn(held, q, 10, metric).collect()}
            found += len(want.keys() & got.keys())
            far = max([far, *(abs(want[i] - got[i]) for i in want.keys() & got.keys())])
        assert found >= 9 * len(queries) and far < 1e-4, (metric, found, far)
    held.unpersist()
    with pytest.raises(ValueError):
        vector.approximate_knn(held, queries[0], 0)
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [1.0])], "id long, embedding array<double>")
    assert [(r.id, r.distance) for r in vector.approximate_knn(zero, [0.0, 1.0], 5, "cosine").collect()] == [(2, 0.0)]
    assert vector.approximate_knn(zero.limit(0), [0.0, 1.0], 5).collect() == []


def test_texts_near_a_query(spark):
    texts = spark.createDataFrame([(1, "graph stores"), (2, "Graph Store"), (3, None), (4, "zzz"), (5, "")], "id long, text string")
    near = vector.text_knn(texts, "GRAPH STORE", 3).collect()
    assert near[0].id == 2 and abs(near[0].distance) < 1e-6 and near[1].id == 1 and len(near) == 3


def test_follower_keeps_one_of_versions_that_come_again(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, False), ("b", 2, False)], "id string, tx long, is_tombstone boolean")
    path, target = str(tmp_path / "log"), str(tmp_path / "copy")
    for rows in (log, log.where("id = 'b'").unionByName(spark.createDataFrame([("b", 3, True)], log.schema)), log):
        rows.write.mode("append").parquet(path)
        feed.follow(feed.subscribe(spark, path, log.schema), target, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.id, r.tx) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 2), ("b", 3)]


def test_windowed_counts_drop_what_is_too_late(spark, tmp_path):
    path = str(tmp_path / "in")
    out = {}

    def keep(batch, number):
        out.update({(str(r.window.start)[11:16], r.k): r.n for r in batch.collect()})

    for k, times in enumerate((["10:01", "10:04", "10:11"], ["10:59"], ["10:02", "11:30"], ["12:00"])):
        spark.createDataFrame([(f"2026-01-01 {t}:00", "x") for t in times], "t string, k string").selectExpr("to_timestamp(t) AS t", "k").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("t timestamp, k string").parquet(path)
        feed.windowed_counts(stream, "t", "k", "10 minutes", "5 minutes").writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert out == {("10:00", "x"): 2, ("10:10", "x"): 1, ("10:50", "x"): 1, ("11:30", "x"): 1}


def test_dictionaries_and_streamed_lines(spark):
    import json

    from arcweave.sources.graph import Graph

    g = Graph(entities={"t": spark.createDataFrame([("1", 2)], "id string, n int")}, edges={"e": Edge(spark.createDataFrame([("1", ["2"], 0.5)], "x string, y array<string>, w double"), ["x", "y"])})
    told = {n: [tuple(r) for r in df.collect()] for n, df in export.dictionaries(g).items()}
    assert told == {"types": [(1, "e", "edge"), (2, "t", "entity")], "roles": [(1, "x"), (2, "y")], "properties": [(1, "n"), (2, "w")]}
    df = spark.createDataFrame([(1, 'a"}\n', [1.5]), (2, None, None)], "n int, `a b` string, v array<double>").orderBy("n")
    lines = [json.loads(x) for x in export.stream_lines(df)]
    assert lines == [{"columns": ["n", "a b", "v"], "truncated": False}, [1, 'a"}\n', [1.5]], [2, None, None]]
    assert [json.loads(x) for x in export.stream_lines(df, 1)] == [{"columns": ["n", "a b", "v"], "truncated": True}, lines[1]]
    assert next(iter(export.stream_lines(df.limit(0), 0))) == json.dumps({"columns": df.columns, "truncated": False})


def test_works_and_their_citations(spark, tmp_path):
    import gzip
    import json

    from arcweave.plans.compiler import run
    from arcweave.sources import works

    row = lambda n, **more: {"id": f"https://openalex.org/W{n}", "publication_year": 2020, "display_name": f"t{n}", **more}
    level = lambda *of: [{"display_name": f"c{k}", "level": k} for k in of]
    refs = [f"https://openalex.org/W{n}" for n in (1, 2, 2, 3, 9)] + ["https://x/A5", None]
    rows = [
        row(1, cited_by_count=3, concepts=level(0, 2, 1), referenced_works=refs, authorships=[{"author": {"display_name": "Ann"}}, {"author": {}}]),
        row(2, concepts=level(0), doi="d"), row(2, cited_by_count=1, display_name=None, concepts=[]), row(3, publication_year=0), {"id": "https://openalex.org/A7", "publication_year": 1}, {"id": None},
    ]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, own in (("part_0.gz", rows[:3]), ("deep/part_1.jsonl.gz", rows[3:]), ("other.gz", [row(8)])):
        with gzip.open(tmp_path / "in" / name, "wt") as f:
            f.write("".join(json.dumps(r) + "\n" for r in own))
    found = {r.number: r for r in works.papers(spark, str(tmp_path / "in")).collect()}
    assert found.keys() == {1, 2} and (found[1].field, found[1].authors, found[1].citations) == ("c2", ["Ann"], 3)
    assert (found[2].name, found[2].field, found[2].doi, found[2].cited) == ("(untitled)", "Unknown", "", None)
    g = works.graph(spark, str(tmp_path / "in"))
    got = run(spark, g, "match cites(citing: ?a, cited: ?b) paper(name: ?n) as ?b return ?a, ?n").collect()
    assert [tuple(r) for r in got] == [("paper:1", "(untitled)")] * 2
