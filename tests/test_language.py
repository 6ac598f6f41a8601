from __future__ import annotations

import itertools

import pytest

from arcweave.errors import QueryError
from arcweave.operators.recursion import closure
from arcweave.operators.writes import execute
from arcweave.plans.compiler import explain, run, run_truncated
from arcweave.plans.language import Agg, Bool, Cmp, Lit, Path, Ref, Var, lex, parse
from arcweave.sources.graph import Edge, Graph


@pytest.fixture(scope="module")
def sales(spark):
    customers = spark.createDataFrame([("c1", "Ann", "n", 5), ("c2", "Bob", "s", None), ("c3", None, "n", 7)], "id string, name string, region string, age long")
    orders = spark.createDataFrame([("e1", "c1", 10), ("e2", "c1", 20), ("e3", "c2", 30), ("e4", "c9", 40)], "edge_id string, buyer string, amount long")
    teams = spark.createDataFrame([("t1", "c1", ["c2", "c3"]), ("t2", "c2", ["c1"])], "edge_id string, lead string, member array<string>")
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "parent string, child string")
    return Graph({"customer": customers}, {"sale": Edge(orders, ["buyer"]), "team": Edge(teams, ["lead", "member"]), "contains": Edge(chain, ["parent", "child"])}, sizes={"customer": 3, "sale": 4})


def rows(spark, graph, source):
    return sorted((tuple(r) for r in run(spark, graph, source).collect()), key=str)


def test_parse_shapes():
    q = parse('AS OF 5 match a(x: ?v, y: "s\\n", z: _, w: uuid:q-1,) as ?e b+(p: ?e, q: ?f) where not (?v > 1 and ?e.k != -2.5) or ?v = true return ?v, sum(?e.k), order by ?v desc limit 3 # end')
    assert q.as_of == 5 and q.limit == 3 and q.order == [(Path("v"), False)] and q.returns == [Path("v"), Agg("sum", Path("e", "k"))]
    assert q.patterns[0].bindings[1] == ("y", Lit("s\n")) and q.patterns[0].bindings[3] == ("w", Ref("q-1")) and q.patterns[1].steps == (1, None)
    assert isinstance(q.where, Bool) and q.where.args[1] == Cmp("=", Path("v"), Lit(True)) and q.patterns[0].bindings[0][1] == Var("v")
    assert [t.kind for t in lex("?a ? {1,2}")] == ["var", "op", "op", "int", "op", "int", "op", "end"]


@pytest.mark.parametrize(
    "source, code",
    [
        ("match customer(name: $)", "lex_error"), ('match customer(name: "a\\q")', "lex_error"), ("match", "parse_error"), ("match customer(", "parse_error"), ("return ?x", "parse_error"),
        ("match nobody() return ?x", "unknown_type"), ("match customer(shoe: ?s) return ?s", "unknown_role_or_property"), ("match customer() as ?c return ?d", "unbound_variable"),
        ("match customer*(name: ?n) return ?n", "recursion_on_entity_type"), ("match contains{3,1}(parent: ?a, child: ?b) return ?a", "recursion_config_invalid"),
        ("match contains+(parent: ?a, child: ?b) return ?a", "recursion_config_invalid"), ("match customer(name: ?n) where _ = 1 return ?n", "anonymous_term_in_filter"),
        ("match customer() as ?c return ?c limit -1", "parse_error"), ('match sale(buyer: "c1") return count()', "unknown_role_or_property"), ("match customer() as ?c return sum()", "parse_error"),
    ],
)
def test_errors(spark, sales, source, code):
    with pytest.raises(QueryError) as e:
        run(spark, sales, source)
    assert e.value.code == code


def test_reading(spark, sales):
    assert rows(spark, sales, 'match customer(region: "n") as ?c return ?c') == [("c1",), ("c3",)]
    assert rows(spark, sales, 'match customer(region: "n", name: _) as ?c return ?c') == [("c1",)]
    assert rows(spark, sales, "match customer() as ?c sale(buyer: ?c, amount: ?a) where ?a >= 20 return ?c.name, ?a") == [("Ann", 20), ("Bob", 30)]
    # A missing or foreign value compares false, so its negation holds.
    assert rows(spark, sales, "match customer() as ?c where not ?c.age > 6 return ?c") == [("c1",), ("c2",)]
    assert rows(spark, sales, 'match customer(age: ?a) as ?c where ?a = "5" return ?c') == []
    assert rows(spark, sales, "match sale(buyer: ?b, amount: ?a) return ?b.name, sum(?a), count(), avg(?a)") == [("Ann", 30.0, 2, 15.0), ("Bob", 30.0, 1, 30.0), (None, 40.0, 1, 40.0)]
    assert rows(spark, sales, "match team(lead: ?l, member: ?m) return ?l, ?m") == [("c1", "c2"), ("c1", "c3"), ("c2", "c1")]
    ordered = [tuple(r) for r in run(spark, sales, "match customer() as ?c return ?c, ?c.age order by ?c.age desc").collect()]
    assert ordered == [("c2", None), ("c3", 7), ("c1", 5)]
    assert rows(spark, sales, "match contains*(parent: uuid:a, child: ?x) return ?x") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(spark, sales, "match contains+(parent: uuid:x, child: ?x) return ?x") == [("x",), ("y",)]
    df, truncated = run_truncated(spark, sales, "match customer() as ?c return ?c limit 2")
    assert df.count() == 2 and truncated
    assert not run_truncated(spark, sales, "match customer() as ?c return ?c limit 3")[1]


def test_pattern_order_does_not_matter(spark, sales):
    parts = ['customer(region: "n") as ?c', "sale(buyer: ?c, amount: ?a)", "team(lead: ?c, member: ?m)"]
    found = {str(rows(spark, sales, f"match {' '.join(p)} return ?c, ?a, ?m")) for p in itertools.permutations(parts)}
    assert len(found) == 1
    assert explain(sales, "match sale(buyer: ?c) customer() as ?c return ?c") == ["customer", "sale"]


def test_depth_cap(spark):
    chain = spark.range(80).selectExpr("string(id) AS src", "string(id + 1) AS dst")
    start = spark.createDataFrame([("0",)], "start string")
    assert closure(chain, start, 2, 3).count() == 2
    with pytest.raises(QueryError) as e:
        closure(chain, start, 1, None)
    assert e.value.code == "recursion_depth_exceeded"


def test_writes_make_versions(spark):
    log = spark.createDataFrame([("a", 1, False, "Ann", 1), ("b", 1, False, "Bob", 2), ("b", 2, True, None, None)], "id string, tx long, is_tombstone boolean, name string, n long")
    g = Graph(entity_logs={"person": log})
    g = execute(spark, g, 'create person(name: "Cid", n: 3) as ?p')
    g = execute(spark, g, 'match person(name: "Ann") as ?p set ?p.n = 9')
    g = execute(spark, g, 'merge person(name: "Cid", n: 3)')
    assert rows(spark, g, "match person(name: ?n, n: ?k) return ?n, ?k") == [("Ann", 9), ("Cid", 3)]
    assert rows(spark, g, "as of 1 match person(name: ?n) return ?n") == [("Ann",), ("Bob",)]
    g = execute(spark, g, "match person(n: 9) as ?p delete ?p")
    assert rows(spark, g, "match person(name: ?n) return ?n") == [("Cid",)]
