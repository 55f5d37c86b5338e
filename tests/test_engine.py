"""Clauses and expressions over a small graph, with values worked out by hand."""

import datetime

import pytest

from weft.engine import Engine
from weft.operators import paths
from weft.operators.writes import ConstraintError
from weft.plans.compiler import SemanticError
from weft.plans.parser import QuerySyntaxError, parse
from weft.sources.catalog import NodeTable, PropertyGraph, RelTable


@pytest.fixture(scope="module")
def graph(spark):
    people = spark.createDataFrame(
        [(1, "A", 13, None), (2, "B", 33, "blue"), (3, "C", 44, "blue"), (4, "D", None, "brown"), (5, "D", None, None)],
        "id long, name string, age long, eyes string",
    )
    knows = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 4), (4, 2, 5), (5, 3, 5)], "id long, src long, dst long")
    return PropertyGraph((NodeTable(("Person",), people),), (RelTable("KNOWS", knows),))


@pytest.fixture
def run(spark, graph):
    engine = Engine(spark, graph)
    return lambda text, **params: [tuple(r) for r in engine.sql(text, params).collect()]


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("MATCH (n:Person) RETURN avg(n.age) AS a, sum(n.age) AS s, percentileCont(n.age, 0.4) AS p, percentileDisc(n.age, 0.5) AS q", [(30.0, 90.0, 29.0, 33)]),
        ("MATCH (n:Person)-[:KNOWS]->()-[:KNOWS]->(f) WHERE n.name = 'A' RETURN count(DISTINCT f) AS d, count(f) AS c", [(1, 2)]),
        ("MATCH (a)-[r]-(b)-[s]-(c) RETURN count(*) AS c", [(12,)]),
        ("MATCH (n) OPTIONAL MATCH (n)-->(m) WHERE m.age > 33 RETURN n.name AS a, m.name AS b ORDER BY a, b", [("A", "C"), ("B", None), ("C", None), ("D", None), ("D", None)]),
        ("MATCH (n) WHERE (n)-->() AND NOT (n)-->({name: 'B'}) RETURN n.name AS n ORDER BY n", [("B",), ("C",)]),
        ("MATCH (n) WITH n ORDER BY n.name DESC LIMIT 3 RETURN collect(n.name) AS l", [(["D", "D", "C"],)]),
        ("MATCH (a {name: 'A'}), (b {name: 'D'}), p = shortestPath((a)-[*]->(b)) RETURN length(p) AS l ORDER BY l", [(1,), (2,)]),
        ("MATCH (a {name: 'A'}), (b {name: 'D'}), p = allShortestPaths((a)-[*]->(b)) RETURN length(p) AS l ORDER BY l", [(1,), (2,), (2,)]),
        ("MATCH (n {name: 'A'})-[*0..2]->(x) RETURN count(*) AS c", [(6,)]),
        ("RETURN 7 / 2 AS d, 2 ^ 3 AS p, [1, 2, 3][-1] AS i, [1, 2, 3, 4][1..3] AS s, 1 < 2 <= 3 AS t", [(3.0, 8, 3, [2, 3], True)]),
        ("RETURN date('2015-W30-2') AS a, date({year: 1984, ordinalDay: 202}) AS b, date('2015-01-31') + duration({months: 1}) AS c", [(datetime.date(2015, 7, 21), datetime.date(1984, 7, 20), datetime.date(2015, 2, 28))]),
        ("RETURN split('a,b,,', ',') AS s, toInteger('10.2') AS i, round(-2.5) AS r, range(5, 1, 1) AS e", [(["a", "b"], 10, -2.0, [])]),
        ("RETURN toString(duration.between(date('1984-10-11'), date('2015-06-24'))) AS a, duration.inMonths(date('2015-01-31'), date('2015-02-28')).months AS m, toString(duration.between(date('2015-06-24'), date('2015-06-20'))) AS b", [("P30Y8M13D", 1, "P-4D")]),
        ("RETURN toString(duration(null)) AS n, duration.between(date('2015-01-01'), null) AS b", [(None, None)]),
        ("RETURN toString(datetime('2015-07-21T21:40:32.142+01:00')) AS a, toString(localdatetime('2015185T19:32:24')) AS b, toString(time('214032.142-0130')) AS c, toString(localtime('21:40')) AS d", [("2015-07-21T21:40:32.142+01:00", "2015-07-04T19:32:24", "21:40:32.142-01:30", "21:40:00")]),
        ("RETURN toString(point({x: 1, y: 2})) AS p", [("point({x: 1.0, y: 2.0, crs: 'cartesian'})",)]),
        ("RETURN [x IN [1, 2]] AS a, extract(x IN [1, 2] | x * 2) AS b, filter(x IN [1, 2, 3] WHERE x > 1) AS c", [([1, 2], [2, 4], [2, 3])]),
        ("MATCH p = (a {name: 'A'})-[*2]->(b) RETURN [x IN nodes(p) | x.name] AS l, size(nodes(p)) AS k ORDER BY l", [(["A", "B", "D"], 3), (["A", "C", "D"], 3)]),
        ("MATCH p = (a {name: 'A'})-->(b) WHERE all(x IN nodes(p) WHERE x.age > 0) RETURN count(*) AS c", [(2,)]),
        ("MATCH (n {name: 'A'})-->(m) RETURN n {.name, k: count(m), s: sum(m.age)} AS m", [(("A", 3, 77.0),)]),
        ("MATCH (n) RETURN percentileDisc(n.age, 0) AS a, percentileDisc(n.age, 1) AS b, percentileDisc(n.name, 0.5) AS c, percentileCont(DISTINCT n.age, 0.4) AS d", [(13, 44, "C", 29.0)]),
        ("RETURN distance(point({x: 2.3, y: 4.5}), point({x: 1.1, y: 5.4})) AS d", [(1.5,)]),
        ("UNWIND [1, null, 2] AS x RETURN x * 2 AS y", [(2,), (None,), (4,)]),
        ("RETURN 1 AS x UNION RETURN 1 AS x", [(1,)]),
        ("MATCH (n:Nothing) RETURN count(n) AS c", [(0,)]),
        ("MATCH (n) RETURN n.eyes AS e, count(*) AS c ORDER BY e DESC", [(None, 2), ("brown", 1), ("blue", 2)]),
    ],
)
def test_reads(run, text, rows):
    assert run(text) == rows


def test_parameters(run):
    assert run("MATCH (n) WHERE n.name IN $names RETURN count(*) AS c", names=["A", "B"]) == [(2,)]


def test_writes(run):
    run("CREATE (:City {name: 'Rome'})-[:IN {w: 1}]->(:Country {name: 'IT'})")
    assert run("MATCH (x:City)-[r]->(y) RETURN x.name AS a, r.w AS w, y.name AS b") == [("Rome", 1, "IT")]
    run("MATCH (n:Person) WHERE n.age > 30 SET n.age = 99, n:Old")
    assert run("MATCH (n:Old) RETURN count(*) AS c, sum(n.age) AS s") == [(2, 198.0)]
    run("MATCH (p:Person) WHERE p.eyes IS NOT NULL MERGE (:Hue {name: p.eyes})")
    assert run("MATCH (h:Hue) RETURN h.name AS n ORDER BY n") == [("blue",), ("brown",)]
    with pytest.raises(ConstraintError):
        run("MATCH (n {name: 'A'}) DELETE n")
    run("MATCH (n {name: 'A'}) DETACH DELETE n")
    assert run("MATCH ()-[r:KNOWS]->() RETURN count(r) AS c") == [(2,)]
    run("MATCH (n:Person {name: 'B'}) FOREACH (x IN [1, 2] | SET n.mark = 5)")
    assert run("MATCH (n) WHERE n.mark = 5 RETURN n.name AS n") == [("B",)]


def test_foreach_over_a_path(run):
    run("MATCH p = (a {name: 'A'})-->({name: 'B'})-->(c) FOREACH (n IN nodes(p) | SET n.marked = true)")
    assert run("MATCH (n) WHERE n.marked RETURN count(*) AS c") == [(3,)]


def test_created_ids_are_new(spark, graph):
    engine = Engine(spark, graph)
    for _ in range(3):
        engine.run("UNWIND [1, 2, 3] AS x CREATE (a:T {v: x})-[:R]->(b:T {v: -x})")
    found = engine.sql("MATCH (n:T) RETURN count(DISTINCT n) AS n, count(n) AS k, min(id(n)) AS lo").first()
    assert (found.n, found.k) == (18, 18)
    assert found.lo > 5
    assert engine.sql("MATCH (:T)-[r:R]->(:T) RETURN count(DISTINCT r) AS n").first().n == 9


def test_errors(run):
    with pytest.raises(SemanticError):
        run("RETURN nobody AS x")
    with pytest.raises(SemanticError):
        run("RETURN nosuch(1) AS x")
    with pytest.raises(QuerySyntaxError):
        parse("MATCH (n RETURN n")


def test_scans_stay_pruned(spark, tmp_path, graph):
    graph.nodes[0].df.write.parquet(str(tmp_path / "p"))
    engine = Engine(spark, PropertyGraph((NodeTable(("Person",), spark.read.parquet(str(tmp_path / "p"))),)))
    plan = engine.sql("MATCH (n:Person) WHERE n.age > 30 RETURN n.name AS n")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,30)" in plan
    assert "ReadSchema: struct<name:string,age:bigint>" in plan


def test_unbounded_shortest_paths_go_on_past_the_hop_limit(spark):
    edges = spark.createDataFrame([((i,), i, i + 1) for i in range(9)] + [((50,), 0, 20), ((51,), 20, 2), ((52,), 9, 0)], "r struct<id: long>, __from long, __to long")
    pairs = spark.createDataFrame([(0, 8), (0, 2), (5, 1), (0, 99)], "s long, t long")
    for every in (False, True):
        got = sorted((r.s, r.t, len(r.rels)) for r in paths.shortest(pairs, edges, 1, None, 3, every).collect())
        assert got == sorted([(0, 8, 8), (0, 2, 2), (5, 1, 6)] + [(0, 8, 8), (0, 2, 2)] * every)
    with pytest.raises(paths.PathLimitError):
        paths.shortest(pairs.where("t = 8"), edges, 2, None, 3, False)
    assert [len(r.rels) for r in paths.shortest(pairs.where("t = 2"), edges, 2, None, 3, False).collect()] == [2]
