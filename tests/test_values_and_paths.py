"""Cross-type values, durations and zones, path searches, updates, and the engine's registries."""

import time

import pytest

from weft.engine import Engine
from weft.operators import paths
from weft.plans.compiler import SemanticError
from weft.sources.catalog import NodeTable, PropertyGraph, RelTable
from weft.sources.tables import read_typed_graph


def rows(engine, text, **params):
    return [tuple(r) for r in engine.sql(text, params).collect()]


@pytest.fixture
def mixed(spark):
    """Two labels that share a property name with other types, and a chain of eight."""
    young = spark.createDataFrame([(1, "x", 36), (2, "y", 20)], "id long, name string, age long")
    old = spark.createDataFrame([(3, "z", "old")], "id long, name string, age string")
    links = spark.createDataFrame([(i, 10 + i, 11 + i) for i in range(8)], "id long, src long, dst long")
    chain = spark.range(10, 19).selectExpr("id", "id - 10 AS at")
    return Engine(spark, PropertyGraph((NodeTable(("P",), young), NodeTable(("D",), old), NodeTable(("C",), chain)), (RelTable("L", links),)))


@pytest.mark.parametrize(
    "text",
    ["+".join(["1"] * 41), "/".join(["64", *["2"] * 40]), " XOR ".join(["true"] * 41), "-".join(["duration({days: 1})"] * 8), "[x IN [1] | [y IN [x] | [z IN [y] | x + y + z]]]"],
)
def test_deep_expressions_compile_fast(spark, text):
    Engine(spark).sql("RETURN 1 AS x")
    began = time.perf_counter()
    Engine(spark).sql(f"RETURN {text} AS x")
    assert time.perf_counter() - began < 3


def test_types_of_equal_literals_are_kept_apart(spark):
    assert rows(Engine(spark), "RETURN 1 AS a, 1.0 AS b, true AS c, count(*) AS n") == [(1, 1.0, True, 1)]


def test_cross_type_values(spark, mixed):
    e = Engine(spark)
    assert rows(e, "RETURN 1 IN ['a', 1] AS a, 1 IN ['a', null] AS b, [1, 'a'][0] = 1 AS c, 'a' < 1 AS d, [1, 'a'] = [1, 'a'] AS e") == [(True, None, True, None, True)]
    assert rows(e, "UNWIND [1, 'a', 2.5, true, null] AS x WITH x ORDER BY x RETURN collect(toString(x)) AS l") == [(["a", "true", "1", "2.5"],)]
    assert rows(e, "UNWIND [1, 'a', 1] AS x RETURN toString(max(x)) AS m, count(DISTINCT x) AS n") == [("1", 2)]
    assert rows(e, "UNWIND [1, 'a', 1] AS x WITH DISTINCT x RETURN count(*) AS n") == [(2,)]
    assert rows(mixed, "MATCH (n) RETURN count(n) AS n") == [(12,)]
    assert rows(mixed, "MATCH (n) WHERE n.age > 25 OR n.age = 'old' RETURN n.name AS n ORDER BY n") == [("x",), ("z",)]
    assert rows(mixed, "MATCH (n:P) RETURN n.age + 1 AS a ORDER BY a") == [(21,), (37,)]


#: Durations and the texts that they must have.
DURATIONS = [
    ("duration({months: -1})", "P-1M"), ("duration({seconds: -1})", "PT-1S"), ("duration({months: 0.75})", "P22DT19H51M49.5S"), ("duration('PT0.75M')", "PT45S"),
    ("duration({minutes: 1.5, seconds: 1, milliseconds: 123, microseconds: 456, nanoseconds: 789})", "PT1M31.123456789S"),
    ("duration({seconds: -1, milliseconds: 500})", "PT-0.5S"), ("duration.between(date('1985-11-25'), date('1984-10-11'))", "P-1Y-1M-14D"),
    ("duration.between(date('1984-10-11'), datetime('1984-10-12T21:40:32.142+0100'))", "P1DT21H40M32.142S"),
    ("duration.between(localtime('14:30'), time('16:30+0100'))", "PT2H"), ("duration.inSeconds(date('1984-10-12'), date('1984-10-11'))", "PT-24H"),
    ("duration.between(datetime({year: 2017, month: 10, day: 29, hour: 0, timezone: 'Europe/Stockholm'}), datetime({year: 2017, month: 10, day: 29, hour: 0, timezone: 'Europe/London'}))", "PT1H"),
]


def test_duration_texts(spark):
    e = Engine(spark)
    got = e.sql("RETURN " + ", ".join(f"toString({d}) AS x{i}" for i, (d, _) in enumerate(DURATIONS))).first()
    assert list(got) == [t for _, t in DURATIONS]
    assert rows(e, "UNWIND [-1, -12] AS m RETURN duration({months: m}).years AS y, duration({seconds: 61 * m}).minutes AS k") == [(0, -1), (-1, -12)]
    assert rows(e, "UNWIND [duration({days: 1}), duration({days: 1}), duration({days: 2})] AS d RETURN sum(DISTINCT d).days AS s, sum(d).days AS t") == [(3, 4)]


def test_zones_are_kept(spark):
    e = Engine(spark)
    text = "WITH datetime('2015-06-24T12:50:35.556+0100') AS d RETURN d.hour AS h, d.timezone AS z, toString(datetime.truncate('hour', d)) AS t, d = datetime('2015-06-24T11:50:35.556Z') AS s, toString(datetime({datetime: d, timezone: 'Pacific/Honolulu'})) AS p"
    assert rows(e, text) == [(12, "+01:00", "2015-06-24T12:00:00+01:00", True, "2015-06-24T01:50:35.556-10:00[Pacific/Honolulu]")]


def test_conditions_reach_path_searches(spark, mixed, monkeypatch):
    asked = {}

    def spy(pairs, *args):
        asked["pairs"] = pairs.count()
        return original(pairs, *args)

    original = paths.shortest
    monkeypatch.setattr(paths, "shortest", spy)
    assert rows(mixed, "MATCH (a:C), (b:C), p = shortestPath((a)-[*]->(b)) WHERE a.at = 1 AND b.at >= 7 RETURN b.at AS b, length(p) AS l ORDER BY b") == [(7, 6), (8, 7)]
    assert asked["pairs"] == 2
    starts = {}

    def spy_many(s, *args):
        starts["n"], starts["ends"] = s.count(), args[-1].count()
        return many(s, *args)

    many = paths.var_length
    monkeypatch.setattr(paths, "var_length", spy_many)
    assert rows(mixed, "MATCH (a:C)-[r*2..3]->(b:C) WHERE a.at < 2 AND b.at = 3 RETURN a.at AS a, size(r) AS k ORDER BY a") == [(0, 3), (1, 2)]
    assert starts == {"n": 2, "ends": 1} or starts == {"n": 1, "ends": 2}


def test_all_shortest_paths_by_predecessors(spark):
    nodes = spark.range(0, 8).selectExpr("id", "id AS k")
    # a ladder of three diamonds: 0 - (1, 2) - 3 - (4, 5) - 6 - 7, with parallel edges at the end
    links = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (6, 7), (6, 7)]
    rels = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(links)], "id long, src long, dst long")
    e = Engine(spark, PropertyGraph((NodeTable(("N",), nodes),), (RelTable("R", rels),)))
    assert rows(e, "MATCH (a {k: 0}), (b {k: 7}), p = allShortestPaths((a)-[*]->(b)) RETURN length(p) AS l, count(*) AS n") == [(5, 8)]
    assert rows(e, "MATCH (a {k: 7}), (b {k: 0}), p = shortestPath((a)-[*..9]-(b)) RETURN length(p) AS l, size(nodes(p)) AS n") == [(5, 6)]
    assert rows(e, "MATCH (a {k: 7}), (b {k: 0}), p = shortestPath((a)-[*]->(b)) RETURN count(*) AS n") == [(0,)]


def test_optional_match_joins_once(spark, mixed):
    df = mixed.sql("MATCH (n:C) OPTIONAL MATCH (n)-[:L]->(m:C) WHERE m.at > 4 RETURN n.at AS a, m.at AS b")
    assert sorted((r[0], r[1]) for r in df.collect() if r[1] is not None) == [(4, 5), (5, 6), (6, 7), (7, 8)]
    assert df.count() == 9
    assert "Distinct" not in df._jdf.queryExecution().analyzed().toString()


def test_foreach_runs_in_order(spark, mixed):
    mixed.run("MATCH (n:P) FOREACH (x IN [1, 2, 3] | SET n.age = n.age + x, n.mark = x SET n:Seen)")
    assert rows(mixed, "MATCH (n:P) RETURN n.age AS a, n.mark AS m, n:Seen AS s ORDER BY a") == [(26, 3, True), (42, 3, True)]
    mixed.run("MATCH (n:P) FOREACH (x IN CASE WHEN n.age > 30 THEN [1, 2] ELSE [] END | MERGE (l:Leaf {v: x}) CREATE (n)-[:HAS]->(l))")
    assert rows(mixed, "MATCH (n:P)-[:HAS]->(l:Leaf) RETURN n.name AS n, l.v AS v ORDER BY v") == [("x", 1), ("x", 2)]
    mixed.run("MATCH (n:P) FOREACH (x IN [] | SET n.age = 0)")
    assert rows(mixed, "MATCH (n:P) RETURN min(n.age) AS a") == [(26,)]


def test_last_row_of_a_node_stays_and_overlays_are_bounded(spark, mixed):
    for i in range(10):
        mixed.run("MATCH (n:P) UNWIND [1, 2, $i] AS x WITH n, x SET n.v = x", {"i": i})
    assert rows(mixed, "MATCH (n:P) RETURN DISTINCT n.v AS v") == [(9,)]
    assert max(t.overlays for t in mixed.graph.nodes) < 8


def test_registries(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    e = Engine(spark)

    @e.function(nulls=False)
    def twice(x, by=2):
        return F.coalesce(x, F.lit(0)) * by

    assert rows(e, "RETURN twice(4) AS a, twice(4, 3) AS b, twice(null) AS c") == [(8, 12, None)]
    with pytest.raises(SemanticError, match="1 to 2 arguments"):
        e.sql("RETURN twice(1, 2, 3) AS x")
    e.register_aggregate("product", lambda x: F.product(x))
    assert rows(e, "UNWIND [2, 3, 4] AS x RETURN product(x) AS p, product(x) + 1 AS q") == [(24.0, 25.0)]
    (tmp_path / "my_functions.py").write_text("from pyspark.sql import functions as F\nFUNCTIONS = {'shout': lambda s: F.concat(F.upper(s), F.lit('!'))}\nPROCEDURES = {'my.one': lambda: F.lit(1)}\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert e.load("my_functions") == ["my.one", "shout"]
    assert rows(e, "CALL my.one() YIELD value RETURN shout('a') AS s, value AS v") == [("A!", 1)]


def test_typed_csv_graph(spark, tmp_path):
    (tmp_path / "person.csv").write_text("id:ID|:LABEL|name|born:int|langs:string[]\n1|Person|Ann|1990|de;en\n2|Person|Bob||\n")
    (tmp_path / "post.csv").write_text("postId:ID|:LABEL|content\n7|Post|hello\n")
    (tmp_path / "likes.csv").write_text("REL_ID:IGNORE|:TYPE|since:Date|:START_ID|:END_ID\n0|LIKES|2020-01-02|1|7\n1|LIKES|2020-01-03|2|99\n")
    g = read_typed_graph(spark, [f"{tmp_path}/person.csv", f"{tmp_path}/post.csv"], [f"{tmp_path}/likes.csv"])
    e = Engine(spark, g)
    assert rows(e, "MATCH (p:Person)-[l:LIKES]->(m:Message) RETURN p.id AS id, p.name AS n, m.postId AS m, toString(l.since) AS s") == [("1", "Ann", "7", "2020-01-02")]
    assert rows(e, "MATCH (p:Person) WHERE p.id = '2' RETURN p.born AS b, p.langs AS l") == [(None, None)]
    assert rows(e, "MATCH ()-[r:LIKES]->() RETURN count(r) AS n") == [(1,)]  # the other end of the second is missing
    assert g.node_at(7).count() == 1 and g.node_at(8).count() == 0
