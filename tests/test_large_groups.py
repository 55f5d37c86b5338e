"""A few keys with very many rows each: results are right, and the work doesn't pile up in one place."""

import pytest
from pyspark.sql import functions as F

from weft.engine import Engine
from weft.operators import relational
from weft.sources.catalog import NodeTable, PropertyGraph, RelTable


def rows(engine, text):
    return sorted(tuple(r) for r in engine.sql(text).collect())


def hub(spark, n):
    """Two hubs with n leaves each of type X and n of type Y."""
    hubs = spark.range(2).selectExpr("id", "id AS k")
    leaves = spark.range(10, 10 + 4 * n).selectExpr("id", "id % 2 AS half")
    x = spark.range(2 * n).selectExpr("id", "id + 10 AS src", "id % 2 AS dst")
    y = spark.range(2 * n, 4 * n).selectExpr("id", "id + 10 AS src", "id % 2 AS dst")
    return Engine(spark, PropertyGraph((NodeTable(("H",), hubs), NodeTable(("L",), leaves)), (RelTable("X", x), RelTable("Y", y))))


def aggregates(engine, text):
    return engine.sql(text)._jdf.queryExecution().analyzed().toString().count("Aggregate [")


def test_matches_around_a_node_are_counted_by_branches(spark):
    n, e = 3000, hub(spark, 3000)
    text = "MATCH (a)-[:X]->(h:H) MATCH (b)-[:Y]->(h) MATCH (c)-[:X]->(h) MATCH (d)-[:Y]->(h) RETURN h.k AS k, count(*) AS n, 1 + count(a) AS m"
    assert aggregates(e, text) > 1  # otherwise 160 million million rows are made below
    assert rows(e, text) == [(0, n**4, n**4 + 1), (1, n**4, n**4 + 1)]
    assert rows(e, "MATCH (a)-[:X]->(h:H) MATCH (b)-[:Y]->(h) WHERE a.half = 0 AND h.k > 5 RETURN count(*) AS n") == [(0,)]
    assert rows(e, "MATCH (a)-[:X]->(h:H) MATCH (b)-[:Y]->(h) WHERE b.half = 1 WITH h, count(b) AS n WHERE n > 5 RETURN h.k AS k, n") == [(1, n * n)]


def test_relationships_that_must_differ_are_counted_without_pairs(spark):
    n, e = 3000, hub(spark, 3000)
    text = "MATCH (a)-[:X]->(h:H)<-[:X]-(b) RETURN h.k AS k, count(*) AS n"
    assert aggregates(e, text) > 1
    assert rows(e, text) == [(0, n * (n - 1)), (1, n * (n - 1))]
    assert rows(e, "MATCH (a)-[:X]->(h:H), (b)-->(h), (c)-[:X|Y]->(h), (d)-->(h) WHERE c.half = 1 RETURN count(*) AS n") == [(n * (2 * n - 1) * (2 * n - 2) * (2 * n - 3),)]
    links = spark.createDataFrame([(1, 10, 0), (1, 12, 0), (2, 14, 0), (None, 16, 0), (3, 11, 1)], "id long, src long, dst long")  # ids that repeat or are missing
    odd = Engine(spark, PropertyGraph(e.graph.nodes, (RelTable("X", links),)))
    assert rows(odd, text) == [(0, 4)]  # nothing for the hub with a single relationship


def test_a_mixed_value_is_placed_in_the_order_once_a_row(spark):
    parts = spark.range(2000).selectExpr("id", "id % 50 AS size", "concat('B', id % 25) AS brand")
    e = Engine(spark, PropertyGraph((NodeTable(("P",), parts),)))
    for text, want in (
        ("MATCH (p:P) UNWIND [p.size, p.brand] AS x RETURN toString(max(x)) AS hi, toString(min(x)) AS lo, count(DISTINCT x) AS n", [("49", "B0", 75)]),
        ("MATCH (p:P) UNWIND [p.size, p.brand] AS x WITH x, count(*) AS n RETURN count(*) AS k, sum(n) AS n", [(75, 4000.0)]),
    ):
        df = e.sql(text)
        plan = df._jdf.queryExecution().executedPlan().toString().lower()
        assert plan.count("schemaofvariant(") == 1  # as an expression of a sort it would be found at each comparison
        assert [tuple(r) for r in df.collect()] == want
    mixed = "UNWIND [1, 2.5, 'a', true, null, [1, 'b'], date('2020-01-01')] AS x WITH x ORDER BY x RETURN collect(toString(x))[0] AS a, toString(max(x)) AS b, count(DISTINCT x) AS n"
    assert rows(e, mixed) == [("2020-01-01", "2.5", 6)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_share_out_the_rows_of_one_key(spark, monkeypatch, how):
    monkeypatch.setattr(relational, "BLOCK_ROWS", 100)
    left = spark.range(2000).selectExpr("IF(id < 1990, 7, IF(id < 1995, NULL, id)) AS k", "concat('l', id % 3) AS a")
    right = spark.range(1000).selectExpr("IF(id < 990, 7L, IF(id < 995, NULL, -id)) AS k", "concat('r', id % 3) AS b")
    got = relational.join(left, right, how)
    shares = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < sum(shares) / 2
    want = left.join(right, "k", {"outer": "full"}.get(how, how))
    assert got.dtypes == want.dtypes
    count = lambda df: sorted(map(str, df.groupBy("k", "a", "b").count().collect()))
    assert count(got) == count(want) and sum(shares) == 1990 * 990 + {"inner": 0, "left": 10, "right": 10, "outer": 20}[how]
