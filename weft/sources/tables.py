"""The driver's Parquet tables as a property graph, and typed-header CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import FIRST_ID, NodeTable, PropertyGraph, RelTable, widened

#: Ids of one table lie in its own range of this size.
RANGE = 1 << 48


def _id(ordinal: int, key: str):
    return (F.lit(ordinal * RANGE).cast("bigint") + F.col(key).cast("bigint")).alias("id")


def _end(ordinal: int, key: str, name: str):
    return (F.lit(ordinal * RANGE).cast("bigint") + F.col(key).cast("bigint")).alias(name)


#: Node tables: label -> (ordinal, table, key, {property: column}).
NODES = {
    "Region": (1, "region", "r_regionkey", {"name": "r_name"}),
    "Nation": (2, "nation", "n_nationkey", {"name": "n_name"}),
    "Customer": (3, "customer", "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}),
    "Supplier": (4, "supplier", "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal"}),
    "Part": (5, "part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
    "Order": (6, "orders", "o_orderkey", {"orderstatus": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "orderpriority": "o_orderpriority"}),
    "Event": (8, "events", "event_id", {"ts": "ts", "event_type": "event_type", "value": "value", "props": "props"}),
    "Document": (9, "documents", "doc_id", {"lang": "lang", "source": "source", "n_chars": "n_chars", "text": "text"}),
}
#: A turn's key within its table's range: the conversation, and below it 16 bits for the turn.
TURN_BITS = 16


def driver_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Each table is read only once a query needs it. Customers, orders, parts, suppliers, nations, regions, users, events, documents and turns of conversations as nodes and relationships."""
    read = lambda t: widened(spark.read.parquet(f"{sf_dir}/{t}.parquet"))

    def node(o, t, key, props):
        return lambda: read(t).select(_id(o, key), *[F.col(c).alias(p) for p, c in props.items()])

    nodes = [NodeTable((label,), node(*spec)) for label, spec in NODES.items()]
    nodes.append(NodeTable(("User",), lambda: read("events").select(_id(7, "user_id")).distinct()))

    def turns():
        key = F.shiftleft(F.col("conv_id").cast("bigint"), TURN_BITS) + F.col("turn").cast("bigint")
        return read("conversations").withColumn("key", key)

    nodes.append(NodeTable(("Turn",), lambda: turns().select(_id(10, "key"), "role", "text")))

    def following():
        after = F.expr("lead(key) over (partition by conv_id order by turn)")
        return turns().select("key", "conv_id", "turn").withColumn("next", after).where("next is not null")

    def rel(kind, ordinal, df, key, start, end, props=None, whole=False):
        (so, sk, sl), (eo, ek, el) = start, end

        def make():
            cols = [_id(ordinal, key), _end(so, sk, "src"), _end(eo, ek, "dst")]
            return df().select(*cols, *[F.col(c).alias(p) for p, c in (props or {}).items()])

        return RelTable(kind, make, (sl,), (el,), whole)

    def lines():
        # line items have no key; rows are distinct, so a hash of the row identifies it
        li = read("lineitem")
        return li.withColumn("k", F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in li.columns]), 16))

    def supplies():
        return read("lineitem").select("l_suppkey", "l_partkey").distinct().withColumn("k", F.shiftrightunsigned(F.xxhash64("l_suppkey", "l_partkey"), 16))

    def followed():
        following = F.expr("lead(event_id) over (partition by user_id order by ts, event_id)")
        return read("events").select("event_id", "user_id", "ts").withColumn("next", following).where("next is not null")

    line_props = {k: f"l_{k}" for k in ("linenumber", "suppkey", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")}
    rels = [
        rel("IN_REGION", 11, lambda: read("nation"), "n_nationkey", (2, "n_nationkey", "Nation"), (1, "n_regionkey", "Region")),
        rel("IN_NATION", 12, lambda: read("customer"), "c_custkey", (3, "c_custkey", "Customer"), (2, "c_nationkey", "Nation")),
        rel("IN_NATION", 13, lambda: read("supplier"), "s_suppkey", (4, "s_suppkey", "Supplier"), (2, "s_nationkey", "Nation")),
        rel("PLACED", 14, lambda: read("orders"), "o_orderkey", (3, "o_custkey", "Customer"), (6, "o_orderkey", "Order")),
        rel("CONTAINS", 15, lines, "k", (6, "l_orderkey", "Order"), (5, "l_partkey", "Part"), line_props),
        rel("SUPPLIES", 16, supplies, "k", (4, "l_suppkey", "Supplier"), (5, "l_partkey", "Part")),
        rel("DID", 17, lambda: read("events"), "event_id", (7, "user_id", "User"), (8, "event_id", "Event"), whole=True),
        rel("FOLLOWED_BY", 18, followed, "event_id", (8, "event_id", "Event"), (8, "next", "Event"), whole=True),
        rel("NEXT", 19, following, "key", (10, "key", "Turn"), (10, "next", "Turn"), whole=True),
    ]
    return PropertyGraph(tuple(nodes), tuple(rels), next_id=FIRST_ID)  # all table ranges lie below


_CSV_TYPES = {"int": "bigint", "date": "date", "id": "string", "": "string"}


def read_typed_csv(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """A CSV file whose header cells are ``name:type``.

    ID cells give the column ``id`` and a string property of the cell's name (``id_text`` if that is id: a node's
    property ``id`` is read from it); START_ID and END_ID give
    ``src`` and ``dst``; LABEL and TYPE are kept as ``label`` and ``type``; ``string[]`` is
    split at ``;``; IGNORE cells are left out; an empty cell is null.
    """
    raw = spark.read.csv(path, sep=sep, header=True)
    out = []
    for cell in raw.columns:
        name, _, kind = cell.partition(":")
        kind = kind.lower()
        c = F.col(f"`{cell}`")
        c = F.when(c != "", c)
        if kind == "ignore":
            continue
        if kind == "id":
            out += [c.cast("bigint").alias("id"), *([c.alias("id_text" if name == "id" else name)] if name else [])]
        elif kind in ("start_id", "end_id"):
            out.append(c.cast("bigint").alias("src" if kind == "start_id" else "dst"))
        elif kind in ("label", "type"):
            out.append(c.alias(kind))
        elif kind.endswith("[]"):
            out.append(F.split(c, ";").alias(name))
        else:
            out.append(c.cast(_CSV_TYPES.get(kind, "string")).alias(name))
    return raw.select(*out)


#: Labels that stand besides a file's own ones.
MORE_LABELS = {"Comment": ("Message",), "Post": ("Message",)}


def read_typed_graph(spark: SparkSession, nodes: list[str], rels: list[str], sep: str = "|", more: dict[str, tuple[str, ...]] | None = None) -> PropertyGraph:
    """A graph of typed CSV files. A file's LABEL column names its nodes' labels (several are joined by ``;``), its TYPE
    column the relationships' types; files without one give no label or type. Labels of ``more`` stand besides."""
    more = MORE_LABELS if more is None else more

    def split(path, column):
        df = read_typed_csv(spark, path, sep)
        if column not in df.columns:
            return [("", df)]
        names = [r[0] for r in df.select(column).distinct().collect()]  # labels and types, a handful a file
        return [(n or "", df.where(F.col(column).eqNullSafe(n)).drop(column)) for n in sorted(names, key=lambda n: n or "")]

    node_tables, rel_tables = [], []
    for path in nodes:
        for name, df in split(path, "label"):
            own = tuple(x for x in name.split(";") if x)
            node_tables.append(NodeTable((*own, *(x for o in own for x in more.get(o, ()))), df))
    for i, path in enumerate(rels):
        for j, (name, df) in enumerate(split(path, "type")):
            if "id" not in df.columns:
                first = ((i << 10) + j) << 43
                df = df.withColumn("id", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 43) - 1)) + F.lit(first))
            rel_tables.append(RelTable(name, df))
    return PropertyGraph(tuple(node_tables), tuple(rel_tables))
