"""Property graphs over DataFrames: node tables by label set, relationship tables by type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Created entities take ids from here on, above all table ranges.
FIRST_ID = 1 << 61

_WIDEN = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


def widened(df: DataFrame) -> DataFrame:
    """Integers as 64-bit, floats as doubles."""
    return df.select(*[F.col(f"`{n}`").cast(_WIDEN[t]).alias(n) if t in _WIDEN else F.col(f"`{n}`") for n, t in df.dtypes])


class _Table:
    """Holds a DataFrame, or a function that makes it when it is first needed."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame]):
        self._df = df
        self.overlays = 0  # updates that are still joins over the table

    @property
    def df(self) -> DataFrame:
        if callable(self._df) and not isinstance(self._df, DataFrame):
            self._df = self._df()
        return self._df


class NodeTable(_Table):
    """Nodes that all have the same labels: column ``id`` (bigint), one column per property."""

    def __init__(self, labels: tuple[str, ...], df):
        super().__init__(df)
        self.labels = tuple(labels)

    def over(self, df) -> NodeTable:
        return NodeTable(self.labels, df)


class RelTable(_Table):
    """Relationships of one type: ``id``, ``src``, ``dst`` (bigint) and properties; known end labels prune scans.

    ``whole`` says that the nodes at both ends exist for sure, so that relationships can be counted alone.
    """

    def __init__(self, type: str, df, start: tuple[str, ...] = (), end: tuple[str, ...] = (), whole: bool = False):
        super().__init__(df)
        self.type, self.start, self.end, self.whole = type, tuple(start), tuple(end), whole

    def over(self, df, type: str | None = None) -> RelTable:
        return RelTable(self.type if type is None else type, df, self.start, self.end)


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable graph; writes make new ones. Ids are unique over all nodes, and over all relationships."""

    nodes: tuple[NodeTable, ...] = ()
    rels: tuple[RelTable, ...] = ()
    indexes: frozenset[tuple[str, tuple[str, ...]]] = field(default_factory=frozenset)
    #: The id of the next created entity, at least FIRST_ID; None: not known yet.
    next_id: int | None = None

    def node_tables(self, labels=()) -> list[NodeTable]:
        return [t for t in self.nodes if set(labels) <= set(t.labels)]

    def rel_tables(self, types=()) -> list[RelTable]:
        return [t for t in self.rels if not types or t.type in types]

    def node_at(self, id: int) -> DataFrame:
        """The node with this id: column ``n``, no row if there is none. Only the id's filter runs over the tables."""
        spark = (self.nodes or self.rels)[0].df.sparkSession
        return node_scan(self, (), None, spark).where(F.col("n.id") == F.lit(id))

    def with_nodes(self, *tables: NodeTable) -> PropertyGraph:
        return replace(self, nodes=self.nodes + tables)

    def with_rels(self, *tables: RelTable) -> PropertyGraph:
        return replace(self, rels=self.rels + tables)

    # counts that need no columns: a count over Parquet reads footers only
    def count_nodes(self, label: str | None = None) -> int:
        return sum(t.df.count() for t in self.node_tables((label,) if label else ()))

    def count_rels(self, type_: str | None = None) -> int:
        return sum(t.df.count() for t in self.rel_tables((type_,) if type_ else ()))


def properties_of(tables, skip: frozenset[str], wanted: set[str] | None = None) -> dict[str, T.DataType]:
    """Names and types of the wanted properties over tables; numbers widen, and a property of other conflicting types holds variants."""
    out: dict[str, T.DataType] = {}
    for t in tables:
        for f in t.df.schema.fields:
            if f.name in skip or (wanted is not None and f.name not in wanted):
                continue
            known = out.get(f.name)
            if known is None or isinstance(known, T.NullType):
                out[f.name] = f.dataType
            elif known != f.dataType and not isinstance(f.dataType, T.NullType):
                numbers = {known.simpleString(), f.dataType.simpleString()}
                if numbers <= {"bigint", "double"}:
                    out[f.name] = T.DoubleType()
                else:
                    out[f.name] = T.VariantType()
    return dict(sorted(out.items()))


def _prop(df: DataFrame, name: str, dtype: T.DataType) -> Column:
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(dtype).alias(name)


def node_scan(graph: PropertyGraph, labels, wanted: set[str] | None, spark) -> DataFrame:
    """One column ``n``: struct<id, labels, properties>, restricted to wanted properties (None: all)."""
    tables = graph.node_tables(labels)
    props = properties_of(tables, frozenset({"id"}), wanted)
    parts = [t.df.select(F.struct(F.col("id"), F.array(*[F.lit(x) for x in t.labels]).cast("array<string>").alias("labels"), *[_prop(t.df, k, v) for k, v in props.items()]).alias("n")) for t in tables]
    if not parts:
        schema = T.StructType([T.StructField("n", T.StructType([T.StructField("id", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType())), *[T.StructField(k, v) for k, v in props.items()]]))])
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def rel_scan(graph: PropertyGraph, types, wanted: set[str] | None, spark) -> DataFrame:
    """One column ``r``: struct<id, src, dst, type, properties>."""
    tables = graph.rel_tables(types)
    skip = frozenset({"id", "src", "dst"})
    props = properties_of(tables, skip, wanted)
    parts = [t.df.select(F.struct("id", "src", "dst", F.lit(t.type).alias("type"), *[_prop(t.df, k, v) for k, v in props.items()]).alias("r")) for t in tables]
    if not parts:
        fields = [T.StructField(k, T.LongType()) for k in ("id", "src", "dst")] + [T.StructField("type", T.StringType()), *[T.StructField(k, v) for k, v in props.items()]]
        return spark.createDataFrame([], T.StructType([T.StructField("r", T.StructType(fields))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
