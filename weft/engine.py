"""The engine: a graph, parameters and registries behind ``run``."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.writes import Writer
from .plans.compiler import Compiler, SemanticError
from .plans.parser import parse
from .sources.catalog import PropertyGraph


@dataclass(frozen=True)
class Procedure:
    """A function from arguments to a Column (one value a row) or a DataFrame (a table)."""

    function: Callable
    yields: str = "value"


@dataclass
class Result:
    """A query's rows, and what they were made from."""

    df: DataFrame
    text: str
    tree: tuple

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def records(self):
        return self.df.toLocalIterator()

    def cache(self) -> Result:
        return Result(self.df.cache(), self.text, self.tree)

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)


class Engine:
    def __init__(self, spark: SparkSession, graph: PropertyGraph | None = None, hop_limit: int = 30):
        self.spark, self.graph, self.hop_limit = spark, graph or PropertyGraph(), hop_limit
        self.functions: dict[str, Callable[..., Column]] = {}
        self.procedures: dict[str, Procedure] = {}
        self.aggregates: dict[str, Callable[..., Column]] = {}
        self._parsed: dict[str, tuple] = {}
        # placeholders of a full-text index: they answer with an empty text
        self.register_procedure("db.index.fulltext.queryNodes", lambda index, text: F.lit(""))
        self.register_procedure("db.index.fulltext.createNodeIndex", lambda name, labels, properties: F.lit(""))

    def register_function(self, name: str, function: Callable[..., Column]) -> None:
        """A scalar function over Columns: native expressions, or a pandas UDF."""
        self.functions[name.lower()] = function

    def function(self, name: str | None = None, nulls: bool = True):
        """Decorator: a scalar function whose number of arguments is checked; without ``nulls`` it is null where an argument is."""
        def put(f):
            low, slots = (name or f.__name__).lower(), inspect.signature(f).parameters.values()
            least = sum(p.default is p.empty and p.kind is not p.VAR_POSITIONAL for p in slots)
            most = None if any(p.kind is p.VAR_POSITIONAL for p in slots) else len(slots)

            def call(*args: Column) -> Column:
                if len(args) < least or (most is not None and len(args) > most):
                    raise SemanticError(f"{low} takes {least if least == most else f'{least} to {most}'} arguments, not {len(args)}")
                if nulls or not args:
                    return f(*args)
                return F.when(reduce(lambda a, b: a & b, [a.isNotNull() for a in args]), f(*args))

            self.functions[low] = call
            return f

        return put

    def register_aggregate(self, name: str, function: Callable[..., Column]) -> None:
        """An aggregate over Columns: composed of Spark's aggregates, or a grouped pandas UDF. ``DISTINCT`` gives it a
        set of the values as a list instead."""
        self.aggregates[name.lower()] = function

    def load(self, module: str) -> list[str]:
        """Import a module and register what it names: ``FUNCTIONS``, ``AGGREGATES`` and ``PROCEDURES``, each a dict by name."""
        found = importlib.import_module(module)
        for kind, put in (("FUNCTIONS", self.register_function), ("AGGREGATES", self.register_aggregate), ("PROCEDURES", self.register_procedure)):
            for name, f in getattr(found, kind, {}).items():
                put(name, f)
        return sorted(n for kind in ("FUNCTIONS", "AGGREGATES", "PROCEDURES") for n in getattr(found, kind, {}))

    def register_procedure(self, name: str, function: Callable, yields: str = "value") -> None:
        wrapped = lambda *a: function(*[x.col for x in a])
        wrapped.__wrapped__ = function
        self.procedures[name.lower()] = Procedure(wrapped, yields)

    def compile(self, text: str) -> tuple:
        if text not in self._parsed:
            if len(self._parsed) > 1_000:
                self._parsed.clear()
            self._parsed[text] = parse(text)
        return self._parsed[text]

    def run(self, text: str, params: dict | None = None) -> Result:
        tree = self.compile(text)
        writer = Writer(self.graph)
        compiler = Compiler(self.spark, self.graph, params or {}, self.functions, self.procedures, writer, self.hop_limit, self.aggregates)
        df = compiler.run(tree)
        self.graph = writer.graph
        return Result(df, text, tree)

    def sql(self, text: str, params: dict | None = None) -> DataFrame:
        return self.run(text, params).df

    def indexes(self) -> list[tuple[str, tuple[str, ...]]]:
        return sorted(self.graph.indexes)
