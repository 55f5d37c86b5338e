"""Syntax tree to DataFrame: every clause becomes ordinary DataFrame operations for Catalyst.

A variable is a column of its name; nodes, relationships and paths are structs. Scans
build those structs with just the properties that the query names (all of them only if
an entity is used whole), so Parquet scans stay pruned. Labels and types choose tables
before Catalyst sees a plan, and a shared variable is an equi-join on ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations, takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import anyvalue, temporal
from ..functions.scalar import FUNCTIONS, Arg, is_list, is_node, is_path, is_rel
from ..operators import counting, paths
from ..sources.catalog import PropertyGraph, node_scan, rel_scan
from .parser import AGGREGATES, has_aggregate, rewrite, walk


#: Types of literals by their Python type.
_LITERAL_TYPES = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}


#: Functions whose results have one type, whatever their arguments (as long as no argument is the literal null).
_RESULT_TYPES = {
    **dict.fromkeys(("tostring", "left", "right", "ltrim", "rtrim", "trim", "replace", "tolower", "lower", "toupper", "upper", "substring", "type"), T.StringType()),
    **dict.fromkeys(("tointeger", "size", "length", "id", "timestamp"), T.LongType()),
    **dict.fromkeys(("tofloat", "round", "ceil", "floor", "sqrt", "exp", "log", "log10", "sin", "cos", "tan", "pi", "e", "rand", "distance"), T.DoubleType()),
    **dict.fromkeys(("toboolean", "exists", "isempty"), T.BooleanType()),
    **dict.fromkeys(("duration", "duration.between", "duration.inmonths", "duration.indays", "duration.inseconds"), temporal.DURATION),
    "datetime": temporal.ZONED, "datetime.truncate": temporal.ZONED, "localdatetime": T.TimestampNTZType(), "localdatetime.truncate": T.TimestampNTZType(),
    "date": T.DateType(), "date.truncate": T.DateType(), "labels": T.ArrayType(T.StringType()), "range": T.ArrayType(T.LongType()),
}


#: Functions that take a value of unknown type as text, or as a number.
_OF_TEXT = frozenset("left right ltrim rtrim trim replace tolower lower toupper upper substring split size tointeger tofloat toboolean tostring reverse".split())
_OF_NUMBERS = frozenset("abs ceil floor round sign sqrt exp log log10 sin cos tan cot acos asin atan atan2 degrees radians haversin power".split())


class SemanticError(ValueError):
    """The query is well-formed but means nothing over this graph."""


@dataclass
class Var:
    """How to read a variable: its column where it is used, and its name among the scratch columns."""

    col: Column
    scratch: str


class Scope:
    """Variables over a DataFrame, and types of expressions over them.

    Types are found once per expression: they are remembered by syntax tree, and those that the parser can't
    tell are asked of Spark over an empty scratch DataFrame with the variables' types and nothing else below it.
    """

    def __init__(self, df: DataFrame, extra: dict[str, Var] | None = None, types: dict[str, T.DataType] | None = None, memo: dict | None = None, spark: SparkSession | None = None, probes: bool = False):
        self.df, self.extra, self.memo, self.probes = df, extra or {}, {} if memo is None else memo, probes
        self.types = types if types is not None else {f.name: f.dataType for f in df.schema.fields}
        self.spark = spark or df.sparkSession

    def names(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__h_")]

    def get(self, name: str) -> Var | None:
        if name in self.extra:
            return self.extra[name]
        return Var(F.col(f"`{name}`"), name) if name in self.types else None

    def bind(self, name: str, col: Column, dtype: T.DataType) -> Scope:
        """This scope and one more variable; scopes of like variables share what is known of types."""
        scratch = f"__l_{name}_{len(self.extra)}"
        memo = self.memo.setdefault(("bind", scratch, dtype.json()), {})
        return Scope(self.df, {**self.extra, name: Var(col, scratch)}, {**self.types, scratch: dtype}, memo, self.spark)

    def probing(self) -> Scope:
        """The same variables as scratch columns."""
        return Scope(self.df, {k: Var(F.col(f"`{v.scratch}`"), v.scratch) for k, v in self.extra.items()}, self.types, self.memo, self.spark, True)

    @property
    def scratch(self) -> DataFrame:
        if "scratch" not in self.memo:
            self.memo["scratch"] = self.spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in self.types.items()])
        return self.memo["scratch"]


def _whole_use(tree) -> bool:
    """Whether some entity is used as a whole, so that all its properties are needed."""
    def bare(e, top=False):
        if not isinstance(e, tuple) or not e:
            return False
        if e[0] == "var":
            return True
        if e[0] in ("prop", "haslabels"):
            return e[1][0] != "var" and bare(e[1])
        if e[0] == "call" and isinstance(e[1], str) and e[1].lower() in ("id", "type", "labels", "count", "length", "exists", "startnode", "endnode", "size"):
            return e[1].lower() in ("startnode", "endnode") or any(bare(a) for a in e[2] if a[0] != "var")
        if e[0] == "isnull":
            return e[1][0] != "var" and bare(e[1])
        return any(bare(x) for x in e if isinstance(x, tuple))

    for n in walk(tree):
        if n[0] == "return" and isinstance(n[3], tuple) and (n[2] or any(bare(e) for e, _ in n[3])):
            return True
        if n[0] == "with" and any(e[0] != "var" and bare(e) for e, _ in n[3]):
            return True
        if n[0] in ("unwind", "set", "remove", "foreach", "merge", "create", "index", "mapproj", "delete"):
            return True
    return False


class Compiler:
    def __init__(self, spark: SparkSession, graph: PropertyGraph, params: dict, functions: dict, procedures: dict, writer=None, hop_limit: int = 30, aggregates: dict | None = None):
        self.spark, self.graph, self.params = spark, graph, params
        self.functions, self.procedures, self.writer, self.hop_limit = functions, procedures, writer, hop_limit
        self.aggregates = aggregates or {}
        self.wanted: set[str] | None = None
        self.fresh = 0
        #: Conjuncts that are applied as soon as their variable is bound, by variable.
        self.early: dict[str, list[tuple]] = {}
        #: A variable of the outer rows that a pattern is joined to by its id alone.
        self.free: str | None = None
        #: A column that says for how many matches a row stands; None: each row is one.
        self.weight: str | None = None

    def hidden(self, kind: str) -> str:
        self.fresh += 1
        return f"__h_{kind}{self.fresh}"

    def unit(self) -> DataFrame:
        return self.spark.range(1).select()

    # -- statements ----------------------------------------------------------------------------

    def run(self, tree) -> DataFrame:
        if self.aggregates:  # calls of registered aggregates are marked, so that they group like the built-in ones
            mark = lambda n: ("call", "aggregate()", (("lit", n[1].lower()), *(rewrite(a, mark) for a in n[2])), n[3]) if n[0] == "call" and isinstance(n[1], str) and n[1].lower() in self.aggregates else None
            tree = rewrite(tree, mark)
        _, parts, kinds = tree
        self.wanted = None if _whole_use(tree) else self._named_properties(tree)
        out = self.single(parts[0])
        for part, kind in zip(parts[1:], kinds):
            other = self.single(part)
            if set(other.columns) != set(out.columns):
                raise SemanticError("UNION needs the same columns on both sides")
            out = out.unionByName(other)
            if kind == "distinct":
                out = self.distinct(out)
        return out

    @staticmethod
    def distinct(df: DataFrame) -> DataFrame:
        """Distinct rows; values of unknown type, which Spark can't compare, are compared by their keys."""
        odd = [f for f in df.schema.fields if anyvalue.holds_variant(f.dataType)]
        if not odd:
            return df.distinct()
        names = {f.name: f"__h_is_{i}" for i, f in enumerate(odd)}
        keyed = df.withColumns({names[f.name]: anyvalue.identity(F.col(f"`{f.name}`"), f.dataType) for f in odd})
        return keyed.dropDuplicates([names.get(c, c) for c in df.columns]).drop(*names.values())

    @staticmethod
    def _named_properties(tree) -> set[str]:
        out = {n[2] for n in walk(tree) if n[0] == "prop" and isinstance(n[2], str)}
        out |= {"id_text"} if "id" in out else set()
        for n in walk(tree):
            if n[0] in ("node", "rel"):
                props = n[3] if n[0] == "node" else n[4]
                if props and props[0] == "map":
                    out |= {k for k, _ in props[1]}
                elif props:
                    out |= {"*"}
        return out

    def single(self, clauses) -> DataFrame:
        self.df = self.unit()
        self.order: list[tuple[str, bool]] = []
        if self.wanted is not None and "*" in self.wanted:
            self.wanted = None
        result = None
        if (counted := self.counted(clauses)) is not None:
            return counted
        clauses, (begin, tree) = list(clauses), self.tree_of(clauses) or (0, None)
        if tree:
            self.weight = self.hidden("w")
            self.df = self.matches_of(tree[0], None, tree, self.weight)
        for i, c in enumerate(clauses):
            if i < begin:
                continue
            kind = c[0]
            if kind == "match":
                self.df = self.match(self.df, c)
            elif kind in ("return", "with"):
                self.df = self.project(c)
                self.weight = None
                if kind == "return":
                    result = self.df
                    if i + 1 < len(clauses):
                        raise SemanticError("RETURN must be last")
            elif kind == "unwind":
                self.df = self.unwind(c[1], c[2])
            elif kind == "call":
                result = self.call(c)
                self.df = result
            else:
                if self.writer is None:
                    raise SemanticError(f"{kind} needs a graph that can be written")
                self.df = self.writer.apply(self, c)
                result = None
        if result is None:
            result = self.spark.createDataFrame([], "empty boolean").select()
        return result.select(*[f"`{c}`" for c in result.columns if not c.startswith("__h_")])

    def counted(self, clauses) -> DataFrame | None:
        """``MATCH (n:Label) RETURN count(n)`` and the like as a count over tables: no column is read, only Parquet's
        row counts. Relationships are counted so where their tables say that both ends exist."""
        if len(clauses) != 2 or clauses[0][0] != "match" or clauses[1][0] != "return":
            return None
        (_, optional, pats, where), (_, distinct, star, items, order, skip, limit, _) = clauses
        if optional or where or len(pats) != 1 or pats[0][1] or pats[0][2] or distinct or star or order or skip or limit or not items:
            return None
        el = pats[0][3]
        if any(e[3] for e in el[::2]) or not all(e[0] == "call" and e[1].lower() == "count" and not e[3] for e, _ in items):
            return None
        if len(el) == 1:
            tables = self.graph.node_tables(el[0][2])
        elif len(el) == 3 and not el[1][3] and not el[1][4] and el[1][5] != "both" and el[0][1] != el[2][1] and not el[0][2] and not el[2][2]:
            tables = self.graph.rel_tables(el[1][2])
            if not all(t.whole for t in tables):
                return None
        else:
            return None
        names = {e[1] for e in el}
        if any(e[2] and (e[2][0][0] != "var" or e[2][0][1] not in names) for e, _ in items) or not tables:
            return None
        rows = reduce(DataFrame.unionAll, [t.df.select(F.lit(1).alias("x")) for t in tables])
        return rows.agg(*[F.count(F.lit(1)).alias(a) for _, a in items])

    def tree_of(self, clauses) -> tuple[int, tuple] | None:
        """Whether the MATCH clauses at the beginning are only counted, by one node at most: how many clauses there are, and
        the pattern as a tree below that node, (root, nodes, links, conditions).

        Matches of a tree needn't be made to be counted: those of its branches are counted by node and multiplied
        (``matches_of``). Conditions have to concern single nodes, and relationships that must differ to be branches of one node.
        """
        head = list(takewhile(lambda c: c[0] == "match", clauses))
        if not head or len(head) == len(clauses) or clauses[len(head)][0] not in ("return", "with"):
            return None
        _, _, star, items, *_ = clauses[len(head)]
        nodes: dict[str, list] = {}
        links, conditions = [], {}
        for at, (_, optional, pats, _) in enumerate(head):
            for _, pname, kind, el in pats:
                if optional or pname or kind or any(r[3] for r in el[1::2]) or any(e[-1 if e[0] == "node" else 4] and not self._constant_props(e[-1 if e[0] == "node" else 4]) for e in el):
                    return None
                for e in el[::2]:
                    nodes.setdefault(e[1], []).append(e)
                links += [(at, a[1], r, b[1]) for a, r, b in zip(el[::2], el[1::2], el[2::2])]
        rels = {r[1] for _, _, r, _ in links}
        if star or len(links) < 2 or len(rels) < len(links) or rels & set(nodes) or len(links) != len(nodes) - 1:
            return None
        for c in (c for m in head if m[3] for c in self._conjuncts(m[3])):
            if (name := self._of_one(c)) not in nodes:
                return None
            conditions.setdefault(name, []).append(c)
        calls, keys = [], set()
        pull = lambda n: calls.append(n) or ("lit", None) if n[0] == "call" and isinstance(n[1], str) and n[1].lower() in AGGREGATES else None
        for e, _ in items:
            rest = rewrite(e, pull)
            if any(n[0] in ("pattern", "patcomp") for n in walk(rest)):
                return None
            keys |= {n[1] for n in walk(rest) if n[0] == "var"}
        known = rels | set(nodes)
        if not calls or any(n[1].lower() != "count" or n[3] or (n[2] and (n[2][0][0] != "var" or n[2][0][1] not in known)) for n in calls):
            return None
        if len(keys) > 1 or not keys <= set(nodes):
            return None
        for root in keys or nodes:
            tree = (root, nodes, links, conditions)
            if self._countable(tree):
                return len(head), tree
        return None

    @staticmethod
    def _branches(name: str, above: str | None, links) -> list[tuple]:
        """Links from a node of a tree downwards: (clause, relationship, whether it is followed against its writing, node)."""
        out = [(at, r, False, b) for at, a, r, b in links if a == name and r[1] != above]
        return out + [(at, r, True, a) for at, a, r, b in links if b == name and r[1] != above]

    @staticmethod
    def _must_differ(x, y) -> bool:
        """Whether two relationships have to be different ones: those of one clause that can be of one type."""
        return x[0] == y[0] and (not x[1][2] or not y[1][2] or bool(set(x[1][2]) & set(y[1][2])))

    def _groups(self, branches) -> list[list[tuple]]:
        """Branches of a node; those whose relationships must differ are together."""
        out: list[list[tuple]] = []
        for b in branches:
            near = [g for g in out if any(self._must_differ(b, x) for x in g)]
            out = [g for g in out if g not in near] + [[*(x for g in near for x in g), b]]
        return out

    def _countable(self, tree) -> bool:
        """Whether all nodes hang below the root, and only branches of one node must differ, each from all others of its group."""
        root, nodes, links, _ = tree
        todo, seen, allowed = [(root, None)], set(), 0
        while todo:
            name, above = todo.pop()
            if name in seen:
                return False
            seen.add(name)
            branches = self._branches(name, above, links)
            for g in self._groups(branches):
                pairs = [self._must_differ(x, y) for x, y in combinations(g, 2)]
                if not all(pairs) or len(g) > counting.MOST:
                    return False
                allowed += len(pairs)
            todo += [(b, r[1]) for _, r, _, b in branches]
        every = [(at, r) for at, _, r, _ in links]
        return seen == set(nodes) and allowed == sum(self._must_differ(x, y) for x, y in combinations(every, 2))

    def matches_of(self, name: str, above, tree, weight: str) -> DataFrame:
        """A node's rows, and in ``weight`` the number of matches of the part of the tree below it; rows without any are left out."""
        _, nodes, links, conditions = tree
        branches = self._branches(name, above[0][1] if above else None, links)
        labels = tuple(dict.fromkeys(x for _, _, own, _ in nodes[name] for x in own))
        ends = [(r, not flip) for _, r, flip, _ in branches] + ([above] if above else [])
        implied = tuple(dict.fromkeys((*labels, *(x for r, flip in ends for x in self.end_labels(r, flip)))))
        props = [n[3] for n in nodes[name] if n[3]]
        df = self.scan_as(name, implied if self.graph.node_tables(implied) else labels, props[0] if props else None)
        for p in props[1:]:
            df = self.with_props(df, name, p)
        outer, self.early = self.early, conditions
        try:
            df = self.with_early(df, name).withColumn(weight, F.lit(1).cast("bigint"))
        finally:
            self.early = outer
        for group in self._groups(branches):
            parts = []
            for _, r, flip, b in group:
                e = self.with_props_of_edge(self.edges(r, flip).withColumnRenamed("r", r[1]), r[1], r[4], None)
                below = self.matches_of(b, (r, flip), tree, weight).select(F.col(f"`{b}`.id").alias("__id"), weight)
                parts.append(e.join(below, e["__to"] == below["__id"]).select("__from", F.col(f"`{r[1]}`.id").alias("__rel"), F.col(weight).alias("__n")))
            df = df.join(counting.choices(parts), F.col(f"`{name}`.id") == F.col("__from")).withColumn(weight, F.col(weight) * F.col("__n")).drop("__from", "__n")
        return df

    def unwind(self, e, name: str) -> DataFrame:
        df, e = self.attach(self.df, e)
        scope = Scope(df)
        col = self.expr(e, scope)
        if not is_list(self.dtype(e, scope)):
            col = F.when(col.isNotNull(), F.array(col))
        return df.select(*[f"`{c}`" for c in df.columns if c != name], F.explode(col).alias(name))

    def call(self, c) -> DataFrame:
        _, name, args, items, where = c
        fn = self.procedures.get(name.lower())
        if fn is None:
            raise SemanticError(f"unknown procedure {name}")
        scope = Scope(self.df)
        if args is None:
            import inspect

            args = tuple(("param", p) for p in inspect.signature(fn.function).parameters if p in self.params)
        made = fn.function(*[self.arg(a, scope) for a in args])
        if isinstance(made, DataFrame):
            out = self.df.crossJoin(made)  # a table-valued procedure is applied to every row
            names = made.columns
        else:
            names = [fn.yields]
            out = self.df.withColumn(fn.yields, made)
        keep = self.df.columns
        wanted = items or tuple((n, n) for n in names)
        for n, _ in wanted:
            if n not in names:
                raise SemanticError(f"{name} does not yield {n}")
        out = out.select(*[f"`{k}`" for k in keep], *[F.col(f"`{n}`").alias(a) for n, a in wanted])
        return out.where(self.expr(where, Scope(out))) if where else out

    # -- projection ----------------------------------------------------------------------------

    def project(self, c) -> DataFrame:
        kind, distinct, star, items, order, skip, limit, where = c
        df = self.df
        if star:
            items = tuple((("var", n), n) for n in Scope(df).names() if not n.startswith("__")) + items
        if len({a for _, a in items}) < len(items):
            raise SemanticError("two columns have one name")
        df, items = self.attach_items(df, items)
        aggregated = any(has_aggregate(e) for e, _ in items)
        sort: list[tuple[str, bool]] = []
        if aggregated:
            out = self.aggregate(df, items)
            for e, up in order:
                name = next((a for x, a in items if x == e), None)
                h = self.hidden("o")
                out = out.withColumn(h, F.col(f"`{name}`") if name else self.expr(e, Scope(out)))
                sort.append((h, up))
            self.order = []
        else:
            scope = Scope(df)
            cols = [self.expr(e, scope).alias(a) for e, a in items]
            if distinct:
                out = self.distinct(df.select(*cols))
                for e, up in order:
                    h = self.hidden("o")
                    name = next((a for x, a in items if x == e), None)
                    out = out.withColumn(h, F.col(f"`{name}`") if name else self.expr(e, Scope(out)))
                    sort.append((h, up))
                self.order = []
            else:
                extra = []
                by_alias = {a: e for e, a in items}
                for e, up in order:
                    h = self.hidden("o")
                    e = rewrite(e, lambda n: by_alias[n[1]] if n[0] == "var" and n[1] in by_alias and by_alias[n[1]] != n else None)
                    df, e = self.attach(df, e)
                    extra.append(self.expr(e, Scope(df)).alias(h))
                    sort.append((h, up))
                carried = [] if order else [n for n, _ in self.order]
                out = df.select(*cols, *extra, *[f"`{n}`" for n in carried])
                if order:
                    self.order = []
        if distinct and aggregated:
            out = self.distinct(out)
        if sort:
            types = dict(zip(out.columns, (f.dataType for f in out.schema.fields)))
            out = out.withColumns({h: anyvalue.key(F.col(h), types[h]) for h, _ in sort if anyvalue.is_variant(types[h])}) if any(anyvalue.is_variant(types[h]) for h, _ in sort) else out
            out = out.orderBy(*[F.col(h).asc_nulls_last() if up else F.col(h).desc_nulls_first() for h, up in sort])
            self.order = sort if kind == "with" else []
        if skip is not None:
            out = out.offset(self.constant(skip))
        if limit is not None:
            out = out.limit(self.constant(limit))
        if where is not None:
            out = self.filter(out, where)
        return out

    def constant(self, e) -> int:
        row = self.unit().select(self.expr(e, Scope(self.unit())).alias("v")).first() if e[0] not in ("lit", "param") else [e[1] if e[0] == "lit" else self.params[e[1]]]
        if not isinstance(row[0], int) or row[0] < 0:
            raise SemanticError("SKIP and LIMIT take whole numbers from 0")
        return row[0]

    def aggregate(self, df: DataFrame, items) -> DataFrame:
        scope = Scope(df)
        keys = [(e, a) for e, a in items if not has_aggregate(e)]
        aggs: list[tuple[tuple, str]] = []

        def pull(n):
            if n[0] == "call" and isinstance(n[1], str) and n[1].lower() in AGGREGATES:
                if any(has_aggregate(a) for a in n[2]):
                    raise SemanticError("an aggregate within an aggregate")
                if (known := next((h for t, h in aggs if repr(t) == repr(n)), None)) is None:
                    aggs.append((n, known := self.hidden("a")))
                return ("var", known)
            return None

        post = [(rewrite(e, pull), a) if has_aggregate(e) else (("var", a), a) for e, a in items]
        inner = {repr(e): ("var", a) for e, a in keys if e[0] != "lit"}
        post = [(rewrite(e, lambda n: inner.get(repr(n))), a) for e, a in post]
        group = [self.expr(e, scope).alias(a) for e, a in keys]
        # the entity of a map projection around an aggregate is a grouping key too
        for name in dict.fromkeys(n[1][1] for e, _ in post for n in walk(e) if n[0] == "mapproj" and n[1][0] == "var" and n[1][1] in df.columns):
            h = self.hidden("k")
            group.append(F.col(f"`{name}`").alias(h))
            post = [(rewrite(e, lambda n, name=name, h=h: ("var", h) if n == ("var", name) else None), a) for e, a in post]
        ranked = {}
        for n, h in aggs:
            if n[1].lower() == "percentiledisc" and not n[3] and isinstance(t := self.dtype(n[2][0], scope), T.NumericType):
                ranked[h] = (c := self.hidden("d"), t)
                df = df.withColumn(c, self.expr(n[2][0], scope))
        keyed: dict[str, str] = {}  # places in the global order, found once a row
        for n, _ in aggs:
            low = n[1].lower()
            if (low in ("min", "max") or (low == "count" and n[3])) and repr(n[2][0]) not in keyed and anyvalue.is_variant(t := self.dtype(n[2][0], scope)):
                keyed[repr(n[2][0])] = c = self.hidden("v")
                df = df.withColumn(c, anyvalue.key(self.expr(n[2][0], scope), t))
        made = [self.agg(n, scope, keyed).alias(h) if h not in ranked else self.disc(n, *ranked[h]).alias(h) for n, h in aggs]
        odd = [(a, t) for e, a in keys if anyvalue.holds_variant(t := self.dtype(e, scope))]
        if odd:  # grouped by what Spark can compare; the value itself is that of any of the group's rows
            df = df.select("*", *[c for c, (_, a) in zip(group, keys) if a in dict(odd)]) if not set(dict(odd)) & set(df.columns) else df
            group = [g for g, (_, a) in zip(group, keys) if a not in dict(odd)] + group[len(keys):]
            for a, t in odd:
                df = df.withColumn(k := self.hidden("k"), anyvalue.identity(F.col(f"`{a}`"), t))
                group.append(F.col(k))
                made.append(F.first(F.col(f"`{a}`")).alias(a))
        out = df.groupBy(*group).agg(*made) if group else df.agg(*made)
        s = Scope(out)
        return out.select(*[self.expr(e, s).alias(a) for e, a in post])

    def agg(self, call, scope: Scope, keyed: dict[str, str]) -> Column:
        _, name, args, distinct = call
        name = name.lower()
        if self.weight:
            return F.coalesce(F.sum(self.weight), F.lit(0).cast("bigint"))  # tree_of() lets nothing but count() through
        if name == "count" and not args:
            return F.count(F.lit(1))
        if name == "aggregate()":
            cols = [self.expr(a, scope) for a in args[1:]]
            return self.aggregates[args[0][1]](*([F.collect_set(cols[0]), *cols[1:]] if distinct else cols))
        col, t = self.expr(args[0], scope), self.dtype(args[0], scope)
        place = keyed.get(repr(args[0]))
        if name == "count":
            if distinct and place:
                return F.count_distinct(F.col(place))
            key = col["id"] if is_node(t) or is_rel(t) else col
            return F.count_distinct(anyvalue.identity(col, t)) if distinct else F.count(key)
        if name == "collect":
            if distinct and anyvalue.is_variant(t):
                return F.transform(F.array_sort(F.collect_set(F.to_json(col))), F.parse_json)
            if distinct:
                return F.array_sort(F.collect_set(col)) if not (is_node(t) or is_rel(t) or is_path(t)) else F.collect_set(col)
            if self.order:
                return self._ordered(col)
            return F.collect_list(col)
        if name in ("min", "max"):
            if anyvalue.is_variant(t):
                return (F.min_by if name == "min" else F.max_by)(col, F.col(place))
            return (F.min if name == "min" else F.max)(col)
        if temporal.is_duration(t) and name in ("sum", "avg"):
            if distinct:
                # a duration has few fields, and a group few different ones; sums of equal fields of different durations must not merge
                values = F.collect_set(col)
                zero = F.struct(*[F.lit(0).cast("bigint").alias(k) for k in temporal.DURATION.names])
                parts = F.aggregate(values, zero, lambda a, v: F.struct(*[(a[k] + v[k]).alias(k) for k in temporal.DURATION.names]))
                n = F.size(values)
                total = temporal._duration(*[parts[k] for k in temporal.DURATION.names])
            else:
                n = F.count(col)
                total = temporal._duration(*[F.coalesce(F.sum(col[k]), F.lit(0)) for k in temporal.DURATION.names])
            return total if name == "sum" else F.when(n > 0, temporal.scale(total, n, True))
        col = anyvalue.number_of(col, t)
        if name == "sum":
            x = col.cast("double")
            return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0.0))
        if name == "avg":
            x = col.cast("double")
            return F.sum_distinct(x) / F.count_distinct(x) if distinct else F.avg(x)
        if name in ("stdev", "stdevp"):
            x = col.cast("double")
            if distinct:
                values = F.collect_set(x)
                mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
                ss = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
                n = F.size(values)
                return F.when(n > 1, F.sqrt(ss / (n - 1 if name == "stdev" else n))).otherwise(F.lit(0.0))
            return F.coalesce((F.stddev_samp if name == "stdev" else F.stddev_pop)(x), F.lit(0.0))
        p = self.share(args[1])
        if name == "percentilecont" and not distinct:
            return F.percentile(F.when(col.isNotNull(), col.cast("double")), F.lit(p))
        values = F.sort_array(F.collect_set(col) if distinct else F.collect_list(col))
        if name == "percentilecont":
            at = (F.size(values) - 1) * F.lit(p)
            low, high = F.get(values, F.floor(at).cast("int")).cast("double"), F.get(values, F.ceil(at).cast("int")).cast("double")
            return low + (high - low) * (at - F.floor(at))
        return F.get(values, F.greatest(F.ceil(F.size(values) * p).cast("int") - 1, F.lit(0)))

    def share(self, e) -> float:
        p = self.literal(e)
        if not isinstance(p, (int, float)) or not 0 <= p <= 1:
            raise SemanticError("a percentile lies between 0 and 1")
        return float(p)

    def disc(self, call, column: str, dtype) -> Column:
        """percentileDisc() of a number: Spark's own aggregate, which counts distinct values and merges partial counts."""
        return F.expr(f"percentile_disc({self.share(call[2][1])!r}D) within group (order by `{column}`)").cast(dtype)

    def _ordered(self, col: Column) -> Column:
        """collect() in the order of the last ORDER BY: rows carry its keys, nulls last where ascending."""
        keys = [h for h, _ in self.order]
        rows = F.collect_list(F.struct(*[F.col(h) for h in keys], col.alias("__v")))
        ups = [up for _, up in self.order]

        def compare(a, b):
            out = F.lit(0)
            for h, up in reversed(list(zip(keys, ups))):
                x, y = a[h], b[h]
                less, more = (-1, 1) if up else (1, -1)
                out = (
                    F.when(x.isNull() & y.isNull(), out).when(x.isNull(), F.lit(more)).when(y.isNull(), F.lit(less))
                    .when(x < y, F.lit(less)).when(x > y, F.lit(more)).otherwise(out)
                )
            return out

        sorted_rows = F.array_sort(rows, compare)
        return F.transform(F.filter(sorted_rows, lambda r: r["__v"].isNotNull()), lambda r: r["__v"])

    # -- matching ------------------------------------------------------------------------------

    def filter(self, df: DataFrame, where) -> DataFrame:
        """Keep rows where the predicate is true; pattern predicates at the top are semi and anti joins."""
        rest = []
        for c in self._conjuncts(where):
            negated = c[0] == "not"
            p = c[1] if negated else c
            if p[0] == "call" and p[1].lower() == "exists" and p[2][0][0] == "pattern":
                p = p[2][0]
            if p[0] == "pattern":
                df = self.semi(df, p[1], "left_anti" if negated else "left_semi")
            else:
                rest.append(c)
        keep = df.columns
        for c in rest:
            df, c = self.attach(df, c)
            scope = Scope(df)
            col = self.expr(c, scope)
            if is_list(self.dtype(c, scope)):
                col = F.size(col) > 0
            df = df.where(col)
        return df.select(*[f"`{k}`" for k in keep])

    def _conjuncts(self, e):
        return [x for s in e[1:] for x in self._conjuncts(s)] if e[0] == "and" else [e]

    def keys_of(self, df: DataFrame, tree) -> list[str]:
        """Variables of df that a tree mentions."""
        names = {n[1] for n in walk(tree) if n[0] in ("var", "node", "rel") and isinstance(n[1], str)}
        names |= {n[1] for n in walk(tree) if n[0] == "part" and n[1]}
        return [c for c in df.columns if c in names]

    def _key(self, df: DataFrame, name: str) -> Column:
        t = df.schema[name].dataType
        c = df[f"`{name}`"]
        return c["id"] if is_node(t) or is_rel(t) else c

    def correlated(self, df: DataFrame, tree, build) -> tuple[DataFrame, list[str]]:
        """build() over the bindings of the variables that the tree mentions.

        Where that is a single node which begins or ends the pattern's first hop and is asked nothing but its id,
        the pattern is matched on its own, with the hop's end in the node's place: the outer rows are joined
        to it once. Otherwise it is matched for the distinct bindings.
        """
        keys = self.keys_of(df, tree)
        if len(keys) == 1 and self._by_id_alone(df, tree, keys[0]):
            outer, self.free = self.free, keys[0]
            try:
                return build(self.unit()), keys
            finally:
                self.free = outer
        base = self.distinct(df.select(*[f"`{k}`" for k in keys])) if keys else self.unit()
        for k in keys:
            t = df.schema[k].dataType
            if is_node(t) or is_rel(t):
                base = base.where(F.col(f"`{k}`.id").isNotNull())
        return build(base), keys

    def _by_id_alone(self, df: DataFrame, tree, name: str) -> bool:
        if self.free is not None or not is_node(df.schema[name].dataType):
            return False
        mentions = [n for n in walk(tree) if n[0] in ("var", "node", "rel") and n[1] == name]
        parts = [n for n in walk(tree) if n[0] == "part"]
        if len(mentions) != 1 or len(parts) != 1 or parts[0][1] or parts[0][2]:
            return False
        el = parts[0][3]
        at = 1 if el[0] == mentions[0] else len(el) - 2 if el[-1] == mentions[0] else 0
        return mentions[0][0] == "node" and not mentions[0][2] and not mentions[0][3] and at > 0 and not el[at][3] and el[at][1] not in df.columns

    def joined(self, df: DataFrame, other: DataFrame, keys: list[str], how: str, values: list[str]) -> DataFrame:
        renamed = other.select(*[self._key(other, k).alias(f"__k_{i}") for i, k in enumerate(keys)], *[f"`{v}`" for v in values])
        if not keys:
            if how in ("left_semi", "left_anti"):
                renamed = renamed.limit(1)
            return df.join(renamed, F.lit(True), how)
        on = None
        for i, k in enumerate(keys):
            t = df.schema[k].dataType
            left = self._key(df, k)
            c = left == renamed[f"__k_{i}"] if is_node(t) or is_rel(t) else left.eqNullSafe(renamed[f"__k_{i}"])
            on = c if on is None else on & c
        out = df.join(renamed, on, how)
        return out if how in ("left_semi", "left_anti") else out.drop(*[f"__k_{i}" for i in range(len(keys))])

    def semi(self, df: DataFrame, part, how: str) -> DataFrame:
        found, keys = self.correlated(df, part, lambda base: self.patterns(base, (("part", None, None, part),), None))
        return self.joined(df, found, keys, how, [])

    def attach(self, df: DataFrame, e):
        """Replace pattern expressions in e by columns that are joined to df."""
        made = []

        def path_nodes(n) -> str | None:
            """The path variable of a nodes() call."""
            if n[0] == "call" and n[1] == "nodes" and len(n[2]) == 1 and n[2][0][0] == "var" and n[2][0][1] in df.columns:
                return n[2][0][1] if is_path(df.schema[n[2][0][1]].dataType) else None
            return None

        def pull(n):
            nonlocal df
            if n[0] == "call" and n[1] == "size" and len(n[2]) == 1 and (p := path_nodes(n[2][0])):
                return ("call", "size", (("prop", ("var", p), "nodes"),), False)
            if p := path_nodes(n):
                h = self.hidden("p")
                df = self.with_path_nodes(df, p, h)
                return ("var", h)
            if n[0] == "call" and isinstance(n[1], str) and n[1].lower() in ("startnode", "endnode"):
                h = self.hidden("e")
                end = "src" if n[1].lower() == "startnode" else "dst"
                nodes = node_scan(self.graph, (), self.wanted, self.spark).withColumnRenamed("n", h)
                rel = self.expr(n[2][0], Scope(df))
                df = df.join(nodes, rel[end] == nodes[h]["id"], "left")
                return ("var", h)
            if n[0] == "call" and isinstance(n[1], str) and n[1].lower() == "exists" and n[2] and n[2][0][0] == "pattern":
                return ("cmp", ">", self._counted_pattern(n[2][0][1], made), ("lit", 0))
            if n[0] == "call" and isinstance(n[1], str) and n[1].lower() == "size" and n[2] and n[2][0][0] == "pattern":
                return self._counted_pattern(n[2][0][1], made)
            if n[0] == "pattern":
                return ("cmp", ">", self._counted_pattern(n[1], made), ("lit", 0))
            if n[0] == "patcomp":
                h = self.hidden("c")
                made.append(("collect", n[1], n[2], n[3], h))
                return ("call", "coalesce", (("var", h), ("emptylike", h)), False)
            return None

        e = rewrite(e, pull)
        for kind, part, where, body, h in made:
            if kind == "count":
                found, keys = self.correlated(df, part, lambda base, p=part: self.patterns(base, (("part", None, None, p),), None))
                counts = found.groupBy(*[f"`{k}`" for k in keys]).agg(F.count(F.lit(1)).alias(h)) if keys else found.agg(F.count(F.lit(1)).alias(h))
                df = self.joined(df, counts, keys, "left", [h]).withColumn(h, F.coalesce(F.col(h), F.lit(0)))
            else:
                def build(base, p=part, w=where):
                    m = self.patterns(base, (("part", None, None, p),), None)
                    return self.filter(m, w) if w else m

                found, keys = self.correlated(df, (part, where or (), body), build)
                found, b = self.attach(found, body)
                value = self.expr(b, Scope(found)).alias("__v")
                lists = found.select(*[f"`{k}`" for k in keys], value).groupBy(*[f"`{k}`" for k in keys]).agg(F.collect_list("__v").alias(h))
                df = self.joined(df, lists, keys, "left", [h])
        return df, e

    def with_path_nodes(self, df: DataFrame, path: str, name: str) -> DataFrame:
        """A column with the nodes of a path; paths carry ids, so each distinct list of ids is looked up once."""
        ids = df.select(F.col(f"`{path}`.nodes").alias("__ids")).where("__ids is not null").distinct()
        nodes = node_scan(self.graph, (), self.wanted, self.spark)
        each = ids.select("__ids", F.posexplode("__ids").alias("__at", "__id")).join(nodes, F.col("__id") == F.col("n.id"))
        in_order = F.array_sort(F.collect_list(F.struct("__at", "n")), lambda a, b: a["__at"] - b["__at"])
        lists = each.groupBy("__ids").agg(F.transform(in_order, lambda x: x["n"]).alias(name))
        return df.join(lists, F.col(f"`{path}`.nodes") == lists["__ids"], "left").drop("__ids")

    def _counted_pattern(self, part, made):
        h = self.hidden("n")
        made.append(("count", part, None, None, h))
        return ("var", h)

    def attach_items(self, df: DataFrame, items):
        out = []
        for e, a in items:
            df, e = self.attach(df, e)
            out.append((e, a))
        return df, tuple(out)

    def match(self, df: DataFrame, c) -> DataFrame:
        _, optional, pats, where = c
        if not optional:
            return self.where_matched(df, pats, where)
        found, keys = self.correlated(df, (pats, where or ()), lambda base: self.where_matched(base, pats, where))
        new = [c for c in found.columns if c not in df.columns]
        return self.joined(df, found, keys, "left", new)

    @staticmethod
    def _of_one(c) -> str | None:
        """The variable of a condition that needs one only and can be applied to it at once."""
        names = {n[1] for n in walk(c) if n[0] == "var"}
        plain = not any(n[0] in ("pattern", "patcomp", "comp", "quant", "reduce") or (n[0] == "call" and n[1].lower() in ("startnode", "endnode", "nodes", "rand", "randomuuid")) for n in walk(c))
        return names.pop() if plain and c[0] != "var" and len(names) == 1 else None

    def where_matched(self, df: DataFrame, pats, where) -> DataFrame:
        """Matches of the patterns where the predicate holds. Conjuncts over one new node are applied at its scan, so
        that searches for paths, which Spark can't push filters through, begin and end at the nodes in question."""
        early: dict[str, list[tuple]] = {}
        late = []
        nodes = {e[1] for p in pats for e in p[3] if e[0] == "node"} - set(df.columns)
        for c in self._conjuncts(where) if where else ():
            if (name := self._of_one(c)) in nodes:
                early.setdefault(name, []).append(c)
            else:
                late.append(c)
        outer, self.early = self.early, early
        try:
            out = self.patterns(df, pats, where)
        finally:
            self.early = outer
        for c in late:
            out = self.filter(out, c)
        return out

    def patterns(self, df: DataFrame, pats, where) -> DataFrame:
        rels: list[tuple[str, tuple, bool]] = []
        todo = list(pats)
        while todo:
            bound = set(df.columns)
            at = next((i for i, p in enumerate(todo) if any(e[0] == "node" and e[1] in bound for e in p[3])), 0)
            part = todo.pop(at)
            if part[2]:
                df = self.shortest(df, part)
            else:
                df = self.chain(df, part, rels)
        drop = [c for c in df.columns if c.startswith("__n") or c.startswith("__r")]
        return df.drop(*drop)

    def with_props(self, df: DataFrame, name: str, props) -> DataFrame:
        if not props:
            return df
        scope = Scope(df)
        if props[0] == "param":
            props = ("map", tuple((k, ("lit", v)) for k, v in self.params[props[1]].items()))
        for k, v in props[1]:
            df = df.where(self.expr(("prop", ("var", name), k), scope) == self.expr(v, scope))
        return df

    def start(self, df: DataFrame, node) -> DataFrame:
        _, name, labels, props = node
        if name == self.free and name not in df.columns:
            return df  # the first hop brings it
        if name in df.columns:
            if not is_node(df.schema[name].dataType):
                raise SemanticError(f"{name} is not a node")
            df = df.where(F.col(f"`{name}`.id").isNotNull())
            for x in labels:
                df = df.where(F.array_contains(F.col(f"`{name}`.labels"), x))
            return self.with_props(df, name, props)
        scan = self.with_early(self.scan_as(name, labels, props), name)
        if props and not self._constant_props(props):
            scan = self.with_props(scan if not df.columns else df.crossJoin(scan), name, props)
            return scan
        return scan if not df.columns else df.crossJoin(scan)

    @staticmethod
    def _constant_props(props) -> bool:
        return props[0] == "param" or all(v[0] in ("lit", "param") for _, v in props[1])

    def scan_as(self, name: str, labels, props) -> DataFrame:
        """The nodes of the labels as a column, filtered by properties that are constant."""
        scan = node_scan(self.graph, labels, self.wanted, self.spark).withColumnRenamed("n", name)
        return self.with_props(scan, name, props) if props and self._constant_props(props) else scan

    def with_early(self, df: DataFrame, name: str) -> DataFrame:
        """Apply the conjuncts of WHERE that concern this variable only."""
        for c in self.early.get(name, ()):
            scope = Scope(df)
            df = df.where(self.expr(c, scope))
        return df

    def chain(self, df: DataFrame, part, rels) -> DataFrame:
        _, pname, _, el = part
        steps = list(el)
        nodes = [i for i in range(0, len(steps), 2)]
        bound = [i for i in nodes if steps[i][1] in df.columns or steps[i][1] == self.free]
        if bound:
            begin = bound[0]
        else:  # begin where labels, properties and conditions say most
            begin = max(nodes, key=lambda i: (steps[i][3] is not None, len(self.early.get(steps[i][1], ())), bool(steps[i][2]), -i))
        df = self.start(df, steps[begin])
        for i in range(begin + 1, len(steps), 2):
            df = self.expand(df, steps[i - 1], steps[i], steps[i + 1], rels, False)
        for i in range(begin - 1, 0, -2):
            df = self.expand(df, steps[i + 1], steps[i], steps[i - 1], rels, True)
        if pname:
            df = df.withColumn(pname, self.path_of(df, steps))
        return df

    def path_of(self, df: DataFrame, steps) -> Column:
        """struct<nodes: array of ids, rels: array of relationships>."""
        simple = lambda r: F.struct(r["id"].alias("id"), r["src"].alias("src"), r["dst"].alias("dst"), r["type"].alias("type"))
        nodes, rels = [F.array(F.col(f"`{steps[0][1]}`.id"))], [F.array().cast("array<struct<id:bigint,src:bigint,dst:bigint,type:string>>")]
        for i in range(1, len(steps), 2):
            r = F.col(f"`{steps[i][1]}`")
            if steps[i][3]:
                inner = F.col(f"`__via_{steps[i][1]}`")
                nodes.append(inner)
                rels.append(F.transform(r, simple))
            else:
                nodes.append(F.array(F.col(f"`{steps[i + 1][1]}`.id")))
                rels.append(F.array(simple(r)))
        return F.struct(F.concat(*nodes).alias("nodes"), F.concat(*rels).alias("rels"))

    def edges(self, rel, flip: bool) -> DataFrame:
        """(r, __from, __to) in the direction of travel."""
        _, _, types, _, _, direction = rel
        e = rel_scan(self.graph, types, self.wanted, self.spark)
        out = e.select("r", F.col("r.src").alias("__from"), F.col("r.dst").alias("__to"))
        back = e.select("r", F.col("r.dst").alias("__from"), F.col("r.src").alias("__to"))
        if direction == "both":
            return out.unionAll(back.where("__from <> __to"))
        return back if (direction == "in") != flip else out

    def end_labels(self, rel, flip: bool):
        """Labels that the relationship types prescribe for the node arrived at, if all agree."""
        tables = self.graph.rel_tables(rel[2])
        if rel[5] == "both" or not tables:
            return ()
        forward = (rel[5] == "out") != flip
        ends = {t.end if forward else t.start for t in tables}
        return next(iter(ends)) if len(ends) == 1 else ()

    def expand(self, df: DataFrame, a, rel, b, rels, flip: bool) -> DataFrame:
        _, rname, types, length, rprops, direction = rel
        if length:
            return self.expand_many(df, a, rel, b, flip)
        e = self.edges(rel, flip).withColumnRenamed("r", rname) if rname not in df.columns else None
        frm = F.col(f"`{a[1]}`.id")
        if e is None:  # a bound relationship
            r = F.col(f"`{rname}`")
            forward = (r["src"] == frm, r["dst"])
            backward = (r["dst"] == frm, r["src"])
            way = backward if (direction == "in") != flip else forward
            df = df.withColumn("__to", F.when(way[0], way[1]) if direction != "both" else F.when(forward[0], forward[1]).when(backward[0], backward[1])).where("__to is not null")
        elif a[1] == self.free and a[1] not in df.columns:
            e = self.with_props_of_edge(e, rname, rprops, df)
            df = e.withColumn(a[1], F.struct(F.col("__from").alias("id"), F.lit(None).cast("array<string>").alias("labels"))).drop("__from")
        else:
            e = self.with_props_of_edge(e, rname, rprops, df)
            df = df.join(e, frm == e["__from"]).drop("__from")
        for other, other_types, _ in rels:
            if other in df.columns and other != rname and (not types or not other_types or set(types) & set(other_types)):
                df = df.where(F.col(f"`{other}`.id") != F.col(f"`{rname}`.id"))
        rels.append((rname, types, False))
        return self.arrive(df, b, self.end_labels(rel, flip))

    def with_props_of_edge(self, e, rname, rprops, df):
        if not rprops:
            return e
        if rprops[0] == "param":
            rprops = ("map", tuple((k, ("lit", v)) for k, v in self.params[rprops[1]].items()))
        for k, v in rprops[1]:
            e = e.where(self.expr(("prop", ("var", rname), k), Scope(e)) == self.expr(v, Scope(e)))
        return e

    def arrive(self, df: DataFrame, b, implied=()) -> DataFrame:
        _, name, labels, props = b
        if name in df.columns:
            df = df.where(F.col(f"`{name}`.id") == F.col("__to")).drop("__to")
            for x in labels:
                df = df.where(F.array_contains(F.col(f"`{name}`.labels"), x))
            return self.with_props(df, name, props)
        look = tuple(dict.fromkeys((*labels, *implied))) if self.graph.node_tables((*labels, *implied)) else labels
        scan = self.with_early(self.scan_as(name, look, props), name)
        if props and self._constant_props(props):
            props = None
        df = df.join(scan, F.col("__to") == scan[f"`{name}`"]["id"]).drop("__to")
        return self.with_props(df, name, props)

    def expand_many(self, df: DataFrame, a, rel, b, flip: bool) -> DataFrame:
        _, rname, types, (lo, hi), rprops, _ = rel
        edges = self.with_props_of_edge(self.edges(rel, flip).withColumnRenamed("r", rname), rname, rprops, df).withColumnRenamed(rname, "r")
        starts = df.select(F.col(f"`{a[1]}`.id").alias("s")).where("s is not null").distinct()
        found = paths.var_length(starts, edges, lo, hi, self.hop_limit, self.ends_of(df, b))
        if flip:
            found = found.select("s", "t", F.reverse("rels").alias("rels"), F.reverse(F.concat(F.array("s"), F.slice("via", 1, F.greatest(F.size("via") - 1, F.lit(0))))).alias("via"))
            found = found.withColumn("via", F.when(F.size("rels") == 0, F.array().cast("array<bigint>")).otherwise(F.col("via")))
        found = found.select(F.col("s").alias("__s"), F.col("t").alias("__to"), F.col("rels").alias(rname), F.col("via").alias(f"__via_{rname}"))
        df = df.join(found, F.col(f"`{a[1]}`.id") == found["__s"]).drop("__s")
        return self.arrive(df, b)

    def ends_of(self, df: DataFrame, b) -> DataFrame | None:
        """Ids ``(t)`` of the nodes that a path may end at, if something is asked of them; None: any node."""
        _, name, labels, props = b
        if name in df.columns or (props and not self._constant_props(props)) or not (props or self.early.get(name)):
            return None
        return self.with_early(self.scan_as(name, labels, props), name).select(F.col(f"`{name}`.id").alias("t"))

    def shortest(self, df: DataFrame, part) -> DataFrame:
        _, pname, kind, (a, rel, b) = part
        df = self.start(df, a)
        if b[1] not in df.columns:
            df = self.start(df, b)
        lo, hi = rel[3] or (1, 1)
        edges = self.with_props_of_edge(self.edges(rel, False).withColumnRenamed("r", rel[1]), rel[1], rel[4], df).withColumnRenamed(rel[1], "r")
        pairs = df.select(F.col(f"`{a[1]}`.id").alias("s"), F.col(f"`{b[1]}`.id").alias("t")).distinct()
        found = paths.shortest(pairs, edges, lo, hi, self.hop_limit, kind == "all")
        simple = F.transform("rels", lambda r: F.struct(r["id"].alias("id"), r["src"].alias("src"), r["dst"].alias("dst"), r["type"].alias("type")))
        path = F.struct(F.concat(F.array("s"), F.col("via")).alias("nodes"), simple.alias("rels"))
        found = found.select(F.col("s").alias("__s"), F.col("t").alias("__t"), F.col("rels").alias(rel[1]), path.alias(pname or "__npath"))
        out = df.join(found, (F.col(f"`{a[1]}`.id") == found["__s"]) & (F.col(f"`{b[1]}`.id") == found["__t"])).drop("__s", "__t")
        return out

    # -- expressions ---------------------------------------------------------------------------

    def dtype(self, e, scope: Scope) -> T.DataType:
        key = ("type", repr(e))
        if key not in scope.memo:
            found = self._plain_type(e, scope)
            scope.memo[key] = scope.scratch.select(self.expr(e, scope.probing()).alias("x")).schema[0].dataType if found is None else found
        return scope.memo[key]

    def _plain_type(self, e, scope: Scope) -> T.DataType | None:
        """The type where the syntax tree and the variables tell it."""
        kind = e[0]
        if kind == "lit" and type(e[1]) in _LITERAL_TYPES:
            return _LITERAL_TYPES[type(e[1])]
        if kind == "var" and scope.get(e[1]) is not None:
            return scope.types[scope.get(e[1]).scratch]
        if kind == "prop" and isinstance(e[2], str):
            t = self.dtype(e[1], scope)
            if isinstance(t, T.StructType) and not temporal.is_duration(t) and not temporal.is_clock(t) and not temporal.is_zoned(t) and e[2] in t.fieldNames() and e[2] != "id":
                return t[e[2]].dataType
        if kind in ("isnull", "haslabels", "starts", "ends", "contains", "regex", "quant", "cmp", "and", "or", "xor", "not", "in"):
            return T.BooleanType()
        if kind == "neg":
            t = self.dtype(e[1], scope)
            return t if isinstance(t, (T.LongType, T.DoubleType)) else None
        if kind == "arith" and e[1] in "+-*/":
            left, right = (self.dtype(x, scope) for x in e[2:4])
            found = {type(left), type(right)}
            if found <= {T.LongType, T.DoubleType}:
                return T.DoubleType() if T.DoubleType in found or e[1] == "/" else T.LongType()
            if e[1] == "+" and found == {T.StringType}:
                return T.StringType()
            if e[1] in "+-" and temporal.is_duration(left) and temporal.is_duration(right):
                return temporal.DURATION
            if e[1] in "*/" and temporal.is_duration(left) and isinstance(right, T.NumericType):
                return temporal.DURATION
        if kind == "call" and isinstance(e[1], str) and e[1].lower() in _RESULT_TYPES and e[1].lower() not in self.functions:
            nulls = any(a == ("lit", None) or (a[0] == "param" and self.params.get(a[1]) is None) for a in e[2])
            return None if nulls else _RESULT_TYPES[e[1].lower()]
        return None

    def arg(self, e, scope: Scope) -> Arg:
        return Arg(self.expr(e, scope), lambda: self.dtype(e, scope), ("lit", self.params[e[1]]) if e[0] == "param" else e)

    def literal(self, e):
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.params[e[1]]
        if e[0] == "neg":
            return -self.literal(e[1])
        raise SemanticError("a constant is needed here")

    def value(self, v) -> Column:
        import datetime

        if isinstance(v, bool) or v is None or isinstance(v, (str, float)):
            return F.lit(v)
        if isinstance(v, int):
            return F.lit(v).cast("bigint")
        if isinstance(v, (list, tuple)):
            return F.array(*[self.value(x) for x in v]) if v else F.array().cast("array<string>")
        if isinstance(v, dict):
            return F.struct(*[self.value(x).alias(k) for k, x in v.items()])
        if isinstance(v, datetime.datetime) and v.tzinfo is None:
            return F.lit(v).cast("timestamp_ntz")
        return F.lit(v)

    def expr(self, e, scope: Scope) -> Column:
        if not scope.probes:
            return getattr(self, f"e_{e[0]}")(e, scope)
        key = ("probe", repr(e))  # only types are asked of these, so parts can be shared
        if key not in scope.memo:
            scope.memo[key] = getattr(self, f"e_{e[0]}")(e, scope)
        return scope.memo[key]

    def e_lit(self, e, scope):
        return self.value(e[1])

    def e_param(self, e, scope):
        if e[1] not in self.params:
            raise SemanticError(f"no value for parameter {e[1]}")
        return self.value(self.params[e[1]])

    def e_var(self, e, scope):
        v = scope.get(e[1])
        if v is None:
            raise SemanticError(f"unknown variable {e[1]}")
        return v.col

    def e_emptylike(self, e, scope):
        return F.array().cast(scope.types[e[1]])

    def e_prop(self, e, scope):
        t = self.dtype(e[1], scope)
        c = self.expr(e[1], scope)
        if isinstance(t, T.NullType):
            return F.lit(None)
        if isinstance(t, T.MapType):
            return F.try_element_at(c, F.lit(e[2]))
        if not temporal.is_duration(t) and not temporal.is_zoned(t) and isinstance(t, T.StructType) and e[2] in t.fieldNames():
            if e[2] == "id" and is_node(t) and "id_text" in t.fieldNames():
                return c["id_text"]
            return c[e[2]] if not temporal.is_clock(t) else c
        if (x := temporal.component(c, t, e[2])) is not None:
            return x
        if isinstance(t, T.StructType):
            alias = {"latitude": "y", "longitude": "x", "height": "z"}.get(e[2])
            return c[alias] if alias and alias in t.fieldNames() else F.lit(None)
        raise SemanticError(f"no component {e[2]} of {t.simpleString()}")

    def e_haslabels(self, e, scope):
        c = self.expr(e[1], scope)
        t = self.dtype(e[1], scope)
        out = F.lit(True)
        for x in e[2]:
            out = out & (c["type"] == x if is_rel(t) else F.array_contains(c["labels"], x))
        return out

    def e_and(self, e, scope):
        return self.expr(e[1], scope) & self.expr(e[2], scope)

    def e_or(self, e, scope):
        return self.expr(e[1], scope) | self.expr(e[2], scope)

    def e_xor(self, e, scope):
        return self.expr(e[1], scope).cast("boolean") != self.expr(e[2], scope).cast("boolean")

    def e_not(self, e, scope):
        c = self.expr(e[1], scope)
        return ~(F.size(c) > 0) if is_list(self.dtype(e[1], scope)) else ~c

    def e_isnull(self, e, scope):
        c = self.expr(e[1], scope)
        return c.isNotNull() if e[2] else c.isNull()

    def e_cmp(self, e, scope):
        _, o, x, y = e
        return anyvalue.compare(o, self.expr(x, scope), self.dtype(x, scope), self.expr(y, scope), self.dtype(y, scope))

    def e_neg(self, e, scope):
        return -self.expr(e[1], scope)

    def e_arith(self, e, scope):
        _, o, x, y = e
        a, b = self.expr(x, scope), self.expr(y, scope)
        ta, tb = self.dtype(x, scope), self.dtype(y, scope)
        if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
            return F.lit(None)
        if anyvalue.is_variant(ta) or anyvalue.is_variant(tb):
            if o == "+" and T.StringType() in (ta, tb):
                return F.concat(anyvalue.text_of(a, ta), anyvalue.text_of(b, tb))
            if not is_list(ta) and not is_list(tb):  # numbers of unknown type are taken as floats
                a, ta = (anyvalue.number_of(a, ta), T.DoubleType()) if anyvalue.is_variant(ta) else (a, ta)
                b, tb = (anyvalue.number_of(b, tb), T.DoubleType()) if anyvalue.is_variant(tb) else (b, tb)
        if o in "+-":
            sign = 1 if o == "+" else -1
            if temporal.is_duration(tb) and not isinstance(ta, T.StringType):
                return temporal.both(a, b, lambda a, b: temporal.plus(a, ta, b, sign))
            if o == "+" and temporal.is_duration(ta) and not isinstance(tb, T.StringType):
                return temporal.both(a, b, lambda a, b: temporal.plus(b, tb, a))
            if o == "+" and (is_list(ta) or is_list(tb)):
                a, ta = (a, ta) if is_list(ta) else (F.array(a), T.ArrayType(ta))
                b, tb = (b, tb) if is_list(tb) else (F.array(b), T.ArrayType(tb))
                ka, kb = anyvalue.kind(ta.elementType), anyvalue.kind(tb.elementType)
                empty = [x for x in (e[2], e[3]) if x == ("list", ())]
                if ka != kb and "null" not in (ka, kb) and not empty:
                    a, b = (c if k == "any" else F.transform(c, lambda v: v.cast("variant")) for c, k in ((a, ka), (b, kb)))
                elif empty and e[2] == ("list", ()):
                    return F.concat(F.array().cast(tb), b)
                elif empty:
                    return F.concat(a, F.array().cast(ta))
                return F.concat(a, b)
            if o == "+" and (isinstance(ta, T.StringType) or isinstance(tb, T.StringType)):
                return F.concat(a.cast("string"), b.cast("string"))
            return a + b if o == "+" else a - b
        if temporal.is_duration(ta) and o in "*/":
            return temporal.both(a, b, lambda a, b: temporal.scale(a, b, o == "/"))
        if temporal.is_duration(tb) and o == "*":
            return temporal.both(a, b, lambda a, b: temporal.scale(b, a, False))
        whole = isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType)
        if o == "*":
            return a * b
        if o == "/":
            if whole:
                return F.call_function("div", a, F.nullif(b, F.lit(0))).cast("double")
            return a / F.nullif(b.cast("double"), F.lit(0.0))
        if o == "%":
            if not whole:
                raise SemanticError("% takes whole numbers")
            return a % F.nullif(b, F.lit(0))
        p = F.pow(a.cast("double"), b.cast("double"))
        return p.cast("bigint") if whole else p

    def e_regex(self, e, scope):
        return self.text(e[1], scope).rlike(self.literal(e[2])) if e[2][0] in ("lit", "param") else F.regexp_like(self.text(e[1], scope), self.text(e[2], scope))

    def e_in(self, e, scope):
        x, items = self.expr(e[1], scope), e[2]
        t = self.dtype(e[1], scope)
        if items[0] == "param" and isinstance(self.params.get(items[1]), (list, tuple)):
            items = ("list", tuple(("lit", v) for v in self.params[items[1]]))
        if items[0] == "list":
            if not items[1]:
                return F.lit(False)
            cols, types = [self.expr(i, scope) for i in items[1]], [self.dtype(i, scope) for i in items[1]]
            kinds = {anyvalue.kind(k) for k in types} - {"null"}
            if kinds <= {anyvalue.kind(t)} <= {"number", "string", "boolean"}:
                return x.isin(*cols)
            return reduce(lambda a, b: a | b, [anyvalue.compare("=", x, t, c, k) for c, k in zip(cols, types)])
        col, lt = self.expr(items, scope), self.dtype(items, scope)
        if isinstance(lt, T.ArrayType) and lt.elementType != t or anyvalue.holds_variant(lt) or is_node(t) or is_rel(t):
            et = lt.elementType if isinstance(lt, T.ArrayType) else T.NullType()
            return F.exists(col, lambda v: anyvalue.compare("=", v, et, x, t))
        return F.array_contains(col, x)

    def text(self, e, scope) -> Column:
        return anyvalue.text_of(self.expr(e, scope), self.dtype(e, scope))

    def e_starts(self, e, scope):
        return self.text(e[1], scope).startswith(self.text(e[2], scope))

    def e_ends(self, e, scope):
        return self.text(e[1], scope).endswith(self.text(e[2], scope))

    def e_contains(self, e, scope):
        return self.text(e[1], scope).contains(self.text(e[2], scope))

    def e_case(self, e, scope):
        _, subject, whens, other = e
        values = [v for _, v in whens] + ([other] if other is not None else [])
        cols = anyvalue.unified([self.expr(v, scope) for v in values], [self.dtype(v, scope) for v in values])
        out = None
        for (c, _), v in zip(whens, cols):
            if subject is not None:
                cond = self.expr(subject, scope).isNull() if c == ("lit", None) else self.expr(c, scope) if c[0] in ("cmp", "and", "or", "not") else self.e_cmp(("cmp", "=", subject, c), scope)
            else:
                cond = self.expr(c, scope)
            out = F.when(cond, v) if out is None else out.when(cond, v)
        return out.otherwise(cols[-1]) if other is not None else out

    def e_list(self, e, scope):
        if not e[1]:
            return F.array().cast("array<string>")
        cols, types = [self.expr(x, scope) for x in e[1]], [self.dtype(x, scope) for x in e[1]]
        return F.array(*anyvalue.unified(cols, types))  # a truly mixed list holds variants

    def e_map(self, e, scope):
        return F.struct(*[self.expr(v, scope).alias(k) for k, v in e[1]]) if e[1] else F.create_map().cast("map<string,string>")

    def e_mapproj(self, e, scope):
        t = self.dtype(e[1], scope)
        c = self.expr(e[1], scope)
        hidden = {"id", "labels"} if is_node(t) else {"id", "src", "dst", "type"} if is_rel(t) else set()
        fields: dict[str, Column] = {}
        for it in e[2]:
            if it[0] == "all":
                fields.update({n: c[n] for n in t.fieldNames() if n not in hidden})
            else:
                fields[it[1]] = self.expr(it[2], scope)
        return F.when(c.isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))

    def e_index(self, e, scope):
        t = self.dtype(e[1], scope)
        c = self.expr(e[1], scope)
        if isinstance(t, T.StructType):
            if e[2][0] in ("lit", "param"):
                return self.e_prop(("prop", e[1], self.literal(e[2])), scope)
            key = self.expr(e[2], scope)
            hidden = ("id", "labels") if is_node(t) else ("id", "src", "dst", "type") if is_rel(t) else ()
            names = [n for n in t.fieldNames() if n not in hidden]
            out = None
            for n, value in zip(names, anyvalue.unified([c[n] for n in names], [t[n].dataType for n in names])):
                out = F.when(key == n, value) if out is None else out.when(key == n, value)
            return F.lit(None) if out is None else out
        if isinstance(t, T.MapType):
            return F.try_element_at(c, self.expr(e[2], scope))
        if e[2][0] == "lit" and isinstance(e[2][1], int) and e[2][1] >= 0:
            return F.get(c, F.lit(e[2][1]))
        if e[2][0] == "neg" and e[2][1][0] == "lit":
            return F.try_element_at(c, F.lit(-e[2][1][1]))
        i = self.expr(e[2], scope).cast("int")
        return temporal.both(c, i, lambda c, i: F.get(c, F.when(i < 0, F.size(c) + i).otherwise(i)))

    def e_slice(self, e, scope):
        return temporal.let(self.expr(e[1], scope), lambda c: self._slice(c, e, scope))

    def _slice(self, c, e, scope):
        n = F.size(c)
        fix = lambda x, d: d if x is None else (lambda i: F.least(F.greatest(F.when(i < 0, n + i).otherwise(i), F.lit(0)), n))(self.expr(x, scope).cast("int"))
        lo, hi = fix(e[2], F.lit(0)), fix(e[3], n)
        return F.slice(c, lo + 1, F.greatest(hi - lo, F.lit(0)))

    def element(self, e, scope) -> T.DataType:
        t = self.dtype(e, scope)
        return t.elementType if isinstance(t, T.ArrayType) else T.NullType()

    def e_comp(self, e, scope):
        _, var, source, where, body = e
        c, t = self.expr(source, scope), self.element(source, scope)
        if where is not None:
            c = F.filter(c, lambda x: F.coalesce(self.expr(where, scope.bind(var, x, t)), F.lit(False)))
        return F.transform(c, lambda x: self.expr(body, scope.bind(var, x, t))) if body is not None else c

    def e_quant(self, e, scope):
        _, kind, var, source, where = e
        c, t = self.expr(source, scope), self.element(source, scope)
        holds = lambda x: F.coalesce(self.expr(where, scope.bind(var, x, t)), F.lit(False))
        if kind == "all":
            return F.forall(c, holds)
        if kind == "single":
            return F.size(F.filter(c, holds)) == 1
        return F.exists(c, holds) if kind == "any" else ~F.exists(c, holds)

    def e_reduce(self, e, scope):
        _, acc, start, var, source, body = e
        t, ta = self.element(source, scope), self.dtype(start, scope)
        both = lambda a, x, ty: scope.bind(acc, a, ty).bind(var, x, t)
        probe = both(F.lit(None), F.lit(None), ta)
        ta = self.dtype(body, probe)
        return F.aggregate(self.expr(source, scope), self.expr(start, scope).cast(ta), lambda a, x: self.expr(body, both(a, x, ta)).cast(ta))

    def e_pattern(self, e, scope):
        raise SemanticError("a pattern can't be used here")

    e_patcomp = e_pattern

    def e_call(self, e, scope):
        _, name, args, _ = e
        low = name.lower()
        if low in AGGREGATES:
            raise SemanticError(f"{name} is an aggregate and can't be used here")
        if low in self.functions:
            return self.functions[low](*[self.expr(a, scope) for a in args])
        if low not in FUNCTIONS:
            raise SemanticError(f"unknown function {name}")
        if low not in ("coalesce", "exists") and any(a == ("lit", None) or (a[0] == "param" and a[1] in self.params and self.params[a[1]] is None) for a in args):
            return F.lit(None)
        made = [self.arg(a, scope) for a in args]
        if low in _OF_TEXT or low in _OF_NUMBERS:
            made = [Arg((anyvalue.text_of if low in _OF_TEXT else anyvalue.number_of)(a.col, a.type), lambda low=low: T.StringType() if low in _OF_TEXT else T.DoubleType(), a.tree) if anyvalue.is_variant(a.type) else a for a in made]
        try:
            return FUNCTIONS[low](*made)
        except TypeError as x:
            if "positional argument" in str(x):
                raise SemanticError(f"{name} doesn't take {len(args)} arguments") from x
            raise
