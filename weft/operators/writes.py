"""Graph updates: every clause makes a new immutable graph from the old one by DataFrame operations."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import is_node, is_rel
from ..sources.catalog import FIRST_ID, NodeTable, PropertyGraph, RelTable
from .paths import _shared


#: Updates of a table that are kept as joins before it is written out.
MAX_OVERLAYS = 8


class ConstraintError(RuntimeError):
    """A node can't go while relationships hold on to it."""


class Writer:
    """Applies update clauses; ``graph`` is the version after the last of them."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph
        self.relabelled = False

    def _next_id(self) -> int:
        """The graph's counter; a graph that comes without one is searched once."""
        if self.graph.next_id is not None:
            return self.graph.next_id
        top = FIRST_ID
        for t in (*self.graph.nodes, *self.graph.rels):
            m = t.df.where(F.col("id") >= FIRST_ID).agg(F.max("id")).first()[0] if t.df.schema["id"].dataType == T.LongType() else None
            top = max(top, (m or 0) + 1)
        return top

    def apply(self, cx, clause) -> DataFrame:
        out = getattr(self, clause[0])(cx, cx.df, *clause[1:])
        cx.graph = self.graph
        return out

    # -- indexes
    def create_index(self, cx, df, label, props):
        self.graph = replace(self.graph, indexes=self.graph.indexes | {(label, props)})
        return df

    def drop_index(self, cx, df, label, props):
        self.graph = replace(self.graph, indexes=self.graph.indexes - {(label, props)})
        return df

    # -- create
    def _props(self, cx, df, props):
        from ..plans.compiler import Scope

        if not props:
            return {}
        if props[0] == "param":
            return {k: cx.value(v) for k, v in cx.params[props[1]].items()}
        if props[0] != "map":
            raise TypeError("properties must be a map")
        return {k: cx.expr(v, Scope(df)) for k, v in props[1]}

    def create(self, cx, df, pats) -> DataFrame:
        first = self._next_id()
        slot = 0
        made_nodes, made_rels = [], []
        df = df.withColumn("__row", F.monotonically_increasing_id())
        elements = [e for p in pats for e in p[3]]
        width = max(1, len(elements))
        for _, _, _, el in pats:
            for e in el[::2]:
                if e[1] in df.columns:
                    continue
                props = self._props(cx, df, e[3])
                node_id = F.lit(first + slot).cast("bigint") + F.col("__row") * width
                labels = F.array(*[F.lit(x) for x in e[2]]).cast("array<string>")
                df = df.withColumn(e[1], F.struct(node_id.alias("id"), labels.alias("labels"), *[v.alias(k) for k, v in props.items()]))
                made_nodes.append((e[1], e[2], list(props)))
                slot += 1
            for i in range(1, len(el), 2):
                r = el[i]
                if len(r[2]) > 1 or r[3]:
                    raise ValueError("a created relationship has one type and one hop")
                a, b = el[i - 1][1], el[i + 1][1]
                if r[5] == "in":
                    a, b = b, a
                props = self._props(cx, df, r[4])
                rel_id = F.lit(first + slot).cast("bigint") + F.col("__row") * width
                kind = r[2][0] if r[2] else ""
                df = df.withColumn(r[1], F.struct(rel_id.alias("id"), F.col(f"`{a}`.id").alias("src"), F.col(f"`{b}`.id").alias("dst"), F.lit(kind).alias("type"), *[v.alias(k) for k, v in props.items()]))
                made_rels.append((r[1], kind, list(props)))
                slot += 1
        df = _shared(df)  # ids must not change when the rows are read again
        made = [F.max(f"`{name}`.id") for name, *_ in (*made_nodes, *made_rels)]
        last = max((x for x in df.agg(*made).first() if x is not None), default=first - 1) if made else first - 1
        self.graph = replace(self.graph, next_id=last + 1)
        for name, labels, props in made_nodes:
            self.graph = self.graph.with_nodes(NodeTable(tuple(labels), df.select(f"`{name}`.id", *[F.col(f"`{name}`.`{p}`").alias(p) for p in props])))
        for name, kind, props in made_rels:
            rows = df.where(F.col(f"`{name}`.src").isNotNull() & F.col(f"`{name}`.dst").isNotNull())
            self.graph = self.graph.with_rels(RelTable(kind, rows.select(f"`{name}`.id", f"`{name}`.src", f"`{name}`.dst", *[F.col(f"`{name}`.`{p}`").alias(p) for p in props])))
        for p in pats:
            if p[1]:
                df = df.withColumn(p[1], cx.path_of(df, list(p[3])))
        hidden = [c for c in df.columns if c.startswith("__n") or c.startswith("__r")]
        return df.drop(*hidden)

    # -- merge
    def merge(self, cx, df, part, on_match, on_create) -> DataFrame:
        """Per row: match, else create; rows that need the same thing create it once."""
        df = _shared(df)
        named = part
        found = cx.match(df, ("match", True, (named,), None))
        new = [c for c in found.columns if c not in df.columns]
        bound = [e[1] for e in part[3] if e[1] in df.columns]
        if not new:  # every name is hidden: test for the match by a marked relationship
            marked = tuple((e[0], f"m{i}", *e[2:]) if e[1].startswith("__") else e for i, e in enumerate(part[3]))
            part = ("part", part[1], part[2], marked)
            found = cx.match(df, ("match", True, (part,), None))
            new = [c for c in found.columns if c not in df.columns]
        key = new[0]
        found = _shared(found)
        hit, missing = found.where(F.col(f"`{key}`").isNotNull()), found.where(F.col(f"`{key}`").isNull()).drop(*new)
        if on_match:
            hit = self.set(cx, hit, on_match)
        if missing.isEmpty():
            cx.graph = self.graph
            return hit
        # what a row would create depends on its bound entities and the pattern's property values
        values = []
        for e in part[3]:
            props = e[3] if e[0] == "node" else e[4]
            values += list(self._props(cx, missing, props).values()) if props and e[1] not in df.columns else []
        ids = [F.col(f"`{b}`.id") for b in bound]
        keyed = missing.select("*", F.sha2(F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate([*ids, *values, F.lit(1)])])), 256).alias("__h_key"))
        once = keyed.dropDuplicates(["__h_key"])
        created = self.create(cx, once, (part,))
        cx.graph = self.graph
        if on_create:
            created = self.set(cx, created, on_create)
        fresh = [c for c in created.columns if c not in df.columns and not c.startswith("__")]
        back = keyed.join(created.select("__h_key", *[f"`{c}`" for c in fresh]), "__h_key").drop("__h_key")
        return hit.unionByName(back, allowMissingColumns=True) if not hit.isEmpty() else back.select(*[f"`{c}`" for c in back.columns if not c.startswith("__")])

    # -- set and remove
    def _updates(self, cx, df, var, items):
        """{property: column} for one variable, in order of statement."""
        from ..plans.compiler import Scope

        out: dict[str, object] = {}
        clear = False
        for it in items:
            if it[0] == "prop":
                out[it[2]] = cx.expr(it[3], Scope(df))
            else:
                value = it[2]
                if value[0] == "map":
                    fields = {k: cx.expr(v, Scope(df)) for k, v in value[1]}
                elif value[0] == "param":
                    fields = {k: cx.value(v) for k, v in cx.params[value[1]].items()}
                else:
                    t = cx.dtype(value, Scope(df))
                    c = cx.expr(value, Scope(df))
                    hide = {"id", "labels"} if is_node(t) else {"id", "src", "dst", "type"} if is_rel(t) else set()
                    fields = {n: c[n] for n in t.fieldNames() if n not in hide}
                if it[0] == "replace":
                    clear, out = True, {}
                out.update(fields)
        return out, clear

    def _touched(self, df: DataFrame, var: str, nodes: bool) -> list:
        """The tables that the variable's entities can stand in, by the labels or types that occur among them."""
        if self.relabelled:  # rows may hold labels and types from before
            return list(self.graph.nodes if nodes else self.graph.rels)
        c = F.col(f"`{var}`")
        mark = (F.array_sort(c["labels"]) if nodes else c["type"]).alias("m")
        seen = {tuple(r[0]) if nodes else r[0] for r in df.where(c.isNotNull()).select(mark).distinct().collect()}  # at most one row a table
        return [t for t in (self.graph.nodes if nodes else self.graph.rels) if (tuple(sorted(t.labels)) if nodes else t.type) in seen]

    def _write(self, df: DataFrame, var: str, values: dict, clear: bool, nodes: bool) -> None:
        """Overlay ``{property: column}`` over the rows of df on the tables. Where rows share an entity, each sees the
        entity as it was before, and the last row in order stays."""
        tables = self._touched(df, var, nodes)
        if not tables:
            return
        props = list(values)
        row = F.struct(F.monotonically_increasing_id().alias("at"), *[values[k].alias(f"__set_{k}") for k in props])
        rows = df.where(F.col(f"`{var}`").isNotNull()).select(F.col(f"`{var}`.id").alias("id"), row.alias("row"))
        last = rows.groupBy("id").agg(F.max_by("row", "row.at").alias("row"))
        touched = _shared(last.select("id", *[F.col(f"row.`__set_{k}`").alias(f"__set_{k}") for k in props], F.lit(True).alias("__hit")))

        def overlay(t):
            df = t.df
            keep = [c for c in df.columns if c in ("id", "src", "dst")]
            own = [c for c in df.columns if c not in keep]
            j = df.join(touched, "id", "left")
            cols = []
            for c in dict.fromkeys([*own, *props]):
                old = F.col(f"`{c}`") if c in own else F.lit(None)
                if c in props:
                    cols.append(F.when(F.col("__hit"), F.col(f"`__set_{c}`")).otherwise(old).alias(c))
                else:
                    cols.append((F.when(F.col("__hit").isNull(), old) if clear else old).alias(c))
            out = j.select(*keep, *cols)
            new = t.over(out)
            new.overlays = t.overlays + 1
            if new.overlays >= MAX_OVERLAYS:  # many updates in a row don't pile up joins
                new = t.over(_shared(out))
            return new

        changed = {id(t): overlay(t) for t in tables}
        swap = lambda ts: tuple(changed.get(id(t), t) for t in ts)
        self.graph = replace(self.graph, nodes=swap(self.graph.nodes)) if nodes else replace(self.graph, rels=swap(self.graph.rels))

    def set(self, cx, df, items) -> DataFrame:
        df = _shared(df)
        for it in items:
            target = it[1]
            if target[0] != "var":  # (CASE ... END).p = v
                h = cx.hidden("t")
                from ..plans.compiler import Scope

                df = df.withColumn(h, cx.expr(target, Scope(df)))
                target = ("var", h)
                it = (it[0], target, *it[2:])
            var = target[1]
            t = df.schema[var].dataType
            if it[0] == "label":
                self._relabel(df.select(F.col(f"`{var}`.id").alias("id")).where("id is not null").distinct(), it[2], True)
                df = df.withColumn(var, F.col(f"`{var}`").withField("labels", F.array_union(F.col(f"`{var}`.labels"), F.array(*[F.lit(x) for x in it[2]]))))
                continue
            values, clear = self._updates(cx, df, var, [it])
            if not is_node(t) and not is_rel(t):
                raise TypeError(f"{var} has no properties to set")
            if values or clear:
                self._write(df, var, values, clear, is_node(t))
            c = F.col(f"`{var}`")
            hide = ("id", "labels") if is_node(t) else ("id", "src", "dst", "type")
            fields = [c[n].alias(n) for n in hide]
            own = [n for n in t.fieldNames() if n not in hide]
            for n in dict.fromkeys([*own, *values]):
                fields.append((values[n] if n in values else F.lit(None).cast(t[n].dataType) if clear else c[n]).alias(n))
            df = _shared(df.withColumn(var, F.when(c.isNotNull(), F.struct(*fields))))
        cx.graph = self.graph
        return df

    def _relabel(self, ids: DataFrame, labels, add: bool) -> None:
        ids = _shared(ids)
        self.relabelled = True
        out = []
        for t in self.graph.nodes:
            after = tuple(dict.fromkeys((*t.labels, *labels))) if add else tuple(x for x in t.labels if x not in labels)
            if after == t.labels or (not add and not set(labels) & set(t.labels)) or t.df.join(ids, "id", "left_semi").isEmpty():
                out.append(t)
                continue
            out += [t.over(t.df.join(ids, "id", "left_anti")), NodeTable(after, t.df.join(ids, "id", "left_semi"))]
        self.graph = replace(self.graph, nodes=tuple(out))

    def remove(self, cx, df, items) -> DataFrame:
        df = _shared(df)
        for it in items:
            var = it[1][1]
            c, t = F.col(f"`{var}`"), df.schema[var].dataType
            if it[0] == "prop":
                if it[2] in t.fieldNames():
                    self._write(df, var, {it[2]: F.lit(None).cast(t[it[2]].dataType)}, False, is_node(t))
                    df = df.withColumn(var, c.withField(it[2], F.lit(None).cast(t[it[2]].dataType)))
            elif is_node(t):
                self._relabel(df.select(c["id"].alias("id")).where("id is not null").distinct(), it[2], False)
                df = df.withColumn(var, c.withField("labels", F.array_except(c["labels"], F.array(*[F.lit(x) for x in it[2]]))))
            else:  # a relationship's type
                ids = _shared(df.select(c["id"].alias("id")).where("id is not null").distinct())
                out = []
                self.relabelled = True
                for x in self.graph.rels:
                    if x.type in it[2]:
                        out += [x.over(x.df.join(ids, "id", "left_anti")), x.over(x.df.join(ids, "id", "left_semi"), "")]
                    else:
                        out.append(x)
                self.graph = replace(self.graph, rels=tuple(out))
                df = df.withColumn(var, c.withField("type", F.lit("")))
        return _shared(df)

    # -- delete
    def delete(self, cx, df, items, detach) -> DataFrame:
        from ..plans.compiler import Scope

        df = _shared(df)
        nodes, rels = [], []
        for e in items:
            t, c = cx.dtype(e, Scope(df)), cx.expr(e, Scope(df))
            if is_node(t):
                nodes.append(df.select(c["id"].alias("id")))
            elif is_rel(t):
                rels.append(df.select(c["id"].alias("id")))
        union = lambda xs: _shared(reduce(DataFrame.unionAll, xs).where("id is not null").distinct())
        if rels:
            ids = union(rels)
            self.graph = replace(self.graph, rels=tuple(t.over(t.df.join(ids, "id", "left_anti")) for t in self.graph.rels))
        if nodes:
            ids = union(nodes)
            src, dst = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
            if not detach and any(not t.df.join(src, "src", "left_semi").isEmpty() or not t.df.join(dst, "dst", "left_semi").isEmpty() for t in self.graph.rels):
                raise ConstraintError("a node to be deleted still has relationships; use DETACH DELETE")
            keep = tuple(t.over(t.df.join(src, "src", "left_anti").join(dst, "dst", "left_anti")) for t in self.graph.rels) if detach else self.graph.rels
            self.graph = replace(self.graph, nodes=tuple(t.over(t.df.join(ids, "id", "left_anti")) for t in self.graph.nodes), rels=keep)
        return df.where("false")

    # -- foreach
    def foreach(self, cx, df, var, source, body) -> DataFrame:
        """Run the clauses once for every element of the list, in order.

        SET clauses on variables of the rows are folded over the list within each row, so that an element sees what
        the one before has set. Other clauses (and SET on what they bind) run over the rows times the elements.
        """
        df = _shared(df)
        outer = set(df.columns)
        at = 0
        while at < len(body) and body[at][0] == "set" and all(i[1][0] == "var" and i[1][1] in outer for i in body[at][1]):
            at += 1
        if at:
            items = [i for c in body[:at] for i in c[1]]
            df = self._fold(cx, df, var, source, items)
        if at < len(body):
            wide, source = cx.attach(df, source)
            rows = wide.select("*", F.explode(self._scoped(cx, wide, source)).alias(var))
            for c in body[at:]:
                if c[0] == "delete":
                    self.delete(cx, rows, *c[1:])
                else:
                    rows = getattr(self, c[0])(cx, rows, *c[1:])
                cx.graph = self.graph
        return df

    @staticmethod
    def _scoped(cx, df, e):
        from ..plans.compiler import Scope

        return cx.expr(e, Scope(df))

    def _fold(self, cx, df, var, source, items) -> DataFrame:
        from ..plans.compiler import Scope

        wide, source = cx.attach(df, source)
        scope = Scope(wide)
        elements, of = cx.expr(source, scope), cx.element(source, scope)
        names = list(dict.fromkeys(i[1][1] for i in items))
        for i in (i for i in items if i[0] == "label"):
            self._relabel(wide.where(F.size(elements) > 0).select(F.col(f"`{i[1][1]}`.id").alias("id")).where("id is not null").distinct(), i[2], True)
        hide = {n: ("id", "labels") if is_node(wide.schema[n].dataType) else ("id", "src", "dst", "type") for n in names}
        types = {n: {f.name: f.dataType for f in wide.schema[n].dataType.fields} for n in names}

        def step(of_names, x, types):
            """Fields of each variable after one element, as columns, and their types."""
            fields = {n: {k: of_names[n][k] for k in types[n]} for n in names}
            found = {n: dict(types[n]) for n in names}
            for it in items:
                if it[0] == "label":
                    continue
                now = scope.bind(var, x, of)
                for n in names:
                    now = now.bind(n, F.struct(*[c.alias(k) for k, c in fields[n].items()]), T.StructType([T.StructField(k, t) for k, t in found[n].items()]))
                n, it_values = it[1][1], {}
                if it[0] == "prop":
                    it_values = {it[2]: it[3]}
                elif it[2][0] == "map":
                    it_values = dict(it[2][1])
                elif it[2][0] == "param":
                    it_values = {k: ("lit", v) for k, v in cx.params[it[2][1]].items()}
                else:
                    raise TypeError("FOREACH sets properties from maps or single values")
                new = {k: (cx.expr(e, now), cx.dtype(e, now)) for k, e in it_values.items()}
                if it[0] == "replace":
                    fields[n].update({k: F.lit(None).cast(t) for k, t in found[n].items() if k not in hide[n]})
                for k, (c, t) in new.items():
                    old = found[n].get(k)
                    kept = old if isinstance(t, T.NullType) and old is not None else t
                    if old is not None and {type(old), type(t)} == {T.LongType, T.DoubleType}:
                        kept = T.DoubleType()
                    fields[n][k], found[n][k] = c.cast(kept), kept
            return fields, found

        blank = {n: {k: F.lit(None).cast(t) for k, t in types[n].items()} for n in names}
        for _ in range(8):  # the types that the properties end up with, over any number of rounds
            _, after = step({n: {**blank[n], **{k: F.lit(None).cast(t) for k, t in types[n].items()}} for n in names}, F.lit(None).cast(of), types)
            if after == types:
                break
            types = after
        pack = lambda fields: F.struct(*[F.struct(*[fields[n][k].cast(types[n][k]).alias(k) for k in types[n]]).alias(n) for n in names])
        own = {n: set(wide.schema[n].dataType.names) for n in names}
        first = {n: {k: F.col(f"`{n}`.`{k}`") if k in own[n] else F.lit(None) for k in types[n]} for n in names}

        def unpack(acc):
            return {n: {k: acc[n][k] for k in types[n]} for n in names}

        folded = F.aggregate(F.coalesce(elements, F.array().cast(T.ArrayType(of))), pack(first), lambda acc, x: pack(step(unpack(acc), x, types)[0]))
        h = cx.hidden("f")
        out = _shared(wide.withColumn(h, folded))
        for n in names:
            changed = {k for i in items if i[0] != "label" and i[1][1] == n for k in ([i[2]] if i[0] == "prop" else [k for k in types[n] if k not in hide[n]])}
            if changed:
                self._write(out, n, {k: F.col(f"`{h}`.`{n}`.`{k}`") for k in types[n] if k in changed}, False, is_node(wide.schema[n].dataType))
            labels = [x for i in items if i[0] == "label" and i[1][1] == n for x in i[2]]
            value = F.when(F.col(f"`{n}`").isNotNull(), F.col(f"`{h}`.`{n}`"))
            if labels:
                value = value.withField("labels", F.when(F.size(elements) > 0, F.array_union(value["labels"], F.array(*[F.lit(x) for x in labels]))).otherwise(value["labels"]))
            out = out.withColumn(n, value)
        return out.select(*[f"`{c}`" for c in df.columns])
