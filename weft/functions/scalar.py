"""Scalar functions as Column builders: each takes the call's arguments (column, type) and returns a Column."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Arg:
    """An argument: its column, its type (found on demand) and its syntax tree."""

    col: Column
    find: Callable[[], T.DataType]
    tree: tuple = ()

    @property
    def type(self) -> T.DataType:
        return self.find()


FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register(*names: str):
    def put(f):
        for n in names:
            FUNCTIONS[n.lower()] = f
        return f

    return put


def is_list(t) -> bool:
    return isinstance(t, T.ArrayType)


def is_struct(t, *names: str) -> bool:
    return isinstance(t, T.StructType) and list(t.fieldNames()[: len(names)]) == list(names)


def is_node(t) -> bool:
    return is_struct(t, "id", "labels")


def is_rel(t) -> bool:
    return is_struct(t, "id", "src", "dst", "type")


def is_path(t) -> bool:
    return is_struct(t, "nodes", "rels")


def number(c: Column) -> Column:
    return c.cast("double")


for _name, _f in {
    "acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "cot": F.cot, "sin": F.sin, "tan": F.tan, "degrees": F.degrees,
    "radians": F.radians, "exp": F.exp, "log": F.ln, "log10": F.log10, "sqrt": F.sqrt, "sign": F.signum,
}.items():
    FUNCTIONS[_name] = lambda a, _f=_f: _f(number(a.col))
FUNCTIONS["atan2"] = lambda a, b: F.atan2(number(a.col), number(b.col))
FUNCTIONS["haversin"] = lambda a: (1 - F.cos(number(a.col))) / 2
FUNCTIONS["pi"] = lambda: F.lit(math.pi)
FUNCTIONS["e"] = lambda: F.lit(math.e)
FUNCTIONS["rand"] = lambda: F.rand()
FUNCTIONS["abs"] = lambda a: F.abs(a.col)
FUNCTIONS["ceil"] = lambda a: F.ceil(number(a.col)).cast("double")
FUNCTIONS["floor"] = lambda a: F.floor(number(a.col)).cast("double")
FUNCTIONS["power"] = lambda a, b: F.pow(number(a.col), number(b.col)).cast("bigint")
FUNCTIONS["weft"] = lambda: F.lit("weft-0.1")
FUNCTIONS["timestamp"] = lambda: F.unix_millis(F.current_timestamp())
FUNCTIONS["randomuuid"] = lambda: F.expr("uuid()")
FUNCTIONS["id"] = lambda a: a.col["id"]
FUNCTIONS["type"] = lambda a: F.when(a.col.isNotNull(), F.coalesce(a.col["type"], F.lit("")))
FUNCTIONS["labels"] = lambda a: a.col["labels"]
FUNCTIONS["nodes"] = lambda a: a.col["nodes"]
FUNCTIONS["relationships"] = FUNCTIONS["rels"] = lambda a: a.col["rels"]
FUNCTIONS["head"] = lambda a: F.get(a.col, F.lit(0))
FUNCTIONS["last"] = lambda a: F.try_element_at(a.col, F.lit(-1))
FUNCTIONS["tail"] = lambda a: F.slice(a.col, 2, F.greatest(F.size(a.col), F.lit(1)))


@register("coalesce")
def _coalesce(*a: Arg) -> Column:
    from .anyvalue import unified

    return F.coalesce(*unified([x.col for x in a], [x.type for x in a]))


@register("round")
def _round(a: Arg, p: Arg | None = None) -> Column:
    if p is None:
        return F.floor(number(a.col) + 0.5).cast("double")
    scale = F.pow(F.lit(10.0), number(p.col))
    return F.floor(number(a.col) * scale + 0.5).cast("double") / scale


@register("length")
def _length(a: Arg) -> Column:
    return (F.size(a.col["rels"]) if is_path(a.type) else F.size(a.col) if is_list(a.type) else F.length(a.col)).cast("bigint")


@register("size")
def _size(a: Arg) -> Column:
    n = F.size(a.col) if is_list(a.type) else F.size(a.col["rels"]) if is_path(a.type) else F.length(a.col.cast("string"))
    return F.when(a.col.isNotNull(), n).cast("bigint")


@register("isEmpty")
def _is_empty(a: Arg) -> Column:
    return F.size(a.col) == 0 if is_list(a.type) else F.length(a.col) == 0


@register("exists")
def _exists(a: Arg) -> Column:
    if isinstance(a.type, T.BooleanType):
        return F.coalesce(a.col, F.lit(False)) if a.tree[0] != "prop" else a.col.isNotNull()
    return F.coalesce(F.size(a.col) > 0, F.lit(False)) if is_list(a.type) and a.tree[0] != "prop" else a.col.isNotNull()


@register("reverse")
def _reverse(a: Arg) -> Column:
    return F.reverse(a.col)


@register("range")
def _range(a: Arg, b: Arg, step: Arg | None = None) -> Column:
    lo, hi = a.col.cast("bigint"), b.col.cast("bigint")
    by = F.lit(1).cast("bigint") if step is None else step.col.cast("bigint")
    forward = ((by > 0) & (lo <= hi)) | ((by < 0) & (lo >= hi))
    # the branch guards sequence(), which rejects empty ranges
    return F.when(forward, F.sequence(F.when(forward, lo).otherwise(F.lit(0)), F.when(forward, hi).otherwise(F.lit(0)), F.when(forward, by).otherwise(F.lit(1)))).otherwise(F.array().cast("array<bigint>"))


@register("properties")
def _properties(a: Arg) -> Column:
    t = a.type
    hidden = {"id", "labels"} if is_node(t) else {"id", "src", "dst", "type"} if is_rel(t) else set()
    return F.when(a.col.isNotNull(), F.struct(*[a.col[n].alias(n) for n in t.fieldNames() if n not in hidden]))


@register("keys")
def _keys(a: Arg) -> Column:
    t = a.type
    if isinstance(t, T.MapType):
        return F.map_keys(a.col)
    hidden = {"id", "labels"} if is_node(t) else {"id", "src", "dst", "type"} if is_rel(t) else set()
    entity = bool(hidden)
    names = [F.when(a.col[n].isNotNull(), F.lit(n)) if entity else F.lit(n) for n in t.fieldNames() if n not in hidden]
    return F.when(a.col.isNotNull(), F.array_compact(F.array(*names).cast("array<string>")))


@register("toInteger")
def _to_integer(a: Arg) -> Column:
    return a.col.cast("string").try_cast("double").try_cast("bigint") if not isinstance(a.type, T.LongType) else a.col


@register("toFloat")
def _to_float(a: Arg) -> Column:
    text = a.col.cast("string")
    return text.try_cast("double") if not isinstance(a.type, T.StringType) else F.when(text.rlike(r"^-?[0-9]+\.?[0-9]*$"), text.try_cast("double"))


@register("toBoolean")
def _to_boolean(a: Arg) -> Column:
    text = F.lower(a.col.cast("string"))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


@register("toString")
def _to_string(a: Arg) -> Column:
    from .temporal import temporal_text

    if is_struct(a.type, "x", "y", "z", "srid", "crs"):
        p = a.col
        third = F.when(p["z"].isNotNull(), F.concat(F.lit(", z: "), p["z"].cast("string"))).otherwise(F.lit(""))
        return F.concat(F.lit("point({x: "), p["x"].cast("string"), F.lit(", y: "), p["y"].cast("string"), third, F.lit(", crs: '"), p["crs"], F.lit("'})"))
    text = temporal_text(a.col, a.type)
    return a.col.cast("string") if text is None else text


FUNCTIONS["left"] = lambda s, n: F.left(s.col, n.col.cast("int"))
FUNCTIONS["right"] = lambda s, n: F.right(s.col, n.col.cast("int"))
FUNCTIONS["ltrim"] = lambda s: F.regexp_replace(s.col, r"^[ 　]+", "")
FUNCTIONS["rtrim"] = lambda s: F.regexp_replace(s.col, r"[ 　]+$", "")
FUNCTIONS["trim"] = lambda s: F.regexp_replace(s.col, r"^[ 　]+|[ 　]+$", "")
FUNCTIONS["replace"] = lambda s, a, b: F.replace(s.col, a.col, b.col)
FUNCTIONS["tolower"] = FUNCTIONS["lower"] = lambda s: F.lower(s.col)
FUNCTIONS["toupper"] = FUNCTIONS["upper"] = lambda s: F.upper(s.col)


@register("split")
def _split(s: Arg, d: Arg) -> Column:
    """By a literal separator; empty pieces at the end are dropped."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(d.col, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    parts = F.split(s.col, quoted)
    kept = F.size(parts) - F.coalesce(F.array_position(F.transform(F.reverse(parts), lambda x: x != ""), True) - 1, F.size(parts)).cast("int")
    return F.slice(parts, 1, F.greatest(kept, F.lit(0)))


@register("substring")
def _substring(s: Arg, start: Arg, n: Arg | None = None) -> Column:
    size = n.col.cast("int") if n is not None else F.length(s.col)
    return F.substring(s.col, start.col.cast("int") + 1, size)


# -- points

#: Coordinate systems by name, with their identifiers.
CRS = {"cartesian": 7203, "cartesian-3d": 9157, "wgs-84": 4326, "wgs-84-3d": 4979}
#: Fixed value: the earth's radius in metres.
EARTH_RADIUS = 6378140.0


@register("point")
def _point(m: Arg) -> Column:
    names = {n.lower(): n for n in m.type.fieldNames()}
    get = lambda *ks: next((m.col[names[k]].cast("double") for k in ks if k in names), F.lit(None).cast("double"))
    if "crs" in names and "srid" in names:
        raise ValueError("a point takes crs or srid, not both")
    flat = not ({"longitude", "latitude"} & names.keys())
    deep = bool({"z", "height"} & names.keys())
    literal = dict(m.tree[1]) if m.tree and m.tree[0] == "map" else {}
    named = {k.lower(): v[1] for k, v in literal.items() if v[0] == "lit"}
    crs = named.get("crs", "").lower() if "crs" in names else None
    if "srid" in names:
        crs = {v: k for k, v in CRS.items()}.get(named.get("srid"))
    crs = crs or ("cartesian" if flat else "wgs-84") + ("-3d" if deep else "")
    if crs not in CRS:
        raise ValueError(f"unknown coordinate system {crs!r}")
    made = F.struct(get("x", "longitude").alias("x"), get("y", "latitude").alias("y"), get("z", "height").alias("z"), F.lit(CRS[crs]).cast("bigint").alias("srid"), F.lit(crs).alias("crs"))
    return F.when(made["x"].isNotNull() & made["y"].isNotNull(), made)


@register("distance")
def _distance(p: Arg, q: Arg) -> Column:
    a, b = p.col, q.col
    dz = F.coalesce(a["z"], F.lit(0.0)) - F.coalesce(b["z"], F.lit(0.0))
    plane = F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + dz**2)
    lat1, lat2 = F.radians(a["y"]), F.radians(b["y"])
    h = F.sin((lat2 - lat1) / 2) ** 2 + F.cos(lat1) * F.cos(lat2) * F.sin(F.radians(b["x"] - a["x"]) / 2) ** 2
    radius = F.lit(EARTH_RADIUS) + (F.coalesce(a["z"], F.lit(0.0)) + F.coalesce(b["z"], F.lit(0.0))) / 2
    arc = 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    globe = F.sqrt(arc**2 + dz**2)
    return F.when(a["srid"] == b["srid"], F.when(a["srid"].isin(7203, 9157), plane).otherwise(globe))
