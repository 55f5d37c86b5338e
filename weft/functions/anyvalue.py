"""Values whose type is known only at run time: VARIANT columns, and comparison across kinds of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import is_list, is_node, is_rel
from .temporal import is_clock, is_duration, is_zoned, wall

#: Ranks of kinds in the global order; temporal values come first, null last.
RANK = {"temporal": 0, "map": 1, "node": 2, "relationship": 3, "list": 4, "string": 6, "boolean": 7, "number": 8}
_VARIANT_KINDS = {"OBJECT": "map", "ARRAY": "list", "STRING": "string", "BOOLEAN": "boolean", **dict.fromkeys(("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "number")}


def is_variant(t) -> bool:
    return isinstance(t, T.VariantType)


def kind(t) -> str:
    """The kind of a type's values: those of one kind can be compared by Spark itself."""
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) or is_zoned(t):
        return "temporal"
    if is_duration(t) or is_clock(t):
        return "duration" if is_duration(t) else "clock"
    if is_node(t) or is_rel(t):
        return "node" if is_node(t) else "relationship"
    return {"NullType": "null", "StringType": "string", "BooleanType": "boolean", "ArrayType": "list", "StructType": "map", "MapType": "map", "VariantType": "any"}.get(type(t).__name__, type(t).__name__)


def holds_variant(t) -> bool:
    if isinstance(t, T.ArrayType):
        return holds_variant(t.elementType)
    if isinstance(t, T.StructType):
        return any(holds_variant(f.dataType) for f in t.fields)
    return is_variant(t)


def key(c: Column, t) -> Column:
    """A value's place in the global order: struct<rank, number, text>; null for null."""
    if is_variant(t):
        def of(name: Column) -> Column:
            rank = reduce(lambda w, nk: w.when(name == nk[0], F.lit(RANK[nk[1]])), _VARIANT_KINDS.items(), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0))
            plain = name.isin(*(k for k, v in _VARIANT_KINDS.items() if v == "number"))
            number = F.when(name == "BOOLEAN", F.try_variant_get(c, "$", "boolean").cast("double")).when(plain, F.try_variant_get(c, "$", "double"))
            text = F.when(name == "STRING", F.try_variant_get(c, "$", "string")).when((name != "BOOLEAN") & ~plain, F.to_json(c))
            return F.struct(rank.alias("rank"), number.alias("number"), text.alias("text"))

        # a lambda's argument is found once; by itself the name would be found anew wherever it is used
        name = F.substring_index(F.substring_index(F.schema_of_variant(c), "(", 1), "<", 1)
        return F.when(c.isNotNull() & ~F.is_variant_null(c), F.transform(F.array(name), of)[0])
    k = kind(t)
    none_number, none_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if k in ("number", "boolean"):
        number, text = c.cast("double"), none_text
    elif k in ("node", "relationship"):
        number, text = c["id"].cast("double"), none_text
    else:
        number, text = none_number, c if k == "string" else c.cast("string") if k in ("temporal", "null") and not is_zoned(t) else F.to_json(F.struct(c))
    return F.when(c.isNotNull(), F.struct(F.lit(RANK.get(k, 0)).alias("rank"), number.alias("number"), text.alias("text")))


def unlike(o: str, a: Column, b: Column) -> Column:
    """Values of different kinds are never equal and have no order."""
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(o == "<>")) if o in ("=", "<>") else F.lit(None).cast("boolean")


_PLAIN = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(o: str, a: Column, ta, b: Column, tb) -> Column:
    """a o b with the language's rules for values of any two types; null where either is null."""
    ka, kb = kind(ta), kind(tb)
    if "null" in (ka, kb):
        return F.lit(None).cast("boolean")
    if "any" in (ka, kb):
        x, y = key(a, ta), key(b, tb)
        return _PLAIN[o](x, y) if o in ("=", "<>") else F.when(x["rank"] == y["rank"], _PLAIN[o](x, y))
    if ka != kb:
        return unlike(o, a, b)
    if ka in ("node", "relationship"):
        return _PLAIN[o](a["id"], b["id"])
    if is_zoned(ta) or is_zoned(tb):  # two date-times as instants, one with another temporal value by its local time
        if is_zoned(ta) and is_zoned(tb):
            return _PLAIN[o](a["ts"], b["ts"])
        return _PLAIN[o](wall(a, ta), wall(b, tb))
    if is_list(ta) and (holds_variant(ta) or holds_variant(tb) or kind(ta.elementType) != kind(tb.elementType)) and "null" not in (kind(ta.elementType), kind(tb.elementType)):
        keys = lambda c, t: F.transform(c, lambda v: key(v, t.elementType))
        return F.when(a.isNotNull() & b.isNotNull(), _PLAIN[o](keys(a, ta), keys(b, tb)))
    return _PLAIN[o](a, b)


def unified(columns: list[Column], types: list) -> list[Column]:
    """The columns as they are if they are of one kind, else as variants."""
    kinds = {k for t in types if (k := kind(t)) != "null"}
    if len(kinds) < 2:
        return columns
    return [F.lit(None).cast("variant") if kind(t) == "null" else c if is_variant(t) else c.cast("variant") for c, t in zip(columns, types)]


def number_of(c: Column, t) -> Column:
    return F.try_variant_get(c, "$", "double") if is_variant(t) else c


def text_of(c: Column, t) -> Column:
    return c.cast("string") if is_variant(t) else c


def identity(c: Column, t) -> Column:
    """Something that Spark can group by and that is equal where the values are."""
    if is_node(t) or is_rel(t):
        return c["id"]
    if is_variant(t):
        return key(c, t)
    return F.to_json(F.struct(c)) if holds_variant(t) else c
