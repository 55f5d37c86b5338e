"""Temporal functions. Dates are DATE, local date-times TIMESTAMP_NTZ, date-times structs of an instant and its
zone (TIMESTAMP columns of tables are date-times in the session's zone), local times and times structs of
nanoseconds of the day, durations structs of months, days, seconds and nanoseconds. A duration's seconds and
nanoseconds have one sign, and its components are truncated towards zero."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import FUNCTIONS, Arg, is_struct

DAY_NANOS = 86_400_000_000_000
#: Average lengths that fractional units cascade by.
MONTH_DAYS = 30.436875


ZONED = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("zone", T.StringType())])
DURATION = T.StructType([T.StructField(n, T.LongType()) for n in ("months", "days", "seconds", "nanos")])


def is_duration(t) -> bool:
    return is_struct(t, "months", "days", "seconds", "nanos")


def is_zoned(t) -> bool:
    return is_struct(t, "ts", "zone")


def is_clock(t) -> bool:
    return is_struct(t, "nanos_of_day")


def _div(a: Column, by: int) -> Column:
    """Whole division that truncates towards zero."""
    return F.call_function("div", a.cast("bigint"), F.lit(by).cast("bigint"))


def _duration(months, days, seconds, nanos) -> Column:
    """A duration whose seconds and nanoseconds are brought to one sign and less than a second of nanoseconds."""
    def settle(e):
        s, n = e["s"] + _div(e["n"], 1_000_000_000), e["n"] % 1_000_000_000
        off = F.when((s > 0) & (n < 0), F.lit(-1)).when((s < 0) & (n > 0), F.lit(1)).otherwise(F.lit(0))
        return F.struct(e["m"].alias("months"), e["d"].alias("days"), (s + off).cast("bigint").alias("seconds"), (n - off * 1_000_000_000).cast("bigint").alias("nanos"))

    parts = zip(("m", "d", "s", "n"), (months, days, seconds, nanos))
    return let(F.struct(*[c.cast("bigint").alias(k) for k, c in parts]), settle)


def _whole(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("bigint")


def _from_units(get) -> Column:
    """Cascade fractional units: months into days by the average month, days into seconds."""
    v = lambda *ks: sum((F.coalesce(get(k).cast("double"), F.lit(0.0)) for k in ks if get(k) is not None), F.lit(0.0))

    def clock(e):
        seconds = e["clock"] + (e["days"] - _whole(e["days"])) * 86400
        return let(F.struct(e["months"].alias("m"), _whole(e["days"]).alias("d"), seconds.alias("s"), e["small"].alias("n")), parts)

    def parts(e):
        sec = _whole(F.round(e["s"], 9))
        return _duration(e["m"], e["d"], sec, F.round((e["s"] - sec) * 1e9) + e["n"])

    def months(e):
        days = e["days"] + (e["months"] - _whole(e["months"])) * MONTH_DAYS
        return let(F.struct(_whole(e["months"]).alias("months"), days.alias("days"), e["clock"].alias("clock"), e["small"].alias("small")), clock)

    return let(
        F.struct(
            (v("years", "year") * 12 + v("quarters", "quarter") * 3 + v("months", "month")).alias("months"),
            (v("weeks", "week") * 7 + v("days", "day")).alias("days"),
            (v("hours", "hour") * 3600 + v("minutes", "minute") * 60 + v("seconds", "second")).alias("clock"),
            (v("milliseconds", "millisecond") * 1e6 + v("microseconds", "microsecond") * 1e3 + v("nanoseconds", "nanosecond")).alias("small"),
        ),
        months,
    )


def _constant_duration(parts: dict) -> Column:
    """The duration of constant units, by the rules of ``_from_units`` in exact fractions."""
    v = lambda *ks: sum((Fraction(str(parts[k])) for k in ks if parts.get(k) is not None), Fraction(0))
    months = v("years", "year") * 12 + v("quarters", "quarter") * 3 + v("months", "month")
    days = v("weeks", "week") * 7 + v("days", "day") + (months - int(months)) * Fraction(str(MONTH_DAYS))
    sec = v("hours", "hour") * 3600 + v("minutes", "minute") * 60 + v("seconds", "second") + (days - int(days)) * 86400
    sec += v("milliseconds", "millisecond") / 1_000 + v("microseconds", "microsecond") / 1_000_000 + v("nanoseconds", "nanosecond") / 1_000_000_000
    nanos = int(abs(sec) * 1_000_000_000 + Fraction(1, 2)) * (1 if sec >= 0 else -1)
    seconds = int(Fraction(nanos, 1_000_000_000))
    fields = {"months": int(months), "days": int(days), "seconds": seconds, "nanos": nanos - seconds * 1_000_000_000}
    return F.struct(*[F.lit(x).cast("bigint").alias(k) for k, x in fields.items()])


def _constants(tree) -> dict | None:
    """A map's values by lower-cased key if all are constant numbers."""
    if tree and tree[0] == "lit" and isinstance(tree[1], dict):
        values = tree[1]
    elif tree and tree[0] == "map":
        values = {k: v[1] if v[0] == "lit" else -v[1][1] if v[0] == "neg" and v[1][0] == "lit" else "" for k, v in tree[1]}
    else:
        return None
    if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values.values()):
        return None
    return {k.lower(): v for k, v in values.items()}


_ISO = re.compile(r"^(-?)P(?:([-\d.]+)Y)?(?:([-\d.]+)M)?(?:([-\d.]+)W)?(?:([-\d.]+)D)?(?:T(?:([-\d.]+)H)?(?:([-\d.]+)M)?(?:([-\d.]+)S)?)?$")
_ISO_DATE = re.compile(r"^P(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d(?:\.\d+)?)$")


def duration(a: Arg) -> Column:
    if (parts := _constants(a.tree)) is not None:
        return _constant_duration(parts)
    if a.tree[0] == "lit" and isinstance(a.tree[1], str):
        text = a.tree[1]
        units = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")
        if m := _ISO_DATE.match(text):
            parts = dict(zip(("years", "months", "days", "hours", "minutes", "seconds"), m.groups()))
        elif m := _ISO.match(text):
            sign = -1 if m[1] else 1
            parts = {u: sign * Fraction(x) for u, x in zip(units, m.groups()[1:]) if x}
        else:
            raise ValueError(f"not a duration: {text!r}")
        return _constant_duration(parts)
    if isinstance(a.type, T.StructType):
        names = {n.lower(): n for n in a.type.fieldNames()}
        return let(a.col, lambda c: _from_units(lambda k: c[names[k]] if k in names else None))
    part = lambda rx: F.regexp_extract(a.col, rx, 1).try_cast("double")
    rx = {"years": r"^P[^T]*?([-\d.]+)Y", "months": r"^P[^T]*?([-\d.]+)M", "weeks": r"^P[^T]*?([-\d.]+)W", "days": r"^P[^T]*?([-\d.]+)D", "hours": r"T.*?([-\d.]+)H", "minutes": r"T.*?([-\d.]+)M", "seconds": r"T.*?([-\d.]+)S"}
    return F.when(a.col.isNotNull(), _from_units(lambda k: part(rx[k]) if k in rx else None))


def let(value: Column, body) -> Column:
    """body(value) with the value's expression in the plan once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def both(a: Column, b: Column, body) -> Column:
    """body(a, b), or null where either is; both operands stand in the plan once."""
    made = let(F.struct(a.alias("a"), b.alias("b")), lambda e: F.when(e["a"].isNotNull() & e["b"].isNotNull(), body(e["a"], e["b"])))
    return made


def wall(c: Column, t) -> Column:
    """The local date and time of a temporal value, as TIMESTAMP_NTZ (dates and other timestamps by a cast)."""
    if is_zoned(t):
        return F.convert_timezone(F.current_timezone(), c["zone"], c["ts"].cast("timestamp_ntz"))
    return c.cast("timestamp_ntz")


def zoned(local: Column, zone: Column) -> Column:
    """The date-time at a local date and time (TIMESTAMP_NTZ) of a zone; null where either is."""
    return both(local, zone, lambda a, z: F.struct(F.convert_timezone(z, F.current_timezone(), a).cast("timestamp").alias("ts"), z.alias("zone")))


def in_zone(instant: Column, zone: Column) -> Column:
    return F.when(instant.isNotNull() & zone.isNotNull(), F.struct(instant.alias("ts"), zone.alias("zone")))


def offset_seconds(c: Column) -> Column:
    """Offset from UTC of a date-time."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c["ts"].cast("timestamp_ntz"))
    return _div(F.unix_micros(wall(c, ZONED).cast("timestamp")) - F.unix_micros(utc.cast("timestamp")), 1_000_000)


def offset_text(seconds: Column) -> Column:
    away = F.abs(seconds)
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.when(seconds == 0, F.lit("Z")).otherwise(F.concat(sign, _two(_div(away, 3600)), F.lit(":"), _two(_div(away % 3600, 60))))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("bigint").cast("string"), 2, "0")


def clock_text(c: Column, zoned: bool) -> Column:
    """ISO form of a time of day, with its offset if it has one."""
    n = c["nanos_of_day"]
    part = lambda unit, of: _two(F.floor(n / unit) % of)
    frac = F.regexp_replace(F.lpad((n % 1_000_000_000).cast("string"), 9, "0"), "0+$", "")
    text = F.concat(part(3_600_000_000_000, 24), F.lit(":"), part(60_000_000_000, 60), F.lit(":"), part(1_000_000_000, 60), F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    if not zoned:
        return text
    return F.concat(text, offset_text(c["offset_seconds"]))


def temporal_text(c: Column, t) -> Column | None:
    """ISO form of a temporal value, or None for another type."""
    if is_duration(t):
        return F.when(c.isNotNull(), let(c, duration_text))
    if is_clock(t):
        return F.when(c.isNotNull(), let(c, lambda v: clock_text(v, "offset_seconds" in t.fieldNames())))
    if is_zoned(t):
        named = lambda v: F.when(v["zone"].rlike("^([+-].*|Z)$"), F.lit("")).otherwise(F.concat(F.lit("["), v["zone"], F.lit("]")))
        local = lambda v: F.replace(wall(v, t).cast("string"), F.lit(" "), F.lit("T"))
        return F.when(c.isNotNull(), let(c, lambda v: F.concat(local(v), offset_text(offset_seconds(v)), named(v))))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        text = F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
        return text if isinstance(t, T.TimestampNTZType) else F.concat(text, F.date_format(c, "XXX"))
    return None


def duration_text(d: Column) -> Column:
    """ISO form; each unit carries its own sign."""
    n = lambda v, u: F.when(v != 0, F.concat(v.cast("string"), F.lit(u))).otherwise(F.lit(""))
    months, seconds, nanos = d["months"], d["seconds"], d["nanos"]
    s = seconds % 60
    frac = F.when(nanos != 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(F.abs(nanos).cast("string"), 9, "0"), "0+$", ""))).otherwise(F.lit(""))
    sign = F.when((s < 0) | (nanos < 0), F.lit("-")).otherwise(F.lit(""))
    sec = F.when((s != 0) | (nanos != 0), F.concat(sign, F.abs(s).cast("string"), frac, F.lit("S"))).otherwise(F.lit(""))
    clock = F.concat(n(_div(seconds, 3600), "H"), n(_div(seconds % 3600, 60), "M"), sec)
    day = F.concat(F.lit("P"), n(_div(months, 12), "Y"), n(months % 12, "M"), n(d["days"], "D"))
    return let(F.struct(day.alias("d"), clock.alias("c")), lambda e: F.when((e["d"] == "P") & (e["c"] == ""), F.lit("PT0S")).otherwise(F.concat(e["d"], F.when(e["c"] != "", F.concat(F.lit("T"), e["c"])).otherwise(F.lit("")))))


# -- construction

def _week_date(year, week, day) -> Column:
    jan4 = F.make_date(year.cast("int"), F.lit(1), F.lit(4))
    monday = F.date_sub(jan4, F.weekday(jan4))
    return F.date_add(monday, ((week - 1) * 7 + day - 1).cast("int"))


def parse_date(s: Column) -> Column:
    """ISO calendar, week, quarter and ordinal forms, with or without separators."""
    g = lambda rx, i: F.regexp_extract(s, rx, i).try_cast("int")
    week, quarter, ordinal = r"^(\d{4})-?W(\d\d)-?(\d)?$", r"^(\d{4})-?Q(\d)-?(\d\d)?$", r"^(\d{4})-?(\d{3})$"
    full, month, year = r"^(\d{4})-?(\d\d)-?(\d\d)$", r"^(\d{4})-?(\d\d)$", r"^(\d{4})$"
    one = lambda c: F.coalesce(c, F.lit(1))
    return (
        F.when(s.rlike(full), F.make_date(g(full, 1), g(full, 2), g(full, 3)))
        .when(s.rlike(week), _week_date(g(week, 1), g(week, 2), one(g(week, 3))))
        .when(s.rlike(quarter), F.date_add(F.make_date(g(quarter, 1), (g(quarter, 2) - 1) * 3 + 1, F.lit(1)), one(g(quarter, 3)) - 1))
        .when(s.rlike(ordinal), F.date_add(F.make_date(g(ordinal, 1), F.lit(1), F.lit(1)), g(ordinal, 2) - 1))
        .when(s.rlike(month), F.make_date(g(month, 1), g(month, 2), F.lit(1)))
        .when(s.rlike(year), F.make_date(g(year, 1), F.lit(1), F.lit(1)))
    )


def _fields(a: Arg):
    names = {n.lower(): n for n in a.type.fieldNames()}
    return lambda k, d=None: a.col[names[k]].cast("int") if k in names else (F.lit(d) if d is not None else None), names


def date_of(a: Arg) -> Column:
    t = a.type
    if is_zoned(t):
        return wall(a.col, t).cast("date")
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return a.col.cast("date")
    if isinstance(t, T.StringType):
        return parse_date(F.regexp_replace(a.col, "T.*$", ""))
    get, names = _fields(a)
    whole = names.get("date") or names.get("datetime")
    base = wall(a.col[whole], t[whole].dataType).cast("date") if whole else None
    year = get("year") if "year" in names else F.year(base) if base is not None else F.lit(1)
    if "week" in names:
        return _week_date(year, get("week"), get("dayofweek", 1))
    if "quarter" in names:
        return F.date_add(F.make_date(year, (get("quarter") - 1) * 3 + 1, F.lit(1)), get("dayofquarter", 1) - 1)
    if "ordinalday" in names:
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), get("ordinalday") - 1)
    pick = lambda k, f: get(k) if k in names else f(base) if base is not None else F.lit(1)
    return F.make_date(year, pick("month", F.month), pick("day", F.dayofmonth))


def _nanos_text(s: Column) -> Column:
    rx = r"^T?(\d\d):?(\d\d)?:?(\d\d)?(?:[.,](\d+))?"
    g = lambda i: F.coalesce(F.regexp_extract(s, rx, i).try_cast("bigint"), F.lit(0))
    frac = F.coalesce(F.rpad(F.regexp_extract(s, rx, 4), 9, "0").try_cast("bigint"), F.lit(0))
    return F.when(s.rlike(rx), (g(1) * 3600 + g(2) * 60 + g(3)) * 1_000_000_000 + frac)


def _nanos_map(get, names, base: Column | None = None) -> Column:
    u = [("hour", 3_600_000_000_000), ("minute", 60_000_000_000), ("second", 1_000_000_000), ("millisecond", 1_000_000), ("microsecond", 1_000), ("nanosecond", 1)]
    if base is not None and not ({k for k, _ in u} & names.keys()):
        return base
    total = F.lit(0).cast("bigint")
    for k, n in u:
        if k in names:
            total = total + get(k).cast("bigint") * F.lit(n)
        elif base is not None and k in ("hour", "minute", "second"):
            total = total + F.floor(base / n) % (24 if k == "hour" else 60) * F.lit(n)
    return total


def clock_of(a: Arg, zoned: bool) -> Column:
    t = a.type
    off = F.lit(0)
    if isinstance(t, T.StringType):
        n = _nanos_text(a.col)
        rx = r"([+-])(\d\d):?(\d\d)?$"
        sign = F.when(F.regexp_extract(a.col, rx, 1) == "-", -1).otherwise(1)
        off = sign * (F.coalesce(F.regexp_extract(a.col, rx, 2).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(F.regexp_extract(a.col, rx, 3).try_cast("int"), F.lit(0)) * 60)
    elif is_clock(t):
        n = a.col["nanos_of_day"]
        if zoned and "offset_seconds" in t.fieldNames():
            off = a.col["offset_seconds"]
    elif is_zoned(t):
        n, off = day_nanos(wall(a.col, t)), offset_seconds(a.col)
    elif isinstance(t, T.StructType):
        get, names = _fields(a)
        base = names.get("time") or names.get("datetime")
        bt = t[base].dataType if base else None
        n = _nanos_map(get, names, (a.col[base]["nanos_of_day"] if is_clock(bt) else day_nanos(wall(a.col[base], bt))) if base else None)
        if base and is_clock(bt) and "offset_seconds" in bt.fieldNames():
            off = a.col[base]["offset_seconds"]
        elif base and is_zoned(bt):
            off = offset_seconds(a.col[base])
        if "timezone" in names:
            # a zone's offset at the start of 1970 for its name; a time with an offset of its own moves to the new one
            moved = offset_seconds(F.struct(F.timestamp_micros(F.lit(0)).alias("ts"), a.col[names["timezone"]].alias("zone")))
            if base and (is_zoned(bt) or "offset_seconds" in getattr(bt, "names", [])):
                n = F.pmod(n + (moved - off) * 1_000_000_000, F.lit(DAY_NANOS))
            off = moved
    else:
        n = day_nanos(a.col)
    fields = [n.cast("bigint").alias("nanos_of_day")] + ([off.cast("bigint").alias("offset_seconds")] if zoned else [])
    return F.when(n.isNotNull(), F.struct(*fields))


def day_nanos(ts: Column) -> Column:
    return ((F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") + F.floor(F.date_part(F.lit("second"), ts)).cast("bigint")) * 1_000_000_000 + (F.date_part(F.lit("second"), ts) * 1_000_000 % 1_000_000).cast("bigint") * 1000


def _at(date: Column, nanos: Column, ntz: bool) -> Column:
    base = F.unix_micros(date.cast("timestamp")) + F.floor(nanos / 1000).cast("bigint")
    ts = F.timestamp_micros(base)
    return ts.cast("timestamp_ntz") if ntz else ts


def datetime_of(a: Arg, ntz: bool) -> Column:
    t = a.type
    here = F.current_timezone()
    if is_zoned(t):
        return wall(a.col, t) if ntz else a.col
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return a.col.cast("timestamp_ntz") if ntz else in_zone(a.col.cast("timestamp"), here)
    if isinstance(t, T.StringType):
        text = F.regexp_replace(a.col, r"\[[^\]]*\]$", "")
        rx = r"^([^T]+)T?([\d:.,]*)(Z|[+-]\d\d:?\d\d|[+-]\d\d)?$"
        date, clock, offset = (F.regexp_extract(text, rx, i) for i in (1, 2, 3))
        local = _at(parse_date(date), F.coalesce(_nanos_text(clock), F.lit(0)), True)
        if ntz:
            return local
        # an offset sets the instant; a zone in brackets, the offset else, names the zone
        named = F.nullif(F.regexp_extract(a.col, r"\[([^\]]*)\]$", 1), F.lit(""))
        offset = F.when(offset.isin("", "Z"), F.nullif(offset, F.lit(""))).otherwise(F.regexp_replace(F.regexp_replace(offset, r"^(...)$", "$1:00"), r"^(...)(\d\d)$", "$1:$2"))
        at = zoned(local, F.coalesce(offset, named, here))
        return F.when(named.isNotNull(), in_zone(at["ts"], named)).otherwise(at)
    get, names = _fields(a)
    zone = a.col[names["timezone"]] if "timezone" in names else None
    if "epochseconds" in names or "epochmillis" in names:
        ms = a.col[names["epochmillis"]].cast("bigint") if "epochmillis" in names else a.col[names["epochseconds"]].cast("bigint") * 1000
        extra = _nanos_map(get, {k: v for k, v in names.items() if k in ("millisecond", "microsecond", "nanosecond")})
        at = in_zone(F.timestamp_micros(ms * 1000 + _div(extra, 1000)), here if zone is None else zone)
        return wall(at, ZONED) if ntz else at
    base, own = None, None
    for k in ("time", "datetime"):
        if k in names and base is None:
            c, bt = a.col[names[k]], t[names[k]].dataType
            base = c["nanos_of_day"] if is_clock(bt) else day_nanos(wall(c, bt))
            if is_zoned(bt):
                own = c["zone"]
            elif "offset_seconds" in getattr(bt, "names", []):
                own = offset_text(c["offset_seconds"])
    local = _at(date_of(a), _nanos_map(get, names, base), True)
    if ntz:
        return local
    if own is not None:  # the same instant in another zone
        at = zoned(local, own)
        return at if zone is None else in_zone(at["ts"], zone)
    return zoned(local, here if zone is None else zone)


def _now(kind: str):
    def f(*tz: Arg) -> Column:
        at = in_zone(F.current_timestamp(), tz[0].col if tz else F.current_timezone())
        local = wall(at, ZONED)
        if kind == "date":
            return local.cast("date")
        if kind == "datetime":
            return at
        if kind == "localdatetime":
            return local
        n = day_nanos(local).alias("nanos_of_day")
        return F.struct(n) if kind == "localtime" else F.struct(n, offset_seconds(at).alias("offset_seconds"))

    return f


_MAKE = {"date": date_of, "datetime": lambda a: datetime_of(a, False), "localdatetime": lambda a: datetime_of(a, True), "time": lambda a: clock_of(a, True), "localtime": lambda a: clock_of(a, False)}


def _make(kind):
    return lambda *a: _MAKE[kind](a[0]) if a else _now(kind)()


#: Nanoseconds of the clock's units.
_CLOCK_UNITS = {"hour": 3_600_000_000_000, "minute": 60_000_000_000, "second": 1_000_000_000, "millisecond": 1_000_000, "microsecond": 1_000, "day": DAY_NANOS}


def truncated_date(unit: str, d: Column) -> Column:
    y = F.year(d)
    if unit in ("millennium", "century", "decade"):
        size = {"millennium": 1000, "century": 100, "decade": 10}[unit]
        return F.make_date((F.floor(y / size) * size).cast("int"), F.lit(1), F.lit(1))
    if unit == "weekyear":
        thursday = F.date_add(d, 3 - F.weekday(d))
        return _week_date(F.year(thursday), F.lit(1), F.lit(1))
    if unit == "day" or unit in _CLOCK_UNITS:
        return d
    return F.trunc(d, unit)


def _truncate(kind):
    def f(unit: Arg | None = None, value: Arg | None = None, parts: Arg | None = None) -> Column:
        if unit is None:
            return _now("date" if kind in ("date", "datetime") else kind)()
        u = unit.tree[1].lower()
        if kind in ("time", "localtime"):
            n = value.col["nanos_of_day"] if is_clock(value.type) else day_nanos(wall(value.col, value.type))
            n = F.floor(n / _CLOCK_UNITS[u]).cast("bigint") * _CLOCK_UNITS[u]
            if parts is not None:
                get, names = _fields(parts)
                n = n + _nanos_map(get, names)
            fields = [n.alias("nanos_of_day")]
            if kind == "time":
                own = value.col["offset_seconds"] if is_struct(value.type, "nanos_of_day", "offset_seconds") else offset_seconds(value.col) if is_zoned(value.type) else F.lit(0).cast("bigint")
                fields.append(own.alias("offset_seconds"))
            return F.struct(*fields)
        local = wall(value.col, value.type)
        d = truncated_date(u, local.cast("date"))
        get, names = _fields(parts) if parts is not None else (None, {})
        if names:
            if "dayofweek" in names:
                d = F.date_add(d, get("dayofweek") - 1)
            pick = lambda k, g: get(k) if k in names else g(d)
            if {"year", "month", "day"} & names.keys():
                d = F.make_date(pick("year", F.year), pick("month", F.month), pick("day", F.dayofmonth))
        if kind == "date":
            return d
        n = F.lit(0).cast("bigint")
        if u in _CLOCK_UNITS and u != "day":
            n = F.floor(day_nanos(local) / _CLOCK_UNITS[u]).cast("bigint") * _CLOCK_UNITS[u]
        if names:
            n = n + _nanos_map(get, names)
        if kind == "localdatetime":
            return _at(d, n, True)
        zone = value.col["zone"] if is_zoned(value.type) else F.current_timezone()
        if "timezone" in names:
            zone = parts.col[names["timezone"]]
        return zoned(_at(d, n, True), zone)

    return f


for _kind in _MAKE:
    FUNCTIONS[_kind] = _make(_kind)
    for _when in ("transaction", "statement", "realtime"):
        FUNCTIONS[f"{_kind}.{_when}"] = _now(_kind)
    FUNCTIONS[f"{_kind}.truncate"] = _truncate(_kind)
FUNCTIONS["duration"] = duration


# -- between, arithmetic, components

def _comparable(x: Arg, y: Arg) -> tuple[Column, Column]:
    """Both values as timestamps: instants if both have a zone, else their local date and time. A time of day has
    the other's date, and two times of day are compared as they stand."""
    both_zoned = is_zoned(x.type) and is_zoned(y.type)

    def one(a: Arg, other: Arg) -> Column:
        t = a.type
        if is_clock(t):
            day = F.lit("1970-01-01").cast("date").cast("timestamp") if is_clock(other.type) else wall(other.col, other.type).cast("date").cast("timestamp")
            return F.timestamp_micros(F.unix_micros(day) + _div(a.col["nanos_of_day"], 1000))
        if is_zoned(t):
            return a.col["ts"] if both_zoned else wall(a.col, t).cast("timestamp")
        return a.col.cast("timestamp")

    return one(x, y), one(y, x)


def _months_on(a: Column, months: Column) -> Column:
    """a timestamp some months on, at the same time of day."""
    day = F.add_months(a.cast("date"), months.cast("int")).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(day) + F.unix_micros(a) - F.unix_micros(F.date_trunc("day", a)))


def _with_months(a: Column, b: Column, body) -> Column:
    """body(a, b, whole months from a to b); null where either is."""
    def fit(e):
        a, b, m = e["a"], e["b"], e["m"]
        over = _months_on(a, m)
        whole = F.when((b >= a) & (over > b), m - 1).when((b < a) & (over < b), m + 1).otherwise(m).cast("bigint")
        return let(F.struct(a.alias("a"), b.alias("b"), whole.alias("m")), lambda e: body(e["a"], e["b"], e["m"]))

    def count(e):
        m = (F.year(e["b"]) - F.year(e["a"])) * 12 + F.month(e["b"]) - F.month(e["a"])
        return let(F.struct(e["a"].alias("a"), e["b"].alias("b"), m.alias("m")), fit)

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), count))


def _between(x: Arg, y: Arg) -> Column:
    def rest(a, b, m):
        def split(e):
            us = e["us"]
            days = _div(us, 86_400_000_000)
            return _duration(e["m"], days, F.lit(0).cast("bigint"), (us - days * 86_400_000_000) * 1000)

        return let(F.struct(m.alias("m"), (F.unix_micros(b) - F.unix_micros(_months_on(a, m))).alias("us")), split)

    return _with_months(*_comparable(x, y), rest)


def _months(x: Arg, y: Arg) -> Column:
    return _with_months(*_comparable(x, y), lambda a, b, m: m)


FUNCTIONS["duration.between"] = _between
FUNCTIONS["duration.inmonths"] = lambda x, y: _duration(_months(x, y), F.lit(0), F.lit(0), F.lit(0))


def _in_days(x: Arg, y: Arg) -> Column:
    a, b = _comparable(x, y)
    return _duration(F.lit(0), _div(F.unix_micros(b) - F.unix_micros(a), 86_400_000_000), F.lit(0), F.lit(0))


FUNCTIONS["duration.indays"] = _in_days


def _in_seconds(x: Arg, y: Arg) -> Column:
    a, b = _comparable(x, y)
    return let(F.unix_micros(b) - F.unix_micros(a), lambda us: _duration(F.lit(0), F.lit(0), _div(us, 1_000_000), us % 1_000_000 * 1000))


FUNCTIONS["duration.inseconds"] = _in_seconds


def plus(a: Column, t, d: Column, sign: int = 1) -> Column:
    """A temporal value plus or minus a duration."""
    if is_duration(t):
        return _duration(a["months"] + sign * d["months"], a["days"] + sign * d["days"], a["seconds"] + sign * d["seconds"], a["nanos"] + sign * d["nanos"])
    nanos = sign * (d["seconds"] * 1_000_000_000 + d["nanos"])
    if is_clock(t):
        return a.withField("nanos_of_day", F.pmod(a["nanos_of_day"] + nanos, F.lit(DAY_NANOS)))
    if is_zoned(t):  # months and days on the local calendar, the clock on the time line
        days = _duration(d["months"], d["days"], F.lit(0), F.lit(0))
        moved = zoned(plus(wall(a, t), T.TimestampNTZType(), days, sign), a["zone"])
        return in_zone(F.timestamp_micros(F.unix_micros(moved["ts"]) + _div(nanos, 1000)), a["zone"])
    day = F.date_add(F.add_months(a.cast("date"), (sign * d["months"]).cast("int")), (sign * d["days"]).cast("int"))
    if isinstance(t, T.DateType):
        return F.date_add(day, F.floor(nanos / DAY_NANOS).cast("int"))
    inner = F.unix_micros(a.cast("timestamp")) - F.unix_micros(F.date_trunc("day", a.cast("timestamp")))
    ts = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + inner + F.floor(nanos / 1000).cast("bigint"))
    return ts.cast("timestamp_ntz") if isinstance(t, T.TimestampNTZType) else ts


def scale(d: Column, by: Column, divide: bool) -> Column:
    if not divide:
        return _duration(d["months"] * by, d["days"] * by, d["seconds"] * by, d["nanos"] * by)
    return _from_units(lambda k: {"months": d["months"] / by, "days": d["days"] / by, "seconds": (d["seconds"] + d["nanos"] / 1e9) / by}.get(k))


def component(c: Column, t, name: str) -> Column | None:
    """A temporal component by name, or None if the type has none such."""
    k = name.lower()
    if is_duration(t):
        months, days, total, nanos = c["months"], c["days"], c["seconds"], c["nanos"]
        out = {
            "years": lambda: _div(months, 12), "quarters": lambda: _div(months, 3), "months": lambda: months, "weeks": lambda: _div(days, 7), "days": lambda: days,
            "hours": lambda: _div(total, 3600), "minutes": lambda: _div(total, 60), "seconds": lambda: total, "milliseconds": lambda: total * 1000 + _div(nanos, 1_000_000),
            "microseconds": lambda: total * 1_000_000 + _div(nanos, 1000), "nanoseconds": lambda: total * 1_000_000_000 + nanos,
            "quartersofyear": lambda: _div(months % 12, 3), "monthsofquarter": lambda: months % 3, "monthsofyear": lambda: months % 12, "daysofweek": lambda: days % 7,
            "minutesofhour": lambda: _div(total % 3600, 60), "secondsofminute": lambda: total % 60, "millisecondsofsecond": lambda: _div(nanos, 1_000_000),
            "microsecondsofsecond": lambda: _div(nanos, 1000), "nanosecondsofsecond": lambda: nanos,
        }.get(k)
        return out().cast("bigint") if out is not None else None
    if is_zoned(t):
        special = {
            "timezone": lambda: c["zone"], "offset": lambda: offset_text(offset_seconds(c)), "offsetseconds": lambda: offset_seconds(c), "offsetminutes": lambda: _div(offset_seconds(c), 60),
            "epochmillis": lambda: F.unix_millis(c["ts"]), "epochseconds": lambda: F.unix_seconds(c["ts"]),
        }.get(k)
        return special() if special is not None else component(wall(c, t), T.TimestampNTZType(), name)
    if is_clock(t):
        if k in ("timezone", "offset") and "offset_seconds" in t.fieldNames():
            return offset_text(c["offset_seconds"])
        n = c["nanos_of_day"]
    elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        thursday = F.date_add(c.cast("date"), 3 - F.weekday(c))
        quarter_start = F.trunc(c.cast("date"), "quarter")
        date = {
            "year": F.year(c), "quarter": F.quarter(c), "month": F.month(c), "week": F.weekofyear(c), "weekyear": F.year(thursday), "day": F.dayofmonth(c),
            "dayofweek": F.weekday(c) + 1, "weekday": F.weekday(c) + 1, "ordinalday": F.dayofyear(c), "dayofyear": F.dayofyear(c),
            "dayofquarter": F.datediff(c.cast("date"), quarter_start) + 1, "quarterday": F.datediff(c.cast("date"), quarter_start) + 1,
        }.get(k)
        if date is not None:
            return date.cast("bigint")
        if isinstance(t, T.DateType):
            return None
        if k == "epochmillis":
            return F.unix_millis(c.cast("timestamp"))
        if k == "epochseconds":
            return F.unix_seconds(c.cast("timestamp"))
        if k in ("timezone", "offset") and isinstance(t, T.TimestampType):
            return F.current_timezone() if k == "timezone" else F.lit("Z")
        n = day_nanos(c)
    else:
        return None
    out = {"hour": n / 3_600_000_000_000, "minute": n / 60_000_000_000 % 60, "second": n / 1_000_000_000 % 60, "millisecond": n / 1_000_000 % 1000, "microsecond": n / 1000 % 1_000_000, "nanosecond": n % 1_000_000_000}.get(k)
    return F.floor(out).cast("bigint") if out is not None else None
