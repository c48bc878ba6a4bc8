"""Scalar functions of the query language over typed columns; all built-in expressions but where noted."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.cypher.values import (
    BOOLEAN,
    DATE,
    DOUBLE,
    DURATION,
    LONG,
    NAIVE,
    NULL,
    STRING,
    VARIANT,
    ZONED,
    Val,
    cast_to,
    common_type,
    contained,
    family,
    field_of,
    is_a,
    make_map,
    null,
    numeric,
    to_variant,
    variant_as,
)
from trellis.exceptions import CypherExecutionError

Function = Callable[..., Val]
FUNCTIONS: dict[str, tuple[int, int, Function]] = {}


def function(names: str, least: int, most: int | None = None) -> Callable[[Function], Function]:
    def add(f: Function) -> Function:
        for n in names.split():
            FUNCTIONS[n.lower()] = (least, least if most is None else most, f)
        return f

    return add


def call(name: str, args: list[Val]) -> Val:
    if name.lower() not in FUNCTIONS:
        raise CypherExecutionError(f"unknown function {name}")
    least, most, f = FUNCTIONS[name.lower()]
    if not least <= len(args) <= most:
        raise CypherExecutionError(f"{name} takes {least} to {most} arguments, not {len(args)}")
    return f(*args)


def text(v: Val, what: str = "a function of strings") -> Column:
    if is_a(v, T.VariantType):
        return variant_as(v.col, "string")
    if not is_a(v, T.StringType, T.NullType):
        raise CypherExecutionError(f"{what} takes a string, not a {family(v.dt)}")
    return v.col.cast("string")


def number(v: Val) -> Column:
    if is_a(v, T.VariantType):
        return variant_as(v.col, "number")
    if not numeric(v) and not is_a(v, T.NullType):
        raise CypherExecutionError(f"expected a number, not a {family(v.dt)}")
    return v.col.cast("double") if is_a(v, T.NullType) else v.col


def items(v: Val) -> tuple[Column, T.DataType]:
    if is_a(v, T.NullType):
        return F.lit(None).cast("array<string>"), NULL
    if is_a(v, T.VariantType):
        return variant_as(v.col, "list"), VARIANT
    if not is_a(v, T.ArrayType):
        raise CypherExecutionError(f"expected a list, not a {family(v.dt)}")
    return v.col, v.dt.elementType  # type: ignore[attr-defined]


# conversion
@function("toInteger toInt", 1)
def to_integer(x: Val) -> Val:
    if is_a(x, T.BooleanType):
        return Val(x.col.cast("bigint"), LONG)
    if is_a(x, T.VariantType):
        return Val(F.coalesce(variant_as(x.col, "number"), variant_as(x.col, "string").try_cast("double"), variant_as(x.col, "boolean").cast("double")).try_cast("bigint"), LONG)
    if is_a(x, T.StringType):
        return Val(F.coalesce(F.trim(x.col).try_cast("bigint"), F.trim(x.col).try_cast("double").try_cast("bigint")), LONG)
    if numeric(x) or is_a(x, T.NullType):
        return Val(x.col.try_cast("bigint"), LONG)
    raise CypherExecutionError(f"toInteger takes no {family(x.dt)}")


@function("toFloat", 1)
def to_float(x: Val) -> Val:
    if is_a(x, T.VariantType):
        return Val(F.coalesce(variant_as(x.col, "number"), variant_as(x.col, "string").try_cast("double")), DOUBLE)
    return Val(x.col.try_cast("double"), DOUBLE)


@function("toString", 1)
def to_string(x: Val) -> Val:
    if is_a(x, T.VariantType):
        return Val(x.col.cast("string"), STRING)
    if is_a(x, T.ArrayType, T.StructType, T.MapType):
        return Val(F.to_json(x.col), STRING)
    return Val(x.col.cast("string"), STRING)


@function("toBoolean", 1)
def to_boolean(x: Val) -> Val:
    return Val(F.lower(x.col.cast("string")).try_cast("boolean"), BOOLEAN)


# strings
for _name, _f in {"toUpper": F.upper, "upper": F.upper, "toLower": F.lower, "lower": F.lower}.items():
    function(_name, 1)(lambda x, f=_f: Val(f(text(x)), STRING))
function("trim", 1)(lambda x: Val(F.regexp_replace(text(x), r"(?U)^\s+|\s+$", ""), STRING))
function("ltrim", 1)(lambda x: Val(F.regexp_replace(text(x), r"(?U)^\s+", ""), STRING))
function("rtrim", 1)(lambda x: Val(F.regexp_replace(text(x), r"(?U)\s+$", ""), STRING))
function("left", 2)(lambda x, n: Val(F.left(text(x), n.col.cast("int")), STRING))
function("right", 2)(lambda x, n: Val(F.right(text(x), n.col.cast("int")), STRING))
function("replace", 3)(lambda x, a, b: Val(F.replace(text(x), text(a), text(b)), STRING))


@function("split", 2)
def split(x: Val, d: Val) -> Val:
    if d.const == "":
        raise CypherExecutionError("split needs a delimiter")
    return Val(F.split(text(x), F.concat(F.lit("\\Q"), text(d), F.lit("\\E")), -1), T.ArrayType(STRING))


@function("substring", 2, 3)
def substring(x: Val, start: Val, n: Val | None = None) -> Val:
    if any(isinstance(v.const, int) and v.const < 0 for v in (start, n) if v is not None):
        raise CypherExecutionError("substring takes no negative numbers")
    begin = number(start).cast("int") + 1
    return Val(F.substr(text(x), begin, number(n).cast("int")) if n is not None else F.substr(text(x), begin), STRING)


@function("matches regex", 2)
def matches(x: Val, pattern: Val) -> Val:
    import re

    if isinstance(pattern.const, str):
        try:
            re.compile(pattern.const)
        except re.error as e:
            raise CypherExecutionError(f"invalid pattern: {e}") from None
    return Val(F.regexp_like(text(x), text(pattern)), BOOLEAN)


@F.pandas_udf(T.StringType())  # type: ignore[call-overload]
def _deaccent(x: pd.Series) -> pd.Series:
    """Unicode decomposition has no built-in expression."""
    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


EMOJI = "[\\x{1F300}-\\x{1F5FF}\\x{1F600}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F700}-\\x{1F77F}\\x{1F900}-\\x{1F9FF}\\x{1FA70}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}]+"
function("deaccent apoc.text.deaccent", 1)(lambda x: Val(_deaccent(text(x)), STRING))
function("strip_html", 1)(lambda x: Val(F.regexp_replace(text(x), "<[^>]*>", ""), STRING))
function("strip_emoji", 1)(lambda x: Val(F.regexp_replace(text(x), EMOJI, ""), STRING))


@function("snake_case", 1)
def snake_case(x: Val) -> Val:
    s = _deaccent(text(x))
    for pattern, by in (("([A-Z]+)([A-Z][a-z])", "$1_$2"), ("([a-z0-9])([A-Z])", "$1_$2"), ("[^A-Za-z0-9]+", "_"), ("_+", "_"), ("^_+|_+$", "")):
        s = F.regexp_replace(s, pattern, by)
    return Val(F.lower(s), STRING)


function("levenshtein", 2)(lambda a, b: Val(F.levenshtein(text(a), text(b)).cast("bigint"), LONG))


@function("jaccard", 2)
def jaccard(a: Val, b: Val) -> Val:
    """Of the two sets of words; two texts without words are equal."""
    x, y = (F.array_distinct(F.filter(F.split(text(v), r"(?U)\s+"), lambda w: w != "")) for v in (a, b))
    union = F.size(F.array_union(x, y))
    return Val(F.when(a.col.isNull() | b.col.isNull(), F.lit(None)).when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union), DOUBLE)


# general
@function("coalesce", 1, 99)
def coalesce(*args: Val) -> Val:
    dt = common_type([a.dt for a in args])
    return Val(F.coalesce(*(cast_to(a, dt) for a in args)), dt, next((a.ent for a in args if a.ent), None))


@function("size", 1)
def size(x: Val) -> Val:
    if is_a(x, T.StringType):
        return Val(F.length(x.col).cast("bigint"), LONG)
    if is_a(x, T.StructType):
        return Val(F.when(x.col.isNotNull(), F.lit(len(x.dt.fields)).cast("bigint")), LONG)  # type: ignore[attr-defined]
    if is_a(x, T.MapType):
        return Val(F.when(x.col.isNotNull(), F.size(x.col).cast("bigint")), LONG)
    if is_a(x, T.VariantType):
        return Val(F.coalesce(F.length(variant_as(x.col, "string")), F.when(variant_as(x.col, "list").isNotNull(), F.size(variant_as(x.col, "list")))).cast("bigint"), LONG)
    col, _ = items(x)
    return Val(F.when(col.isNotNull(), F.size(col).cast("bigint")), LONG)


def _at(x: Val, place: Column) -> Val:
    col, inner = items(x)
    return Val(F.try_element_at(col, place), inner, x.ent)


function("head", 1)(lambda x: _at(x, F.lit(1)))
function("last", 1)(lambda x: _at(x, F.lit(-1)))


@function("tail", 1)
def tail(x: Val) -> Val:
    col, inner = items(x)
    return Val(F.when(F.coalesce(F.size(col), F.lit(0)) > 1, F.slice(col, F.lit(2), F.greatest(F.size(col) - 1, F.lit(0)))).otherwise(F.array().cast(T.ArrayType(inner if not isinstance(inner, T.NullType) else STRING))), T.ArrayType(inner), x.ent)


@function("reverse", 1)
def reverse(x: Val) -> Val:
    if is_a(x, T.StringType):  # a list of its characters, last first
        return Val(F.reverse(F.split(x.col, "")), T.ArrayType(STRING))
    col, inner = items(x)
    return Val(F.reverse(col), T.ArrayType(inner), x.ent)


@function("range", 2, 3)
def range_(a: Val, b: Val, step: Val | None = None) -> Val:
    if step is not None and step.const == 0:
        raise CypherExecutionError("range takes no step of 0")
    x, y = number(a).cast("bigint"), number(b).cast("bigint")
    s = number(step).cast("bigint") if step is not None else F.lit(1).cast("bigint")
    right = F.when(s > 0, x <= y).otherwise(x >= y)
    return Val(F.when(right, F.sequence(x, y, s)).when(~right, F.array().cast("array<bigint>")), T.ArrayType(LONG))


@function("keys", 1)
def keys(x: Val) -> Val:
    if is_a(x, T.StructType):
        fields = x.dt.fields  # type: ignore[attr-defined]
        if x.ent in ("node", "rel"):  # an entity has the properties that aren't null
            inner = next(f.dataType for f in fields if f.name == "properties").fields
            props = x.col.getField("properties")
            return Val(F.when(x.col.isNotNull(), F.filter(F.array(*(F.when(props.getField(f.name).isNotNull(), F.lit(f.name)) for f in inner)), lambda k: k.isNotNull())), T.ArrayType(STRING))
        return Val(F.array(*(F.lit(f.name) for f in fields)), T.ArrayType(STRING))
    if is_a(x, T.MapType):
        return Val(F.map_keys(x.col), T.ArrayType(STRING))
    if is_a(x, T.NullType):
        return Val(F.lit(None).cast("array<string>"), T.ArrayType(STRING))
    if is_a(x, T.VariantType):
        return Val(F.map_keys(F.try_variant_get(x.col, "$", "map<string,variant>")), T.ArrayType(STRING))
    raise CypherExecutionError(f"keys takes no {family(x.dt)}")


@function("values", 1)
def values(x: Val) -> Val:
    if is_a(x, T.MapType):
        return Val(F.map_values(x.col), T.ArrayType(x.dt.valueType))  # type: ignore[attr-defined]
    if is_a(x, T.StructType):
        v = x if x.ent not in ("node", "rel") else Val(x.col.getField("properties"), next(f.dataType for f in x.dt.fields if f.name == "properties"))  # type: ignore[attr-defined]
        fields = v.dt.fields  # type: ignore[attr-defined]
        dt = common_type([f.dataType for f in fields])
        all_ = F.array(*(cast_to(Val(v.col.getField(f.name), f.dataType), dt) for f in fields))
        return Val(F.filter(all_, lambda k: k.isNotNull()) if x.ent else all_, T.ArrayType(dt))
    raise CypherExecutionError(f"values takes no {family(x.dt)}")


# numbers
for _name, _f in {"sqrt": F.sqrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "degrees": F.degrees, "radians": F.radians}.items():
    function(_name, 1)(lambda x, f=_f: Val(f(number(x)), DOUBLE))
function("log", 1)(lambda x: Val(F.when(number(x) > 0, F.ln(number(x))), DOUBLE))
function("log10", 1)(lambda x: Val(F.when(number(x) > 0, F.log10(number(x))), DOUBLE))
function("atan2", 2)(lambda a, b: Val(F.atan2(number(a), number(b)), DOUBLE))
function("pow", 2)(lambda a, b: Val(F.pow(number(a), number(b)), DOUBLE))
function("ceil", 1)(lambda x: Val(F.ceil(number(x)).cast("double"), DOUBLE))
function("floor", 1)(lambda x: Val(F.floor(number(x)).cast("double"), DOUBLE))
function("sign", 1)(lambda x: Val(F.signum(number(x)).cast("bigint"), LONG))
function("rand", 0)(lambda: Val(F.rand(), DOUBLE))
function("pi", 0)(lambda: Val(F.pi(), DOUBLE))
function("e", 0)(lambda: Val(F.e(), DOUBLE))
function("abs", 1)(lambda x: Val(F.abs(number(x)), x.dt if numeric(x) else DOUBLE))
function("round", 1, 2)(lambda x, n=None: Val(F.round(number(x).cast("double"), n.const if n else 0), DOUBLE))


# points
POINT = ("x", "y", "z", "longitude", "latitude", "height")


@function("point", 1)
def point(m: Val) -> Val:
    if not is_a(m, T.StructType):
        raise CypherExecutionError("point takes a map")
    have = {f.name for f in m.dt.fields}  # type: ignore[attr-defined]
    round_ = {"longitude", "latitude"} <= have
    if not round_ and not {"x", "y"} <= have:
        raise CypherExecutionError("point needs x and y, or longitude and latitude")
    use = POINT[3:] if round_ else POINT[:3]
    srid = 4326 if round_ else 7203
    cols = [(F.coalesce(number(field_of(m, k)).cast("double"), F.lit(None).cast("double")) if k in use and k in have else F.lit(None).cast("double")).alias(k) for k in POINT]
    dt = T.StructType([T.StructField(k, DOUBLE) for k in POINT] + [T.StructField("srid", T.IntegerType())])
    return Val(F.struct(*cols, F.lit(srid).alias("srid")), dt, "point")


@function("distance point.distance", 2)
def distance(p: Val, q: Val) -> Val:
    if p.ent != "point" or q.ent != "point":
        raise CypherExecutionError("distance takes two points")
    f = lambda v, k: v.col.getField(k)
    flat = F.sqrt(sum((F.pow(F.coalesce(f(p, k), F.lit(0.0)) - F.coalesce(f(q, k), F.lit(0.0)), F.lit(2.0)) for k in "xyz"), F.lit(0.0)))
    a, b = F.radians(f(p, "latitude")), F.radians(f(q, "latitude"))
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(f(q, "longitude") - f(p, "longitude")) / 2), F.lit(2.0))
    ball = 2 * 6371000.0 * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    both = f(p, "srid") == f(q, "srid")
    return Val(F.when(both & (f(p, "srid") == 4326), ball).when(both, flat), DOUBLE)


# times
@function("date", 0, 1)
def date(x: Val | None = None) -> Val:
    if x is None:
        return Val(F.current_date(), DATE)
    return Val(F.to_date(F.to_timestamp_ntz(F.substr(text(x), F.lit(1), F.lit(10)))) if is_a(x, T.StringType) else x.col.cast("date"), DATE)


def _moment(x: Val | None, naive: bool) -> Val:
    if x is None:
        return Val(F.localtimestamp(), NAIVE) if naive else Val(F.current_timestamp(), ZONED)
    if not is_a(x, T.StringType):
        return Val(x.col.cast("timestamp_ntz" if naive else "timestamp"), NAIVE if naive else ZONED) if naive or not is_a(x, T.TimestampNTZType) else x
    zoned = isinstance(x.const, str) and bool(x.const.endswith("Z") or "+" in x.const[10:] or "-" in x.const[10:])
    if naive:
        return Val(F.regexp_replace(x.col, r"(Z|[+-]\d\d:?\d\d)$", "").cast("timestamp_ntz"), NAIVE)
    return Val(x.col.cast("timestamp"), ZONED) if zoned or x.const is None else Val(x.col.cast("timestamp_ntz"), NAIVE)


function("datetime", 0, 1)(lambda x=None: _moment(x, False))
function("localdatetime", 0, 1)(lambda x=None: _moment(x, True))
function("time localtime", 0, 1)(lambda x=None: Val(F.date_format(F.localtimestamp(), "HH:mm:ss.SSSSSS") if x is None else F.regexp_replace(text(x), r"(Z|[+-]\d\d:?\d\d)$", ""), STRING, "time"))
SPAN = r"^P(?:(\d+(?:\.\d+)?)W)?(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


@function("duration", 1)
def duration(x: Val) -> Val:
    if is_a(x, T.DayTimeIntervalType):
        return x
    if is_a(x, T.StructType):
        units = {"weeks": 604800, "days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}
        total = sum((number(field_of(x, f.name)).cast("double") * units[f.name] for f in x.dt.fields if f.name in units), F.lit(0.0))  # type: ignore[attr-defined]
        return Val(F.make_dt_interval(secs=total.cast("decimal(18,6)")), DURATION)
    s = text(x)
    total = sum((F.coalesce(F.nullif(F.regexp_extract(s, SPAN, k + 1), F.lit("")).cast("double"), F.lit(0.0)) * w for k, w in enumerate((604800, 86400, 3600, 60, 1))), F.lit(0.0))
    good = F.regexp_like(s, F.lit(SPAN)) & ~s.isin("P", "PT")
    if isinstance(x.const, str):
        import re

        if not re.match(SPAN, x.const) or x.const in ("P", "PT"):
            raise CypherExecutionError(f"invalid duration {x.const!r}")
    return Val(F.when(good, F.make_dt_interval(secs=total.cast("decimal(18,6)"))), DURATION)


@function("date.truncate", 2)
def date_truncate(unit: Val, x: Val) -> Val:
    if unit.const not in ("year", "quarter", "month", "week", "day"):
        raise CypherExecutionError(f"date.truncate takes no unit {unit.const!r}")
    d = date(x).col
    return Val(d if unit.const == "day" else F.trunc(d, unit.const), DATE)


@function("datetime.truncate localdatetime.truncate", 2)
def datetime_truncate(unit: Val, x: Val) -> Val:
    if unit.const not in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"):
        raise CypherExecutionError(f"datetime.truncate takes no unit {unit.const!r}")
    v = x if family(x.dt) in ("zoned", "naive") else _moment(x, False)
    return Val(F.date_trunc(unit.const, v.col).cast(v.dt), v.dt)


@function("time.truncate", 2)
def time_truncate(unit: Val, x: Val) -> Val:
    tails = {"hour": (2, ":00:00"), "minute": (5, ":00"), "second": (8, "")}
    if unit.const not in tails:
        raise CypherExecutionError(f"time.truncate takes no unit {unit.const!r}")
    n, end = tails[unit.const]
    return Val(F.concat(F.substr(text(x), F.lit(1), F.lit(n)), F.lit(end)), STRING, "time")


def time_seconds(x: Column) -> Column:
    part = F.split(x, ":")
    return F.try_element_at(part, F.lit(1)).cast("double") * 3600 + F.try_element_at(part, F.lit(2)).cast("double") * 60 + F.coalesce(F.try_element_at(part, F.lit(3)).cast("double"), F.lit(0.0))


@function("duration.between", 2)
def duration_between(a: Val, b: Val) -> Val:
    fa, fb = family(a.dt), family(b.dt)
    if a.ent == b.ent == "time":
        return Val(F.make_dt_interval(secs=(time_seconds(b.col) - time_seconds(a.col)).cast("decimal(18,6)")), DURATION)
    if {fa, fb} == {"zoned", "naive"} or "null" in (fa, fb):
        return Val(F.lit(None).cast(DURATION), DURATION)
    if fa != fb or fa not in ("date", "zoned", "naive"):
        raise CypherExecutionError("duration.between takes two dates, two datetimes or two times")
    return Val((b.col.cast("timestamp_ntz") - a.col.cast("timestamp_ntz")).cast(DURATION), DURATION)


# apoc
@function("apoc.text.join", 2)
def text_join(xs: Val, d: Val) -> Val:
    col, inner = items(xs)
    strings = F.transform(col, lambda x: to_string(Val(x, inner)).col) if not isinstance(inner, T.StringType) else col
    return Val(F.when(col.isNotNull() & ~F.exists(strings, lambda x: x.isNull()), F.array_join(strings, d.const)), STRING)


function("apoc.text.split", 2)(lambda x, p: Val(F.split(text(x), text(p), -1), T.ArrayType(STRING)))


@function("apoc.text.replace", 3)
def text_replace(x: Val, pattern: Val, by: Val) -> Val:
    if isinstance(by.const, str):
        import re

        return Val(F.regexp_replace(text(x), text(pattern), F.lit(re.sub(r"\\(\d)", r"$\1", by.const))), STRING)
    return Val(F.regexp_replace(text(x), text(pattern), text(by)), STRING)


def _entries(m: Val) -> list[tuple[str, Val]]:
    if is_a(m, T.NullType):
        return []
    if is_a(m, T.MapType) and isinstance(m.const, dict) and not m.const:
        return []
    if not is_a(m, T.StructType):
        raise CypherExecutionError(f"expected a map, not a {family(m.dt)}")
    if m.ent in ("node", "rel"):
        return _entries(Val(m.col.getField("properties"), next(f.dataType for f in m.dt.fields if f.name == "properties")))  # type: ignore[attr-defined]
    return [(f.name, Val(m.col.getField(f.name), f.dataType)) for f in m.dt.fields]  # type: ignore[attr-defined]


function("apoc.map.merge", 2)(lambda a, b: make_map(list((dict(_entries(a)) | dict(_entries(b))).items())))
function("apoc.convert.toMap properties", 1)(lambda x: null() if is_a(x, T.NullType) else make_map(_entries(x)))
function("apoc.map.removeKey", 2)(lambda m, k: make_map([(n, v) for n, v in _entries(m) if n != k.const]))


@function("apoc.map.get", 2, 3)
def map_get(m: Val, k: Val, default: Val | None = None) -> Val:
    if is_a(m, T.MapType):
        return field_of(m, k.const) if default is None else Val(F.when(F.map_contains_key(m.col, k.col), F.try_element_at(m.col, k.col)).otherwise(cast_to(default, m.dt.valueType)), m.dt.valueType)  # type: ignore[attr-defined]
    have = dict(_entries(m))
    return have[k.const] if k.const in have else default or null()


@function("apoc.map.clean", 3)
def map_clean(m: Val, names: Val, bad: Val) -> Val:
    """Entries whose key is not named and whose value is neither null nor among the bad ones."""
    pairs = [(n, v) for n, v in _entries(m) if n not in (names.const or [])]
    if not pairs:
        return make_map([])
    entries = F.array(*(F.when(v.col.isNotNull() & ~F.coalesce(contained(v, bad), F.lit(False)), F.struct(F.lit(n).alias("key"), to_variant(v).alias("value"))) for n, v in pairs))
    return Val(F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())), T.MapType(STRING, VARIANT))


@function("apoc.map.fromPairs", 1)
def map_from_pairs(xs: Val) -> Val:
    col, inner = items(xs)
    if isinstance(inner, T.NullType):
        return make_map([])
    if not isinstance(inner, T.ArrayType):
        raise CypherExecutionError("apoc.map.fromPairs takes a list of pairs")
    dt = inner.elementType
    key = (lambda x: variant_as(x, "string")) if isinstance(dt, T.VariantType) else (lambda x: x.cast("string"))
    return Val(F.map_from_entries(F.transform(col, lambda p: F.struct(key(F.get(p, F.lit(0))).alias("key"), F.get(p, F.lit(1)).alias("value")))), T.MapType(STRING, dt))


function("apoc.coll.contains", 2)(lambda xs, x: Val(contained(x, xs), BOOLEAN))
function("apoc.coll.toSet", 1)(lambda xs: Val(F.array_distinct(items(xs)[0]), xs.dt, xs.ent))


@function("apoc.util.compress", 1, 2)
def compress(x: Val, options: Val | None = None) -> Val:
    kind = str((options.const or {}).get("compression", "GZIP") if options else "GZIP").upper()
    if kind not in ("DEFLATE", "GZIP", "BZ2", "XZ", "NONE"):
        raise CypherExecutionError(f"unknown compression {kind}")

    @F.pandas_udf(T.BinaryType())  # type: ignore[call-overload]
    def run(s: pd.Series) -> pd.Series:
        import bz2
        import gzip
        import lzma
        import zlib

        f = {"DEFLATE": zlib.compress, "GZIP": lambda b: gzip.compress(b, mtime=0), "BZ2": bz2.compress, "XZ": lzma.compress, "NONE": bytes}[kind]
        return s.map(lambda t: None if t is None else f(t.encode()))

    return Val(run(text(x)), T.BinaryType())
