"""Typed column values, entities and scopes of the query compiler, and the comparison rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.exceptions import CypherExecutionError

LONG, DOUBLE, STRING, BOOLEAN, NULL, VARIANT = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType(), T.VariantType()
DATE, ZONED, NAIVE, DURATION = T.DateType(), T.TimestampType(), T.TimestampNTZType(), T.DayTimeIntervalType(0, 3)
INTEGERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
NUMERIC = (*INTEGERS, T.DoubleType, T.FloatType, T.DecimalType)


@dataclass
class Val:
    col: Column
    dt: T.DataType
    ent: str | None = None  # node, rel, path, point or time where the type alone doesn't say so
    const: Any = None  # a literal's value


@dataclass
class Ent:
    """A bound node or relationship: its columns share a prefix."""

    kind: str
    prefix: str
    props: dict[str, T.DataType]
    labels: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return self.prefix + "id"

    def system(self) -> list[str]:
        return [self.prefix + x for x in (("id", "labels", "uri") if self.kind == "node" else ("id", "src", "dst", "type", "uri"))]

    def columns(self) -> list[str]:
        return self.system() + [self.column(k) for k in self.props]

    def column(self, key: str) -> str:
        return f"{self.prefix}p_{key}"

    def prop(self, key: str) -> Val:
        if key in self.props:
            return Val(ref(self.column(key)), self.props[key])
        return null()

    def struct(self) -> Val:
        """The entity as one value: null where it isn't bound."""
        p, system = self.prefix, {"node": ("id", "labels", "uri"), "rel": ("id", "src", "dst", "type", "uri")}[self.kind]
        props = F.struct(*(ref(self.column(k)).alias(k) for k in self.props)) if self.props else F.struct(F.lit(None).cast("string").alias("_"))
        types = {"id": LONG, "labels": T.ArrayType(STRING), "uri": STRING, "src": LONG, "dst": LONG, "type": STRING}
        fields = [T.StructField(x, types[x]) for x in system] + [T.StructField("properties", T.StructType([T.StructField(k, t) for k, t in self.props.items()] or [T.StructField("_", STRING)]))]
        value = F.struct(*(ref(p + x).alias(x) for x in system), props.alias("properties"))
        return Val(F.when(ref(p + "id").isNotNull(), value), T.StructType(fields), self.kind)


@dataclass
class PathVal:
    """A bound path: columns with arrays of the nodes and relationships (structs) in order."""

    nodes: str
    rels: str
    node_type: T.DataType
    rel_type: T.DataType


@dataclass
class Scope:
    vars: dict[str, Any] = field(default_factory=dict)  # name to Ent, PathVal or (column name, Val without a column)

    def copy(self) -> Scope:
        return Scope(dict(self.vars))


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def null() -> Val:
    return Val(F.lit(None), NULL)


def is_a(v: Val, *types: type) -> bool:
    return isinstance(v.dt, types)


def numeric(v: Val) -> bool:
    return is_a(v, *NUMERIC)


def family(dt: T.DataType) -> str:
    for name, types in (
        ("null", (T.NullType,)),
        ("number", NUMERIC),
        ("string", (T.StringType,)),
        ("boolean", (T.BooleanType,)),
        ("date", (T.DateType,)),
        ("zoned", (T.TimestampType,)),
        ("naive", (T.TimestampNTZType,)),
        ("duration", (T.DayTimeIntervalType,)),
        ("list", (T.ArrayType,)),
        ("map", (T.StructType, T.MapType)),
        ("variant", (T.VariantType,)),
        ("binary", (T.BinaryType,)),
    ):
        if isinstance(dt, types):
            return name
    raise CypherExecutionError(f"unsupported type {dt}")


def variant_as(v: Column, kind: str) -> Column:
    """A dynamic value if it is of that kind, else null."""
    shape = F.schema_of_variant(v)
    kinds = {"number": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)", "string": "^STRING$", "boolean": "^BOOLEAN$", "list": "^ARRAY"}
    types = {"number": "double", "string": "string", "boolean": "boolean", "list": "array<variant>"}
    return F.when(shape.rlike(kinds[kind]), F.try_variant_get(v, "$", types[kind]))


def to_variant(v: Val) -> Column:
    if is_a(v, T.VariantType):
        return v.col
    if family(v.dt) in ("list", "map"):
        return F.to_variant_object(v.col)
    if family(v.dt) in ("duration",):
        return v.col.cast("string").cast("variant")
    return v.col.cast("variant")


def canonical(v: Val) -> Column:
    """A text that is equal for equal values of one type: a key for grouping and comparing maps and dynamic values."""
    if is_a(v, T.VariantType):
        return F.to_json(v.col)
    return F.to_json(F.to_variant_object(v.col)) if is_a(v, T.MapType, T.StructType) else v.col


def common_type(types: list[T.DataType]) -> T.DataType:
    """The type of values of several types put together: dynamic if nothing else holds them."""
    seen = [t for t in types if not isinstance(t, T.NullType)]
    if not seen:
        return NULL
    if all(t == seen[0] for t in seen):
        return seen[0]
    families = {family(t) for t in seen}
    if families == {"number"}:
        return LONG if all(isinstance(t, INTEGERS) for t in seen) else DOUBLE
    if families == {"list"}:
        return T.ArrayType(common_type([t.elementType for t in seen]))  # type: ignore[attr-defined]
    return VARIANT


def cast_to(v: Val, dt: T.DataType) -> Column:
    if v.dt == dt:
        return v.col
    if is_a(v, T.NullType):
        return v.col.cast(dt) if not isinstance(dt, T.NullType) else v.col
    if isinstance(dt, T.VariantType):
        return to_variant(v)
    if isinstance(dt, T.ArrayType) and is_a(v, T.ArrayType):
        inner = v.dt.elementType  # type: ignore[attr-defined]
        return v.col.cast(dt) if family(inner) != "variant" and not isinstance(dt.elementType, T.VariantType) else F.transform(v.col, lambda x: cast_to(Val(x, inner), dt.elementType))
    return v.col.cast(dt)


def equal(a: Val, b: Val) -> Column:
    """Three-valued equality: values of different kinds are unequal; a list is equal to its members (and to an equal list)."""
    fa, fb = family(a.dt), family(b.dt)
    if "null" in (fa, fb):
        return F.lit(None).cast("boolean")
    if fa == "variant" or fb == "variant":
        if fa == fb:
            return F.to_json(a.col) == F.to_json(b.col)
        dyn, other = (a, b) if fa == "variant" else (b, a)
        kind = family(other.dt)
        if kind in ("number", "string", "boolean"):
            same = variant_as(dyn.col, kind) == other.col
            return F.when(dyn.col.isNotNull() & other.col.isNotNull() & ~F.is_variant_null(dyn.col), F.coalesce(same, F.lit(False)))
        return F.to_json(dyn.col) == F.to_json(to_variant(other))
    if fa == fb:
        if fa == "list":
            inner = common_type([a.dt.elementType, b.dt.elementType])  # type: ignore[attr-defined]
            if isinstance(inner, T.VariantType):
                return F.to_json(to_variant(a)) == F.to_json(to_variant(b))
            return cast_to(a, T.ArrayType(inner)) == cast_to(b, T.ArrayType(inner))
        if fa == "map":
            if a.ent in ("node", "rel") and b.ent == a.ent:
                return a.col.getField("id") == b.col.getField("id")
            return canonical(a) == canonical(b)
        return a.col == b.col
    if fa == "list" or fb == "list":
        xs, x = (a, b) if fa == "list" else (b, a)
        return contained(x, xs)
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))


def contained(x: Val, xs: Val) -> Column:
    """x IN xs with three-valued logic."""
    inner = xs.dt.elementType if is_a(xs, T.ArrayType) else None  # type: ignore[attr-defined]
    if inner is None:
        return F.lit(None).cast("boolean")
    if isinstance(inner, T.NullType) or is_a(x, T.NullType):
        return F.when(F.size(xs.col) == 0, F.lit(False))
    if inner == x.dt and family(inner) not in ("map", "variant", "list") or {family(inner), family(x.dt)} == {"number"}:
        return F.array_contains(xs.col if inner == x.dt else xs.col.cast("array<double>"), x.col if inner == x.dt else x.col.cast("double"))
    return F.exists(xs.col, lambda y: equal(Val(y, inner), x))


def ordered(op: str, a: Val, b: Val) -> Column:
    """<, >, <=, >=: null for values of different kinds."""
    fa, fb = family(a.dt), family(b.dt)
    apply = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if fa == "variant" and fb == "variant":
        return F.coalesce(*(apply(variant_as(a.col, k), variant_as(b.col, k)) for k in ("number", "string")))
    if fa == "variant" and fb in ("number", "string", "boolean"):
        return apply(variant_as(a.col, fb), b.col)
    if fb == "variant" and fa in ("number", "string", "boolean"):
        return apply(a.col, variant_as(b.col, fa))
    if fa == fb and fa not in ("map", "null"):
        return apply(a.col, b.col)
    return F.lit(None).cast("boolean")


def literal(value: Any) -> Val:
    """A Python value as a typed column."""
    import datetime as dt

    if value is None:
        return null()
    if isinstance(value, bool):
        return Val(F.lit(value), BOOLEAN, const=value)
    if isinstance(value, int):
        return Val(F.lit(value).cast("bigint"), LONG, const=value)
    if isinstance(value, float):
        return Val(F.lit(value), DOUBLE, const=value)
    if isinstance(value, str):
        return Val(F.lit(value), STRING, const=value)
    if isinstance(value, dt.datetime):
        return Val(F.lit(value), ZONED) if value.tzinfo else Val(F.lit(value.isoformat(sep=" ")).cast(NAIVE), NAIVE)
    if isinstance(value, dt.date):
        return Val(F.lit(value), DATE)
    if isinstance(value, dt.timedelta):
        return Val(F.lit(value), DURATION)
    if isinstance(value, (bytes, bytearray)):
        return Val(F.lit(bytes(value)), T.BinaryType())
    if isinstance(value, (list, tuple)):
        return make_list([literal(x) for x in value], const=list(value))
    if isinstance(value, dict):
        return make_map([(str(k), literal(v)) for k, v in value.items()], const=value)
    raise CypherExecutionError(f"no value of the language: {type(value).__name__}")


def make_list(items: list[Val], const: Any = None) -> Val:
    inner = common_type([x.dt for x in items])
    ents = {x.ent for x in items if not is_a(x, T.NullType)}
    ent = ents.pop() if len(ents) == 1 else None
    if not items:
        return Val(F.array(), T.ArrayType(NULL), const=const)
    return Val(F.array(*(cast_to(x, inner) for x in items)), T.ArrayType(inner), ent, const)


def make_map(items: list[tuple[str, Val]], const: Any = None) -> Val:
    if not items:
        return Val(F.create_map().cast("map<string,string>"), T.MapType(STRING, STRING), const=const)
    return Val(F.struct(*(v.col.alias(k) for k, v in items)), T.StructType([T.StructField(k, v.dt) for k, v in items]), const=const)


def field_of(v: Val, key: str) -> Val:
    """A property or key of a value."""
    if is_a(v, T.StructType):
        names = {f.name: f.dataType for f in v.dt.fields}  # type: ignore[attr-defined]
        if v.ent in ("node", "rel"):
            inner = {f.name: f.dataType for f in names["properties"].fields}  # type: ignore[attr-defined]
            return Val(v.col.getField("properties").getField(key), inner[key]) if key in inner else null()
        return Val(v.col.getField(key), names[key]) if key in names else null()
    if is_a(v, T.MapType):
        return Val(F.try_element_at(v.col, F.lit(key)), v.dt.valueType)  # type: ignore[attr-defined]
    if is_a(v, T.VariantType):
        return Val(F.try_variant_get(v.col, f"$['{key}']", "variant"), VARIANT)
    if is_a(v, T.ArrayType):
        inner = v.dt.elementType  # type: ignore[attr-defined]
        if isinstance(inner, T.NullType):
            return v
        one = field_of(Val(v.col, inner, v.ent), key)
        return Val(F.transform(v.col, lambda x: field_of(Val(x, inner, v.ent), key).col), T.ArrayType(one.dt))
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "week": F.weekofyear, "hour": F.hour, "minute": F.minute, "second": F.second}
    if family(v.dt) in ("date", "zoned", "naive") and key in parts:
        return Val(parts[key](v.col).cast("bigint"), LONG)
    if is_a(v, T.DayTimeIntervalType) and key in ("days", "hours", "minutes", "seconds"):
        unit = {"days": "DAY", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND"}[key]
        return Val(F.extract(F.lit(unit), v.col).cast("bigint"), LONG)
    if is_a(v, T.NullType):
        return null()
    raise CypherExecutionError(f"a {family(v.dt)} has no property {key!r}")
