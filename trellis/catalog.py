"""Tables of a graph: node and relationship tables with typed property columns, and the registry of indexes and constraints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.cypher.values import VARIANT, cast_to, common_type, family, ref
from trellis.cypher.values import Val as Value

NODE = ("id", "labels", "uri")
REL = ("id", "src", "dst", "type", "uri")
ORDINAL = 1 << 40


class Table:
    """Rows with the system columns and a column p_<name> for each property.

    labels: of a node table whose rows all have them, or the one type of a relationship table; else empty.
    ends: labels of the tables a relationship table's ends lie in, where declared.
    single: whether a relationship table has one row for each of its start's or end's nodes, as that side is the node table's own key column.
        Only the order of joins goes by it.
    load: makes the rows and property types when they are first asked for, so a query opens only the tables it uses.
    """

    def __init__(
        self,
        kind: str,
        df: DataFrame | None = None,
        props: dict[str, T.DataType] | None = None,
        labels: tuple[str, ...] = (),
        ends: tuple[str | None, str | None] = (None, None),
        load: Callable[[], tuple[DataFrame, dict[str, T.DataType]]] | None = None,
        single: tuple[bool, bool] = (False, False),
    ) -> None:
        self.kind, self.labels, self.ends, self.single = kind, labels, ends, single
        self._load = load
        self._held = (df, props or {}) if df is not None else None

    def _content(self) -> tuple[DataFrame, dict[str, T.DataType]]:
        if self._held is None:
            assert self._load is not None
            self._held = self._load()
        return self._held

    @property
    def df(self) -> DataFrame:
        return self._content()[0]

    @property
    def props(self) -> dict[str, T.DataType]:
        return self._content()[1]

    def but(self, df: DataFrame, props: dict[str, T.DataType] | None = None, labels: tuple[str, ...] | None = None) -> Table:
        return Table(self.kind, df, self.props if props is None else props, self.labels if labels is None else labels, self.ends, single=self.single)

    def may_have(self, labels: tuple[str, ...]) -> bool:
        if not self.labels:
            return True
        own = {x.lower() for x in self.labels}
        return all(x.lower() in own for x in labels) if self.kind == "node" else not labels or bool(own & {x.lower() for x in labels})

    def scan(self, labels: tuple[str, ...]) -> DataFrame:
        """The rows with all labels, or of one of the types."""
        if self.labels or not labels:
            return self.df
        if self.kind == "rel":
            return self.df.where(F.lower("type").isin(*[x.lower() for x in labels]))
        low = F.transform("labels", F.lower)
        test = F.lit(True)
        for x in labels:
            test = test & F.array_contains(low, x.lower())
        return self.df.where(test)


def typed(t: T.DataType, c: Column) -> tuple[Column, T.DataType]:
    """Columns of the engine's own types: whole numbers are 64 bits wide, the others as they are."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("bigint"), T.LongType()
    if isinstance(t, (T.FloatType, T.DecimalType)):
        return c.cast("double"), T.DoubleType()
    return c, t


Source = DataFrame | Callable[[], DataFrame]


def node_table(label: str, source: Source, key: str, ordinal: int, props: list[str] | None = None) -> Table:
    """A label over a table: global ids are the label's ordinal and the key; properties keep their columns."""

    def load() -> tuple[DataFrame, dict[str, T.DataType]]:
        df = source() if callable(source) else source
        types = {f.name: f.dataType for f in df.schema.fields}
        cols = {n: typed(types[n], ref(n)) for n in props or df.columns}
        out = df.select(
            (F.lit(ordinal * ORDINAL) + ref(key).cast("bigint")).alias("id"), F.array(F.lit(label)).alias("labels"), F.lit(None).cast("string").alias("uri"), *(c.alias("p_" + n) for n, (c, _) in cols.items())
        )
        return out, {n: t for n, (_, t) in cols.items()}

    return Table("node", labels=(label,), load=load)


def rel_table(kind: str, source: Source, start: tuple[str, int, str], end: tuple[str, int, str], props: list[str] | None, single: tuple[bool, bool] = (False, False)) -> Table:
    """A relationship type over a table; start and end give label, ordinal and key column. Ids are a hash of the row."""

    def load() -> tuple[DataFrame, dict[str, T.DataType]]:
        df = source() if callable(source) else source
        types = {f.name: f.dataType for f in df.schema.fields}
        cols = {n: typed(types[n], ref(n)) for n in (props if props is not None else [c for c in types if c not in (start[2], end[2])])}
        src, dst = (F.lit(o * ORDINAL) + ref(k).cast("bigint") for _, o, k in (start, end))
        out = df.select(
            F.xxhash64(F.lit(kind), *(ref(c) for c in types)).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("uri"),
            *(c.alias("p_" + n) for n, (c, _) in cols.items()),
        )
        return out, {n: t for n, (_, t) in cols.items()}

    return Table("rel", labels=(kind,), ends=(start[0], end[0]), load=load, single=single)


def merged_props(tables: list[Table]) -> dict[str, T.DataType]:
    names: dict[str, list[T.DataType]] = {}
    for t in tables:
        for n, dt in t.props.items():
            names.setdefault(n, []).append(dt)
    return {n: common_type(dts) for n, dts in names.items()}


def conform(t: Table, df: DataFrame, props: dict[str, T.DataType], prefix: str = "") -> DataFrame:
    """System columns and the given properties, named with a prefix."""
    system = NODE if t.kind == "node" else REL
    own = [
        (cast_to(Value(ref("p_" + n), t.props[n]), dt) if n in t.props else F.lit(None).cast(dt if family(dt) != "null" else "string")).alias(f"{prefix}p_{n}") for n, dt in props.items()
    ]
    return df.select(*(ref(c).alias(prefix + c) for c in system), *own)


def scan(tables: list[Table], labels: tuple[str, ...], prefix: str) -> tuple[DataFrame | None, dict[str, T.DataType]]:
    """All rows of the tables with the labels (or one of the types), under prefixed names, and the property types."""
    use = [t for t in tables if t.may_have(labels)]
    props = merged_props(use)
    out: DataFrame | None = None
    for t in use:
        part = conform(t, t.scan(labels), props, prefix)
        out = part if out is None else out.unionByName(part)
    return out, props


def records_table(kind: str, rows: list[dict], spark) -> Table:  # noqa: ANN001
    """A table of Python records (system columns and `properties`), each property's type inferred; mixed ones are dynamic."""
    import json

    values: dict[str, list] = {}
    for r in rows:
        for k, v in r["properties"].items():
            values.setdefault(k, []).append(v)
    types = {k: common_type([python_type(v) for v in vs]) for k, vs in values.items()}
    system = [("id", "bigint"), ("labels", "array<string>"), ("uri", "string")] if kind == "node" else [("id", "bigint"), ("src", "bigint"), ("dst", "bigint"), ("type", "string"), ("uri", "string")]
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in system])
    for k, t in types.items():
        schema = schema.add("p_" + k, T.StringType() if dynamic(t) else t if family(t) != "null" else T.StringType())
    data = [
        tuple(r[n] for n, _ in system) + tuple((None if r["properties"].get(k) is None else json.dumps(r["properties"][k], default=str)) if dynamic(t) else plain(r["properties"].get(k), t) for k, t in types.items())
        for r in rows
    ]
    df = spark.createDataFrame(data, schema)
    for k, t in types.items():
        if dynamic(t):
            df = df.withColumn("p_" + k, F.parse_json(ref("p_" + k)))
    return Table(kind, df, {k: VARIANT if dynamic(t) else T.StringType() if family(t) == "null" else t for k, t in types.items()})


def dynamic(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return dynamic(t.elementType) or isinstance(t.elementType, T.NullType)
    return isinstance(t, (T.VariantType, T.StructType, T.MapType))


def plain(v: object, t: T.DataType) -> object:
    if v is not None and isinstance(t, T.DoubleType):
        return float(v)  # type: ignore[arg-type]
    if isinstance(v, (list, tuple)) and isinstance(t, T.ArrayType):
        return [plain(x, t.elementType) for x in v]
    return v


def python_type(v: object) -> T.DataType:
    import datetime as dt

    for kind, t in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType())):
        if isinstance(v, kind):
            return t
    if v is None:
        return T.NullType()
    if isinstance(v, dt.datetime):
        return T.TimestampType() if v.tzinfo else T.TimestampNTZType()
    if isinstance(v, dt.date):
        return T.DateType()
    if isinstance(v, (list, tuple)):
        return T.ArrayType(common_type([python_type(x) for x in v]))
    return VARIANT


@dataclass(frozen=True)
class Constraint:
    name: str
    entity: str
    label: str
    property: str
    kind: str  # unique, exists, type
    type: str | None = None


@dataclass(frozen=True)
class Index:
    name: str
    entity: str
    label: str | None
    property: str
    unique: bool = False


@dataclass(frozen=True)
class State:
    """An immutable snapshot of a graph."""

    nodes: tuple[Table, ...] = ()
    rels: tuple[Table, ...] = ()
    indexes: tuple[Index, ...] = ()
    constraints: tuple[Constraint, ...] = ()
    next_node: int = 1
    next_rel: int = 1
    texts: dict[str, list[dict]] = field(default_factory=dict)
    vectors: dict[str, dict] = field(default_factory=dict)

    def but(self, **changes: object) -> State:
        return replace(self, **changes)  # type: ignore[arg-type]
