"""Property, label and sort filters of the programmatic interface, compiled to columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.cypher.values import Val, equal, family, field_of, literal, ordered, ref, variant_as
from trellis.exceptions import InvalidFilterError

PATH = re.compile(r"^[a-zA-Z0-9_.]+$")
TYPES = {"string": str, "str": str, "int": int, "integer": int, "float": float, "number": (int, float), "bool": bool, "boolean": bool}


@dataclass(frozen=True)
class PropertyFilter:
    op: str
    value: Any
    second: Any = None
    case_sensitive: bool = True

    @staticmethod
    def _checked(value: Any, expected: str | type | None) -> Any:
        want = TYPES.get(expected.lower()) if isinstance(expected, str) else expected
        if want is not None and not isinstance(value, want):
            raise InvalidFilterError(f"{value!r} is no {expected}")
        return value

    @classmethod
    def gt(cls, v: Any, expected_type: Any = None) -> PropertyFilter:
        return cls(">", cls._checked(v, expected_type))

    @classmethod
    def lt(cls, v: Any, expected_type: Any = None) -> PropertyFilter:
        return cls("<", cls._checked(v, expected_type))

    @classmethod
    def gte(cls, v: Any, expected_type: Any = None) -> PropertyFilter:
        return cls(">=", cls._checked(v, expected_type))

    @classmethod
    def lte(cls, v: Any, expected_type: Any = None) -> PropertyFilter:
        return cls("<=", cls._checked(v, expected_type))

    @classmethod
    def ne(cls, v: Any, expected_type: Any = None) -> PropertyFilter:
        return cls("<>", cls._checked(v, expected_type))

    @classmethod
    def between(cls, a: Any, b: Any, expected_type: Any = None) -> PropertyFilter:
        return cls("between", cls._checked(a, expected_type), cls._checked(b, expected_type))

    @classmethod
    def contains(cls, v: str, case_sensitive: bool = True) -> PropertyFilter:
        return cls("contains", cls._checked(v, str), None, case_sensitive)

    @classmethod
    def starts_with(cls, v: str, case_sensitive: bool = True) -> PropertyFilter:
        return cls("starts_with", cls._checked(v, str), None, case_sensitive)

    @classmethod
    def ends_with(cls, v: str, case_sensitive: bool = True) -> PropertyFilter:
        return cls("ends_with", cls._checked(v, str), None, case_sensitive)

    @classmethod
    def regex(cls, v: str) -> PropertyFilter:
        try:
            re.compile(v)
        except (re.error, TypeError) as e:
            raise InvalidFilterError(f"invalid pattern {v!r}: {e}") from None
        return cls("regex", v)

    def column(self, v: Val) -> Column:
        if self.op in (">", "<", ">=", "<="):
            return ordered(self.op, v, literal(self.value))
        if self.op == "<>":  # a missing value is different
            return ~F.coalesce(equal(v, literal(self.value)), F.lit(False))
        if self.op == "between":
            return ordered(">=", v, literal(self.value)) & ordered("<=", v, literal(self.second))
        fam = family(v.dt)
        text = v.col if fam == "string" else variant_as(v.col, "string") if fam == "variant" else F.lit(None).cast("string")
        if self.op == "regex":
            return F.regexp_like(text, F.lit(self.value))
        want = F.lit(self.value if self.case_sensitive else self.value.lower())
        text = text if self.case_sensitive else F.lower(text)
        return {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[self.op](text, want)


@dataclass(frozen=True)
class PropertyFilterGroup:
    """Filters joined by OR or AND; items are maps of filters, groups, or filters of one property."""

    op: str
    items: tuple[Any, ...]

    @classmethod
    def or_(cls, *items: Any) -> PropertyFilterGroup:
        return cls._made("or", items)

    @classmethod
    def and_(cls, *items: Any) -> PropertyFilterGroup:
        return cls._made("and", items)

    @classmethod
    def _made(cls, op: str, items: tuple[Any, ...]) -> PropertyFilterGroup:
        if not items:
            raise InvalidFilterError("a group needs filters")
        return cls(op, items)


@dataclass(frozen=True)
class LabelFilter:
    mode: str
    labels: tuple[str, ...]

    @classmethod
    def any(cls, *labels: str) -> LabelFilter:
        return cls._made("any", labels)

    @classmethod
    def all(cls, *labels: str) -> LabelFilter:
        return cls._made("all", labels)

    @classmethod
    def _made(cls, mode: str, labels: tuple[Any, ...]) -> LabelFilter:
        flat = tuple(x for y in labels for x in (y if isinstance(y, (list, tuple)) else [y]))
        if not flat or any(not isinstance(x, str) or not x for x in flat):
            raise InvalidFilterError("a label filter needs labels")
        return cls(mode, flat)


@dataclass(frozen=True)
class SortOrder:
    key: str
    ascending: bool = True

    @classmethod
    def asc(cls, key: str) -> SortOrder:
        return cls(key, True)

    @classmethod
    def desc(cls, key: str) -> SortOrder:
        return cls(key, False)


def path_value(key: str, props: dict[str, T.DataType]) -> Val:
    """A property or a dotted path into one; null where nothing has it."""
    if not isinstance(key, str) or not PATH.match(key):
        raise InvalidFilterError(f"invalid property {key!r}")
    if key in props:
        return Val(ref("p_" + key), props[key])
    head, *rest = key.split(".")
    v = Val(ref("p_" + head), props[head]) if head in props else literal(None)
    for k in rest:
        v = field_of(v, k) if family(v.dt) in ("map", "variant", "null") else literal(None)
    return v


def _one(key: str, want: Any, props: dict[str, T.DataType]) -> Column:
    v = path_value(key, props)
    if isinstance(want, PropertyFilter):
        return want.column(v)
    if isinstance(want, PropertyFilterGroup):
        parts = [_one(key, x, props) for x in want.items]
        return reduce(lambda a, b: a | b if want.op == "or" else a & b, parts)
    if want is None:
        return v.col.isNull()
    if isinstance(want, (list, dict)) and family(v.dt) not in ("list", "map", "variant"):
        return F.lit(False)
    if family(v.dt) == "list" and not isinstance(want, list):
        return F.lit(False)
    return equal(v, literal(want))


def condition(properties: dict | PropertyFilterGroup, props: dict[str, T.DataType]) -> Column:
    if isinstance(properties, PropertyFilterGroup):
        parts = [condition(x, props) for x in properties.items]
        return reduce(lambda a, b: a | b if properties.op == "or" else a & b, parts)
    if not isinstance(properties, dict):
        raise InvalidFilterError("filters are a map or a group")
    return reduce(lambda a, b: a & b, (_one(k, w, props) for k, w in properties.items()), F.lit(True))


OPTIONS = {"gt", "lt", "gte", "lte", "ne", "between", "contains", "starts_with", "ends_with", "regex"}


def from_options(spec: dict[str, Any]) -> dict | PropertyFilterGroup:
    """Filters from plain maps, as in {age: {gt: 3}, or: [{a: 1}, {b: 2}]}."""
    groups, plain = [], {}
    for k, v in spec.items():
        name = k.lstrip("$")
        if name in ("or", "and") and isinstance(v, list):
            groups.append(PropertyFilterGroup(name, tuple(from_options(x) for x in v)))
        elif isinstance(v, dict) and v and {x.lstrip("$") for x in v} - {"case_sensitive"} <= OPTIONS:
            case = {"case_sensitive": v["case_sensitive"]} if "case_sensitive" in v else {}
            made = []
            for o, x in v.items():
                o = o.lstrip("$")
                if o == "case_sensitive":
                    continue
                args = x if o == "between" else [x]
                made.append(getattr(PropertyFilter, o)(*args, **(case if o in ("contains", "starts_with", "ends_with") else {})))
            plain[k] = made[0] if len(made) == 1 else PropertyFilterGroup("and", tuple(made))
        else:
            plain[k] = v
    if not groups:
        return plain
    return PropertyFilterGroup("and", (*([plain] if plain else []), *groups))


def order_columns(order_by: Any, ascending: bool, props: dict[str, T.DataType]) -> list[Column]:
    """Nulls come last in either direction."""
    out = []
    for x in order_by if isinstance(order_by, list) else [order_by]:
        key, up = (x.key, x.ascending) if isinstance(x, SortOrder) else x if isinstance(x, tuple) else (x, ascending)
        col = ref(key) if key in ("id", "uri") else path_value(key, props).col
        out.append(col.asc_nulls_last() if up else col.desc_nulls_last())
    return out
