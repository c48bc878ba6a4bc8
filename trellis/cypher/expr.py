"""Expressions of the query language compiled to columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.cypher import ast as A
from trellis.cypher.parser import AGGREGATES
from trellis.cypher.values import (
    BOOLEAN,
    DOUBLE,
    DURATION,
    LONG,
    STRING,
    VARIANT,
    Ent,
    PathVal,
    Scope,
    Val,
    cast_to,
    common_type,
    contained,
    equal,
    family,
    field_of,
    is_a,
    literal,
    make_list,
    make_map,
    null,
    numeric,
    ordered,
    ref,
    variant_as,
)
from trellis.exceptions import CypherExecutionError
from trellis.functions import scalar


class Exprs:
    """Compiles expressions in a scope; `known` holds expressions that are columns already."""

    def __init__(self, scope: Scope, params: dict[str, Any] | None = None, known: dict[A.Expr, Val] | None = None) -> None:
        self.scope, self.params, self.known = scope, params or {}, known or {}
        self.local: dict[str, Val] = {}

    def ex(self, e: A.Expr) -> Val:
        if e in self.known:
            return self.known[e]
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def predicate(self, e: A.Expr) -> Column:
        return self.truth(self.ex(e))

    @staticmethod
    def truth(v: Val) -> Column:
        if is_a(v, T.BooleanType):
            return v.col
        if is_a(v, T.VariantType):
            return variant_as(v.col, "boolean")
        return F.lit(None).cast("boolean")

    def _lit(self, e: A.Lit) -> Val:
        return literal(e.value)

    def _param(self, e: A.Param) -> Val:
        if e.name not in self.params:
            raise CypherExecutionError(f"missing parameter ${e.name}")
        return literal(self.params[e.name])

    def _var(self, e: A.Var) -> Val:
        if e.name in self.local:
            return self.local[e.name]
        x = self.scope.vars.get(e.name)
        if x is None:
            raise CypherExecutionError(f"unknown variable {e.name}")
        if isinstance(x, Ent):
            return x.struct()
        if isinstance(x, PathVal):
            dt = T.StructType([T.StructField("nodes", x.node_type), T.StructField("relationships", x.rel_type)])
            return Val(F.struct(ref(x.nodes).alias("nodes"), ref(x.rels).alias("relationships")), dt, "path")
        return x

    def entity(self, e: A.Expr) -> Ent | None:
        if isinstance(e, A.Var) and e.name not in self.local:
            x = self.scope.vars.get(e.name)
            return x if isinstance(x, Ent) else None
        return None

    def _prop(self, e: A.Prop) -> Val:
        ent = self.entity(e.base)
        return ent.prop(e.key) if ent else field_of(self.ex(e.base), e.key)

    def _listlit(self, e: A.ListLit) -> Val:
        items = [self.ex(x) for x in e.items]
        return make_list(items, [x.const for x in items])

    def _maplit(self, e: A.MapLit) -> Val:
        items = [(k, self.ex(x)) for k, x in e.items]
        return make_map(items, {k: v.const for k, v in items})

    def _unary(self, e: A.Unary) -> Val:
        v = self.ex(e.x)
        if e.op == "NOT":
            return Val(~self.truth(v), BOOLEAN)
        if is_a(v, T.VariantType):
            return Val(-variant_as(v.col, "number"), DOUBLE)
        if not numeric(v) and not is_a(v, T.DayTimeIntervalType, T.NullType):
            raise CypherExecutionError(f"- takes no {family(v.dt)}")
        return Val(-v.col, v.dt)

    def _binary(self, e: A.Binary) -> Val:
        op = e.op
        a, b = self.ex(e.a), self.ex(e.b)
        if op in ("AND", "OR", "XOR"):
            x, y = self.truth(a), self.truth(b)
            return Val(x & y if op == "AND" else x | y if op == "OR" else x != y, BOOLEAN)
        if op in ("=", "<>"):
            ea, eb = self.entity(e.a), self.entity(e.b)
            same = ref(ea.id) == ref(eb.id) if ea and eb else equal(a, b)
            return Val(same if op == "=" else ~same, BOOLEAN)
        if op in ("<", ">", "<=", ">="):
            return Val(ordered(op, a, b), BOOLEAN)
        if op == "IN":
            if is_a(b, T.StringType) and is_a(a, T.StringType):
                return Val(F.contains(b.col, a.col), BOOLEAN)
            if is_a(b, T.StructType):
                return Val(a.col.isin(*[f.name for f in b.dt.fields]), BOOLEAN)  # type: ignore[attr-defined]
            if is_a(b, T.MapType):
                return Val(F.map_contains_key(b.col, a.col), BOOLEAN)
            if is_a(b, T.VariantType):
                return Val(contained(a, Val(variant_as(b.col, "list"), T.ArrayType(VARIANT))), BOOLEAN)
            return Val(contained(a, b), BOOLEAN)
        if op in ("CONTAINS", "STARTS WITH", "ENDS WITH", "=~"):
            x, y = (variant_as(v.col, "string") if is_a(v, T.VariantType) else v.col.cast("string") if is_a(v, T.StringType, T.NullType) else F.lit(None).cast("string") for v in (a, b))
            if op == "=~":  # the whole text matches
                return Val(F.regexp_like(x, F.concat(F.lit("^(?:"), y, F.lit(")$"))), BOOLEAN)
            return Val({"CONTAINS": F.contains, "STARTS WITH": F.startswith, "ENDS WITH": F.endswith}[op](x, y), BOOLEAN)
        return self.arithmetic(op, a, b)

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        fa, fb = family(a.dt), family(b.dt)
        if "null" in (fa, fb):
            return null()
        if op == "+" and "list" in (fa, fb):
            if fa == fb:
                inner = common_type([a.dt.elementType, b.dt.elementType])  # type: ignore[attr-defined]
            else:
                xs, x = (a, b) if fa == "list" else (b, a)
                inner = common_type([xs.dt.elementType, x.dt])  # type: ignore[attr-defined]
            dt = T.ArrayType(inner)
            parts = [cast_to(v, dt) if family(v.dt) == "list" else F.array(cast_to(v, inner)) for v in (a, b)]
            return Val(F.concat(*parts), dt, a.ent or b.ent)
        if "variant" in (fa, fb):
            x, y = (variant_as(v.col, "number") if family(v.dt) == "variant" else v.col if numeric(v) else F.lit(None).cast("double") for v in (a, b))
            n = self.numbers(op, Val(x, DOUBLE), Val(y, DOUBLE))
            return n
        if fa == fb == "number":
            return self.numbers(op, a, b)
        if op == "+" and fa == fb == "string":
            return Val(F.concat(a.col, b.col), STRING)
        if op in ("+", "-"):
            if (a.ent == "time" or b.ent == "time") and "duration" in (fa, fb):
                t, d = (a, b) if a.ent == "time" else (b, a)
                seconds = scalar.time_seconds(t.col) + (1 if op == "+" else -1) * _seconds(d.col)
                day = F.pmod(seconds, F.lit(86400.0))
                midnight = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
                return Val(F.date_format(midnight + F.make_dt_interval(secs=day.cast("decimal(18,6)")), "HH:mm:ss"), STRING, "time")
            if fa == fb == "duration":
                return Val(a.col + b.col if op == "+" else a.col - b.col, DURATION)
            if fa in ("date", "zoned", "naive") and fb == "duration":
                moved = a.col + b.col if op == "+" else a.col - b.col
                return Val(moved.cast(a.dt), a.dt)
            if op == "+" and fa == "duration" and fb in ("date", "zoned", "naive"):
                return Val((b.col + a.col).cast(b.dt), b.dt)
            if op == "-" and fa == fb and fa in ("date", "zoned", "naive"):
                return scalar.call("duration.between", [b, a])
        raise CypherExecutionError(f"no {op} of {fa} and {fb}")

    @staticmethod
    def numbers(op: str, a: Val, b: Val) -> Val:
        whole = common_type([a.dt, b.dt])
        x, y = a.col.cast(whole), b.col.cast(whole)
        if op in "+-*":
            return Val({"+": x + y, "-": x - y, "*": x * y}[op], whole)
        if op == "^":
            return Val(F.pow(x, y), DOUBLE)
        if op == "/":
            q = F.when(y != 0, x / y)
            if isinstance(whole, T.LongType):
                return Val(F.when(y != 0, (x - x % y) / y).cast("bigint"), LONG)
            return Val(q, DOUBLE)
        return Val(F.when(y != 0, x % y), whole)

    def _isnull(self, e: A.IsNull) -> Val:
        ent = self.entity(e.x)
        v = Val(ref(ent.id), LONG) if ent else self.ex(e.x)
        empty = v.col.isNull() | F.is_variant_null(v.col) if is_a(v, T.VariantType) else v.col.isNull()
        return Val(~empty if e.negated else empty, BOOLEAN)

    def _case(self, e: A.Case) -> Val:
        operand = self.ex(e.operand) if e.operand is not None else None
        tests = [equal(operand, self.ex(c)) if operand is not None else self.predicate(c) for c, _ in e.whens]
        results = [self.ex(r) for _, r in e.whens]
        default = self.ex(e.default) if e.default is not None else null()
        dt = common_type([r.dt for r in [*results, default]])
        out = F.when(tests[0], cast_to(results[0], dt))
        for t, r in zip(tests[1:], results[1:], strict=True):
            out = out.when(t, cast_to(r, dt))
        return Val(out.otherwise(cast_to(default, dt)), dt, results[0].ent)

    def _index(self, e: A.Index) -> Val:
        v, i = self.ex(e.x), self.ex(e.i)
        if is_a(v, T.StructType, T.MapType):
            if isinstance(i.const, str):
                return field_of(v, i.const)
            if is_a(v, T.MapType):
                return Val(F.try_element_at(v.col, i.col), v.dt.valueType)  # type: ignore[attr-defined]
            entries = make_map([]) if not v.dt.fields else Val(F.from_json(F.to_json(v.col), "map<string,variant>"), T.MapType(STRING, VARIANT))  # type: ignore[attr-defined]
            return Val(F.try_element_at(entries.col, i.col), VARIANT)
        if is_a(v, T.NullType) or is_a(i, T.NullType):
            return null()
        if is_a(v, T.VariantType):
            if isinstance(i.const, str):
                return field_of(v, i.const)
            v = Val(variant_as(v.col, "list"), T.ArrayType(VARIANT))
        if not is_a(v, T.ArrayType) or not is_a(i, T.LongType, T.IntegerType):
            raise CypherExecutionError("an index is an integer into a list or a key of a map")
        at = i.col.cast("int")
        return Val(F.try_element_at(v.col, F.when(at >= 0, at + 1).otherwise(at)), v.dt.elementType, v.ent)  # type: ignore[attr-defined]

    def _slice(self, e: A.Slice) -> Val:
        v = self.ex(e.x)
        if is_a(v, T.NullType):
            return null()
        if not is_a(v, T.ArrayType):
            raise CypherExecutionError("a slice takes a list")
        n = F.size(v.col)

        def edge(x: A.Expr | None, default: Column) -> Column:
            if x is None:
                return default
            c = self.ex(x).col.cast("int")
            return F.least(F.greatest(F.when(c < 0, c + n).otherwise(c), F.lit(0)), n)

        a, b = edge(e.a, F.lit(0)), edge(e.b, n)
        return Val(F.slice(v.col, a + 1, F.greatest(b - a, F.lit(0))), v.dt, v.ent)

    # expressions with a variable of their own
    def inside(self, name: str, v: Val, f: Callable[[], Any]) -> Any:
        before = self.local.get(name)
        self.local[name] = v
        try:
            return f()
        finally:
            if before is None:
                del self.local[name]
            else:
                self.local[name] = before

    def source(self, e: A.Expr) -> tuple[Val, T.DataType]:
        v = self.ex(e)
        if is_a(v, T.NullType):
            return Val(F.array().cast("array<string>"), T.ArrayType(STRING)), STRING
        if is_a(v, T.VariantType):
            v = Val(variant_as(v.col, "list"), T.ArrayType(VARIANT))
        if not is_a(v, T.ArrayType):
            raise CypherExecutionError("expected a list")
        return v, v.dt.elementType  # type: ignore[attr-defined]

    def _listcomp(self, e: A.ListComp) -> Val:
        v, inner = self.source(e.source)
        col, dt, ent = v.col, inner, v.ent
        if e.where is not None:
            where = e.where
            col = F.filter(col, lambda x: self.inside(e.var, Val(x, inner, v.ent), lambda: self.predicate(where)))
        if e.project is not None:
            project = e.project
            one = self.inside(e.var, Val(F.lit(None), inner, v.ent), lambda: self.ex(project))
            dt, ent = one.dt, one.ent
            col = F.transform(col, lambda x: self.inside(e.var, Val(x, inner, v.ent), lambda: self.ex(project)).col)
        return Val(F.coalesce(col, F.array().cast(T.ArrayType(dt))) if not isinstance(dt, (T.NullType, T.StructType)) else col, T.ArrayType(dt), ent)

    def _quantifier(self, e: A.Quantifier) -> Val:
        v, inner = self.source(e.source)

        def test(x: Column) -> Column:
            one = Val(x, inner, v.ent)
            if e.where is None:
                return self.truth(one) if is_a(one, T.BooleanType, T.VariantType) else x.isNotNull()
            where = e.where
            return self.inside(e.var, one, lambda: self.predicate(where))

        col = F.coalesce(v.col, F.array().cast(v.dt)) if not isinstance(inner, (T.NullType, T.StructType)) else v.col
        if e.kind == "any":
            return Val(F.exists(col, test), BOOLEAN)
        if e.kind == "all":
            return Val(F.forall(col, test), BOOLEAN)
        if e.kind == "none":
            return Val(~F.exists(col, test), BOOLEAN)
        hits = F.size(F.filter(col, test))
        unknown = F.size(F.filter(col, lambda x: test(x).isNull()))
        return Val(F.when(hits > 1, F.lit(False)).when(unknown == 0, hits == 1), BOOLEAN)

    def _reduce(self, e: A.Reduce) -> Val:
        init = self.ex(e.init)
        v, inner = self.source(e.source)
        step = lambda acc, x: self.inside(e.acc, acc, lambda: self.inside(e.var, x, lambda: self.ex(e.step)))
        dt = common_type([init.dt, step(Val(F.lit(None), init.dt), Val(F.lit(None), inner, v.ent)).dt])
        return Val(F.aggregate(v.col, cast_to(init, dt), lambda a, x: cast_to(step(Val(a, dt), Val(x, inner, v.ent)), dt)), dt)

    def _haslabel(self, e: A.HasLabel) -> Val:
        ent = self.entity(e.x)
        if ent is None:
            v = self.ex(e.x)
            labels = v.col.getField("labels")
        elif ent.kind == "rel":
            return Val(F.lower(ref(ent.prefix + "type")).isin(*[x.lower() for x in e.labels]), BOOLEAN)
        else:
            labels = ref(ent.prefix + "labels")
        low = F.transform(labels, F.lower)
        out = F.lit(True)
        for x in e.labels:
            out = out & F.array_contains(low, x.lower())
        return Val(out, BOOLEAN)

    def _call(self, e: A.Call) -> Val:
        name = e.name.lower()
        if name in AGGREGATES:
            raise CypherExecutionError(f"{e.name} is not allowed here")
        if name in ("id", "elementid", "type", "labels", "startnode", "endnode", "properties", "nodes", "relationships", "rels", "length", "exists"):
            found = self.graph_function(name, e)
            if found is not None:
                return found
        return scalar.call(e.name, [self.ex(x) for x in e.args])

    def graph_function(self, name: str, e: A.Call) -> Val | None:
        if len(e.args) != 1:
            raise CypherExecutionError(f"{e.name} takes one argument")
        ent = self.entity(e.args[0])
        if name in ("id", "elementid"):
            return Val(ref(ent.id), LONG) if ent else Val(self.ex(e.args[0]).col.getField("id"), LONG)
        if name == "labels":
            return Val(ref(ent.prefix + "labels") if ent else self.ex(e.args[0]).col.getField("labels"), T.ArrayType(STRING))
        if name == "type":
            return Val(ref(ent.prefix + "type") if ent else self.ex(e.args[0]).col.getField("type"), STRING)
        if name in ("startnode", "endnode"):  # as their ids
            side = "src" if name == "startnode" else "dst"
            return Val(ref(ent.prefix + side) if ent else self.ex(e.args[0]).col.getField(side), LONG)
        if name == "exists":
            return Val(self.ex(e.args[0]).col.isNotNull(), BOOLEAN)
        v = self.ex(e.args[0])
        if name in ("nodes", "relationships", "rels", "length") and v.ent == "path":
            fields = {f.name: f.dataType for f in v.dt.fields}  # type: ignore[attr-defined]
            if name == "length":
                return Val(F.size(v.col.getField("relationships")).cast("bigint"), LONG)
            kind = "nodes" if name == "nodes" else "relationships"
            return Val(v.col.getField(kind), fields[kind], "node" if kind == "nodes" else "rel")
        if name in ("nodes", "relationships", "rels"):
            raise CypherExecutionError(f"{e.name} takes a path")
        return scalar.call("size", [v]) if name == "length" else None

    def _exists(self, e: A.Exists) -> Val:
        raise CypherExecutionError("a pattern is not allowed here")

    def _patterncomp(self, e: A.PatternComp) -> Val:
        raise CypherExecutionError("a pattern comprehension is not allowed here")


def _seconds(d: Column) -> Column:
    return F.extract(F.lit("DAY"), d) * 86400 + F.extract(F.lit("HOUR"), d) * 3600 + F.extract(F.lit("MINUTE"), d) * 60 + F.extract(F.lit("SECOND"), d).cast("double")

