"""Queries compiled to DataFrame plans: one frame of bindings per clause, lazily; patterns are joins."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis import catalog
from trellis.cypher import ast as A
from trellis.cypher.expr import Exprs
from trellis.cypher.parser import AGGREGATES
from trellis.cypher.values import DOUBLE, LONG, STRING, VARIANT, Ent, PathVal, Scope, Val, canonical, cast_to, common_type, equal, family, is_a, ref, variant_as
from trellis.exceptions import CypherExecutionError
from trellis.tables import cut

DEEP = 3  # levels of a variable-length pattern beyond which each level is materialised


@dataclass
class Frame:
    df: DataFrame
    scope: Scope
    unit: bool = False
    keys: tuple[str, ...] = ()  # columns of the outer query that a correlated part carries and groups by
    order: tuple[tuple[str, bool], ...] = ()  # columns the rows were last sorted by, and whether upwards


def walk(e: Any) -> Any:
    if isinstance(e, A.Expr):
        yield e
        for c in e.children():
            yield from walk(c)
    elif isinstance(e, (list, tuple)):
        for x in e:
            yield from walk(x)


def names_in(*xs: Any) -> set[str]:
    out: set[str] = set()
    for x in xs:
        for e in walk(x):
            if isinstance(e, A.Var):
                out.add(e.name)
            elif isinstance(e, (A.NodePat, A.RelPat, A.PathPat)) and e.var:
                out.add(e.var)
    return out


def conjuncts(e: A.Expr) -> list[A.Expr]:
    return conjuncts(e.a) + conjuncts(e.b) if isinstance(e, A.Binary) and e.op == "AND" else [e]


def aggregates_in(e: Any) -> list[A.Call]:
    return [x for x in walk(e) if isinstance(x, A.Call) and x.name.lower() in AGGREGATES]


class Compiler:
    def __init__(self, graph: Any, params: dict[str, Any] | None = None) -> None:
        self.graph, self.params = graph, params or {}
        self.spark = graph.spark
        self.fresh = itertools.count()

    @property
    def state(self) -> catalog.State:
        return self.graph.state

    def name(self, hint: str = "v") -> str:
        return f"{hint}{next(self.fresh)}_"

    def unit(self) -> Frame:
        return Frame(self.spark.range(1).select(F.lit(1).alias(self.name("unit"))), Scope(), True)

    def exprs(self, f: Frame, known: dict[A.Expr, Val] | None = None) -> Exprs:
        return Exprs(f.scope, self.params, known)

    # queries
    def query(self, q: A.Query, start: Frame | None = None) -> Frame:
        out: Frame | None = None
        for k, part in enumerate(q.parts):
            f = self.clauses(part, start or self.unit())
            if out is None:
                out = f
                continue
            mine, theirs = self.output(out), self.output(f)
            both = mine.unionByName(theirs, allowMissingColumns=True)
            keys = out.keys or f.keys
            scope = Scope({n: Val(ref(n), both.schema[n].dataType) for n in both.columns if n not in keys})
            out = Frame(both if q.union_all[k - 1] else self.distinct(both, scope), scope, keys=keys)
        assert out is not None
        return out

    def output(self, f: Frame) -> DataFrame:
        """The columns a query returns, under their names, with the outer keys of a correlated part."""
        cols = []
        for n, x in f.scope.vars.items():
            v = Exprs(f.scope, self.params).ex(A.Var(n))
            cols.append(v.col.alias(n))
        return f.df.select(*(ref(k) for k in f.keys if k not in f.scope.vars), *cols)

    def distinct(self, df: DataFrame, scope: Scope) -> DataFrame:
        """Distinct rows; maps and dynamic values by their canonical text."""
        odd = [c.name for c in df.schema.fields if self.odd(c.dataType)]
        if not odd:
            return df.distinct()
        keys = {c: self.name("key") for c in odd}
        for c, k in keys.items():
            df = df.withColumn(k, canonical(Val(ref(c), df.schema[c].dataType)))
        return df.dropDuplicates([c for c in df.columns if c not in odd]).drop(*keys.values())

    @classmethod
    def odd(cls, dt: T.DataType) -> bool:
        if isinstance(dt, T.StructType):
            return any(cls.odd(x.dataType) for x in dt.fields)
        return isinstance(dt, (T.MapType, T.VariantType)) or (isinstance(dt, T.ArrayType) and cls.odd(dt.elementType))

    def clauses(self, clauses: list[A.Clause], f: Frame) -> Frame:
        for c in clauses:
            f = getattr(self, "do_" + type(c).__name__.lower())(c, f)
        return f

    # reading
    def do_match(self, c: A.Match, f: Frame) -> Frame:
        if not c.optional:
            return self.match(f, c.patterns, c.where)
        return self.optional(f, c)

    def match(self, f: Frame, patterns: list[A.PathPat] | tuple[A.PathPat, ...], where: A.Expr | None) -> Frame:
        left = list(patterns)
        while left:
            known = set(f.scope.vars)
            p = next((p for p in left if names_in(p) & known), left[0])  # connected ones first: no needless products
            left.remove(p)
            f = self.shortest(f, p) if p.function else self.path(f, p)
        return self.filter(f, where) if where is not None else f

    def filter(self, f: Frame, where: A.Expr) -> Frame:
        for e in conjuncts(where):
            negated = isinstance(e, A.Unary) and e.op == "NOT" and isinstance(e.x, A.Exists)
            inner = e.x if negated else e  # type: ignore[attr-defined]
            if isinstance(inner, A.Exists):
                f = self.semi(f, inner, negated)
                continue
            f2, known = self.lift(f, e)
            f = replace(f, df=f2.df.where(self.exprs(f2, known).predicate(e)))
            if f2.df is not f.df and known:
                f = replace(f, df=f.df.drop(*(c for c in f2.df.columns if c.startswith("lift"))))
        return f

    # correlated parts: computed once per distinct set of the outer values they use, then joined back
    def correlated(self, f: Frame, used: set[str]) -> tuple[Frame, list[str]]:
        own = {n: x for n, x in f.scope.vars.items() if n in used}
        keys: list[str] = []
        columns: list[str] = []
        df = f.df
        for n, x in own.items():
            if isinstance(x, Ent):
                keys.append(x.id)
                columns += x.columns()
            elif isinstance(x, PathVal):
                columns += [x.nodes, x.rels]
                keys += [x.nodes, x.rels]
            else:
                held = self.column_of(x)
                if held is None:
                    held = self.name("arg")
                    df = df.withColumn(held, x.col)
                    own[n] = column(held, x.dt, x.ent)
                    f.df, f.scope.vars[n] = df, own[n]
                keys.append(held)
                columns.append(held)
        if not keys:
            return self.unit(), []
        outer = df.select(*(ref(c) for c in dict.fromkeys(columns))).dropDuplicates(list(dict.fromkeys(keys)))
        return Frame(outer, Scope(own), keys=tuple(dict.fromkeys(keys))), list(dict.fromkeys(keys))

    @staticmethod
    def column_of(x: Val) -> str | None:
        return getattr(x, "column", None)

    def join_back(self, f: Frame, sub: DataFrame, keys: list[str], how: str) -> DataFrame:
        other = sub.select(*(ref(k).alias(k + "__o") for k in keys), *(ref(c) for c in sub.columns if c not in f.df.columns))
        on = reduce(lambda a, b: a & b, (f.df[f"`{k}`"].eqNullSafe(other[f"`{k}__o`"]) for k in keys), F.lit(True)) if keys else F.lit(True)
        return f.df.join(other, on, how).drop(*(k + "__o" for k in keys))

    def optional(self, f: Frame, c: A.Match) -> Frame:
        f = replace(f, scope=f.scope.copy())
        outer, keys = self.correlated(f, names_in(c.patterns, c.where))
        sub = self.match(outer, c.patterns, c.where)
        df = self.join_back(f, sub.df, keys, "left")
        return Frame(df, Scope(sub.scope.vars | f.scope.vars), keys=f.keys)

    def semi(self, f: Frame, e: A.Exists, negated: bool) -> Frame:
        f = replace(f, scope=f.scope.copy())
        outer, keys = self.correlated(f, names_in(e.patterns, e.where) & set(f.scope.vars))
        sub = self.match(replace(outer, keys=()), e.patterns, e.where).df.select(*(ref(k) for k in keys)).distinct() if keys else self.match(outer, e.patterns, e.where).df.limit(1)
        return replace(f, df=self.join_back(f, sub, keys, "left_anti" if negated else "left_semi"))

    def lift(self, f: Frame, *xs: Any) -> tuple[Frame, dict[A.Expr, Val]]:
        """Patterns inside expressions become columns by a left join."""
        known: dict[A.Expr, Val] = {}
        for e in walk(xs):
            if isinstance(e, (A.Exists, A.PatternComp)) and e not in known:
                f = replace(f, scope=f.scope.copy())
                inside = (e.patterns, e.where) if isinstance(e, A.Exists) else (e.pattern, e.where, e.project)
                outer, keys = self.correlated(f, names_in(inside) & set(f.scope.vars))
                column = self.name("lift")
                if isinstance(e, A.Exists):
                    sub = self.match(outer, e.patterns, e.where).df
                    sub = (sub.select(*(ref(k) for k in keys)).distinct() if keys else sub.limit(1).select()).withColumn(column, F.lit(True))
                    f = replace(f, df=self.join_back(f, sub, keys, "left"))
                    known[e] = Val(F.coalesce(ref(column), F.lit(False)), T.BooleanType())
                else:
                    m = self.match(outer, (e.pattern,), e.where)
                    v = self.exprs(m).ex(e.project)
                    got = F.transform(F.collect_list(F.struct(v.col.alias("x"))), lambda s: s.x).alias(column)
                    sub = m.df.groupBy(*(ref(k) for k in keys)).agg(got)
                    f = replace(f, df=self.join_back(f, sub, keys, "left"))
                    dt = T.ArrayType(v.dt)
                    known[e] = Val(F.coalesce(ref(column), F.array().cast(dt)) if family(v.dt) != "null" else ref(column), dt, v.ent)
        return f, known

    # patterns
    def bind_node(self, f: Frame, p: A.NodePat, first: bool) -> tuple[Frame, Ent]:
        """The first node of a path: a bound variable, or a scan."""
        bound = f.scope.vars.get(p.var) if p.var else None
        if bound is not None:
            if not isinstance(bound, Ent) or bound.kind != "node":
                raise CypherExecutionError(f"{p.var} is no node")
            return self.check(f, bound, p), bound
        df, ent = self.node_scan(p)
        joined = df if f.unit else f.df.crossJoin(df)  # joined on equality where WHERE asks for it
        return self.check(Frame(joined, self.with_var(f.scope, p.var, ent), keys=f.keys), ent, p, labels=False), ent

    def with_var(self, scope: Scope, name: str | None, x: Any) -> Scope:
        out = scope.copy()
        if name:
            out.vars[name] = x
        return out

    def node_scan(self, p: A.NodePat, within: set[str | None] | None = None) -> tuple[DataFrame, Ent]:
        prefix = self.name("n")
        tables = [t for t in self.state.nodes if within is None or not t.labels or t.labels[0] in within]
        df, props = catalog.scan(tables, p.labels, prefix)
        ent = Ent("node", prefix, props, p.labels)
        if df is None:
            df = self.nothing("node", prefix)
        return df, ent

    def nothing(self, kind: str, prefix: str) -> DataFrame:
        system = "id bigint, labels array<string>, uri string" if kind == "node" else "id bigint, src bigint, dst bigint, type string, uri string"
        return self.spark.createDataFrame([], ", ".join(prefix + x for x in system.split(", ")))

    def check(self, f: Frame, ent: Ent, p: A.NodePat | A.RelPat, labels: bool = True) -> Frame:
        """Labels and inline properties of a pattern."""
        tests = []
        ex = self.exprs(f)
        if labels and isinstance(p, A.NodePat) and p.labels:
            low = F.transform(ref(ent.prefix + "labels"), F.lower)
            tests += [F.array_contains(low, x.lower()) for x in p.labels]
        if p.props is not None:
            tests += [equal(ent.prop(k), ex.ex(v)) for k, v in p.props.items]
        return replace(f, df=f.df.where(reduce(lambda a, b: a & b, tests))) if tests else f

    def rel_scan(self, p: A.RelPat, a: Ent | None, b: A.NodePat | None, reverse: bool = False) -> tuple[DataFrame, Ent, str, str, set[str | None] | None]:
        """Relationships of the types, oriented: columns `from` and `to`; and the labels their far ends may have."""
        prefix = self.name("r")
        direction = p.direction if not reverse else {"out": "in", "in": "out", "both": "both"}[p.direction]
        tables = [t for t in self.state.rels if t.may_have(p.types)]
        near = {x.lower() for x in a.labels} if a is not None else set()
        far = {x.lower() for x in b.labels} if b is not None else set()

        def fits(t: catalog.Table) -> bool:
            ways = [t.ends] if direction == "out" else [t.ends[::-1]] if direction == "in" else [t.ends, t.ends[::-1]]
            ok = lambda end, want: end is None or not want or end.lower() in want or not self.static(want)
            return any(ok(x, near) and ok(y, far) for x, y in ways)

        tables = [t for t in tables if fits(t)]
        df, props = catalog.scan(tables, p.types, prefix)
        ent = Ent("rel", prefix, props)
        if df is None:
            df = self.nothing("rel", prefix)
        at, to = prefix + "from", prefix + "to"
        if p.props is not None:
            df = self.check(Frame(df, Scope()), ent, p).df if not names_in(p.props) else df
        out = df.withColumns({at: ref(prefix + "src"), to: ref(prefix + "dst")})
        back = df.withColumns({at: ref(prefix + "dst"), to: ref(prefix + "src")})
        oriented = out if direction == "out" else back if direction == "in" else out.unionByName(back)
        ends: set[str | None] | None = set()
        for t in tables:
            if t.ends[0] is None:
                ends = None
                break
            ends |= {t.ends[1]} if direction == "out" else {t.ends[0]} if direction == "in" else set(t.ends)  # type: ignore[operator]
        return oriented, ent, at, to, ends

    def static(self, labels: set[str]) -> bool:
        """Whether all nodes with these labels lie in tables of that label."""
        return all(t.labels for t in self.state.nodes if t.may_have(tuple(labels)))

    def path(self, f: Frame, p: A.PathPat) -> Frame:
        elements = list(p.elements)
        bound = lambda n: bool(n.var) and n.var in f.scope.vars
        reverse = len(elements) > 1 and not bound(elements[0]) and bound(elements[-1])
        if reverse:
            elements.reverse()
        f, a = self.bind_node(f, elements[0], True)
        named = p.var is not None
        nodes: list[Column] = [F.array(a.struct().col)] if named else []
        node_types, rel_types, rels = [a.struct().dt], [], []
        if not named and self.closes_early(f, elements, reverse):
            f, _, _ = self.hop(self.check(f, a, elements[-1]), a, elements[-2], elements[-3], not reverse, False)
            elements = elements[:-2]
        skip = False
        for k in range(1, len(elements), 2):
            rel, node = elements[k], elements[k + 1]
            if skip:
                skip = False
            elif not named and self.bridges(f, elements[k : k + 4], reverse):
                f, a = self.bridge(f, a, *elements[k : k + 4], reverse)
                skip = True
            elif rel.length is None:
                f, a, r = self.hop(f, a, rel, node, reverse, named)
                if named:
                    nodes.append(F.array(a.struct().col))
                    rels.append(F.array(r.struct().col))
                    node_types.append(a.struct().dt)
                    rel_types.append(r.struct().dt)
            else:
                f, a, walked = self.walk_levels(f, a, rel, node, reverse, named)
                if named:
                    nodes.append(ref(walked[0]))
                    rels.append(ref(walked[1]))
                    node_types.append(walked[2].elementType)
                    rel_types.append(walked[3].elementType)
        if named:
            f = self.name_path(f, str(p.var), nodes, rels, node_types, rel_types, reverse)
        return f

    def one_each(self, rel: A.RelPat, reverse: bool, labels: tuple[str, ...]) -> bool:
        """Whether every node with the labels has at most one such relationship in the direction read, by the tables' keys."""
        if rel.length is not None or rel.direction == "both":
            return False
        side = 0 if (rel.direction == "out") != reverse else 1
        near = {x.lower() for x in labels}
        fits = [t for t in self.state.rels if t.may_have(rel.types) and (t.ends[side] is None or not near or str(t.ends[side]).lower() in near)]
        return bool(near) and self.static(near) and len({t.ends[side] for t in fits}) == len(fits) > 0 and all(t.single[side] for t in fits)

    def closes_early(self, f: Frame, elements: list, reverse: bool) -> bool:
        """A chain that returns to its start, whose last hop, read from there, leads to one node each: it is taken first."""
        rels, nodes = elements[1::2], elements[::2]
        closed = len(rels) >= 3 and nodes[0].var and nodes[0].var == nodes[-1].var and nodes[-2].var and all(r.length is None for r in rels)
        fresh = closed and not any(n.var in f.scope.vars for n in nodes[1:-1] if n.var) and not any(r.var in f.scope.vars for r in rels if r.var)
        return bool(fresh) and self.one_each(rels[-1], not reverse, nodes[0].labels or nodes[-1].labels)

    def bridges(self, f: Frame, part: list, reverse: bool) -> bool:
        """Two hops to a bound node, of which the second leads to one node each: they meet before they are joined, on both ends."""
        if len(part) < 4:
            return False
        first, middle, second, far = part
        new = all(not x.var or x.var not in f.scope.vars for x in (first, middle, second))
        plain = first.length is None and not any(x.props is not None and names_in(x.props) for x in (first, middle, second))
        return new and plain and bool(far.var) and isinstance(f.scope.vars.get(far.var), Ent) and self.one_each(second, reverse, middle.labels)

    def bridge(self, f: Frame, a: Ent, first: A.RelPat, middle: A.NodePat, second: A.RelPat, far: A.NodePat, reverse: bool) -> tuple[Frame, Ent]:
        rels, r, at, to, ends = self.rel_scan(first, a, middle, reverse)
        nodes, b = self.node_scan(middle, ends)
        onward, s, at2, to2, _ = self.rel_scan(second, b, None, reverse)
        start = Frame(rels.join(nodes, ref(to) == ref(b.id)), Scope())
        pairs = self.check(start, b, middle, labels=False).df.join(onward, ref(b.id) == ref(at2))
        end = f.scope.vars[far.var]
        df = f.df.join(pairs, (f.df[f"`{a.id}`"] == pairs[f"`{at}`"]) & (f.df[f"`{end.id}`"] == pairs[f"`{to2}`"]))
        scope = self.with_var(self.with_var(self.with_var(f.scope, middle.var, b), first.var, r), second.var, s)
        return self.check(Frame(df, scope, keys=f.keys), end, far), end

    def name_path(self, f: Frame, var: str, nodes: list[Column], rels: list[Column], node_types: list, rel_types: list, reverse: bool) -> Frame:
        nt, rt = self.one_struct(node_types), self.one_struct(rel_types) if rel_types else T.StructType([T.StructField("id", LONG)])

        def together(cols: list[Column], types: list, target: T.StructType) -> Column:
            def one(c: Column, t: T.StructType) -> Column:
                return c if t == target else F.transform(c, lambda x: self.as_struct(x, t, target))

            parts = [one(c, t) for c, t in zip(cols, types, strict=True)]
            whole = F.concat(*parts) if parts else F.array().cast(T.ArrayType(target))
            return F.reverse(whole) if reverse else whole

        n, r = self.name("pathn"), self.name("pathr")
        df = f.df.withColumns({n: together(nodes, node_types, nt), r: together(rels, rel_types, rt)})
        return Frame(df, self.with_var(f.scope, var, PathVal(n, r, T.ArrayType(nt), T.ArrayType(rt))), keys=f.keys)

    @staticmethod
    def one_struct(types: list[T.StructType]) -> T.StructType:
        """The struct type with the properties of all."""
        if all(t == types[0] for t in types):
            return types[0]
        props: dict[str, list[T.DataType]] = {}
        for t in types:
            for x in t["properties"].dataType.fields:  # type: ignore[attr-defined]
                props.setdefault(x.name, []).append(x.dataType)
        merged = T.StructType([T.StructField(n, common_type(ts)) for n, ts in props.items()])
        return T.StructType([x if x.name != "properties" else T.StructField("properties", merged) for x in types[0].fields])

    @staticmethod
    def as_struct(x: Column, t: T.StructType, target: T.StructType) -> Column:
        if t == target:
            return x
        own = {p.name: p.dataType for p in t["properties"].dataType.fields}  # type: ignore[attr-defined]
        props = F.struct(
            *(
                (cast_to(Val(x.getField("properties").getField(p.name), own[p.name]), p.dataType) if p.name in own else F.lit(None).cast(p.dataType)).alias(p.name)
                for p in target["properties"].dataType.fields  # type: ignore[attr-defined]
            )
        )
        return F.when(x.isNotNull(), F.struct(*(x.getField(c.name).alias(c.name) for c in target.fields if c.name != "properties"), props.alias("properties")))

    def hop(self, f: Frame, a: Ent, rel: A.RelPat, node: A.NodePat, reverse: bool, named: bool) -> tuple[Frame, Ent, Ent]:
        bound_rel = f.scope.vars.get(rel.var) if rel.var else None
        far = f.scope.vars.get(node.var) if node.var else None
        rels, r, at, to, ends = self.rel_scan(rel, a, node if far is None else None, reverse)
        on = f.df[f"`{a.id}`"] == rels[f"`{at}`"]
        if isinstance(bound_rel, Ent):
            on = on & (f.df[f"`{bound_rel.id}`"] == rels[f"`{r.id}`"])
        if far is not None:
            if not isinstance(far, Ent):
                raise CypherExecutionError(f"{node.var} is no node")
            df, b = f.df.join(rels, on & (f.df[f"`{far.id}`"] == rels[f"`{to}`"])), far
        else:
            nodes, b = self.node_scan(node, ends)
            df = f.df.join(rels, on).join(nodes, ref(to) == ref(b.id))
        scope = self.with_var(self.with_var(f.scope, node.var, b), rel.var if bound_rel is None else None, r)
        out = Frame(df, scope, keys=f.keys)
        if rel.props is not None and names_in(rel.props):
            out = self.check(out, r, rel)
        return self.check(out, b, node, labels=far is not None), b, r

    def level_step(self, now: DataFrame, rel: A.RelPat, reverse: bool, visited: str, end: str, track: tuple[str, str] | None, keep: list[str]) -> tuple[DataFrame, T.DataType, T.DataType | None]:
        """One further relationship from every partial path, never to a node it has visited."""
        rels, r, at, to, _ = self.rel_scan(rel, None, None, reverse)
        df = now.join(rels, now[f"`{end}`"] == rels[f"`{at}`"]).where(~F.array_contains(ref(visited), ref(to)))
        node_type: T.DataType | None = None
        cols = [ref(c) for c in keep] + [F.concat(ref(visited), F.array(ref(to))).alias(visited), ref(to).alias(end)]
        rel_dt = r.struct().dt
        if track:
            nodes, b = self.node_scan(A.NodePat(None, (), None))
            df = df.join(nodes, ref(to) == ref(b.id))
            node_type = b.struct().dt
            cols += [F.concat(ref(track[0]), F.array(b.struct().col)).alias(track[0]), F.concat(ref(track[1]), F.array(r.struct().col)).alias(track[1])]
        return df.select(*cols), rel_dt, node_type

    def start_levels(self, f: Frame, a: Ent, rel: A.RelPat, track: bool) -> tuple[DataFrame, str, str, tuple[str, str] | None, T.ArrayType, T.ArrayType]:
        visited, end = self.name("seen"), self.name("end")
        r = Ent("rel", "x_", catalog.merged_props([t for t in self.state.rels if t.may_have(rel.types)]))
        every = Ent("node", "x_", catalog.merged_props(list(self.state.nodes)))
        node_dt, rel_dt = T.ArrayType(every.struct().dt), T.ArrayType(r.struct().dt)
        df = f.df.withColumns({visited: F.array(ref(a.id)), end: ref(a.id)})
        names = None
        if track:
            names = (self.name("walkn"), self.name("walkr"))
            df = df.withColumns({names[0]: F.array().cast(node_dt), names[1]: F.array().cast(rel_dt)})
        return df, visited, end, names, node_dt, rel_dt

    def walk_levels(self, f: Frame, a: Ent, rel: A.RelPat, node: A.NodePat, reverse: bool, named: bool) -> tuple[Frame, Ent, tuple]:
        """A variable-length pattern: one join a level, the union of the levels wanted."""
        lo, hi = rel.length  # type: ignore[misc]
        hi = self.graph.max_hops if hi is None else hi
        track = named or rel.var is not None
        now, visited, end, names, node_dt, rel_dt = self.start_levels(f, a, rel, track)
        keep = f.df.columns
        levels = [now] if lo == 0 else []
        for depth in range(1, hi + 1):
            now, _, _ = self.level_step(now, rel, reverse, visited, end, names, keep)
            if depth >= DEEP and hi > DEEP:
                now = cut(now)
                if now.isEmpty():
                    break
            if depth >= lo:
                levels.append(now)
        if not levels:
            levels = [now.limit(0)]
        df = reduce(DataFrame.unionByName, levels)
        far = f.scope.vars.get(node.var) if node.var else None
        if isinstance(far, Ent):
            df, b = df.where(ref(end) == ref(far.id)), far
        else:
            nodes, b = self.node_scan(node)
            df = df.join(nodes, ref(end) == ref(b.id))
        scope = self.with_var(f.scope, node.var, b)
        if rel.var and names:
            scope = self.with_var(scope, rel.var, column(names[1], rel_dt, "rel", reverse))
        out = self.check(Frame(df, scope, keys=f.keys), b, node, labels=far is not None)
        return out, b, ((*names, node_dt, rel_dt) if names else ())

    def shortest(self, f: Frame, p: A.PathPat) -> Frame:
        """Breadth-first levels from every start; per pair of ends the first level that reaches it."""
        start, rel, goal = p.elements
        lo, hi = rel.length or (1, 1)
        hi = self.graph.max_hops if hi is None else hi
        f, a = self.bind_node(f, start, True)
        far = f.scope.vars.get(goal.var) if goal.var else None
        if isinstance(far, Ent):
            ends = f.df.select(ref(far.id).alias("goal_id")).distinct()
        else:
            scanned, b = self.node_scan(goal)
            f2 = self.check(Frame(scanned, Scope({goal.var or "": b})), b, goal, labels=False)
            ends = f2.df.select(ref(b.id).alias("goal_id")).distinct()
        starts = Frame(f.df.select(*(ref(c) for c in a.columns())).dropDuplicates([a.id]), Scope({"a": a}))
        now, visited, end, names, node_dt, rel_dt = self.start_levels(starts, a, rel, p.var is not None or rel.var is not None)
        keep = [a.id]
        now = now.select(ref(a.id), ref(visited), ref(end), *(ref(n) for n in names or ()))
        found = [now.join(ends, ref(end) == F.col("goal_id"), "left_semi")] if lo == 0 else []
        reached = now.select(ref(a.id).alias("r_start"), ref(end).alias("r_end"))
        wanted = None  # pairs of given ends not met so far; a path never comes back to its start
        if isinstance(far, Ent):
            wanted = cut(f.df.select(ref(a.id).alias("w_start"), ref(far.id).alias("w_end")).distinct().where("w_start <> w_end"))
        for _ in range(1, hi + 1):
            if wanted is not None:
                if wanted.isEmpty():
                    break
                now = now.join(wanted.select("w_start").distinct(), ref(a.id) == F.col("w_start"), "left_semi")
            now, _, _ = self.level_step(now, rel, False, visited, end, names, keep)
            now = now.join(reached, (ref(a.id) == F.col("r_start")) & (ref(end) == F.col("r_end")), "left_anti")
            if p.function == "shortestpath":  # one path a pair, the first by the ids on it
                one = Window.partitionBy(ref(a.id), ref(end)).orderBy(ref(visited))
                now = now.withColumn("one_", F.row_number().over(one)).where("one_ = 1").drop("one_")
            now = cut(now)
            if now.isEmpty():
                break
            found.append(now.join(ends, ref(end) == F.col("goal_id"), "left_semi"))
            ends_now = now.select(ref(a.id).alias("r_start"), ref(end).alias("r_end")).distinct()
            reached = reached.unionByName(ends_now)
            if wanted is not None:
                wanted = cut(wanted.join(ends_now, (F.col("w_start") == F.col("r_start")) & (F.col("w_end") == F.col("r_end")), "left_anti"))
        paths = reduce(DataFrame.unionByName, found) if found else now.limit(0)
        paths = paths.withColumnRenamed(a.id, "s_id")
        if isinstance(far, Ent):
            df, b = f.df.join(paths, (ref(a.id) == F.col("s_id")) & (ref(far.id) == ref(end))), far
        else:
            nodes, b = self.node_scan(goal)
            df = f.df.join(paths, ref(a.id) == F.col("s_id")).join(nodes, ref(end) == ref(b.id))
        out = self.check(Frame(df.drop("s_id"), self.with_var(f.scope, goal.var, b), keys=f.keys), b, goal, labels=far is not None)
        if rel.var and names:
            out.scope.vars[rel.var] = column(names[1], rel_dt, "rel")
        if p.var and names:
            first = F.array(a.struct().col)
            out = self.name_path(out, p.var, [first, ref(names[0])], [ref(names[1])], [a.struct().dt, node_dt.elementType], [rel_dt.elementType], False)
        return out

    # projection
    def do_projection(self, c: A.Projection, f: Frame) -> Frame:
        items = list(c.items)
        if c.star:
            items = [A.Item(A.Var(n), n) for n in f.scope.vars] + items
        f = replace(f, scope=f.scope.copy())
        f, known = self.lift(f, [i.expr for i in items], [e for e, _ in c.order])
        by_alias = {i.alias: i.expr for i in items}
        if aggregates_in([i.expr for i in items]):
            out, ordering = self.aggregate(f, items, c, known)
        else:
            out, ordering = self.plain(f, items, c, known)
        if c.order:
            keys, order, made = [], [], {}
            for e, up in c.order:
                v = ordering(e)
                col = canonical(v) if self.odd(v.dt) else v.col
                if not c.final:  # kept for an ordered COLLECT
                    order.append((self.name("ord"), up))
                    made[order[-1][0]] = col
                    col = ref(order[-1][0])
                keys.append(col.asc_nulls_last() if up else col.desc_nulls_last())
            if made:
                out = replace(out, df=out.df.withColumns(made), order=tuple(order))
            out = replace(out, df=out.df.orderBy(*keys) if not out.keys else out.df)
            if out.keys and (c.skip is not None or c.limit is not None):
                rank = self.name("rank")
                out = replace(out, df=out.df.withColumn(rank, F.row_number().over(Window.partitionBy(*(ref(k) for k in out.keys)).orderBy(*keys))))
                lo = self.whole(c.skip) if c.skip is not None else 0
                test = ref(rank) > lo
                if c.limit is not None:
                    test = test & (ref(rank) <= lo + self.whole(c.limit))
                out = replace(out, df=out.df.where(test).drop(rank))
        if not (out.keys and c.order):
            if out.keys and (c.skip is not None or c.limit is not None):
                raise CypherExecutionError("SKIP and LIMIT in a subquery need ORDER BY")
            if c.skip is not None:
                out = replace(out, df=out.df.offset(self.whole(c.skip)))
            if c.limit is not None:
                out = replace(out, df=out.df.limit(self.whole(c.limit)))
        if c.where is not None:
            wide = Frame(out.df, Scope(({} if aggregates_in(list(by_alias.values())) or c.distinct else f.scope.vars) | out.scope.vars), keys=out.keys)
            got = self.filter(wide, c.where)
            out = replace(out, df=got.df)
        return out

    def whole(self, e: A.Expr) -> int:
        v = Exprs(Scope(), self.params).ex(e).const
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise CypherExecutionError("SKIP and LIMIT take a whole number")
        return v

    def carried(self, f: Frame) -> list[str]:
        return [k for k in f.keys if k in f.df.columns]

    def named(self, df: DataFrame, values: list[tuple[str, Val]]) -> tuple[DataFrame, dict[str, Any]]:
        columns = {alias: self.name("c") for alias, _ in values}
        df = df.withColumns({columns[a]: (v.col if family(v.dt) != "null" else v.col.cast("string")) for a, v in values}) if values else df
        return df, {a: column(columns[a], v.dt if family(v.dt) != "null" else STRING, v.ent) for a, v in values}

    def plain(self, f: Frame, items: list[A.Item], c: A.Projection, known: dict[A.Expr, Val]) -> tuple[Frame, Callable[[A.Expr], Val]]:
        ex = self.exprs(f, known)
        kept = {i.alias: f.scope.vars[i.expr.name] for i in items if isinstance(i.expr, A.Var) and i.expr.name in f.scope.vars}
        df, new = self.named(f.df, [(i.alias, ex.ex(i.expr)) for i in items if i.alias not in kept])
        scope = Scope({i.alias: kept.get(i.alias, new.get(i.alias)) for i in items})
        out = Frame(df, scope, keys=f.keys)
        if c.distinct:
            names = self.columns(scope) + [k for k in self.carried(f)]
            short = df.select(*(ref(n) for n in dict.fromkeys(names)))
            ids = [x for x in self.identity(scope) + self.carried(f)]
            odd = [n for n in ids if self.odd(short.schema[n].dataType)]
            for n in odd:
                key = self.name("canon")
                short = short.withColumn(key, canonical(Val(ref(n), short.schema[n].dataType)))
                ids[ids.index(n)] = key
            out = Frame(short.dropDuplicates(list(dict.fromkeys(ids))), scope, keys=f.keys)
            return out, Exprs(scope, self.params).ex
        wide = Frame(df, Scope(f.scope.vars | scope.vars), keys=f.keys)
        return out, Exprs(wide.scope, self.params, known).ex

    @staticmethod
    def columns(scope: Scope) -> list[str]:
        out: list[str] = []
        for x in scope.vars.values():
            out += x.columns() if isinstance(x, Ent) else [x.nodes, x.rels] if isinstance(x, PathVal) else [x.column]
        return out

    @staticmethod
    def identity(scope: Scope) -> list[str]:
        out: list[str] = []
        for x in scope.vars.values():
            out += [x.id] if isinstance(x, Ent) else [x.nodes, x.rels] if isinstance(x, PathVal) else [x.column]
        return out

    def aggregate(self, f: Frame, items: list[A.Item], c: A.Projection, known: dict[A.Expr, Val]) -> tuple[Frame, Callable[[A.Expr], Val]]:
        """Items without an aggregate are the grouping keys."""
        ex = self.exprs(f, known)
        keys = [i for i in items if not aggregates_in(i.expr)]
        entities = {i.alias: f.scope.vars[i.expr.name] for i in keys if isinstance(i.expr, A.Var) and isinstance(f.scope.vars.get(i.expr.name), (Ent, PathVal))}
        df, scalars = self.named(f.df, [(i.alias, ex.ex(i.expr)) for i in keys if i.alias not in entities])
        group: list[str] = list(self.carried(f))
        first: list[str] = []
        for x in entities.values():
            group += [x.id] if isinstance(x, Ent) else []
            first += [n for n in (x.columns() if isinstance(x, Ent) else [x.nodes, x.rels])]
        for v in scalars.values():
            if self.odd(v.dt):
                key = self.name("canon")
                df = df.withColumn(key, canonical(v))
                group.append(key)
                first.append(v.column)  # type: ignore[attr-defined]
            else:
                group.append(v.column)  # type: ignore[attr-defined]
        group = list(dict.fromkeys(group))
        first = [n for n in dict.fromkeys(first) if n not in group]
        calls = list(dict.fromkeys(aggregates_in([i.expr for i in items]) + aggregates_in([e for e, _ in c.order])))
        aggs = {call: self.name("agg") for call in calls}
        made = {call: self.aggregate_call(call, ex, f.order) for call in calls}
        exprs = [made[x].col.alias(aggs[x]) for x in calls] + [F.first(ref(n)).alias(n) for n in first]
        grouped = df.groupBy(*(ref(g) for g in group)).agg(*exprs) if group else df.agg(*exprs)
        values: dict[A.Expr, Val] = {x: column(aggs[x], made[x].dt, made[x].ent) for x in calls}
        after = Frame(grouped, Scope(entities | scalars), keys=f.keys)
        values |= {i.expr: scalars[i.alias] for i in keys if i.alias in scalars}
        values |= {A.Var(i.expr.name): Exprs(Scope({i.expr.name: entities[i.alias]})).ex(A.Var(i.expr.name)) for i in keys if i.alias in entities and isinstance(i.expr, A.Var)}
        inner = Scope(entities | scalars | {i.expr.name: entities[i.alias] for i in keys if i.alias in entities and isinstance(i.expr, A.Var)})
        ex2 = Exprs(inner, self.params, values)
        rest = [(i.alias, ex2.ex(i.expr)) for i in items if i not in keys]
        df2, new = self.named(after.df, rest)
        scope = Scope({i.alias: entities.get(i.alias) or scalars.get(i.alias) or new[i.alias] for i in items})
        out = Frame(df2, scope, keys=f.keys)
        if c.distinct:
            out = replace(out, df=df2.dropDuplicates([n for n in dict.fromkeys(self.identity(scope) + self.carried(f)) if not self.odd(df2.schema[n].dataType)]))
        by_expr = {i.expr: scope.vars[i.alias] for i in items if not isinstance(scope.vars[i.alias], (Ent, PathVal))}
        return out, Exprs(Scope(inner.vars | scope.vars), self.params, values | by_expr).ex

    def aggregate_call(self, call: A.Call, ex: Exprs, order: tuple[tuple[str, bool], ...] = ()) -> Val:
        name = call.name.lower()
        if call.star:
            return Val(F.count(F.lit(1)), LONG)
        want = 2 if name.startswith("percentile") else 1
        if len(call.args) != want:
            raise CypherExecutionError(f"{call.name} takes {want} argument(s)")
        ent = ex.entity(call.args[0])
        v = Val(ref(ent.id), LONG) if ent and name == "count" else ex.ex(call.args[0])
        if name == "count":
            col = canonical(v) if self.odd(v.dt) else v.col
            return Val(F.countDistinct(col) if call.distinct else F.count(col), LONG)
        if name == "collect":
            got = F.collect_list(F.struct(v.col.alias("x"), *(ref(n).alias(f"o{k}") for k, (n, _) in enumerate(order))))
            got = F.transform(F.array_sort(got, by_order(order)) if order else got, lambda s: s.x)
            if call.distinct and self.odd(v.dt):
                raise CypherExecutionError("COLLECT(DISTINCT) takes no maps")
            return Val(F.array_distinct(got) if call.distinct else got, T.ArrayType(v.dt), v.ent)
        if name in ("min", "max"):
            if is_a(v, T.VariantType):
                v = Val(variant_as(v.col, "number"), DOUBLE)
            return Val((F.min if name == "min" else F.max)(v.col), v.dt)
        if is_a(v, T.VariantType):
            v = Val(variant_as(v.col, "number"), DOUBLE)
        if family(v.dt) not in ("number", "null", "duration"):
            raise CypherExecutionError(f"{call.name} takes numbers, not a {family(v.dt)}")
        x = v.col.cast("double") if is_a(v, T.NullType) else v.col
        if name == "sum":
            return Val(F.sum_distinct(x) if call.distinct else F.sum(x), v.dt if not is_a(v, T.NullType) else DOUBLE)
        if name == "avg":
            return Val(F.avg(x) if not call.distinct else F.sum_distinct(x) / F.countDistinct(x), DOUBLE)
        values = F.array_sort(F.collect_set(x.cast("double")))
        n = F.size(values)
        if name in ("stddev", "stdevp", "stdev"):
            if not call.distinct:
                return Val(F.stddev_samp(x) if name == "stdev" else F.stddev_pop(x), DOUBLE)
            mean = F.aggregate(values, F.lit(0.0), lambda a, y: a + y) / n
            return Val(F.when(n > 0, F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean)) / n)), DOUBLE)
        p = ex.ex(call.args[1]).const
        if not isinstance(p, (int, float)) or not 0 <= p <= 1:
            raise CypherExecutionError("a percentile lies between 0 and 1")
        if name == "percentiledisc":
            return Val(F.percentile_disc(p, x) if hasattr(F, "percentile_disc") else F.percentile_approx(x, p, 1 << 30), v.dt)
        if not call.distinct:
            return Val(F.percentile(x, F.lit(float(p))), DOUBLE)
        at = F.lit(float(p)) * (n - 1)
        low = F.floor(at).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, n - 1))
        return Val(F.when(n > 0, a + (b - a) * (at - low)), DOUBLE)

    def do_unwind(self, c: A.Unwind, f: Frame) -> Frame:
        f, known = self.lift(f, c.expr)
        v = self.exprs(f, known).ex(c.expr)
        if is_a(v, T.VariantType):
            v = Val(variant_as(v.col, "list"), T.ArrayType(VARIANT))
        if is_a(v, T.NullType):
            v = Val(F.array().cast("array<string>"), T.ArrayType(STRING))
        if not is_a(v, T.ArrayType):
            raise CypherExecutionError("UNWIND takes a list")
        inner = v.dt.elementType  # type: ignore[attr-defined]
        name = self.name("item")
        col = v.col if family(inner) != "null" else F.transform(v.col, lambda x: F.lit(None).cast("variant"))
        df = f.df.select("*", F.explode(col).alias(name))
        return Frame(df, self.with_var(f.scope, c.var, column(name, inner if family(inner) != "null" else VARIANT, v.ent)), keys=f.keys)

    def do_callsub(self, c: A.CallSub, f: Frame) -> Frame:
        f = replace(f, scope=f.scope.copy())
        used: set[str] = set()
        for part in c.query.parts:
            for clause in part:
                used |= names_in(*(vars(clause).values())) | {n for i in getattr(clause, "items", []) if isinstance(i, A.Item) for n in names_in(i.expr)}
                used |= {n for e, _ in getattr(clause, "order", []) for n in names_in(e)}
        outer, keys = self.correlated(f, used & set(f.scope.vars))
        sub = self.query(c.query, outer)
        new = {n: x for n, x in sub.scope.vars.items() if n not in outer.scope.vars}
        df = self.join_back(f, sub.df, keys, "inner")
        return Frame(df, Scope(f.scope.vars | new), keys=f.keys)

    def do_callproc(self, c: A.CallProc, f: Frame) -> Frame:
        from trellis import procedures

        args = [self.exprs(f).ex(a) for a in c.args]
        return procedures.call(self, c, args, f)

    def do_loadcsv(self, c: A.LoadCsv, f: Frame) -> Frame:
        from trellis.sources import files

        place = self.exprs(f).ex(c.source)
        source = self.params[c.source.name] if isinstance(c.source, A.Param) else place.const
        name = self.name("row")
        if source is None:  # the place comes from the rows: each file is read once, by a worker
            key = self.name("place")
            keyed = f.df.withColumn(key, place.col.cast("string"))
            rows, v = files.csv_each(keyed.select(ref(key).alias("source")).distinct(), c.headers, c.separator)
            rows = rows.select(F.col("source").alias(key + "_"), F.col("row").alias(name))
            joined = keyed.join(rows, ref(key) == ref(key + "_")).drop(key, key + "_")
            return Frame(joined, self.with_var(f.scope, c.var, column(name, v, None)), keys=f.keys)
        if not isinstance(source, str):
            raise CypherExecutionError("LOAD CSV takes a place")
        rows, v = files.csv_rows(self.spark, source, c.headers, c.separator)
        df = rows.withColumnRenamed("row", name)
        joined = df if f.unit else f.df.crossJoin(df)
        return Frame(joined, self.with_var(f.scope, c.var, column(name, v, None)), keys=f.keys)

    # writing and schema: see writes.py
    def __getattr__(self, name: str) -> Any:
        if name.startswith("do_"):
            from trellis.cypher import writes

            return lambda c, f: getattr(writes, name)(self, c, f)
        raise AttributeError(name)


def by_order(order: tuple[tuple[str, bool], ...]) -> Callable[[Column, Column], Column]:
    """Compares two structs by their fields o0, o1, ..; nulls last."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for k in reversed(range(len(order))):
            x, y = a.getField(f"o{k}"), b.getField(f"o{k}")
            less, more = (-1, 1) if order[k][1] else (1, -1)
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, less).when(x > y, more).otherwise(out)
        return out

    return compare


def column(name: str, dt: T.DataType, ent: str | None = None, reverse: bool = False) -> Val:
    v = Val(F.reverse(ref(name)) if reverse else ref(name), dt, ent)
    v.column = name  # type: ignore[attr-defined]
    return v
