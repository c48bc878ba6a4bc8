"""Write and schema clauses: set-based changes from one snapshot of the graph to the next."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis import catalog
from trellis.cypher import ast as A
from trellis.cypher.compiler import Compiler, Frame, column
from trellis.cypher.values import LONG, STRING, VARIANT, Ent, Scope, Val, cast_to, common_type, family, is_a, ref, to_variant
from trellis.exceptions import CypherExecutionError
from trellis.tables import cut


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A dense row number from 0, by partition offsets, and the number of rows. Only one count a partition reaches the driver."""
    df = cut(df.withColumn("part_", F.spark_partition_id()).withColumn("mono_", F.monotonically_increasing_id()))
    offsets, total = {}, 0
    for part, least, n in sorted(tuple(r) for r in df.groupBy("part_").agg(F.min("mono_"), F.count("*")).collect()):
        offsets[part] = total - least
        total += n
    offset: Column = F.lit(0).cast("bigint")
    if offsets:
        table = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))
        offset = F.try_element_at(table, F.col("part_")).cast("bigint")
    return df.withColumn(name, F.col("mono_") + offset).drop("part_", "mono_"), total


def storable(v: Val) -> Val:
    """Maps and points are kept as dynamic values, untyped nulls as strings."""
    if is_a(v, T.StructType, T.MapType) or (is_a(v, T.ArrayType) and family(v.dt.elementType) in ("map", "null")):  # type: ignore[attr-defined]
        return Val(to_variant(v), VARIANT)
    if family(v.dt) == "null":
        return Val(v.col.cast("string"), STRING)
    return v


def create(comp: Compiler, patterns: list[A.PathPat], f: Frame) -> Frame:
    state = comp.state
    new_nodes: dict[int, A.NodePat] = {}
    chain: list[tuple[Any, ...]] = []
    seen: dict[str, int] = {}
    for p in patterns:
        places = []
        for x in p.elements[::2]:
            bound = x.var and x.var in f.scope.vars
            if bound:
                places.append(x.var)
            elif x.var and x.var in seen:
                places.append(seen[x.var])
            else:
                k = len(new_nodes)
                new_nodes[k] = x
                places.append(k)
                if x.var:
                    seen[x.var] = k
        for j, rel in enumerate(p.elements[1::2]):
            if rel.length is not None or len(rel.types) > 1:
                raise CypherExecutionError("a created relationship has one type and one step")
            a, b = places[j], places[j + 1]
            chain.append((rel, b, a) if rel.direction == "in" else (rel, a, b))
    row = comp.name("row")
    df, total = numbered(f.df, row)
    scope = f.scope.copy()
    ents: dict[int, Ent] = {}
    tables_n, tables_r = [], []
    ex = comp.exprs(replace(f, scope=scope))
    for k, p in new_nodes.items():
        prefix = comp.name("n")
        values = {key: storable(ex.ex(v)) for key, v in (p.props.items if p.props else ())}
        labels = sorted(dict.fromkeys(p.labels))
        cols = {prefix + "id": F.lit(state.next_node + k).cast("bigint") + ref(row) * len(new_nodes), prefix + "labels": F.array(*(F.lit(x) for x in labels)).cast("array<string>"), prefix + "uri": F.lit(None).cast("string")}
        cols |= {f"{prefix}p_{key}": v.col for key, v in values.items()}
        df = df.withColumns(cols)
        ents[k] = Ent("node", prefix, {key: v.dt for key, v in values.items()}, tuple(labels))
        if p.var:
            scope.vars[p.var] = ents[k]
        ex = comp.exprs(Frame(df, scope))
    rels = []
    for k, (rel, a, b) in enumerate(chain):
        ends = []
        for x in (a, b):
            e = ents[x] if isinstance(x, int) else scope.vars[x]
            if not isinstance(e, Ent) or e.kind != "node":
                raise CypherExecutionError("a relationship joins nodes")
            ends.append(e)
        prefix = comp.name("r")
        values = {key: storable(ex.ex(v)) for key, v in (rel.props.items if rel.props else ())}
        cols = {
            prefix + "id": F.lit(state.next_rel + k).cast("bigint") + ref(row) * len(chain),
            prefix + "src": ref(ends[0].id), prefix + "dst": ref(ends[1].id), prefix + "type": F.lit(rel.types[0] if rel.types else "RELATED_TO"), prefix + "uri": F.lit(None).cast("string"),
        }
        cols |= {f"{prefix}p_{key}": v.col for key, v in values.items()}
        df = df.withColumns(cols)
        r = Ent("rel", prefix, {key: v.dt for key, v in values.items()})
        rels.append(r)
        if rel.var:
            scope.vars[rel.var] = r
    df = cut(df)
    for k in new_nodes:
        tables_n.append(as_table(df, ents[k]))
    tables_r = [as_table(df, r) for r in rels]
    comp.graph.apply(
        state.but(
            nodes=(*state.nodes, *tables_n), rels=(*state.rels, *tables_r), next_node=state.next_node + total * len(new_nodes), next_rel=state.next_rel + total * len(chain)
        )
    )
    return Frame(df, scope, keys=f.keys)


def as_table(df: DataFrame, e: Ent) -> catalog.Table:
    system = catalog.NODE if e.kind == "node" else catalog.REL
    out = df.select(*(ref(e.prefix + c).alias(c) for c in system), *(ref(e.column(k)).alias("p_" + k) for k in e.props))
    return catalog.Table(e.kind, out, dict(e.props))


def do_create(comp: Compiler, c: A.Create, f: Frame) -> Frame:
    return create(comp, c.patterns, f)


def do_merge(comp: Compiler, c: A.Merge, f: Frame) -> Frame:
    """Matches the whole pattern, creates it once for each distinct set of values that has none, matches again."""
    ex = comp.exprs(f)
    values: dict[str, Val] = {}
    elements = []
    scope = f.scope.copy()
    df = f.df
    for x in c.pattern.elements:
        props = []
        for k, v in x.props.items if x.props else ():
            name = comp.name("merge")
            got = storable(ex.ex(v))
            df = df.withColumn(name, got.col)
            scope.vars[name] = column(name, got.dt)
            values[name] = got
            props.append((k, A.Var(name)))
        if isinstance(x, A.RelPat) and not x.types:
            x = replace(x, types=("RELATED_TO",))
        elements.append(replace(x, props=A.MapLit(tuple(props)) if x.props else None))
    pattern = replace(c.pattern, elements=tuple(elements))
    base = Frame(cut(df), scope, keys=f.keys)
    ends = [x.var for x in pattern.elements[::2] if x.var and x.var in f.scope.vars]
    keys = list(dict.fromkeys([*(f.scope.vars[v].id for v in ends), *values]))
    found = comp.match(replace(base, scope=scope.copy()), [pattern], None)
    have = found.df.select(*(ref(k).alias(k + "__m") for k in keys)).distinct() if keys else found.df.limit(1)
    on = F.lit(True)
    for k in keys:
        on = on & base.df[f"`{k}`"].eqNullSafe(have[f"`{k}__m`"])
    missing = (base.df.dropDuplicates(keys) if keys else base.df.limit(1)).join(have, on, "left_anti")
    missing = cut(missing)
    if c.on_match:
        old = Frame(cut(found.df), found.scope)
        if not old.df.isEmpty():
            do_setclause(comp, A.SetClause(c.on_match), old)
    if not missing.isEmpty():
        made = create(comp, [pattern], Frame(missing, scope.copy()))
        if c.on_create:
            do_setclause(comp, A.SetClause(c.on_create), made)
    out = comp.match(replace(base, scope=scope.copy()), [pattern], None)
    for name in values:
        out.scope.vars.pop(name, None)
    return replace(out, df=out.df.limit(1)) if f.unit else out


def patched(state: catalog.State, kind: str, patch: DataFrame, change: dict[str, Val], labels: Column | None = None, clear: bool = False) -> catalog.State:
    """New tables of a kind after a patch (id and the new columns, one row an id)."""
    tables = []
    for t in state.nodes if kind == "node" else state.rels:
        joined = t.df.join(patch, t.df["id"] == patch["patch_id"], "left")
        hit = F.col("patch_id").isNotNull()
        props = dict(t.props)
        cols = {}
        if clear:
            cols = {"p_" + k: F.when(~hit, ref("p_" + k)) for k in props}
        for k, v in change.items():
            dt = common_type([props[k], v.dt]) if k in props else v.dt
            before = cast_to(Val(ref("p_" + k), props[k]), dt) if k in props else F.lit(None).cast(dt)
            cols["p_" + k] = F.when(hit, cast_to(Val(ref(v.col_name), v.dt), dt)).otherwise(before)  # type: ignore[attr-defined]
            props[k] = dt
        if labels is not None:
            cols["labels"] = F.when(hit, labels).otherwise(ref("labels"))
        df = joined.withColumns(cols).drop(*patch.columns)
        tables.append(t.but(df, props, () if labels is not None else None))
    return state.but(nodes=tuple(tables)) if kind == "node" else state.but(rels=tuple(tables))


def do_setclause(comp: Compiler, c: A.SetClause, f: Frame) -> Frame:
    for item in c.items:
        e = f.scope.vars.get(item.var)
        if not isinstance(e, Ent):
            raise CypherExecutionError(f"{item.var} is no node or relationship")
        if item.mode == "label":
            f = change_labels(comp, f, e, str(item.key), True)
            continue
        assert item.value is not None
        if item.mode == "prop":
            change = {str(item.key): storable(comp.exprs(f).ex(item.value))}
        else:
            v = comp.exprs(f).ex(item.value)
            if not is_a(v, T.StructType) and v.const != {}:
                raise CypherExecutionError("SET takes a map")
            from trellis.functions.scalar import _entries

            change = {k: storable(x) for k, x in _entries(v)}
        f = assign(comp, f, item.var, e, change, item.mode == "replace")
    return f


def assign(comp: Compiler, f: Frame, var: str, e: Ent, change: dict[str, Val], clear: bool) -> Frame:
    names = {k: comp.name("set") for k in change}
    for k, v in change.items():
        v.col_name = names[k]  # type: ignore[attr-defined]
    df = f.df.withColumns({names[k]: v.col for k, v in change.items()}) if change else f.df
    df = cut(df)
    once = df.where(ref(e.id).isNotNull()).select(ref(e.id).alias("patch_id"), *(ref(n) for n in names.values()))
    once = once.withColumn("order_", F.monotonically_increasing_id()).groupBy("patch_id").agg(*(F.max_by(ref(n), "order_").alias(n) for n in names.values()), F.max("order_").alias("order_")).drop("order_")
    comp.graph.apply(patched(comp.state, e.kind, cut(once), change, clear=clear))
    after = Ent(e.kind, e.prefix, ({} if clear else dict(e.props)) | {k: v.dt for k, v in change.items()}, e.labels)
    df = df.withColumns({e.column(k): F.when(ref(e.id).isNotNull(), ref(names[k])) for k in change}) if change else df
    scope = f.scope.copy()
    for n, x in scope.vars.items():
        if x is e:
            scope.vars[n] = after
    scope.vars[var] = after
    return Frame(df, scope, keys=f.keys)


def change_labels(comp: Compiler, f: Frame, e: Ent, label: str, add: bool) -> Frame:
    if e.kind != "node":
        raise CypherExecutionError("only nodes have labels")
    df = cut(f.df)
    patch = df.where(ref(e.id).isNotNull()).select(ref(e.id).alias("patch_id")).distinct()
    new = F.array_sort(F.array_union("labels", F.array(F.lit(label)))) if add else F.filter("labels", lambda x: F.lower(x) != label.lower())
    comp.graph.apply(patched(comp.state, "node", patch, {}, labels=new))
    own = ref(e.prefix + "labels")
    df = df.withColumn(e.prefix + "labels", F.array_sort(F.array_union(own, F.array(F.lit(label)))) if add else F.filter(own, lambda x: F.lower(x) != label.lower()))
    return Frame(df, f.scope, keys=f.keys)


def do_remove(comp: Compiler, c: A.Remove, f: Frame) -> Frame:
    for item in c.items:
        e = f.scope.vars.get(item.var)
        if not isinstance(e, Ent):
            raise CypherExecutionError(f"{item.var} is no node or relationship")
        if item.mode == "label":
            f = change_labels(comp, f, e, str(item.key), False)
        elif str(item.key) in e.props:
            dt = e.props[str(item.key)]
            f = assign(comp, f, item.var, e, {str(item.key): Val(F.lit(None).cast(dt), dt)}, False)
    return f


def do_delete(comp: Compiler, c: A.Delete, f: Frame) -> Frame:
    """Nodes go with their relationships; the result counts the matched rows."""
    nodes, rels = [], []
    df = cut(f.df)
    for n in c.names:
        e = f.scope.vars.get(n)
        if not isinstance(e, Ent):
            raise CypherExecutionError(f"{n} is no node or relationship")
        (nodes if e.kind == "node" else rels).append(e)
    state = comp.state
    counts = df.agg(*(F.count(ref(e.id)) for e in nodes + rels)).first()
    assert counts is not None
    for e in rels:
        gone = df.select(ref(e.id).alias("gone_id")).distinct()
        state = state.but(rels=tuple(t.but(t.df.join(gone, t.df["id"] == gone["gone_id"], "left_anti")) for t in state.rels))
    for e in nodes:
        state = without_nodes(state, df.select(ref(e.id).alias("gone_id")).distinct())
    comp.graph.apply(state)
    out = comp.spark.createDataFrame([(sum(counts[: len(nodes)]), sum(counts[len(nodes) :]))], "deleted_nodes bigint, deleted_relationships bigint")
    return Frame(out, Scope({n: column(n, LONG) for n in out.columns}))


def without_nodes(state: catalog.State, gone: DataFrame) -> catalog.State:
    """The snapshot without the nodes (gone_id) and their relationships."""
    nodes = tuple(t.but(t.df.join(gone, t.df["id"] == gone["gone_id"], "left_anti")) for t in state.nodes)
    rels = []
    for t in state.rels:
        df = t.df.join(gone, t.df["src"] == gone["gone_id"], "left_anti")
        again = gone.select(F.col("gone_id").alias("gone_id2"))
        rels.append(t.but(df.join(again, df["dst"] == again["gone_id2"], "left_anti")))
    return state.but(nodes=nodes, rels=tuple(rels))


def do_foreach(comp: Compiler, c: A.Foreach, f: Frame) -> Frame:
    base = Frame(cut(f.df), f.scope, f.unit, f.keys)
    inner = comp.do_unwind(A.Unwind(c.source, c.var), base)
    inner.unit = False
    comp.clauses(c.clauses, inner)
    return base


def do_schema(comp: Compiler, c: A.Schema, f: Frame) -> Frame:
    g, o = comp.graph, c.options
    if c.action == "create_index":
        rows = [vars(g.create_index(o["entity"], o["label"], o["property"], o["unique"]))]
    elif c.action == "create_constraint":
        rows = [vars(g.create_constraint(o["entity"], o["label"], o["property"], o["kind"], o.get("type"), o["name"]))]
    elif c.action == "drop_index":
        rows = [{"name": o["name"], "dropped": g.drop_index(o["name"], o["if_exists"])}]
    elif c.action == "drop_constraint":
        rows = [{"name": o["name"], "dropped": g.drop_constraint(o["name"], o["if_exists"])}]
    elif c.action == "show_indexes":
        rows = [vars(x) for x in comp.state.indexes]
    else:
        rows = [vars(x) for x in comp.state.constraints]
    schema = {
        "create_index": "name string, entity string, label string, property string, unique boolean",
        "show_indexes": "name string, entity string, label string, property string, unique boolean",
        "create_constraint": "name string, entity string, label string, property string, kind string, type string",
        "show_constraints": "name string, entity string, label string, property string, kind string, type string",
    }.get(c.action, "name string, dropped boolean")
    df = comp.spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    out = Frame(df, Scope({n: column(n, df.schema[n].dataType) for n in df.columns}))
    return comp.filter(out, c.where) if c.where is not None else out
