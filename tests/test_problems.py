"""The general data-processing operators against brute force, with nulls, repeats, ties, empty tables and extra columns."""

import json
import random
import re
from collections import Counter, defaultdict
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from trellis.operators import nested, orphans, rejects, skew

RAW = "line_id bigint, file_name string, format string, line string, reason string"


def raw(spark, lines):
    return spark.createDataFrame([(k, "f", kind, line, "clash") for k, (kind, line) in enumerate(lines)], RAW)


def test_reject_reasons(spark):
    lines = [
        ("csv", 'node,a,Person;X,"B, ""c""",,,'),
        ("csv", 'node,a,Person,"open,,,'),
        ("csv", "node,b,Person,ok,,,"),
        ("csv", 'x"y,"abc,Person,n,,,'),
        ("csv", "relationship,,,,a,b,KNOWS"),
        ("csv", "relationship,,,,a,b"),
        ("csv", 'node,"a"x,Person,n,,,'),
        ("csv", 'node,a,Person,n "q" m,,,'),
        ("csv", "node,a,Person;;X,n,,,"),
        ("csv", "node;a;Person;n;;;"),
        ("csv", "Node,a,Person,n,,,"),
        ("csv", "node, ,Person,n,,,"),
        ("jsonl", ' {"type":"node","id":"a","labels":["P"],"properties":{"name":"n"},"more":NaN}'),
        ("jsonl", ' {"type":"node","id":"a","labels":["P"],"properties":{"name":"n"},"more":1} '),
        ("jsonl", '{"type":"node","id":7,"labels":["P"],"properties":{"name":"n"}}'),
        ("jsonl", '{"type":"node","id":"a","labels":["P",""],"properties":{"name":"n"}}'),
        ("jsonl", '{"type":"node","id":"a","labels":["P"],"properties":{"name":" "}}'),
        ("jsonl", '{"type":"relationship","start":"a","end":"b"}{}'),
        ("jsonl", '{"type":"relationship","start":"a","end":"b"}'),
        ("jsonl", '["type"]'),
        ("jsonl", "[" * 100_000),
        ("jsonl", None),
        ("csv", ""),
        (None, "x"),
    ]
    found = {r.line_id: r.reason for r in rejects.rejected(raw(spark, lines)).collect()}
    assert sorted(set(range(len(lines))) - set(found)) == [0, 2, 4, 13, 18]
    assert found[1] == found[3] == found[6] == "broken quoting" and "column" in found[5] and found[21] == found[22] == "no content" and found[23] == "unknown format"
    good = {r.line_id: r for r in rejects.accepted(raw(spark, lines)).collect()}
    assert good[0].labels == ["Person", "X"] and good[0].name == 'B, "c"' and good[4].end == "b" and good[13].name == "n"
    assert rejects.parse_lines(raw(spark, lines).limit(0)).count() == 0


CSV_LINE = re.compile(r'("(?:[^"]|"")*"|[^",]*)' + r',("(?:[^"]|"")*"|[^",]*)' * 6, re.S)


def is_record(kind, line):
    """The definition of a valid record, line by line."""
    if kind == "csv":
        if not (m := CSV_LINE.fullmatch(line)):
            return False
        values = [x[1:-1].replace('""', '"') if x[:1] == '"' else x for x in m.groups()]
        r = dict(zip(("type", "id", "labels", "name", "start", "end"), values))
        r["labels"] = r["labels"].split(";")
    else:
        if not is_json(line) or not isinstance(r := json.loads(line), dict):
            return False
        r["name"] = r["properties"].get("name") if isinstance(r.get("properties"), dict) else None
    blank = lambda x: not isinstance(x, str) or not x.strip()
    if r.get("type") == "node":
        return not (blank(r.get("id")) or not isinstance(r.get("labels"), list) or not r["labels"] or any(map(blank, r["labels"])) or blank(r["name"]))
    return r.get("type") == "relationship" and not blank(r.get("start")) and not blank(r.get("end"))


def test_rejects_match_the_definition_on_altered_lines(spark):
    r = random.Random(5)
    csv = ['node,a,Person;X,"B, ""c""",,,', "node,b,Person,ok,,,", 'relationship,,,,"a","b",KNOWS', 'node,"ä",P,"x;y",,,L', 'node,a,P,"",,,']
    js = ['{"type":"node","id":"a","labels":["P"],"properties":{"name":"n"}}', '{"type":"relationship","start":"a","end":"b","properties":null}', '{"labels":["a","b"],"type":"node","properties":{"name":"ü","x":[1]},"id":"\\u0041"}']
    lines = [("jsonl", '{"type":"node","id":"\\ud800","labels":["P"],"properties":{"name":"n"}}'), ("csv", "node,\u3000,P,n,,,"), ("csv", "node,\x85,P,n,,,"), ("csv", 'node,a,P,"open to the end,,,')]
    for k in range(3000):
        kind = "csv" if k % 2 else "jsonl"
        t = r.choice(csv if k % 2 else js)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            p = r.randrange(len(t) + 1)
            t = t[:p] + r.choice(['"', '"', '""', ",", ";", " ", "a", "{", "]", "0", "\\", ":", '"x', "\t"]) * r.randrange(2) + t[p + r.randrange(2) :]
        lines.append((kind, t))
    df = spark.createDataFrame([(k, f"f{k % 3}", kind, t) for k, (kind, t) in enumerate(lines)], "line_id bigint, file_name string, format string, line string")
    want = {k for k, (kind, t) in enumerate(lines) if not is_record(kind, t)}
    got = {x.line_id: x.reason for x in rejects.rejected(df).collect()}
    assert {(lines[k], got.get(k)) for k in set(got) ^ want} == set() and 500 < len(want) < 2500
    assert rejects.accepted(df).count() == len(lines) - len(want)
    long = spark.createDataFrame([(k, "f", "csv", "node,a,P," + "n" * 3_000_000 + ('"' if k % 2 else "") + ",,,") for k in range(6)] + [(9, "f", "csv", "node,a,P,\"x\ny\",,,")], df.schema)
    assert {x.line_id for x in rejects.rejected(long).collect()} == {1, 3, 5}


def is_json(text):
    """By Python's parser, without what no UTF-8 text can hold."""
    try:
        json.dumps(json.loads(text, parse_constant=lambda _: int("x")), ensure_ascii=False).encode()
    except (ValueError, RecursionError):
        return False
    return True


def brute_objects(value, path="", parent=None):
    """(path, parent_path) of nested objects."""
    if isinstance(value, dict):
        if parent is not None:
            yield path, parent
        for k, v in value.items():
            yield from brute_objects(v, f"{path}.{k}" if path else k, path)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute_objects(v, f"{path}[{i}]", parent if parent is not None else "")


TEXTS = [
    '{"a":{"b":[1,{"c":{}},[{"d":"x,{y}:[z]"},null]]},"e":[]}',
    '{"q\\"k":{"w\\\\":{"z":{}}}, "u\\u0041":[{},{}]}',
    ' [ {"a":{}}, 3, [[{"b":{"c":1}}]] ] ',
    '{"a":{"b":{"c":{"d":{"e":{"f":[[[{}]]]}}}}}}',
    '{"a":{"b":1}',
    '{"a":{"b":NaN}}',
    "",
    None,
    "3",
    '"{{"',
    '{"ä":{"ö":{"s":"\\\\\\""}},"t":{"x":1.5e3,"y":true,"z":"p, q"}}',
]


def test_nested_objects_match_a_recursive_walk(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[0])]
    owned = nested.owners(spark.createDataFrame(rows, "id bigint, properties string"), "nodes")
    got = sorted((r.owner_id, r.path, r.parent_path) for r in nested.child_objects(owned).collect())
    want = sorted((k, *x) for k, t in enumerate(TEXTS) if t and is_json(t) for x in brute_objects(json.loads(t)))
    assert got == want
    fields = {(r.owner_id, r.path): (r.parent_path, r.key, r.position, r.kind, r.value) for r in nested.scalar_fields(owned).collect()}
    assert fields[0, "a.b[2][0].d"] == ("a.b[2][0]", "d", None, "string", "x,{y}:[z]") and fields[0, "a.b[0]"] == ("a", None, 0, "number", "1") and fields[0, "a.b[2][1]"][3:] == ("null", "null")
    assert fields[10, "t.x"][3:] == ("number", "1.5e3") and fields[10, "t.z"][4] == "p, q" and fields[10, "ä.ö.s"][4] == '\\"' and fields[2, "[1]"] == ("", None, 1, "number", "3")
    assert nested.child_objects(owned.limit(0)).count() == 0


def test_strict_json_matches_the_parser_on_altered_texts():
    r = random.Random(3)
    texts = [*TEXTS, "[1,]", '{"a":1,}', "1 2", "01", "\\", '"', '{"a" 1}', "[{} {}]", '{"a":"\\ud800"}', '{"\\udc00":{}}', '{"\\ud83d\\ude00":{}}', '{"a":"\x01"}', '["\\x"]']
    for t in [t for t in TEXTS if t and is_json(t)] * 200:
        for _ in range(r.randrange(1, 3)):
            p = r.randrange(len(t) + 1)
            t = t[:p] + r.choice(['{', '}', '[', ']', ',', ':', '"', '\\', '1', 'e', ' ', 'u', '-', '.']) * r.randrange(2) + t[p + r.randrange(2) :]
        texts.append(t)
    assert nested.strict(pa.array(texts)).tolist() == [bool(t) and is_json(t) for t in texts]
    assert nested.strict(pa.array([], pa.string())).tolist() == []
    assert nested.strict(pa.array(["[" * n + "]" * n for n in (1000, 1001, 100_000)])).tolist() == [True, False, False]  # depth is bounded


def test_nested_block_boundaries():
    texts = pa.array([t for t in TEXTS if t and is_json(t)] * 3)[1:]
    row, path, parent, _, _ = nested.Shape(texts).objects()
    want = sorted((k, *x) for k, t in enumerate(texts.to_pylist()) for x in brute_objects(json.loads(t)))
    assert sorted(zip(row.tolist(), path.to_pylist(), parent.to_pylist())) == want


def test_skewed_aggregate_matches_plain_counts(spark):
    rows = [(i, 1 if i % 3 else i % 50, "A" if i % 2 else None, i % 17) for i in range(3000)] + [(5, 1, "A", 5)] * 40 + [(9999, None, "B", None)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, t string, v bigint")
    got = {(r.k, r.t): (r.n, r.nv, r.lo, r.hi, r.rows) for r in skew.skew_aggregate(df, ["k", "t"], {"n": "id", "nv": "v"}, {"lo": "v"}, {"hi": "v"}, rows="rows", support=0.1).collect()}
    want = defaultdict(lambda: ([], []))
    for i, k, t, v in rows:
        want[k, t][0].append(i)
        want[k, t][1].append(v)
    assert got == {
        x: (len(set(a)), len({y for y in b if y is not None}), min((y for y in b if y is not None), default=None), max((y for y in b if y is not None), default=None), len(a)) for x, (a, b) in want.items()
    }
    assert skew.skew_counts(df.limit(0), ["k", "t"], "id").count() == 0


def test_skewed_join_keeps_every_row(spark):
    left = spark.createDataFrame([(7 if i % 4 else i, i) for i in range(400)] + [(None, 1)], "key bigint, x bigint")
    right = spark.createDataFrame([(i, i * 2) for i in range(0, 300, 3)] + [(7, 14)], "key bigint, y bigint")
    got = Counter((r.key, r.x, r.y) for r in skew.skew_join(left, right, "key", support=0.1).collect())
    assert got == Counter((r.key, r.x, r.y) for r in left.join(right, "key", "left").collect()) and sum(got.values()) == 401


def test_all_branches_see_one_sketch(spark):
    rels = spark.range(1000).selectExpr("IF(id % 3 = 0, id, 7) AS key", "CAST(id AS STRING) AS t", "id AS x")
    right = spark.range(0, 1000, 3).selectExpr("id AS key", "id * 2 AS y")
    for df in (skew.skew_join(rels, right, "key", support=0.1), skew.skew_aggregate(rels, ["key", "t"], {"n": "x"}, support=0.1)):
        df.collect()
        assert "collect_frequent_items" not in df._jdf.queryExecution().toString()
    assert skew.heavy_keys(rels, ["key", "t"], 0.1).dtypes == [("key", "bigint"), ("t", "string")]


def at(day):
    return datetime(2024, 1, day)


def test_orphans_at_their_time_and_now(spark):
    nodes = spark.createDataFrame([(1, at(2)), (1, at(2)), (2, at(5)), (3, at(1))], "id bigint, created_at timestamp")
    gone = spark.createDataFrame([(3, at(9)), (3, at(9)), (8, at(1))], "node_id bigint, deleted_at timestamp")
    deltas = orphans.existence_deltas(nodes, "id", "created_at", gone, "node_id", "deleted_at")
    state = orphans.changes(deltas)
    refs = spark.createDataFrame([(10, 1, at(2)), (11, 1, at(1)), (12, 2, at(3)), (13, 3, at(8)), (14, 3, at(9)), (15, 7, at(3)), (16, None, at(3)), (17, 8, at(4)), (18, 1, None)], "id bigint, n bigint, t timestamp")
    plus = orphans.reference_deltas(refs, "r", {"number": "id"}, "n", "t")
    found = {r.ref_key: r.period for r in orphans.orphan_references(plus, state).collect()}
    assert found == {"11": "2024-01", "12": "2024-01", "14": "2024-01", "15": "2024-01", "17": "2024-01", "18": None}
    minus = orphans.reference_deltas(refs.where("id = 15"), "r", {"number": "id"}, "n", "t", -1)  # a reference withdrawn
    assert {r.ref_key for r in orphans.orphan_references(plus.unionByName(minus), state).collect()} == set(found) - {"15"}
    book = orphans.reference_counts(plus)
    assert {r.key for r in orphans.current_orphans(book, state).collect()} == {3, 7, 8}
    born = spark.createDataFrame([(7, 1, at(20)), (8, 1, at(20)), (1, 1, at(25)), (1, -1, at(26)), (3, 1, at(27))], "key bigint, delta int, at timestamp")
    for first, second in ((deltas, born), (born, deltas)):  # in either order
        refs_now, ledger = orphans.advance(orphans.reference_counts(plus.limit(0)), orphans.changes(first), plus, second)
        assert {r.key for r in orphans.current_orphans(refs_now, ledger).collect()} == {1, 3, 8}
    assert orphans.orphan_references(plus.limit(0), state).count() == 0 and orphans.orphan_references(plus, state.limit(0)).count() == 8
