"""What reaches the scans, and what the plans leave out."""

from pyspark.sql import functions as F

from trellis.graph import Graph
from trellis.operators import skew


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def graph(spark, folder):
    spark.range(100).selectExpr("id AS ck", "concat('s', id % 3) AS segment", "id * 1.5D AS bal", "'x' AS wide").write.parquet(f"{folder}/c")
    spark.range(300).selectExpr("id AS ok", "id % 100 AS o_ck", "id * 2.5D AS price", "'y' AS note").write.parquet(f"{folder}/o")
    opened = []

    def table(name, *columns):
        def load():
            opened.append(name)
            return spark.read.parquet(f"{folder}/{name}").select(*columns or "*")

        return load

    g = Graph(spark).register_nodes("C", table("c"), "ck").register_nodes("O", table("o"), "ok").register_nodes("Other", table("missing"), "k")
    return g.register_relationships("PLACED", table("o", "o_ck", "ok"), ("C", "o_ck"), ("O", "ok")), opened


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    g, opened = graph(spark, str(tmp_path))
    df = g.execute("MATCH (c:C)-[:PLACED]->(o) WHERE c.segment = 's1' AND o.price > 100.0 RETURN c.bal AS bal, COUNT(*) AS n")
    text = plan(df)
    assert "EqualTo(segment,s1)" in text and "GreaterThan(price,100.0)" in text and "wide" not in text and "note" not in text
    assert "missing" not in opened and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text
    want = sum(1 for k in range(300) if (k % 100) % 3 == 1 and k * 2.5 > 100)
    assert df.agg(F.sum("n")).first()[0] == want


def test_equality_across_patterns_is_an_equi_join(spark, tmp_path):
    g, _ = graph(spark, str(tmp_path))
    text = plan(g.execute("MATCH (a:C), (b:C) WHERE a.segment = b.segment AND a.ck < b.ck RETURN COUNT(*) AS n"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_keeps_k_rows_a_task(spark, tmp_path):
    g, _ = graph(spark, str(tmp_path))
    assert "TakeOrderedAndProject" in plan(g.execute("MATCH (c:C) RETURN c.ck AS k ORDER BY k DESC LIMIT 3"))


def test_heavy_keys_are_few(spark):
    df = spark.range(10_000).select((F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id"))).alias("k"))
    heavy = [r.k for r in skew.heavy_keys(df, ["k"], 0.01).collect()]
    assert 1 in heavy and len(heavy) <= 100


def test_closed_chains_meet_from_both_ends(spark):
    people = [(k, k % 4) for k in range(40)]
    shops = [(k, k % 5) for k in range(12)]
    visits = [(k, (k * 7) % 40, (k * 5) % 12) for k in range(200)]
    sold = [(s, (s * 3 + j) % 9) for s in range(12) for j in range(3)]
    bought = [(k, k % 9) for k in range(200)]
    g = Graph(spark)
    for label, rows, schema, key in (("P", people, "p bigint, town bigint", "p"), ("S", shops, "s bigint, s_town bigint", "s"), ("V", visits, "v bigint, v_p bigint, v_s bigint", "v"), ("T", [(k,) for k in range(5)], "t bigint", "t"), ("I", [(k,) for k in range(9)], "i bigint", "i")):
        g.register_nodes(label, spark.createDataFrame(rows, schema), key)
    g.register_relationships("IN", spark.createDataFrame(people, "p bigint, town bigint"), ("P", "p"), ("T", "town"))
    g.register_relationships("IN", spark.createDataFrame(shops, "s bigint, s_town bigint"), ("S", "s"), ("T", "s_town"))
    g.register_relationships("MADE", spark.createDataFrame([(p, v) for v, p, _ in visits], "v_p bigint, v bigint"), ("P", "v_p"), ("V", "v"))
    g.register_relationships("OF", spark.createDataFrame(bought, "b_v bigint, b_i bigint"), ("V", "b_v"), ("I", "b_i"))
    g.register_relationships("SELLS", spark.createDataFrame(sold, "o_s bigint, o_i bigint"), ("S", "o_s"), ("I", "o_i"))
    want = sorted((p, v, i, s, town) for v, p, _ in visits for b, i in bought if b == v for s, j in sold if j == i for town in [dict(people)[p]] if dict(shops)[s] == town)
    text = "MATCH (p:P)-[:MADE]->(v:V)-[:OF]->(i:I)<-[:SELLS]-(s:S)-[:IN]->(t:T)<-[x:IN]-(p) RETURN p.p AS p, v.v AS v, i.i AS i, s.s AS s, t.t AS t"
    df = g.execute(text)
    assert sorted(map(tuple, df.collect())) == want and len(want) > 50
    joins = [line for line in plan(df).splitlines() if "Join" in line and "[" in line]
    assert any(line.count("#") >= 4 for line in joins)  # the shops meet items and towns by one join on both
    back = "MATCH (p)-[:IN]->(t:T)<-[:IN]-(s:S)-[:SELLS]->(i:I)<-[:OF]-(v:V)<-[:MADE]-(p:P) WHERE s.s > 3 RETURN COUNT(*) AS n, COUNT(DISTINCT t.t) AS towns"
    assert tuple(g.execute(back).first()) == (sum(r[3] > 3 for r in want), len({r[4] for r in want if r[3] > 3}))
    named = "MATCH q = (p:P)-[:MADE]->(v:V)-[:OF]->(i:I)<-[:SELLS]-(s:S)-[:IN]->(t:T)<-[:IN]-(p) RETURN COUNT(*) AS n, MAX(length(q)) AS l"
    assert tuple(g.execute(named).first()) == (len(want), 5)
