"""Queries of the general data-processing problems (2, 4, 5, 6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import nested, orphans, rejects, skew
from trellis.tables import read, spread

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(spread(read(spark, d, "people_raw"))).select("line_id")


def p2_rejected(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(spread(read(spark, d, "people_raw")))


def p2_valid(spark: SparkSession, d: str) -> DataFrame:
    return rejects.accepted(spread(read(spark, d, "people_raw")))


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines per file and reason."""
    return rejects.rejected(spread(read(spark, d, "people_raw"))).groupBy("file_name", "reason").agg(F.count("*").alias("n_lines"))


def _owned(spark: SparkSession, d: str) -> DataFrame:
    return nested.owners(spread(read(spark, d, "nodes")), "nodes").unionByName(nested.owners(spread(read(spark, d, "relationships")), "relationships"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_objects(_owned(spark, d)).select("owner_table", "owner_id", "path", "parent_path")


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every scalar with its object and path; numbers as double, other values as text."""
    number = F.col("kind") == "number"
    fields = nested.scalar_fields(_owned(spark, d)).withColumn("number", F.when(number, F.col("value").cast("double")))
    return fields.withColumn("value", F.when(~number, F.col("value"))).distinct()


def _relationships(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "relationships").select("id", "source_node_id", "target_node_id", "type", "created_at")


def p5_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Per source node and type: distinct relationships, distinct targets, first and last creation."""
    return skew.skew_aggregate(
        _relationships(spark, d), ["source_node_id", "type"], {"n_rels": "id", "n_targets": "target_node_id"}, low={"first_at": "created_at"}, high={"last_at": "created_at"}
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rels = _relationships(spark, d)
    pairs = rels.where(F.col("source_node_id").isNotNull() & F.col("type").isNotNull() & F.col("id").isNotNull())
    counts = skew.skew_counts(pairs, ["source_node_id", "type"], "id", "n_rels")
    total = rels.agg(F.countDistinct("id").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n_rels") * 100 >= F.col("total")).select("source_node_id", "type")  # total: one row


def _node_deltas(spark: SparkSession, d: str) -> DataFrame:
    return orphans.existence_deltas(read(spark, d, "nodes"), "id", "created_at", read(spark, d, "node_deletions"), "node_id", "deleted_at")


def _people_deltas(spark: SparkSession, d: str) -> DataFrame:
    return orphans.existence_deltas(read(spark, d, "people").where(F.col("type") == "node"), "id", "loaded_at")


def _node_references(spark: SparkSession, d: str) -> DataFrame:
    rels, vectors = read(spark, d, "relationships"), read(spark, d, "vector_entries")
    parts = [orphans.reference_deltas(rels, "relationships", {"number": "id"}, f, "created_at") for f in ("source_node_id", "target_node_id")]
    vectors = vectors.withColumn("ref_number", F.col("node_id"))
    parts.append(orphans.reference_deltas(vectors, "vector_entries", {"text": "index_name", "number": "ref_number"}, "node_id", "updated_at"))
    return reduce(DataFrame.unionByName, parts)


def _people_references(spark: SparkSession, d: str) -> DataFrame:
    return orphans.reference_deltas(read(spark, d, "people"), "people", {"number": "rec_no"}, "start", "loaded_at")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    nodes = orphans.orphan_references(_node_references(spark, d), _node_deltas(spark, d))
    return nodes.unionByName(orphans.orphan_references(_people_references(spark, d), _people_deltas(spark, d)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("refs")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field and month."""
    return _orphans(spark, d).groupBy("ref_table", "ref_field", "period").agg(F.count("*").alias("n_orphans"))


def p6_current(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are referred to and do not exist now, per table and field, with the number of references."""
    nodes = orphans.current_orphans(orphans.reference_counts(_node_references(spark, d)), orphans.changes(_node_deltas(spark, d)))
    people = orphans.current_orphans(orphans.reference_counts(_people_references(spark, d)), orphans.changes(_people_deltas(spark, d)))
    return nodes.withColumn("key", F.col("key").cast("string")).unionByName(people)


def p6_advanced(spark: SparkSession, d: str) -> DataFrame:
    """p6_current for the nodes by two batches of deltas, those before 2024 and the later ones (and those of no time)."""
    early = lambda df: df.where(F.col("at") < F.lit("2024-01-01").cast("timestamp"))
    late = lambda df: df.where(F.coalesce(F.col("at") >= F.lit("2024-01-01").cast("timestamp"), F.lit(True)))
    references, deltas = _node_references(spark, d), _node_deltas(spark, d)
    refs, ledger = orphans.reference_counts(early(references)), orphans.changes(early(deltas))
    return orphans.current_orphans(*orphans.advance(refs, ledger, late(references), late(deltas)))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_rejected": p2_rejected,
    "p2_valid": p2_valid,
    "p2_reasons": p2_reasons,
    "p4_found": p4_found,
    "p4_fields": p4_fields,
    "p5_found": p5_found,
    "p5_per_key": p5_per_key,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_current": p6_current,
    "p6_advanced": p6_advanced,
}

_FOUND6 = """
WITH born AS (SELECT id, min(created_at) AS at FROM nodes GROUP BY id),
gone AS (SELECT node_id, min(deleted_at) AS at FROM node_deletions GROUP BY node_id),
refs AS (
  SELECT 'relationships' AS ref_table, CAST(id AS VARCHAR) AS ref_key, 'source_node_id' AS ref_field, source_node_id AS k, created_at AS at FROM relationships
  UNION ALL SELECT 'relationships', CAST(id AS VARCHAR), 'target_node_id', target_node_id, created_at FROM relationships
  UNION ALL SELECT 'vector_entries', index_name || ':' || CAST(node_id AS VARCHAR), 'node_id', node_id, updated_at FROM vector_entries),
people_born AS (SELECT id, min(loaded_at) AS at FROM people WHERE type = 'node' GROUP BY id),
found AS (
  SELECT DISTINCT ref_table, ref_key, ref_field, strftime(refs.at, '%Y-%m') AS period
  FROM refs LEFT JOIN born ON born.id = k LEFT JOIN gone ON gone.node_id = k
  WHERE k IS NOT NULL AND (born.at IS NULL OR born.at > refs.at OR (gone.at IS NOT NULL AND gone.at <= refs.at))
  UNION
  SELECT 'people', CAST(p.rec_no AS VARCHAR), 'start', strftime(p.loaded_at, '%Y-%m')
  FROM people p LEFT JOIN people_born b ON b.id = p.start
  WHERE p.start IS NOT NULL AND (b.at IS NULL OR b.at > p.loaded_at))
"""

_FIELD = r"(\"(?:[^\"]|\"\")*\"|[^\",]*)"
_CSV = ",".join([_FIELD] * 7)
_VALUE = """CASE WHEN starts_with(f['{0}'], '"') THEN replace(f['{0}'][2:-2], '""', '"') ELSE f['{0}'] END"""
_WORD = r"[^\s\p{Z}]"  # something that isn't blank
_FOUND2 = f"""
WITH csv AS (
  SELECT line_id, regexp_full_match(line, '{_CSV}', 's') AS ok, regexp_extract(line, '^{_CSV}$', ['type', 'id', 'labels', 'name', 'a', 'b', 'c'], 's') AS f FROM people_raw WHERE format = 'csv'),
csv_values AS (SELECT line_id, ok, {", ".join(f"{_VALUE.format(c)} AS v_{c}" for c in ("type", "id", "labels", "name", "a", "b", "c"))} FROM csv),
csv_good AS (
  SELECT line_id FROM csv_values WHERE ok AND (
    (v_type = 'node' AND regexp_matches(v_id, '{_WORD}') AND regexp_matches(v_name, '{_WORD}') AND len(list_filter(string_split(v_labels, ';'), lambda x: NOT regexp_matches(x, '{_WORD}'))) = 0)
    OR (v_type = 'relationship' AND regexp_matches(v_a, '{_WORD}') AND regexp_matches(v_b, '{_WORD}')))),
js AS (SELECT line_id, CAST(line AS JSON) AS j FROM people_raw WHERE format = 'jsonl' AND json_valid(line)),
js_good AS (
  SELECT line_id FROM js WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.type') = 'VARCHAR' AND (
    (j ->> '$.type' = 'node' AND json_type(j, '$.id') = 'VARCHAR' AND regexp_matches(j ->> '$.id', '{_WORD}')
     AND json_type(j, '$.properties.name') = 'VARCHAR' AND regexp_matches(j ->> '$.properties.name', '{_WORD}')
     AND json_type(j, '$.labels') = 'ARRAY' AND json_array_length(j, '$.labels') > 0
     AND len(list_filter(CAST(j -> '$.labels' AS JSON[]), lambda x: coalesce(json_type(x), 'NULL') <> 'VARCHAR' OR NOT regexp_matches(x ->> '$', '{_WORD}'))) = 0)
    OR (j ->> '$.type' = 'relationship' AND json_type(j, '$.start') = 'VARCHAR' AND json_type(j, '$.end') = 'VARCHAR'
     AND regexp_matches(j ->> '$.start', '{_WORD}') AND regexp_matches(j ->> '$.end', '{_WORD}'))))
"""
_REJECTED2 = _FOUND2 + "SELECT line_id FROM people_raw WHERE line_id NOT IN (SELECT line_id FROM csv_good UNION ALL SELECT line_id FROM js_good)"
_TEXTS = lambda j: f"nullif(list_filter({j}, lambda x: x <> ''), [])"
_VALID2 = (
    _FOUND2
    + f"""
SELECT p.line_id, file_name, format, v_type AS type, nullif(v_id, '') AS id, {_TEXTS("string_split(v_labels, ';')")} AS labels, nullif(v_name, '') AS name, nullif(v_a, '') AS start,
  nullif(v_b, '') AS "end", nullif(v_c, '') AS label
FROM csv_good JOIN csv_values USING (line_id) JOIN people_raw p USING (line_id)
UNION ALL
SELECT p.line_id, file_name, format, j ->> '$.type', {", ".join(f"CASE WHEN json_type(j, '$.{c}') = 'VARCHAR' THEN nullif(j ->> '$.{c}', '') END" for c in ("id",))},
  {_TEXTS("list_transform(CASE WHEN json_type(j, '$.labels') = 'ARRAY' THEN CAST(j -> '$.labels' AS JSON[]) END, lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' END)")},
  {", ".join(f"CASE WHEN json_type(j, '$.{c}') = 'VARCHAR' THEN nullif(j ->> '$.{c}', '') END" for c in ("properties.name", "start", "end", "label"))}
FROM js_good JOIN js USING (line_id) JOIN people_raw p USING (line_id)"""
)
_TREE = """SELECT DISTINCT '{0}' AS owner_table, s.id AS owner_id, replace(substr(t.fullkey, 2), '"', '') AS p
  FROM (SELECT DISTINCT id, properties FROM {0} WHERE id IS NOT NULL AND json_valid(properties)) AS s, json_tree(s.properties) AS t WHERE t.type = 'OBJECT' AND t.fullkey <> '$'"""
_FOUND4 = f"""
WITH tree AS ({_TREE.format("nodes")} UNION ALL {_TREE.format("relationships")})
SELECT owner_table, owner_id, ltrim(p, '.') AS path, regexp_replace(ltrim(p, '.'), '\\.?[^.\\[\\]]*(\\[\\d+\\])*$', '') AS parent_path FROM tree
"""

_SCALARS = """SELECT DISTINCT '{0}' AS owner_table, s.id AS owner_id, ltrim(replace(substr(t.fullkey, 2), '"', ''), '.') AS path, t.type, t.atom ->> '$' AS value
  FROM (SELECT DISTINCT id, properties FROM {0} WHERE id IS NOT NULL AND json_valid(properties)) AS s, json_tree(s.properties) AS t WHERE t.type NOT IN ('OBJECT', 'ARRAY') AND t.fullkey <> '$'"""
_FIELDS4 = f"""
WITH scalars AS ({_SCALARS.format("nodes")} UNION ALL {_SCALARS.format("relationships")})
SELECT owner_table, owner_id, path, regexp_replace(path, '\\.?[^.\\[\\]]*(\\[\\d+\\])*$', '') AS parent_path,
  CASE WHEN path NOT LIKE '%]' THEN regexp_extract(path, '[^.]*$') END AS key, TRY_CAST(regexp_extract(path, '\\[(\\d+)\\]$', 1) AS INTEGER) AS position,
  CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  CASE WHEN type IN ('VARCHAR', 'BOOLEAN', 'NULL') THEN coalesce(value, 'null') END AS value, CASE WHEN type NOT IN ('VARCHAR', 'BOOLEAN', 'NULL') THEN CAST(value AS DOUBLE) END AS number FROM scalars
"""

_CURRENT6 = """
WITH gone AS (SELECT DISTINCT node_id FROM node_deletions WHERE node_id IS NOT NULL), refs AS (
  SELECT 'relationships' AS ref_table, 'source_node_id' AS ref_field, source_node_id AS k FROM relationships
  UNION ALL SELECT 'relationships', 'target_node_id', target_node_id FROM relationships
  UNION ALL SELECT 'vector_entries', 'node_id', node_id FROM vector_entries)
SELECT ref_table, ref_field, CAST(k AS VARCHAR) AS key, count(*) AS refs FROM refs
WHERE k IS NOT NULL AND (k NOT IN (SELECT id FROM nodes WHERE id IS NOT NULL) OR k IN (SELECT node_id FROM gone)) GROUP BY ref_table, ref_field, k
"""

SQL: dict[str, str] = {
    "p4_fields": _FIELDS4,
    "p2_found": _REJECTED2,
    "p2_valid": _VALID2,
    "p4_found": _FOUND4,
    "p5_found": """SELECT source_node_id, type FROM (SELECT source_node_id, type, count(DISTINCT id) AS n FROM relationships
        WHERE source_node_id IS NOT NULL AND type IS NOT NULL GROUP BY source_node_id, type)
        WHERE n * 100 >= (SELECT count(DISTINCT id) FROM relationships)""",
    "p5_per_key": """SELECT source_node_id, type, count(DISTINCT id) AS n_rels, count(DISTINCT target_node_id) AS n_targets,
        min(created_at) AS first_at, max(created_at) AS last_at FROM relationships GROUP BY source_node_id, type""",
    "p6_found": _FOUND6 + "SELECT ref_table, ref_key, ref_field, period FROM found",
    "p6_report": _FOUND6 + "SELECT ref_table, ref_field, period, count(*) AS n_orphans FROM found GROUP BY ref_table, ref_field, period",
    "p6_current": _CURRENT6
    + """UNION ALL
        SELECT 'people', 'start', start, count(*) FROM people
        WHERE start IS NOT NULL AND start NOT IN (SELECT id FROM people WHERE type = 'node' AND id IS NOT NULL) GROUP BY start""",
    "p6_advanced": _CURRENT6.replace("CAST(k AS VARCHAR)", "k"),
}
