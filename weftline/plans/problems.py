"""Queries of the general data problems: orphan references, snapshot changes, hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import WHITE, key128, norm_key, norm_word, packed_key, unpacked_key
from weftline.operators.hierarchy import build_hierarchy, descendants
from weftline.operators.orphans import KeyFilter, find_orphans, orphan_counts, parent_keys
from weftline.operators.snapshots import number_in_series, snapshot_changes
from weftline.session import cut
from weftline.sources.tables import table

#: ref_table: (reference, parent table, key of the parent, its deletion mark)
REFERENCES = {
    "runs": ("report_digest", "blobs", "digest", "deleted_at"),
    "findings": ("run_id", "runs", "run_id", "deleted_at"),
    "examples": ("content_digest", "blobs", "digest", "deleted_at"),
    "triage": ("fingerprint", "findings", "fingerprint", None),
}


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters: dict[str, KeyFilter] = {}
    parts = []
    for name, (reference, parent_name, parent_key, deleted) in REFERENCES.items():
        parent = table(spark, sf_dir, parent_name)
        if parent_name not in filters:
            filters[parent_name] = KeyFilter(parent_keys(parent, parent_key))
        found = find_orphans(table(spark, sf_dir, name), reference, parent, parent_key, deleted=deleted, known=filters[parent_name])
        parts.append(found.withColumn("ref_table", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: rows of the four referring tables without a valid target."""
    return _orphans(spark, sf_dir).select("ref_table", "row_id", "orphan_kind")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: the same per table, month of ingested_at and kind, beside the number of references."""
    refs = reduce(
        DataFrame.unionByName,
        [table(spark, sf_dir, name).where(norm_key(F.col(reference)).isNotNull()).select(F.lit(name).alias("ref_table"), "ingested_at") for name, (reference, *_) in REFERENCES.items()],
    )
    return orphan_counts(refs, _orphans(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: records added, removed or changed in severity from one snapshot of a root to the next."""
    runs = table(spark, sf_dir, "runs").select(
        norm_key("run_id").alias("snapshot"),
        F.struct("ingested_at", "row_id", norm_key("root_digest").alias("root"), norm_word("status").alias("status"), "created_at", F.col("deleted_at").isNotNull().alias("gone")).alias("r"),
    )
    last = runs.where(F.col("snapshot").isNotNull()).groupBy("snapshot").agg(F.max("r").alias("r"))
    complete = last.where(~F.col("r.gone") & F.col("r.root").isNotNull() & (F.col("r.status") == "complete"))
    complete = complete.select("snapshot", key128(F.col("r.root")).alias("series"), F.col("r.created_at").alias("created_at"))
    snapshots = number_in_series(complete, "series", ["created_at", "snapshot"], F.date_trunc("month", "created_at"))
    records = (
        table(spark, sf_dir, "findings")
        .select(norm_key("run_id").alias("snapshot"), packed_key(norm_key("fingerprint")).alias("key"), norm_word("severity").alias("value"), F.struct("ingested_at", "row_id").alias("version"))
        .where(F.col("snapshot").isNotNull() & F.col("key").isNotNull())
    )
    return snapshot_changes(records, snapshots.drop("created_at")).select(F.col("snapshot").alias("run_id"), unpacked_key(F.col("key")).alias("fingerprint"), "change_kind")


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (example_id) with their own digest as key and that of their parent."""
    rows = table(spark, sf_dir, "examples").select("example_id", F.struct("ingested_at", "row_id", key128(norm_key("content_digest")).alias("own"), key128(norm_key("parent_digest")).alias("above")).alias("r"))
    last = rows.where(F.col("example_id").isNotNull()).groupBy("example_id").agg(F.max("r").alias("r"))
    return last.select(F.col("example_id").alias("node"), F.col("r.own").alias("key"), F.col("r.above").alias("parent"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: root and depth of every example; '' and -1 for those that links in a ring cut off."""
    tree = build_hierarchy(_examples(spark, sf_dir))
    return tree.select(F.col("node").alias("example_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: full path and number of descendants of every example."""
    tree = build_hierarchy(_examples(spark, sf_dir), paths=True)
    return tree.select(F.col("node").alias("example_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "path", (F.col("size") - 1).alias("descendants"))


def p6_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: nested-set range of every example in its tree, from which all descendants can be read; its order of siblings is ours, so no SQL."""
    tree = build_hierarchy(_examples(spark, sf_dir))
    return tree.select(F.col("node").alias("example_id"), F.col("root").alias("root_id"), "lo", "hi")


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: all descendants of every example with a row whose row_id is divisible by 50, searched among all examples."""
    tree = cut(build_hierarchy(_examples(spark, sf_dir)))
    asked = table(spark, sf_dir, "examples").where("row_id % 50 = 0 and example_id is not null").select("example_id")
    return descendants(tree, asked).select(F.col("ancestor").alias("example_id"), F.col("node").alias("descendant_id"))


QUERIES = {f.__name__: f for f in (p4_found, p4_counts, p5_found, p6_found, p6_paths, p6_ranges, p6_descendants)}


def _sql_key(column: str) -> str:
    # chr() for the white space that a SQL text can't show
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    low = f"lower(trim({column}, {white}))"
    bare = f"(CASE WHEN starts_with({low}, 'sha256:') THEN substr({low}, 8) ELSE {low} END)"
    return f"nullif(nullif({bare}, ''), repeat('0', 64))"


def _sql_word(column: str) -> str:
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    return f"coalesce(lower(trim({column}, {white})), '')"


def _sql_orphans() -> str:
    parts = []
    for name, (reference, parent, key, deleted) in REFERENCES.items():
        gone = f"arg_max({deleted} IS NOT NULL, (ingested_at, row_id))" if deleted else "false"
        parts.append(f"""
SELECT '{name}' AS ref_table, c.row_id, c.ingested_at,
       CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.first_at > c.ingested_at THEN 'late' END AS orphan_kind
FROM (SELECT row_id, ingested_at, {_sql_key(reference)} AS k FROM {name}) c
LEFT JOIN (SELECT k, min(ingested_at) AS first_at, {gone} AS gone
           FROM (SELECT *, {_sql_key(key)} AS k FROM {parent}) WHERE k IS NOT NULL GROUP BY k) p ON c.k = p.k
WHERE c.k IS NOT NULL""")
    return " UNION ALL ".join(parts)


_REFS = " UNION ALL ".join(f"SELECT '{name}' AS ref_table, ingested_at FROM {name} WHERE {_sql_key(reference)} IS NOT NULL" for name, (reference, *_) in REFERENCES.items())
_TREE = f"""
WITH RECURSIVE last AS (
  SELECT example_id, arg_max({_sql_key('content_digest')}, (ingested_at, row_id)) AS own, arg_max(coalesce({_sql_key('parent_digest')}, ''), (ingested_at, row_id)) AS above
  FROM examples WHERE example_id IS NOT NULL GROUP BY example_id),
owner AS (SELECT own, min(example_id) AS parent FROM last WHERE own IS NOT NULL GROUP BY own),
link AS (SELECT l.example_id, o.parent FROM last l LEFT JOIN owner o ON l.above = o.own),
tree AS (
  SELECT example_id, example_id AS root_id, 0 AS depth, example_id AS path FROM link WHERE parent IS NULL
  UNION ALL
  SELECT l.example_id, t.root_id, t.depth + 1, t.path || '/' || l.example_id FROM link l JOIN tree t ON l.parent = t.example_id)
"""

SQL = {
    "p4_found": f"SELECT ref_table, row_id, orphan_kind FROM ({_sql_orphans()}) WHERE orphan_kind IS NOT NULL",
    "p4_counts": f"""
SELECT o.ref_table, o.month, o.orphan_kind, o.orphans, r.of_references
FROM (SELECT ref_table, coalesce(strftime(ingested_at, '%Y-%m'), 'unknown') AS month, orphan_kind, count(*) AS orphans
      FROM ({_sql_orphans()}) WHERE orphan_kind IS NOT NULL GROUP BY ALL) o
JOIN (SELECT ref_table, coalesce(strftime(ingested_at, '%Y-%m'), 'unknown') AS month, count(*) AS of_references FROM ({_REFS}) GROUP BY ALL) r
  ON o.ref_table = r.ref_table AND o.month = r.month""",
    "p5_found": f"""
WITH last AS (
  SELECT run_id, root, status, created_at, gone FROM (
    SELECT {_sql_key('run_id')} AS run_id, {_sql_key('root_digest')} AS root, {_sql_word('status')} AS status, created_at, deleted_at IS NOT NULL AS gone,
           row_number() OVER (PARTITION BY {_sql_key('run_id')} ORDER BY ingested_at DESC, row_id DESC) AS rn FROM runs)
  WHERE rn = 1 AND run_id IS NOT NULL),
snap AS (
  SELECT run_id, lag(run_id) OVER (PARTITION BY root ORDER BY created_at, run_id) AS before
  FROM last WHERE NOT gone AND root IS NOT NULL AND status = 'complete'),
rec AS (
  SELECT run_id, fp, sev FROM (
    SELECT {_sql_key('run_id')} AS run_id, {_sql_key('fingerprint')} AS fp, {_sql_word('severity')} AS sev,
           row_number() OVER (PARTITION BY {_sql_key('run_id')}, {_sql_key('fingerprint')} ORDER BY ingested_at DESC, row_id DESC) AS rn FROM findings)
  WHERE rn = 1 AND run_id IS NOT NULL AND fp IS NOT NULL),
cur AS (SELECT s.run_id, r.fp, r.sev FROM snap s JOIN rec r ON r.run_id = s.run_id WHERE s.before IS NOT NULL),
old AS (SELECT s.run_id, r.fp, r.sev FROM snap s JOIN rec r ON r.run_id = s.before)
SELECT coalesce(c.run_id, o.run_id) AS run_id, coalesce(c.fp, o.fp) AS fingerprint,
       CASE WHEN o.fp IS NULL THEN 'added' WHEN c.fp IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL OUTER JOIN old o ON c.run_id = o.run_id AND c.fp = o.fp
WHERE o.fp IS NULL OR c.fp IS NULL OR c.sev <> o.sev""",
    "p6_found": _TREE
    + """SELECT l.example_id, coalesce(t.root_id, '') AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth
FROM link l LEFT JOIN tree t ON l.example_id = t.example_id""",
    "p6_paths": _TREE
    + """, pairs AS (SELECT example_id, unnest(string_split(path, '/')) AS above FROM tree),
below AS (SELECT above, count(*) - 1 AS descendants FROM pairs GROUP BY above)
SELECT l.example_id, coalesce(t.root_id, '') AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth, t.path, b.descendants
FROM link l LEFT JOIN tree t ON l.example_id = t.example_id LEFT JOIN below b ON l.example_id = b.above""",
    "p6_descendants": _TREE
    + """, pairs AS (SELECT example_id, unnest(string_split(path, '/')) AS above FROM tree)
SELECT above AS example_id, example_id AS descendant_id FROM pairs
WHERE above <> example_id AND above IN (SELECT example_id FROM examples WHERE row_id % 50 = 0)""",
}
