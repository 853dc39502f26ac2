"""The store of runs, findings, triage and examples: joins, set differences, ranks and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import norm_key
from weftline.operators import joins as J
from weftline.operators import windows as W
from weftline.plans.problems import _sql_key as k
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
_SEV = "nullif(upper(trim(severity)), '')"
_RANK = "CASE sev WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END"
_F = f"f AS (SELECT row_id, {k('run_id')} AS run, {k('fingerprint')} AS fp, rule_id AS rule, path, line, {_SEV} AS sev, ingested_at FROM findings)"
_T = f"t AS (SELECT fp, arg_max(state, (updated_at, row_id)) AS state, arg_max(updated_at, (updated_at, row_id)) AS changed_at FROM (SELECT {k('fingerprint')} AS fp, replace(replace(lower(trim(state)), '-', '_'), ' ', '_') AS state, updated_at, row_id FROM triage) WHERE fp IS NOT NULL GROUP BY fp)"


def rank_of(column: str) -> F.Column:
    out = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(F.col(column) == s, i).otherwise(out)
    return out


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with comparable keys and severities."""
    sev = F.upper(F.trim("severity"))
    return table(spark, sf, "findings").select("row_id", norm_key("run_id").alias("run"), norm_key("fingerprint").alias("fp"), F.col("rule_id").alias("rule"), "path", "line", F.when(sev != "", sev).alias("sev"), "ingested_at")


def triage(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of each fingerprint."""
    rows = table(spark, sf, "triage").select(norm_key("fingerprint").alias("fp"), F.struct("updated_at", "row_id", F.translate(F.lower(F.trim("state")), "- ", "__").alias("state")).alias("r"))
    return rows.where("fp is not null").groupBy("fp").agg(F.max("r").alias("r")).select("fp", F.col("r.state").alias("state"), F.col("r.updated_at").alias("at"))


@query(f"SELECT r.row_id, b.bytes FROM (SELECT row_id, {k('report_digest')} AS d FROM runs) r JOIN (SELECT {k('digest')} AS d, max(bytes) AS bytes FROM blobs GROUP BY 1) b ON r.d = b.d")
def run_reports(spark: SparkSession, sf: str) -> DataFrame:
    """J-1: runs joined with their report by its digest."""
    blobs = table(spark, sf, "blobs").groupBy(norm_key("digest").alias("d")).agg(F.max("bytes").alias("bytes"))
    return table(spark, sf, "runs").select("row_id", norm_key("report_digest").alias("r")).join(blobs, F.col("r") == F.col("d")).select("row_id", "bytes")


@query(
    f"""WITH {_F}, {_T}, now AS (SELECT max(ingested_at) AS ts FROM findings), s AS (SELECT fp, changed_at + INTERVAL 180 DAY AS expires FROM t WHERE state = 'false_positive')
    SELECT f.row_id, t.state, s.fp IS NOT NULL AS suppressed FROM f CROSS JOIN now LEFT JOIN t ON f.fp = t.fp LEFT JOIN s ON f.fp = s.fp AND s.expires > now.ts"""
)
def findings_annotated(spark: SparkSession, sf: str) -> DataFrame:
    """J-3: findings with triage and with suppressions that have not expired; the time is in the join condition."""
    rows, states = findings(spark, sf).select("row_id", "fp"), triage(spark, sf)
    now = rows.sparkSession.read.parquet(f"{sf}/findings.parquet").agg(F.max("ingested_at").alias("now"))
    suppressed = states.where("state = 'false_positive'").select(F.col("fp").alias("s_fp"), F.expr("at + interval 180 days").alias("until"))
    with_state = rows.join(F.broadcast(now)).join(states.select(F.col("fp").alias("t_fp"), "state"), F.col("fp") == F.col("t_fp"), "left")
    return J.valid_at(with_state, suppressed, F.col("fp") == F.col("s_fp"), F.col("until"), F.col("now")).select("row_id", "state", F.col("s_fp").isNotNull().alias("suppressed"))


@query(f"WITH {_F} SELECT rule, count(*) AS findings FROM f WHERE fp IN (SELECT {k('fingerprint')} FROM triage) GROUP BY rule")
def triaged_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """J-4: existence by a semi-join."""
    known = table(spark, sf, "triage").select(norm_key("fingerprint").alias("t_fp"))
    return findings(spark, sf).join(known, F.col("fp") == F.col("t_fp"), "left_semi").groupBy("rule").agg(F.count(F.lit(1)).alias("findings"))


@query(f"SELECT DISTINCT {k('digest')} AS digest FROM blobs WHERE {k('digest')} NOT IN (SELECT d FROM (SELECT {k('report_digest')} AS d FROM runs UNION ALL SELECT {k('content_digest')} FROM examples) WHERE d IS NOT NULL)")
def unreferenced_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """J-5: blobs that nothing names, by an anti-join (nulls on either side can't empty it)."""
    used = table(spark, sf, "runs").select(norm_key("report_digest").alias("u")).unionByName(table(spark, sf, "examples").select(norm_key("content_digest").alias("u")))
    own = table(spark, sf, "blobs").select(norm_key("digest").alias("digest")).where("digest is not null").distinct()
    return own.join(used, F.col("digest") == F.col("u"), "left_anti")


@query(f"WITH {_F}, {_T} SELECT f.row_id, CASE WHEN t.state = 'confirmed' THEN 'confirmed' ELSE 'open' END AS note FROM f LEFT JOIN t ON f.fp = t.fp WHERE coalesce(t.state, '') <> 'false_positive'")
def suppression_filter(spark: SparkSession, sf: str) -> DataFrame:
    """J-6: drops what was judged false, marks what was confirmed."""
    joined = findings(spark, sf).select("row_id", "fp").join(triage(spark, sf).select(F.col("fp").alias("t_fp"), "state"), F.col("fp") == F.col("t_fp"), "left")
    return joined.where(F.coalesce("state", F.lit("")) != "false_positive").select("row_id", F.when(F.col("state") == "confirmed", "confirmed").otherwise("open").alias("note"))


@query("SELECT row_id, created_at FROM runs ORDER BY created_at DESC, row_id DESC LIMIT 50")
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    """L-2: the newest rows (the limit is the feature)."""
    return table(spark, sf, "runs").select("row_id", "created_at").orderBy(F.desc("created_at"), F.desc("row_id")).limit(50)


@query(f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {k('root_digest')} ORDER BY created_at DESC, row_id DESC) AS n FROM runs) WHERE n > 10")
def retention_victims(spark: SparkSession, sf: str) -> DataFrame:
    """L-3, R-3: everything after the newest ten of each root."""
    rows = table(spark, sf, "runs").select("row_id", "created_at", norm_key("root_digest").alias("root"))
    return W.occurrence(rows, ["root"], [F.desc("created_at"), F.desc("row_id")], "n").where("n > 10").select("row_id")


@query(f"WITH {_F} SELECT row_id, sev, path FROM f ORDER BY {_RANK}, path NULLS LAST, line NULLS LAST, row_id LIMIT 100")
def worst_findings(spark: SparkSession, sf: str) -> DataFrame:
    """L-4, L-5: custom order by severity, then by place."""
    return findings(spark, sf).orderBy(rank_of("sev"), F.asc_nulls_last("path"), F.asc_nulls_last("line"), "row_id").limit(100).select("row_id", "sev", "path")


@query("SELECT path, count(*) AS findings FROM findings WHERE path IS NOT NULL GROUP BY path ORDER BY findings DESC, path LIMIT 20")
def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """L-6: paths with most findings; partial counts before the exchange, so a hot path costs nothing."""
    return table(spark, sf, "findings").where("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("findings")).orderBy(F.desc("findings"), "path").limit(20)


@query(f"WITH {_F}, {_T} SELECT rule, count(*) AS judged, round(sum(CASE WHEN state = 'confirmed' THEN 1 ELSE 0 END) * 1.0 / count(*), 3) AS precision FROM f JOIN t ON f.fp = t.fp WHERE state IN ('confirmed', 'false_positive') AND rule IS NOT NULL GROUP BY rule HAVING count(*) >= 3")
def rule_precision(spark: SparkSession, sf: str) -> DataFrame:
    """A-18, T-19: precision of rules with enough verdicts."""
    judged = findings(spark, sf).where("rule is not null").join(triage(spark, sf).where("state in ('confirmed', 'false_positive')").select(F.col("fp").alias("t_fp"), "state"), F.col("fp") == F.col("t_fp"))
    return judged.groupBy("rule").agg(F.count(F.lit(1)).alias("judged"), F.round(F.count_if(F.col("state") == "confirmed") / F.count(F.lit(1)), 3).alias("precision")).where("judged >= 3")


@query(f"WITH {_F} SELECT sev, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM findings), 4) AS pct FROM f GROUP BY sev")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-4, A-5: value counts with their share."""
    counts = findings(spark, sf).groupBy("sev").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("sev", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("pct"))


@query(f"WITH {_F} SELECT row_id, fp || CASE WHEN n > 1 THEN ':' || n ELSE '' END AS report_key FROM (SELECT row_id, fp, row_number() OVER (PARTITION BY run, fp ORDER BY row_id) AS n FROM f WHERE fp IS NOT NULL AND run IS NOT NULL)")
def finding_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """W-9: repeated fingerprints of a run get a suffix."""
    rows = findings(spark, sf).where("fp is not null and run is not null").select("row_id", "run", "fp")
    numbered = W.occurrence(rows, ["run", "fp"], ["row_id"], "n")
    return numbered.select("row_id", F.when(F.col("n") > 1, F.concat_ws(":", "fp", "n")).otherwise(F.col("fp")).alias("report_key"))


@query(f"WITH {_F} SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY run, path, line, rule ORDER BY ingested_at DESC, row_id DESC) AS n FROM f) WHERE n = 1")
def findings_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """T-2, W-10: one finding a place and rule, the last to arrive."""
    return W.first_per_key(findings(spark, sf).select("row_id", "run", "path", "line", "rule", "ingested_at"), ["run", "path", "line", "rule"], [F.desc("ingested_at"), F.desc("row_id")]).select("row_id")


@query(f"WITH {_F} SELECT path, CASE min({_RANK}) WHEN 0 THEN 'failed' WHEN 1 THEN 'failed' WHEN 5 THEN 'clean' ELSE 'findings' END AS status, count(DISTINCT rule) AS rules FROM f WHERE path IS NOT NULL GROUP BY path")
def file_status(spark: SparkSession, sf: str) -> DataFrame:
    """T-3: a status for each path from its worst finding."""
    per = findings(spark, sf).where("path is not null").groupBy("path").agg(F.min(rank_of("sev")).alias("worst"), F.countDistinct("rule").alias("rules"))
    return per.select("path", F.when(F.col("worst") <= 1, "failed").when(F.col("worst") == 5, "clean").otherwise("findings").alias("status"), "rules")


@query(f"WITH {_F} SELECT run, fp, count(DISTINCT sev) AS severities FROM f WHERE run IS NOT NULL AND fp IS NOT NULL GROUP BY run, fp HAVING count(DISTINCT sev) > 1")
def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """A-26: one claim with several values."""
    return findings(spark, sf).where("run is not null and fp is not null").groupBy("run", "fp").agg(F.countDistinct("sev").alias("severities")).where("severities > 1")


@query(f"SELECT run_id, reported, coalesce(derived, 0) AS derived, CASE WHEN reported IS NULL THEN 'unknown' WHEN reported = coalesce(derived, 0) THEN 'observed' ELSE 'refuted' END AS verdict FROM (SELECT {k('run_id')} AS run_id, max(findings) AS reported FROM runs GROUP BY 1) r LEFT JOIN (SELECT {k('run_id')} AS run, count(DISTINCT {k('fingerprint')}) AS derived FROM findings GROUP BY 1) f ON r.run_id = f.run WHERE run_id IS NOT NULL")
def reported_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A-29: totals that runs report against those derived from their rows."""
    derived = findings(spark, sf).groupBy("run").agg(F.countDistinct("fp").alias("derived"))
    runs = table(spark, sf, "runs").groupBy(norm_key("run_id").alias("run_id")).agg(F.max("findings").alias("reported"))
    verdict = F.when(F.col("reported").isNull(), "unknown").when(F.col("reported") == F.col("derived"), "observed").otherwise("refuted")
    both = runs.join(derived, F.col("run_id") == F.col("run"), "left").withColumn("derived", F.coalesce("derived", F.lit(0)))
    return both.where("run_id is not null").select("run_id", "reported", "derived", verdict.alias("verdict"))


@query("SELECT difficulty, expected_rule, count(*) AS examples, round(100.0 * sum(detected) / count(*), 2) AS detected_pct FROM examples GROUP BY difficulty, expected_rule")
def detection_rates(spark: SparkSession, sf: str) -> DataFrame:
    """A-21: share of detected examples by difficulty and rule."""
    return table(spark, sf, "examples").groupBy("difficulty", "expected_rule").agg(F.count(F.lit(1)).alias("examples"), F.round(100.0 * F.sum("detected") / F.count(F.lit(1)), 2).alias("detected_pct"))


@query(
    """SELECT row_id, array_to_string(list_sort(list_distinct(d)), ',') AS detected_set, list_contains(d, expected_rule) AS hit, CAST(len(list_distinct(list_filter(d, lambda x: x <> expected_rule))) AS INTEGER) AS others
    FROM (SELECT row_id, expected_rule, CAST(from_json(detected_rules, '["VARCHAR"]') AS VARCHAR[]) AS d FROM examples)"""
)
def example_rule_sets(spark: SparkSession, sf: str) -> DataFrame:
    """S-24, S-25, O-5: JSON arrays to sets, membership and difference."""
    d = F.from_json("detected_rules", "array<string>")
    return table(spark, sf, "examples").select(
        "row_id", F.array_join(F.array_sort(F.array_distinct(d)), ",").alias("detected_set"), F.array_contains(d, F.col("expected_rule")).alias("hit"), F.size(F.array_distinct(F.filter(d, lambda x: x != F.col("expected_rule")))).alias("others")
    )


@query("SELECT rule, count(*) AS examples FROM (SELECT unnest(from_json(detected_rules, '[\"VARCHAR\"]')) AS rule FROM examples) GROUP BY rule ORDER BY examples DESC, rule LIMIT 25")
def most_detected_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A-4, S-26: counts over exploded arrays."""
    rules = table(spark, sf, "examples").select(F.explode(F.from_json("detected_rules", "array<string>")).alias("rule"))
    return rules.groupBy("rule").agg(F.count(F.lit(1)).alias("examples")).orderBy(F.desc("examples"), "rule").limit(25)


@query(
    f"""WITH snap AS (SELECT run_id, root, profile, lag(run_id) OVER w AS before, lag(profile) OVER w AS before_profile, row_number() OVER (PARTITION BY root ORDER BY created_at DESC, run_id DESC) AS back FROM (
        SELECT {k('run_id')} AS run_id, arg_max({k('root_digest')}, (ingested_at, row_id)) AS root, arg_max(profile_identity_state, (ingested_at, row_id)) AS profile, arg_max(created_at, (ingested_at, row_id)) AS created_at FROM runs GROUP BY 1) WHERE root IS NOT NULL WINDOW w AS (PARTITION BY root ORDER BY created_at, run_id)),
    {_F}, fps AS (SELECT DISTINCT run, fp FROM f WHERE run IS NOT NULL AND fp IS NOT NULL),
    pairs AS (SELECT run_id, before, root FROM snap WHERE back = 1 AND before IS NOT NULL AND profile = before_profile),
    side AS (SELECT p.root, fp, 1 AS cur, 0 AS old FROM pairs p JOIN fps ON run = p.run_id UNION ALL SELECT p.root, fp, 0, 1 FROM pairs p JOIN fps ON run = p.before),
    m AS (SELECT root, fp, max(cur) AS cur, max(old) AS old FROM side GROUP BY ALL)
    SELECT root, CAST(count_if(cur = 1 AND old = 1) AS BIGINT) AS persistent, CAST(count_if(cur = 1 AND old = 0) AS BIGINT) AS new, CAST(count_if(cur = 0 AND old = 1) AS BIGINT) AS resolved FROM m GROUP BY root"""
)
def run_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """O-3: persistent, new and resolved fingerprints of the last two runs of each root, only where their profiles agree."""
    rows = table(spark, sf, "runs").select(norm_key("run_id").alias("run_id"), F.struct("ingested_at", "row_id", norm_key("root_digest").alias("root"), F.col("profile_identity_state").alias("profile"), "created_at").alias("r"))
    last = rows.groupBy("run_id").agg(F.max("r").alias("r")).select("run_id", "r.root", "r.profile", "r.created_at").where("root is not null")
    two = W.top_per_key(last, ["root"], [F.desc("created_at"), F.desc("run_id")], 2)
    pair = two.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("created_at", "run_id", "profile"))).alias("p")).where((F.size("p") == 2) & (F.col("p")[0]["profile"] == F.col("p")[1]["profile"]))
    sides = pair.select("root", F.explode(F.array(F.struct(F.col("p")[1]["run_id"].alias("id"), F.lit(1).alias("cur")), F.struct(F.col("p")[0]["run_id"].alias("id"), F.lit(0).alias("cur")))).alias("s")).select("root", "s.id", "s.cur")
    fps = findings(spark, sf).where("fp is not null").select("run", "fp").distinct()
    seen = sides.join(fps, F.col("id") == F.col("run")).groupBy("root", "fp").agg(F.max("cur").alias("cur"), F.max(1 - F.col("cur")).alias("old"))
    return seen.groupBy("root").agg(F.count_if((F.col("cur") == 1) & (F.col("old") == 1)).alias("persistent"), F.count_if((F.col("cur") == 1) & (F.col("old") == 0)).alias("new"), F.count_if((F.col("cur") == 0) & (F.col("old") == 1)).alias("resolved"))


@query(
    """WITH y AS (SELECT o_custkey AS id, year(o_orderdate) AS y, count(*) AS orders FROM orders GROUP BY ALL), b AS (SELECT min(y) AS y FROM y)
    SELECT coalesce(a.id, c.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' WHEN a.orders <> c.orders THEN 'changed' ELSE 'unchanged' END AS change
    FROM (SELECT * FROM y WHERE y = (SELECT y FROM b)) a FULL OUTER JOIN (SELECT * FROM y WHERE y = (SELECT y + 1 FROM b)) c ON a.id = c.id"""
)
def keyed_diff(spark: SparkSession, sf: str) -> DataFrame:
    """O-4: added, removed, changed and unchanged keys between two states (orders of a customer in two years)."""
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("orders"))
    first = F.broadcast(per.agg(F.min("y").alias("b")))
    old = per.join(first).where("y = b").select("id", F.col("orders").alias("old"))
    new = per.join(first).where("y = b + 1").select(F.col("id").alias("new_id"), F.col("orders").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return old.join(new, F.col("id") == F.col("new_id"), "full_outer").select(F.coalesce("id", "new_id").alias("id"), change.alias("change"))


_PREFIXES = [("PY", 0.9), ("PY-SQLI", 0.95), ("JS", 0.7), ("JS-XSS", 0.8), ("C", 0.5), ("GO", 0.75), ("JAVA", 0.65), ("JAVA-DESER", 0.85), ("PHP-SQLI", 0.9)]
_PREF_SQL = ", ".join(f"('{p}', CAST({v} AS DOUBLE))" for p, v in _PREFIXES)


@query(f"SELECT rule_id, coalesce(arg_max(v, length(p)), 0.6) AS confidence FROM (SELECT DISTINCT rule_id FROM findings WHERE rule_id IS NOT NULL) LEFT JOIN (VALUES {_PREF_SQL}) AS x(p, v) ON starts_with(rule_id, p) GROUP BY rule_id")
def rule_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """J-13: the value of the longest prefix wins, else a default."""
    rules = table(spark, sf, "findings").select("rule_id").where("rule_id is not null").distinct()
    return J.longest_prefix(rules, "rule_id", spark.createDataFrame(_PREFIXES, "p string, confidence double"), "p", "confidence", 0.6)


_WEIGHT = """CASE WHEN regexp_matches(path, '(^|/)(vendor|node_modules|third_party)/') THEN 0.0 WHEN regexp_matches(path, '(_pb2|\\.min|_generated)\\.') THEN 0.0 WHEN regexp_matches(path, '(^|/)(generated|build|dist)/') THEN 0.1
    WHEN regexp_matches(path, '(^|/)tests?/|_test\\.') THEN 0.4 WHEN regexp_matches(path, '(^|/)legacy/') THEN 0.5 ELSE 1.0 END"""


def path_weight(path: str) -> F.Column:
    """P-7: the weight of the first class that a path falls into."""
    c = F.col(path)
    return (
        F.when(c.rlike(r"(^|/)(vendor|node_modules|third_party)/"), 0.0)
        .when(c.rlike(r"(_pb2|\.min|_generated)\."), 0.0)
        .when(c.rlike(r"(^|/)(generated|build|dist)/"), 0.1)
        .when(c.rlike(r"(^|/)tests?/|_test\."), 0.4)
        .when(c.rlike(r"(^|/)legacy/"), 0.5)
        .otherwise(1.0)
    )


_BOOST = "CASE sev WHEN 'CRITICAL' THEN 1.2 WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.8 WHEN 'LOW' THEN 0.5 ELSE 0.3 END"


@query(
    f"""WITH {_F}, c AS (SELECT rule_id, coalesce(arg_max(v, length(p)), 0.6) AS conf FROM (SELECT DISTINCT rule_id FROM findings WHERE rule_id IS NOT NULL) LEFT JOIN (VALUES {_PREF_SQL}) AS x(p, v) ON starts_with(rule_id, p) GROUP BY rule_id)
    SELECT row_id, priority, CASE WHEN priority >= 0.5 THEN 'report' WHEN priority >= 0.2 THEN 'review' ELSE 'suppress' END AS action
    FROM (SELECT row_id, round(CAST(conf AS DOUBLE) * CAST({_WEIGHT} AS DOUBLE) * CAST({_BOOST} AS DOUBLE), 4) AS priority FROM f JOIN c ON rule = rule_id WHERE path IS NOT NULL)"""
)
def triage_priority(spark: SparkSession, sf: str) -> DataFrame:
    """L-7, P-5, P-7, P-8, P-12: product of rule confidence, path weight and severity boost, with bands."""
    boost = F.when(F.col("sev") == "CRITICAL", 1.2).when(F.col("sev") == "HIGH", 1.0).when(F.col("sev") == "MEDIUM", 0.8).when(F.col("sev") == "LOW", 0.5).otherwise(0.3)
    prefixes = spark.createDataFrame(_PREFIXES, "p string, confidence double")
    rows = J.longest_prefix(findings(spark, sf).where("path is not null and rule is not null"), "rule", prefixes, "p", "confidence", 0.6)
    scored = rows.select("row_id", F.round(F.col("confidence") * path_weight("path") * boost, 4).alias("priority"))
    return scored.withColumn("action", F.when(F.col("priority") >= 0.5, "report").when(F.col("priority") >= 0.2, "review").otherwise("suppress"))


_POINTS = "least(10000, greatest(0, (CASE sev WHEN 'CRITICAL' THEN 6000 WHEN 'HIGH' THEN 4500 WHEN 'MEDIUM' THEN 2500 WHEN 'LOW' THEN 1000 ELSE 0 END) + (CASE WHEN line IS NOT NULL THEN 500 ELSE 0 END) + (CASE WHEN regexp_matches(path, '_test\\.') THEN -1500 ELSE 0 END)))"


@query(
    f"""WITH {_F} SELECT row_id, CAST({_POINTS} AS BIGINT) AS score, row_number() OVER (PARTITION BY run ORDER BY {_POINTS} DESC, fp NULLS LAST, path NULLS LAST, line NULLS LAST, row_id) AS rank,
    concat_ws(',', CASE WHEN sev IN ('CRITICAL', 'HIGH') THEN 'severe' END, CASE WHEN line IS NOT NULL THEN 'located' END, CASE WHEN regexp_matches(path, '_test\\.') THEN 'test' END) AS reasons FROM f WHERE run IS NOT NULL"""
)
def review_rank(spark: SparkSession, sf: str) -> DataFrame:
    """L-8, W-8: a fixed-point score with its reasons, and the rank inside a run."""
    test = F.coalesce(F.col("path").rlike(r"_test\."), F.lit(False))
    points = F.when(F.col("sev") == "CRITICAL", 6000).when(F.col("sev") == "HIGH", 4500).when(F.col("sev") == "MEDIUM", 2500).when(F.col("sev") == "LOW", 1000).otherwise(0)
    score = F.least(F.lit(10000), F.greatest(F.lit(0), points + F.when(F.col("line").isNotNull(), 500).otherwise(0) + F.when(test, -1500).otherwise(0))).cast("long")
    reasons = F.concat_ws(",", F.when(F.col("sev").isin("CRITICAL", "HIGH"), "severe"), F.when(F.col("line").isNotNull(), "located"), F.when(test, "test"))
    rows = findings(spark, sf).where("run is not null").withColumns({"score": score, "reasons": reasons})
    ranked = W.occurrence(rows, ["run"], [F.desc("score"), F.asc_nulls_last("fp"), F.asc_nulls_last("path"), F.asc_nulls_last("line"), "row_id"], "rank")
    return ranked.select("row_id", "score", F.col("rank").cast("long").alias("rank"), "reasons")


@query(f"WITH {_F} SELECT rule, row_id FROM (SELECT rule, row_id, row_number() OVER (PARTITION BY rule ORDER BY {_RANK}, row_id) AS n FROM f WHERE rule IS NOT NULL) WHERE n <= 3")
def top_per_rule(spark: SparkSession, sf: str) -> DataFrame:
    """W-16: a few of each group (the limit is the feature); the group limit is applied before the exchange too."""
    return W.top_per_key(findings(spark, sf).where("rule is not null").withColumn("_r", rank_of("sev")), ["rule"], ["_r", "row_id"], 3).select("rule", "row_id")


@query(f"WITH {_F} SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY run, path, rule, line // 10 ORDER BY row_id) AS n FROM f WHERE line IS NOT NULL) WHERE n = 1")
def coarse_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """W-17: one finding for each rule and ten lines of a path."""
    rows = findings(spark, sf).where("line is not null").select("row_id", "run", "path", "rule", F.floor(F.col("line") / 10).alias("b"))
    return W.first_per_key(rows, ["run", "path", "rule", "b"], ["row_id"]).select("row_id")


@query(f"WITH {_F}, base AS (SELECT DISTINCT {k('fingerprint')} AS fp FROM triage WHERE {k('fingerprint')} IS NOT NULL) SELECT run, count(*) AS new_findings, bool_or(coalesce(sev IN ('CRITICAL', 'HIGH'), false)) AS blocked FROM f WHERE run IS NOT NULL AND fp IS NOT NULL AND fp NOT IN (SELECT fp FROM base) GROUP BY run")
def baseline_gate(spark: SparkSession, sf: str) -> DataFrame:
    """J-26: what a baseline lacks, and whether any of it is severe enough to block."""
    base = table(spark, sf, "triage").select(norm_key("fingerprint").alias("b")).where("b is not null")
    new = findings(spark, sf).where("run is not null and fp is not null").join(base, F.col("fp") == F.col("b"), "left_anti")
    return new.groupBy("run").agg(F.count(F.lit(1)).alias("new_findings"), F.bool_or(F.coalesce(F.col("sev").isin("CRITICAL", "HIGH"), F.lit(False))).alias("blocked"))


_CH = "ch AS (SELECT path, CAST(min(line) AS BIGINT) AS line FROM code_findings WHERE path IS NOT NULL AND line IS NOT NULL GROUP BY path)"


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    """A changed line for each path that the code findings name."""
    return table(spark, sf, "code_findings").where("path is not null and line is not null").groupBy("path").agg(F.min("line").cast("long").alias("changed"))


@query(f"WITH {_CH} SELECT c.record_id, abs(c.line - ch.line) AS distance FROM code_findings c JOIN ch ON c.path = ch.path WHERE abs(c.line - ch.line) <= 5")
def near_changes(spark: SparkSession, sf: str) -> DataFrame:
    """J-8, P-9, D14: findings within five lines of a change, by buckets of lines."""
    own = table(spark, sf, "code_findings").select("record_id", "path", F.col("line").cast("long").alias("line"))
    return J.near(own, _changed(spark, sf), "path", "line", 5, other="changed").select("record_id", F.abs(F.col("line") - F.col("changed")).alias("distance"))


@query(f"WITH {_CH} SELECT DISTINCT c.record_id FROM code_findings c JOIN ch ON c.path = ch.path AND c.line BETWEEN ch.line AND ch.line + 200")
def in_changed_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """J-25: findings inside a changed range of their path."""
    own = table(spark, sf, "code_findings").select("record_id", "path", F.col("line").cast("long").alias("line"))
    spans = _changed(spark, sf).withColumn("till", F.col("changed") + 200)
    return J.in_ranges(own, spans, "path", "line", "changed", "till").select("record_id").distinct()


@query(
    """WITH fn AS (SELECT record_id AS f, path, CAST(line AS BIGINT) AS a, CAST(line + 40 AS BIGINT) AS b FROM code_findings WHERE kind = 'AIFinding' AND path IS NOT NULL AND line IS NOT NULL)
    SELECT c.record_id, arg_max(fn.f, (fn.a, fn.f)) AS enclosing FROM code_findings c JOIN fn ON c.path = fn.path AND c.line BETWEEN fn.a AND fn.b WHERE c.kind = 'Finding' GROUP BY c.record_id"""
)
def enclosing_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """J-14: the innermost of the ranges around a line."""
    rows = table(spark, sf, "code_findings").where("path is not null and line is not null")
    ranges = rows.where("kind = 'AIFinding'").select("path", F.col("line").cast("long").alias("a"), (F.col("line") + 40).cast("long").alias("b"), F.col("record_id").alias("enclosing"))
    return J.innermost(rows.where("kind = 'Finding'").withColumn("line", F.col("line").cast("long")), ranges, "record_id", "path", "line", "a", "b", "enclosing")


@query(f"WITH {_CH} SELECT ch.path, count(*) AS findings, CAST(count_if(abs(c.line - ch.line) <= 10) AS BIGINT) AS near FROM code_findings c JOIN ch ON c.path = ch.path WHERE c.line IS NOT NULL GROUP BY ch.path")
def patch_scores(spark: SparkSession, sf: str) -> DataFrame:
    """J-28: findings in changed files, and those within ten lines of the change."""
    own = table(spark, sf, "code_findings").where("line is not null").select("path", F.col("line").cast("long").alias("line"))
    joined = own.join(_changed(spark, sf).withColumnRenamed("path", "p"), F.col("path") == F.col("p"))
    return joined.groupBy("path").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.abs(F.col("line") - F.col("changed")) <= 10).alias("near"))
