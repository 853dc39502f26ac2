"""Evaluation over examples, opinions and code findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import norm_key
from weftline.operators import evaluation as E
from weftline.operators import windows as W
from weftline.plans.problems import _sql_key as k
from weftline.plans.registry import Registry
from weftline.plans.store import rank_of
from weftline.sources.tables import table

registry = Registry()
query = registry.query

_EX = "ex AS (SELECT row_id, example_id, language, difficulty, label, mutator_id, expected_rule, detected, CAST(from_json(detected_rules, '[\"VARCHAR\"]') AS VARCHAR[]) AS fired FROM examples)"


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "examples").select("row_id", "example_id", "language", "difficulty", "label", "mutator_id", "expected_rule", "detected", F.from_json("detected_rules", "array<string>").alias("fired"))


@query(
    f"""WITH {_EX}, n AS (SELECT count(*) AS n FROM ex),
    w AS (SELECT expected_rule AS rule, count(*) AS positives, CAST(count_if(list_contains(fired, expected_rule)) AS BIGINT) AS tp FROM ex WHERE expected_rule <> '' GROUP BY 1),
    x AS (SELECT rule, count(*) AS fp FROM (SELECT expected_rule, unnest(list_distinct(fired)) AS rule FROM ex) WHERE rule <> expected_rule GROUP BY 1),
    c AS (SELECT coalesce(w.rule, x.rule) AS rule, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(positives - tp, 0) AS fn FROM w FULL OUTER JOIN x ON w.rule = x.rule)
    SELECT rule, tp, fp, fn, n - tp - fp - fn AS tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
      round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 4) AS f1 FROM c, n"""
)
def confusion_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """A-7, A-8, S-18: confusion matrix and scores of each rule, fired or not."""
    return E.with_scores(E.rule_confusion(_examples(spark, sf), "expected_rule", "fired"))


@query(
    f"""WITH {_EX}, p AS (SELECT c.row_id, c.difficulty, list_filter(list_distinct(c.fired), lambda r: NOT list_contains(q.fired, r)) AS gained
      FROM (SELECT e.*, {k('parent_digest')} AS up FROM ex e JOIN (SELECT row_id AS rid, parent_digest FROM examples) ON rid = row_id) c
      JOIN (SELECT d, any_value(fired) AS fired FROM (SELECT {k('content_digest')} AS d, CAST(from_json(detected_rules, '["VARCHAR"]') AS VARCHAR[]) AS fired, row_number() OVER (PARTITION BY {k('content_digest')} ORDER BY ingested_at DESC, row_id DESC) AS n FROM examples) WHERE n = 1 GROUP BY d) q ON c.up = q.d)
    SELECT difficulty, count(*) AS pairs, CAST(count_if(len(gained) > 0) AS BIGINT) AS gained, round(100.0 * count_if(len(gained) > 0) / count(*), 4) AS gained_pct FROM p GROUP BY difficulty"""
)
def paired_difference(spark: SparkSession, sf: str) -> DataFrame:
    """A-9: rules that fire on an example but not on its parent."""
    rows = table(spark, sf, "examples").select("row_id", "difficulty", norm_key("content_digest").alias("own"), norm_key("parent_digest").alias("up"), F.from_json("detected_rules", "array<string>").alias("fired"), "ingested_at")
    parents = W.first_per_key(rows.where("own is not null"), ["own"], [F.desc("ingested_at"), F.desc("row_id")]).select(F.col("own").alias("p_own"), F.col("fired").alias("p_fired"))
    gained = F.size(F.array_except("fired", "p_fired")) > 0
    pairs = rows.join(parents, F.col("up") == F.col("p_own"))
    return pairs.groupBy("difficulty").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(gained).alias("gained"), F.round(100.0 * F.count_if(gained) / F.count(F.lit(1)), 4).alias("gained_pct"))


_OP = """op AS (SELECT opinion_id, backend, lower(regexp_replace(member, '[\\s_.-]+', '', 'g')) AS member, latency_ms,
  CASE lower(regexp_replace(verdict, '[\\s_.-]+', '', 'g')) WHEN 'exploitable' THEN 'EXPLOITABLE' WHEN 'notexploitable' THEN 'NOT_EXPLOITABLE' WHEN 'uncertain' THEN 'UNCERTAIN' END AS verdict,
  CASE WHEN confidence < 0 THEN NULL WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS conf, {key} AS finding FROM member_opinions)""".replace("{key}", k("finding"))


def opinions(spark: SparkSession, sf: str) -> DataFrame:
    """Opinions with comparable members, verdicts and confidences on one scale."""
    bare = F.lower(F.regexp_replace("verdict", r"[\s_.-]+", ""))
    verdict = F.when(bare == "exploitable", "EXPLOITABLE").when(bare == "notexploitable", "NOT_EXPLOITABLE").when(bare == "uncertain", "UNCERTAIN")
    conf = F.when(F.col("confidence") < 0, None).when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return table(spark, sf, "member_opinions").select("opinion_id", "backend", F.lower(F.regexp_replace("member", r"[\s_.-]+", "")).alias("member"), "latency_ms", verdict.alias("verdict"), conf.alias("conf"), norm_key("finding").alias("finding"))


_CAL = f"""WITH {_OP}, o AS (SELECT backend, member, conf, verdict = 'EXPLOITABLE' AS y, CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin FROM op WHERE conf BETWEEN 0 AND 1 AND verdict IS NOT NULL AND backend IS NOT NULL),
g AS (SELECT CASE grouping_id(backend, member) WHEN 3 THEN '' WHEN 1 THEN 'backend' ELSE 'backend,member' END AS stratum, backend, member, bin, count(*) AS samples, CAST(count_if(y) AS BIGINT) AS correct, avg(conf) AS mean, avg(pow(conf - CAST(y AS INTEGER), 2)) AS brier
  FROM o GROUP BY GROUPING SETS ((bin), (backend, bin), (backend, member, bin)))"""


def _calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = opinions(spark, sf).where("verdict is not null and backend is not null").withColumn("y", F.col("verdict") == "EXPLOITABLE")
    return E.calibration(rows, "conf", "y", [[], ["backend"], ["backend", "member"]])


@query(
    _CAL
    + """SELECT stratum, backend, member, bin, samples, correct, round(mean, 6) AS mean, round(brier, 6) AS brier, round(CASE WHEN samples >= 30 THEN correct / samples END, 6) AS share,
    round(greatest(0.0, (correct / samples + 3.8414588206941254 / (2.0 * samples)) / (1 + 3.8414588206941254 / samples) - 1.959963984540054 * sqrt(correct / samples * (1 - correct / samples) / samples + 3.8414588206941254 / (4.0 * samples * samples)) / (1 + 3.8414588206941254 / samples)), 6) AS low,
    round(least(1.0, (correct / samples + 3.8414588206941254 / (2.0 * samples)) / (1 + 3.8414588206941254 / samples) + 1.959963984540054 * sqrt(correct / samples * (1 - correct / samples) / samples + 3.8414588206941254 / (4.0 * samples * samples)) / (1 + 3.8414588206941254 / samples)), 6) AS high FROM g"""
)
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    """A-10, S-17: bins with Wilson intervals, overall, by backend and by member of it."""
    out = _calibration(spark, sf)
    return out.select("stratum", "backend", "member", "bin", "samples", "correct", *[F.round(c, 6).alias(c) for c in ("mean", "brier", "share", "low", "high")])


@query(
    _CAL
    + """, o2 AS (SELECT DISTINCT backend, member, bin FROM o)
    SELECT o2.backend, o2.member, o2.bin, round(coalesce(CASE WHEN m.samples >= 30 THEN m.correct / m.samples END, CASE WHEN b.samples >= 30 THEN b.correct / b.samples END, CASE WHEN a.samples >= 30 THEN a.correct / a.samples END), 6) AS share
    FROM o2 LEFT JOIN g m ON m.stratum = 'backend,member' AND m.backend = o2.backend AND m.member = o2.member AND m.bin = o2.bin LEFT JOIN g b ON b.stratum = 'backend' AND b.backend = o2.backend AND b.bin = o2.bin LEFT JOIN g a ON a.stratum = '' AND a.bin = o2.bin"""
)
def calibrated_share(spark: SparkSession, sf: str) -> DataFrame:
    """A-11: the share of the finest stratum that has enough samples."""
    cal = _calibration(spark, sf)
    own = cal.where("stratum = 'backend,member'").select("backend", "member", "bin", F.col("share").alias("s2"))
    mid = cal.where("stratum = 'backend'").select(F.col("backend").alias("b1"), F.col("bin").alias("n1"), F.col("share").alias("s1"))
    top = cal.where("stratum = ''").select(F.col("bin").alias("n0"), F.col("share").alias("s0"))
    joined = own.join(F.broadcast(mid), (F.col("backend") == F.col("b1")) & (F.col("bin") == F.col("n1")), "left").join(F.broadcast(top), F.col("bin") == F.col("n0"), "left")
    return joined.select("backend", "member", "bin", F.round(F.coalesce("s2", "s1", "s0"), 6).alias("share"))


@query(
    f"""WITH {_OP} SELECT backend, count(*) AS opinions, quantile_disc(latency_ms, 0.95) AS p95, median(latency_ms) AS median_ms, round(avg(latency_ms), 4) AS mean_ms, round(stddev_pop(latency_ms), 4) AS deviation_ms,
    min(latency_ms) AS least, max(latency_ms) AS most, round(sum(pow(latency_ms - m, 3)) / count(*) / pow(any_value(s), 3), 4) AS skew, round(sum(pow(latency_ms - m, 4)) / count(*) / pow(any_value(s), 4) - 3, 4) AS excess
    FROM (SELECT backend, CAST(latency_ms AS DOUBLE) AS latency_ms, avg(latency_ms) OVER (PARTITION BY backend) AS m, stddev_pop(latency_ms) OVER (PARTITION BY backend) AS s FROM op WHERE backend IS NOT NULL) GROUP BY backend"""
)
def latency_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A-12, A-13, A-14: nearest-rank percentile, median, moments."""
    rows = opinions(spark, sf).where("backend is not null").withColumn("x", F.col("latency_ms").cast("double"))
    return rows.groupBy("backend").agg(
        F.count(F.lit(1)).alias("opinions"),
        F.expr("percentile_disc(0.95) within group (order by x)").alias("p95"),
        F.median("x").alias("median_ms"),
        F.round(F.avg("x"), 4).alias("mean_ms"),
        F.round(F.stddev_pop("x"), 4).alias("deviation_ms"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
        F.round(F.skewness("x"), 4).alias("skew"),
        F.round(F.kurtosis("x"), 4).alias("excess"),
    )


@query(
    f"""WITH {_OP}, v AS (SELECT finding, verdict, sum(conf) AS w, count(*) AS n FROM op WHERE finding IS NOT NULL AND verdict IS NOT NULL AND conf IS NOT NULL GROUP BY ALL),
    best AS (SELECT finding, arg_max(verdict, (round(w, 9), verdict)) AS verdict, sum(n) AS n, count(*) AS sides FROM v GROUP BY finding)
    SELECT b.finding, b.verdict, round(least(1.0, v.w / v.n + CASE WHEN sides = 1 THEN 0.1 ELSE 0 END), 3) AS confidence, CAST(b.n - v.n AS BIGINT) AS dissent FROM best b JOIN v ON b.finding = v.finding AND b.verdict = v.verdict"""
)
def weighted_votes(spark: SparkSession, sf: str) -> DataFrame:
    """A-16: the verdict with the largest sum of confidences, and the number that dissent; ties go to the later name."""
    sides = opinions(spark, sf).where("finding is not null and verdict is not null and conf is not null").groupBy("finding", "verdict").agg(F.sum("conf").alias("w"), F.count(F.lit(1)).alias("n"))
    best = sides.groupBy("finding").agg(F.max(F.struct(F.round("w", 9), "verdict", "w", "n")).alias("b"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("sides"))
    share = F.col("b.w") / F.col("b.n") + F.when(F.col("sides") == 1, 0.1).otherwise(0)
    return best.select("finding", F.col("b.verdict").alias("verdict"), F.round(F.least(F.lit(1.0), share), 3).alias("confidence"), (F.col("all") - F.col("b.n")).alias("dissent"))


@query(
    """WITH d AS (SELECT DISTINCT cwe FROM code_findings WHERE cwe IS NOT NULL), s AS (SELECT cwe, min(CASE upper(trim(severity)) WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END) AS r, count(*) AS n FROM code_findings GROUP BY cwe)
    SELECT d.cwe, CAST(coalesce(r, 5) AS INTEGER) AS worst, coalesce(n, 0) AS findings FROM d LEFT JOIN s ON d.cwe = s.cwe"""
)
def worst_per_category(spark: SparkSession, sf: str) -> DataFrame:
    """A-17, J-17: worst severity of every category, those without findings included."""
    rows = table(spark, sf, "code_findings").select("cwe", "kind", F.upper(F.trim("severity")).alias("sev"))
    per = rows.groupBy(F.col("cwe").alias("c")).agg(F.min(rank_of("sev")).alias("r"), F.count(F.lit(1)).alias("n"))
    return rows.where("cwe is not null").select("cwe").distinct().join(per, F.col("cwe") == F.col("c"), "left").select("cwe", F.coalesce("r", F.lit(5)).alias("worst"), F.coalesce("n", F.lit(0).cast("long")).alias("findings"))


@query(
    """WITH t AS (SELECT record_id, kind, CAST(length(coalesce(source_snippet, code)) AS DOUBLE) AS n FROM code_findings WHERE coalesce(source_snippet, code) IS NOT NULL), p AS (SELECT kind, avg(n) AS m, stddev_samp(n) AS s FROM t GROUP BY kind)
    SELECT record_id, round(abs(n - m) / s, 4) AS z, CASE WHEN abs(n - m) / s >= 4 THEN 'HIGH' WHEN abs(n - m) / s >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM t JOIN p USING (kind) WHERE s > 0 AND abs(n - m) / s >= 2"""
)
def length_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """A-20, W-3: texts far off the mean length of their kind."""
    rows = table(spark, sf, "code_findings").select("record_id", "kind", F.length(F.coalesce("source_snippet", "code")).cast("double").alias("n")).where("n is not null")
    profile = rows.groupBy(F.col("kind").alias("p")).agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("s")).where("s > 0")
    scored = rows.join(F.broadcast(profile), F.col("kind") == F.col("p")).withColumn("z", F.abs(F.col("n") - F.col("m")) / F.col("s")).where("z >= 2")
    return scored.select("record_id", F.round("z", 4).alias("z"), F.when(F.col("z") >= 4, "HIGH").when(F.col("z") >= 3, "MEDIUM").otherwise("LOW").alias("band"))


@query(
    f"""WITH {_EX}, s AS (SELECT language, detected, lead(detected) OVER w AS after, first_value(detected) OVER w AS start FROM ex WINDOW w AS (PARTITION BY language ORDER BY sha256(example_id || '7'), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT language, count(*) AS examples, round(greatest(avg(detected), 1 - avg(detected)), 4) AS chance, round(avg(CASE WHEN detected = coalesce(after, start) THEN 1.0 ELSE 0.0 END), 4) AS shuffled FROM s GROUP BY language"""
)
def shuffled_control(spark: SparkSession, sf: str) -> DataFrame:
    """A-23, L-9: agreement of labels with labels permuted by a seeded hash, against chance."""
    from pyspark.sql import Window

    w = Window.partitionBy("language").orderBy(F.sha2(F.concat("example_id", F.lit("7")), 256), "row_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = _examples(spark, sf).withColumn("other", F.coalesce(F.lead("detected").over(w), F.first("detected").over(whole)))
    mean = F.avg("detected")
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("examples"), F.round(F.greatest(mean, 1 - mean), 4).alias("chance"), F.round(F.avg(F.when(F.col("detected") == F.col("other"), 1.0).otherwise(0.0)), 4).alias("shuffled"))


@query(f"SELECT c.d AS digest, CAST(count(x.p) AS BIGINT) AS children FROM (SELECT DISTINCT {k('content_digest')} AS d FROM examples) c LEFT JOIN (SELECT DISTINCT example_id, {k('parent_digest')} AS p FROM examples) x ON c.d = x.p WHERE c.d IS NOT NULL GROUP BY c.d")
def child_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """A-24: number of children of every node, zero included; counted before the join, so a hot parent is one row."""
    rows = table(spark, sf, "examples")
    per = rows.select("example_id", norm_key("parent_digest").alias("p")).distinct().where("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    own = rows.select(norm_key("content_digest").alias("digest")).where("digest is not null").distinct()
    return own.join(per, F.col("digest") == F.col("p"), "left").select("digest", F.coalesce("n", F.lit(0).cast("long")).alias("children"))


@query("SELECT count(*) AS ids, bit_xor(CAST('0x' || substr(sha256(example_id), 1, 15) AS BIGINT)) AS digest FROM (SELECT DISTINCT example_id FROM examples WHERE example_id IS NOT NULL)")
def corpus_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A-25: a digest of a set of ids that no order changes."""
    return E.set_digest(table(spark, sf, "examples"), "example_id")


_FAM = """fam AS (SELECT example_id, min(mutator_id || '/' || language) AS family, max(detected) AS detected FROM examples WHERE mutator_id <> '' GROUP BY example_id)"""


@query(
    f"""WITH {_FAM}, h AS (SELECT family, list_sum(list_transform(string_split(sha256(family), ''), lambda d: CAST('0x' || d AS INTEGER))) % 5 = 0 AS unseen FROM (SELECT DISTINCT family FROM fam)),
    c AS (SELECT family, detected, row_number() OVER (PARTITION BY family ORDER BY sha256(example_id)) AS n FROM fam)
    SELECT unseen, count(DISTINCT c.family) AS families, count(*) AS examples, round(100.0 * sum(detected) / count(*), 4) AS detected_pct FROM c JOIN h USING (family) WHERE n <= 12 GROUP BY unseen"""
)
def unseen_families(spark: SparkSession, sf: str) -> DataFrame:
    """A-30, P-11, W-16: detection of families held out by hash against the others, twelve of each at most (the cap is the feature)."""
    rows = table(spark, sf, "examples").where("mutator_id <> ''").groupBy("example_id").agg(F.min(F.concat_ws("/", "mutator_id", "language")).alias("family"), F.max("detected").alias("detected"))
    capped = W.top_per_key(rows.withColumn("_h", F.sha2("example_id", 256)), ["family"], ["_h"], 12)
    return capped.groupBy((E.hash_share(F.col("family")) == 0).alias("unseen")).agg(F.countDistinct("family").alias("families"), F.count(F.lit(1)).alias("examples"), F.round(100.0 * F.sum("detected") / F.count(F.lit(1)), 4).alias("detected_pct"))


@query(
    f"""WITH {_OP}, maj AS (SELECT finding, arg_max(verdict, (n, verdict)) AS truth FROM (SELECT finding, verdict, count(*) AS n FROM op WHERE finding IS NOT NULL AND verdict IS NOT NULL GROUP BY ALL) GROUP BY finding)
    SELECT backend, CAST(count_if(verdict = 'EXPLOITABLE' AND truth = 'EXPLOITABLE') AS BIGINT) AS tp, CAST(count_if(verdict = 'EXPLOITABLE' AND truth <> 'EXPLOITABLE') AS BIGINT) AS fp, CAST(count_if(verdict <> 'EXPLOITABLE' AND truth = 'EXPLOITABLE') AS BIGINT) AS fn,
      CAST(count_if(verdict <> 'EXPLOITABLE' AND truth <> 'EXPLOITABLE') AS BIGINT) AS tn FROM op JOIN maj USING (finding) WHERE verdict IS NOT NULL AND backend IS NOT NULL GROUP BY backend"""
)
def backend_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """A-31: several tools on one corpus against the majority."""
    rows = opinions(spark, sf).where("finding is not null and verdict is not null")
    truth = rows.groupBy("finding", "verdict").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("finding").alias("f")).agg(F.max(F.struct("n", "verdict"))["verdict"].alias("truth"))
    said, real = F.col("verdict") == "EXPLOITABLE", F.col("truth") == "EXPLOITABLE"
    joined = rows.where("backend is not null").join(truth, F.col("finding") == F.col("f"))
    return joined.groupBy("backend").agg(F.count_if(said & real).alias("tp"), F.count_if(said & ~real).alias("fp"), F.count_if(~said & real).alias("fn"), F.count_if(~said & ~real).alias("tn"))


@query("SELECT path, rule_id, line - rn AS run_key, CAST(min(line) AS BIGINT) AS first, CAST(max(line) AS BIGINT) AS last, count(*) AS length FROM (SELECT path, rule_id, line, row_number() OVER (PARTITION BY path, rule_id ORDER BY line) AS rn FROM (SELECT DISTINCT path, rule_id, line FROM findings WHERE path IS NOT NULL AND rule_id IS NOT NULL AND line IS NOT NULL)) GROUP BY ALL".replace("line - rn AS run_key, ", "").replace("GROUP BY ALL", "GROUP BY path, rule_id, line - rn"))
def line_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A-28, J-12: runs of consecutive lines of a rule in a path."""
    rows = table(spark, sf, "findings").where("path is not null and rule_id is not null and line is not null").withColumn("line", F.col("line").cast("long"))
    return W.islands(rows, ["path", "rule_id"], "line")
