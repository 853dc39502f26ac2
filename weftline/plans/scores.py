"""Queries of scores, bands, text measures, windows of lines and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.keys import norm_key
from weftline.operators import corpus as C
from weftline.operators import integrity as I
from weftline.operators import windows as W
from weftline.plans.corpora import LINE_RULES, _CODE, _RULE_SQL, _code
from weftline.plans.problems import _sql_key as k
from weftline.plans.registry import Registry
from weftline.plans.store import _F, findings
from weftline.sources.tables import table

registry = Registry()
query = registry.query

_SCORE = "CASE WHEN confidence > 1 THEN confidence / 10 ELSE confidence * 10 END"


def _score() -> Column:
    return F.when(F.col("confidence") > 1, F.col("confidence") / 10).otherwise(F.col("confidence") * 10)


@query(f"SELECT opinion_id, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s >= 9 THEN 'CRITICAL' WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT opinion_id, {_SCORE} AS s FROM member_opinions)")
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    """P-4: scores in bands, with one for unknown scores."""
    s = F.col("s")
    band = F.when(s.isNull(), "UNKNOWN").when(s >= 9, "CRITICAL").when(s >= 7, "HIGH").when(s >= 4, "MEDIUM").otherwise("LOW")
    return table(spark, sf, "member_opinions").select("opinion_id", _score().alias("s")).select("opinion_id", band.alias("band"))


_EXPOSURE = {"ollama": 1.1, "remote": 1.3, "human": 0.7}


@query(f"SELECT opinion_id, round(least(10, {_SCORE} * (CASE backend WHEN 'ollama' THEN 1.1::DOUBLE WHEN 'remote' THEN 1.3::DOUBLE WHEN 'human' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN verdict IS NULL THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END)), 1) AS score FROM member_opinions WHERE confidence IS NOT NULL")
def exposure_scores(spark: SparkSession, sf: str) -> DataFrame:
    """P-5: score times exposure (a table with a default) times confidence, at most 10, to one place."""
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _EXPOSURE.items() for x in kv]), F.coalesce("backend", F.lit(""))), F.lit(1.0))
    rows = table(spark, sf, "member_opinions").where("confidence is not null")
    return rows.select("opinion_id", F.round(F.least(F.lit(10.0), _score() * factor * F.when(F.col("verdict").isNull(), 0.5).otherwise(0.9)), 1).alias("score"))


_RISK = "greatest(0.1, least(10, (CASE sev WHEN 'CRITICAL' THEN 10::DOUBLE WHEN 'HIGH' THEN 7::DOUBLE WHEN 'MEDIUM' THEN 4::DOUBLE WHEN 'LOW' THEN 1::DOUBLE ELSE 0::DOUBLE END) * (CASE WHEN line % 3 = 0 THEN 1.5::DOUBLE WHEN line % 3 = 1 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN cwe IN ('CWE-89', 'CWE-94', 'CWE-79') THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END)))"


@query(f"SELECT record_id, round(r, 1) AS risk, CASE WHEN r >= 8 THEN 'act' WHEN r >= 4 THEN 'plan' ELSE 'watch' END AS band FROM (SELECT record_id, {_RISK} AS r FROM (SELECT record_id, upper(trim(severity)) AS sev, coalesce(line, 0) AS line, cwe FROM code_findings))")
def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """P-12: severity times reachability times weakness, held between 0.1 and 10, with bands."""
    sev, line = F.upper(F.trim("severity")), F.coalesce("line", F.lit(0)) % 3
    base = F.when(sev == "CRITICAL", 10.0).when(sev == "HIGH", 7.0).when(sev == "MEDIUM", 4.0).when(sev == "LOW", 1.0).otherwise(0.0)
    risk = F.greatest(F.lit(0.1), F.least(F.lit(10.0), base * F.when(line == 0, 1.5).when(line == 1, 0.6).otherwise(1.0) * F.when(F.col("cwe").isin("CWE-89", "CWE-94", "CWE-79"), 1.25).otherwise(1.0)))
    rows = table(spark, sf, "code_findings").select("record_id", risk.alias("r"))
    return rows.select("record_id", F.round("r", 1).alias("risk"), F.when(F.col("r") >= 8, "act").when(F.col("r") >= 4, "plan").otherwise("watch").alias("band"))


@query(
    f"""WITH {_CODE}, m AS (SELECT record_id, path, text, len(string_split(text, chr(10))) AS lines FROM c WHERE text IS NOT NULL AND text <> '' AND path IS NOT NULL AND path <> '')
    SELECT record_id, lines FROM (SELECT *, severity FROM m JOIN (SELECT record_id AS r, severity, kind, description FROM code_findings) ON record_id = r) WHERE kind = 'CIFinding' AND severity IS NOT NULL AND lines BETWEEN 5 AND 500 AND text <> coalesce(description, '')"""
)
def valid_changes(spark: SparkSession, sf: str) -> DataFrame:
    """P-3: rows that meet every clause: kind, texts that are there and differ, lines in a band."""
    lines = F.size(F.split("text", "\n"))
    rows = table(spark, sf, "code_findings").withColumn("text", F.when(F.col("kind") == "Finding", F.col("source_snippet")).otherwise(F.col("code")))
    kept = rows.where((F.col("kind") == "CIFinding") & F.col("severity").isNotNull() & (F.col("text") != "") & (F.col("path") != "") & (F.col("text") != F.coalesce("description", F.lit(""))))
    return kept.select("record_id", lines.cast("long").alias("lines")).where("lines between 5 and 500")


@query(f"WITH {_CODE} SELECT record_id FROM c WHERE text IS NOT NULL AND length(text) >= 32 AND len(string_split(text, chr(10))) >= 3 AND len(regexp_extract_all(text, '[A-Za-z0-9_]+')) >= 5")
def text_gate(spark: SparkSession, sf: str) -> DataFrame:
    """P-6: texts with enough lines, words and characters to be measured."""
    x = F.col("text")
    return _code(spark, sf).where((F.length(x) >= 32) & (F.size(F.split(x, "\n")) >= 3) & (F.size(F.regexp_extract_all(x, F.lit("[A-Za-z0-9_]+"), 0)) >= 5)).select("record_id")


_CLASS_SQL = """CASE WHEN regexp_matches(path, '(^|/)(vendor|node_modules|third_party)/') THEN 0.0 WHEN regexp_matches(path, '(_pb2|\\.min|_generated)\\.') THEN 0.0 WHEN regexp_matches(path, '(^|/)(generated|build|dist)/') THEN 0.1 WHEN regexp_matches(path, '(^|/)tests?/|_test\\.') THEN 0.4
    WHEN regexp_matches(text, '(?i)do not edit|auto-?generated') THEN 0.0 WHEN regexp_matches(path, '(jquery|bootstrap|lodash)') THEN 0.05 WHEN len(l) >= 20 AND len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[A-Z][A-Z0-9_]+\\s*='))) > 0.7 * len(l) THEN 0.1 ELSE 1.0 END"""


@query(f"WITH {_CODE} SELECT record_id, CAST({_CLASS_SQL} AS DOUBLE) AS weight FROM (SELECT record_id, path, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM c WHERE path IS NOT NULL)")
def file_weights(spark: SparkSession, sf: str) -> DataFrame:
    """P-7: the weight of the first class a file falls into: by folder, name, marker in its text, library, or share of constants among its lines."""
    p, lines = F.col("path"), F.split("text", "\n")
    constants = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[A-Z][A-Z0-9_]+\s*=")))
    weight = (
        F.when(p.rlike(r"(^|/)(vendor|node_modules|third_party)/"), 0.0).when(p.rlike(r"(_pb2|\.min|_generated)\."), 0.0).when(p.rlike(r"(^|/)(generated|build|dist)/"), 0.1).when(p.rlike(r"(^|/)tests?/|_test\."), 0.4)
        .when(F.col("text").rlike(r"(?i)do not edit|auto-?generated"), 0.0).when(p.rlike("(jquery|bootstrap|lodash)"), 0.05).when((F.size(lines) >= 20) & (constants > 0.7 * F.size(lines)), 0.1).otherwise(1.0)
    )
    return _code(spark, sf).where("path is not null").withColumn("text", F.coalesce("text", F.lit(""))).select("record_id", weight.alias("weight"))


@query(
    """SELECT backend, count(latency_ms) AS n, CAST(sum(latency_ms) AS BIGINT) AS total, round(avg(latency_ms), 3) AS mean, round(stddev_pop(latency_ms), 3) AS deviation, round(var_pop(latency_ms), 1) AS variance, min(latency_ms) AS least, max(latency_ms) AS most,
    round(quantile_cont(latency_ms, 0.25), 3) AS q1, round(quantile_cont(latency_ms, 0.5), 3) AS median, round(quantile_cont(latency_ms, 0.75), 3) AS q3, round(quantile_cont(latency_ms, 0.75) - quantile_cont(latency_ms, 0.25), 3) AS iqr FROM member_opinions WHERE backend IS NOT NULL GROUP BY backend"""
)
def latency_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """A-14: sum, mean, population deviation and variance, extremes, quartiles and their distance."""
    x = F.col("latency_ms")
    q = lambda p: F.percentile(x, p)
    r = lambda c, d, name: F.round(c, d).alias(name)
    return table(spark, sf, "member_opinions").where("backend is not null").groupBy("backend").agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), r(F.avg(x), 3, "mean"), r(F.stddev_pop(x), 3, "deviation"), r(F.var_pop(x), 1, "variance"), F.min(x).alias("least"), F.max(x).alias("most"), r(q(0.25), 3, "q1"), r(q(0.5), 3, "median"), r(q(0.75), 3, "q3"), r(q(0.75) - q(0.25), 3, "iqr")
    )


_V = f"v AS (SELECT {k('finding')} AS f, member, regexp_replace(upper(verdict), '[^A-Z]', '', 'g') AS v FROM member_opinions)"


@query(f"WITH {_V}, n AS (SELECT f, v, count(*) AS n FROM v WHERE f IS NOT NULL AND v IN ('EXPLOITABLE', 'NOTEXPLOITABLE', 'UNCERTAIN') GROUP BY f, v) SELECT f AS finding, CAST(sum(n) AS BIGINT) AS votes, round(1 - max(n) / sum(n), 4) AS disagreement FROM n GROUP BY f")
def disagreement_rates(spark: SparkSession, sf: str) -> DataFrame:
    """A-13: the share of votes that differ from the most frequent one."""
    rows = table(spark, sf, "member_opinions").select(norm_key("finding").alias("finding"), F.regexp_replace(F.upper("verdict"), "[^A-Z]", "").alias("v")).where("finding is not null and v in ('EXPLOITABLE', 'NOTEXPLOITABLE', 'UNCERTAIN')")
    return rows.groupBy("finding", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("finding").agg(F.sum("n").alias("votes"), F.round(1 - F.max("n") / F.sum("n"), 4).alias("disagreement"))


@query(
    f"""WITH {_CODE}, ch AS (SELECT record_id, unnest(string_split(text, '')) AS x FROM c WHERE text IS NOT NULL AND length(text) >= 32), n AS (SELECT record_id, x, count(*) AS n FROM ch GROUP BY ALL), t AS (SELECT record_id, sum(n) AS t FROM n GROUP BY record_id),
    e AS (SELECT n.record_id, -sum(n / t * log2(n / t)) AS e FROM n JOIN t ON n.record_id = t.record_id GROUP BY n.record_id) SELECT record_id, CASE WHEN e >= 5 THEN 'dense' WHEN e >= 4 THEN 'plain' ELSE 'sparse' END AS band FROM e"""
)
def entropy_bands(spark: SparkSession, sf: str) -> DataFrame:
    """A-19: character entropy of whole code texts in bands; texts under 32 characters say nothing."""
    e = T.char_entropy(F.col("text"))
    return _code(spark, sf).where(F.length("text") >= 32).select("record_id", e.alias("e")).select("record_id", F.when(F.col("e") >= 5, "dense").when(F.col("e") >= 4, "plain").otherwise("sparse").alias("band"))


_MEASURES = "len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '\\b(if|for|while|case|catch|and|or)\\b')) AS branches, list_max(list_transform(string_split(text, chr(10)), lambda x: length(regexp_extract(x, '^( *)', 1)))) AS depth"


@query(
    f"""WITH {_CODE}, m AS (SELECT record_id, {_MEASURES} FROM c WHERE text IS NOT NULL), l AS (SELECT record_id, unnest(['lines', 'branches', 'depth']) AS measure, unnest([lines, branches, depth]) AS x FROM m),
    p AS (SELECT measure, avg(x) AS mean, stddev_pop(x) AS sd FROM l GROUP BY measure) SELECT record_id, l.measure, round((x - mean) / sd, 4) AS z FROM l JOIN p ON l.measure = p.measure WHERE sd > 0 AND abs(x - mean) >= 3 * sd"""
)
def measure_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """A-20: length, branches and nesting of each text against the whole population; three one-row aggregates in one."""
    lines = F.split("text", "\n")
    depth = F.array_max(F.transform(lines, lambda x: F.length(F.regexp_extract(x, "^( *)", 1))))
    rows = _code(spark, sf).where("text is not null").select("record_id", F.size(lines).alias("lines"), F.size(F.regexp_extract_all("text", F.lit(r"\b(if|for|while|case|catch|and|or)\b"), 0)).alias("branches"), depth.alias("depth"))
    long = rows.select("record_id", F.explode(F.create_map(*[x for m in ("lines", "branches", "depth") for x in (F.lit(m), F.col(m).cast("double"))])).alias("measure", "x"))
    profile = long.groupBy(F.col("measure").alias("m")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return long.join(F.broadcast(profile), F.col("measure") == F.col("m")).where("sd > 0 and abs(x - mean) >= 3 * sd").select("record_id", "measure", F.round((F.col("x") - F.col("mean")) / F.col("sd"), 4).alias("z"))


@query("WITH i AS (SELECT DISTINCT example_id AS id FROM examples WHERE example_id IS NOT NULL), b AS (SELECT left(sha256(id), 4) AS bucket, sha256(string_agg(sha256(id), '' ORDER BY sha256(id))) AS d FROM i GROUP BY 1) SELECT CAST((SELECT count(*) FROM i) AS BIGINT) AS ids, sha256(string_agg(d, '' ORDER BY bucket)) AS digest FROM b")
def corpus_sha(spark: SparkSession, sf: str) -> DataFrame:
    """A-25: SHA-256 over the sorted set, in two levels: a digest of each of 65,536 hash ranges, then of their digests in order."""
    ids = table(spark, sf, "examples").select("example_id").where("example_id is not null").distinct().select(F.sha2("example_id", 256).alias("h"))
    ranges = ids.groupBy(F.substring("h", 1, 4).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), "")
    return ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ids"), F.sha2(whole, 256).alias("digest"))


@query("WITH n AS (SELECT path, rule_id, count(DISTINCT line) AS lines FROM findings WHERE path IS NOT NULL AND rule_id IS NOT NULL AND line IS NOT NULL GROUP BY ALL), t AS (SELECT path, count(DISTINCT line) AS of_lines FROM findings WHERE path IS NOT NULL AND line IS NOT NULL GROUP BY path) SELECT n.path, rule_id, lines, round(lines / of_lines, 4) AS share FROM n JOIN t ON n.path = t.path")
def attribution_shares(spark: SparkSession, sf: str) -> DataFrame:
    """A-28: lines of a path by what they are attributed to, with their share of all lines asked for."""
    rows = table(spark, sf, "findings").select("path", "rule_id", "line").where("path is not null and line is not null").distinct()
    per = rows.where("rule_id is not null").groupBy("path", "rule_id").agg(F.count(F.lit(1)).alias("lines"))
    total = rows.select(F.col("path").alias("p"), "line").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("of_lines"))
    return per.join(total, F.col("path") == F.col("p")).select("path", "rule_id", "lines", F.round(F.col("lines") / F.col("of_lines"), 4).alias("share"))


@query("SELECT kind, true AS close FROM (SELECT 'path' AS kind UNION ALL SELECT 'fingerprint' UNION ALL SELECT 'rule_id')")
def approximate_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-27: approximate distinct counts (error under 5 percent at the set precision) beside exact ones; the SQL states that they are close."""
    rows, columns = table(spark, sf, "findings"), ["path", "fingerprint", "rule_id"]
    pairs = [F.struct(F.lit(c).alias("kind"), (F.abs(F.approx_count_distinct(c, 0.01) - F.countDistinct(c)) <= F.greatest(F.lit(1.0), 0.05 * F.countDistinct(c))).alias("close")) for c in columns]
    return rows.agg(F.array(*pairs).alias("a")).select(F.explode("a").alias("p")).select("p.kind", "p.close")


@query(
    f"""WITH {_CODE}, l AS (SELECT record_id, string_split(text, chr(10)) AS l FROM c WHERE text IS NOT NULL), w AS (SELECT record_id, l, unnest(range(0, greatest(1, CAST(ceil((len(l) - 30) / 15.0) AS BIGINT) + 1))) AS i FROM l)
    SELECT record_id, CAST(i * 15 + 1 AS INTEGER) AS first, CAST(least(i * 15 + 30, len(l)) AS INTEGER) AS last, md5(array_to_string(l[i * 15 + 1 : i * 15 + 30], chr(10))) AS digest FROM w"""
)
def half_overlapping_windows(spark: SparkSession, sf: str) -> DataFrame:
    """W-12: windows of 30 lines every 15, the last one shorter."""
    lines = F.split("text", "\n")
    n = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - 30) / 15).cast("int")))
    rows = _code(spark, sf).where("text is not null").select("record_id", lines.alias("l"), F.explode(starts).alias("i"))
    cut = F.slice("l", F.col("i") * 15 + 1, F.lit(30))
    return rows.select("record_id", (F.col("i") * 15 + 1).alias("first"), F.least(F.col("i") * 15 + 30, F.size("l")).alias("last"), F.md5(F.array_join(cut, "\n")).alias("digest"))


@query(
    f"""WITH {_CODE}, l AS (SELECT record_id, string_split(text, chr(10)) AS l, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM c WHERE text IS NOT NULL), h AS (SELECT record_id, l, n, unnest({_RULE_SQL}) AS rule FROM l)
    SELECT record_id, CAST(n AS INTEGER) AS line_no, rule, array_to_string(l[greatest(1, n - 2) : least(len(l), n + 2)], chr(10)) AS context FROM h WHERE rule IS NOT NULL"""
)
def hit_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """W-13: two lines on either side of every hit, as far as the text goes; cut out of the array of lines, without a join."""
    rows = _code(spark, sf).where("text is not null").select("record_id", F.split("text", "\n").alias("l"))
    each = rows.select("record_id", "l", F.posexplode("l").alias("p", "line"))
    hits = each.select("record_id", "l", (F.col("p") + 1).alias("line_no"), F.explode(F.filter(F.array(*[F.when(F.col("line").rlike(x), F.lit(n)) for n, x in LINE_RULES]), lambda r: r.isNotNull())).alias("rule"))
    first = F.greatest(F.lit(1), F.col("line_no") - 2)
    return hits.select("record_id", "line_no", "rule", F.array_join(F.slice("l", first, F.least(F.size("l"), F.col("line_no") + 2) - first + 1), "\n").alias("context"))


@query(
    """WITH w AS (SELECT record_id, list_filter(regexp_extract_all(lower(description), '[\\pL\\pN_]+'), lambda x: true) AS w FROM code_findings WHERE description IS NOT NULL)
    SELECT record_id, CAST(greatest(0, len(w) - 1) AS INTEGER) AS pairs, CAST(greatest(0, len(w) - 2) AS INTEGER) AS triples, CAST(len(list_distinct(list_transform(range(1, greatest(1, len(w) - 3)), lambda i: array_to_string(list_sort(w[i : i + 4]), ' ')))) AS INTEGER) AS sets FROM w"""
)
def ngram_sets(spark: SparkSession, sf: str) -> DataFrame:
    """W-14: pairs, triples, and distinct sorted runs of five words."""
    w = T.words(F.col("description"))
    fives = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.array_sort(F.slice("w", i, F.lit(5))), " "))
    rows = table(spark, sf, "code_findings").where("description is not null").select("record_id", w.alias("w"))
    n = lambda size: F.size(T.ngrams(F.col("w"), size))
    return rows.select("record_id", n(2).alias("pairs"), n(3).alias("triples"), F.when(F.size("w") >= 5, F.size(F.array_distinct(fives))).otherwise(0).alias("sets"))


@query("SELECT min(event_id) AS ordinal, user_id, event_type FROM events GROUP BY user_id, event_type HAVING arg_min(value, event_id) >= 10")
def work_queue(spark: SparkSession, sf: str) -> DataFrame:
    """L-12: a queue without repeats: the first entry of each item keeps its place and decides by its state (value) whether it still waits."""
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("event_id", "value")).alias("f"))
    return first.where("f.value >= 10").select(F.col("f.event_id").alias("ordinal"), "user_id", "event_type")


_FIELDS = ["category", "cwe", "kind", "line", "rule_id", "severity"]


@query(f"SELECT kind, count(*) AS distinct_rows FROM (SELECT DISTINCT {', '.join(_FIELDS)} FROM code_findings) GROUP BY kind")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    """O-7, S-10: rows distinct by their canonical JSON (sorted keys, nulls kept); counted by kind."""
    rows = table(spark, sf, "code_findings").select("kind", T.canonical_json(*_FIELDS).alias("j")).dropDuplicates(["j"])
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("distinct_rows"))


@query("SELECT record_id, '{' || '\"cwe\":' || coalesce('\"' || cwe || '\"', 'null') || ',\"line\":' || coalesce(CAST(line AS VARCHAR), 'null') || ',\"rule_id\":' || coalesce('\"' || rule_id || '\"', 'null') || '}' AS json FROM code_findings")
def canonical_records(spark: SparkSession, sf: str) -> DataFrame:
    """S-10: records as canonical JSON."""
    return table(spark, sf, "code_findings").select("record_id", T.canonical_json("rule_id", "line", "cwe").alias("json"))


_ALIASES = {"en": "english", "eng": "english", "de": "german", "ger": "german", "fr": "french", "es": "spanish", "pt": "portuguese", "py": "python", "js": "javascript", "ts": "typescript", "c++": "cpp", "c#": "csharp", "golang": "go"}


@query("SELECT doc_id, CASE lower(trim(lang)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ALIASES.items()) + " ELSE coalesce(nullif(lower(trim(lang)), ''), 'unknown') END AS language FROM documents")
def language_names(spark: SparkSession, sf: str) -> DataFrame:
    """S-6: written forms of languages through a map of aliases; others stay as they are."""
    low = F.lower(F.trim("lang"))
    names = F.create_map(*[F.lit(x) for kv in _ALIASES.items() for x in kv])
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.element_at(names, low), F.when(low != "", low), F.lit("unknown")).alias("language"))


@query("SELECT record_id, md5(rule_id) AS md5, left(sha256(rule_id), 16) AS sha, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(rule_id, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: (xor(a, x) * 16777619) % 4294967296) AS fnv FROM code_findings WHERE rule_id <> ''")
def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """S-9: MD5, the first 16 places of SHA-256, and FNV-1a of 32 bits (over single-byte characters)."""
    return table(spark, sf, "code_findings").where("rule_id <> ''").select("record_id", F.md5("rule_id").alias("md5"), F.substring(F.sha2("rule_id", 256), 1, 16).alias("sha"), T.fnv1a("rule_id").alias("fnv"))


_STOPS = ["if", "else", "for", "while", "return", "def", "class", "import", "from", "the", "int", "void", "const", "var", "let", "new", "public", "static", "self", "this"]
_TOKENS = f"list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '(//|#)[^\\n]*', ' ', 'g'), '\"[^\"\\n]*\"|''[^''\\n]*''', ' ', 'g')), '[a-z_][a-z0-9_]*'), lambda x: length(x) > 1 AND NOT list_contains({_STOPS}, x))"


@query(f"WITH {_CODE} SELECT record_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_tokens FROM (SELECT record_id, {_TOKENS} AS t FROM c WHERE text IS NOT NULL)")
def code_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """S-13: words of code without comments, literals, stop words and single letters."""
    tokens = T.code_words(F.col("text"), _STOPS)
    return _code(spark, sf).where("text is not null").select("record_id", tokens.alias("t")).select("record_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


_QUERY_STOPS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "which", "what", "how", "why"]


@query(f"SELECT pair_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(instruction), '[a-z0-9]+'), lambda x: length(x) >= 3 AND NOT list_contains({_QUERY_STOPS}, x)))), ' ') AS terms FROM tool_use_training WHERE instruction IS NOT NULL")
def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    """S-31: the set of words of a question, of three letters at least, without stop words."""
    w = F.filter(F.regexp_extract_all(F.lower("instruction"), F.lit("[a-z0-9]+"), 0), lambda x: (F.length(x) >= 3) & ~x.isin(_QUERY_STOPS))
    return table(spark, sf, "tool_use_training").where("instruction is not null").select("pair_id", F.array_join(F.array_sort(F.array_distinct(w)), " ").alias("terms"))


@query(
    """WITH w AS (SELECT record_id, regexp_extract_all(lower(description), '[\\pL\\pN_]+') AS w FROM code_findings WHERE description IS NOT NULL), g AS (SELECT record_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, greatest(1, len(w) - 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
    b AS (SELECT record_id, CAST('0x' || left(md5(x), 7) AS BIGINT) % 512 AS bucket FROM (SELECT record_id, unnest(g) AS x FROM g)), n AS (SELECT record_id, bucket, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT record_id, sum(n) AS t FROM n GROUP BY record_id)
    SELECT n.record_id, bucket, CAST(floor(n * 10000 / t) AS BIGINT) AS weight FROM n JOIN t ON n.record_id = t.record_id"""
)
def hashed_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """S-16: words, pairs and triples hashed into 512 buckets, as whole ten-thousandths of their number."""
    w = F.col("w")
    rows = table(spark, sf, "code_findings").where("description is not null").select("record_id", T.words(F.col("description")).alias("w"))
    grams = rows.select("record_id", F.explode(F.concat(w, T.ngrams(w, 2), T.ngrams(w, 3))).alias("g"))
    counted = grams.groupBy("record_id", (F.conv(F.substring(F.md5("g"), 1, 7), 16, 10).cast("long") % 512).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy(F.col("record_id").alias("r")).agg(F.sum("n").alias("t"))
    return counted.join(total, F.col("record_id") == F.col("r")).select("record_id", "bucket", F.floor(F.col("n") * 10000 / F.col("t")).alias("weight"))


@query("SELECT record_id, regexp_replace(regexp_replace(replace(path, '/', '\\'), '\\\\', '/', 'g'), '^(\\./)+', '') AS path, regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext, suffix(path, '_test.py') OR contains(path, '/test/') AS test FROM code_findings WHERE path IS NOT NULL")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    """S-23: paths in one form, their base name, ending and a match of their end; written with either slash."""
    either = F.replace("path", F.lit("/"), F.lit("\\"))
    p = F.regexp_replace(F.replace(either, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return table(spark, sf, "code_findings").where("path is not null").select("record_id", p.alias("path"), F.regexp_extract(p, "([^/]*)$", 1).alias("base"), F.lower(F.regexp_extract(p, r"\.([^./]*)$", 1)).alias("ext"), (p.endswith("_test.py") | F.contains(p, F.lit("/test/"))).alias("test"))


@query("SELECT event_id, CASE WHEN k % 3 = 0 THEN k * 3 WHEN k % 3 = 1 THEN k * 2 ELSE k END AS score FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def metric_preference(spark: SparkSession, sf: str) -> DataFrame:
    """S-24: a value in nested JSON by an order of preference of the fields that may hold it."""
    n = F.get_json_object("props", "$.k").try_cast("int")
    metric = lambda field, value: F.concat(F.lit(f'"{field}":[{{"data":{{"score":'), value.cast("string"), F.lit("}}]"))
    made = F.concat(F.lit('{"metrics":{'), F.concat_ws(",", F.when(n % 3 == 0, metric("v31", n * 3)), F.when(n % 3 <= 1, metric("v30", n * 2)), metric("v2", n)), F.lit("}}"))
    at = lambda field: F.get_json_object("j", f"$.metrics.{field}[0].data.score")
    return table(spark, sf, "events").select("event_id", made.alias("j")).select("event_id", F.coalesce(at("v31"), at("v30"), at("v2")).cast("int").alias("score"))


@query("SELECT language, array_to_string(list_sort(list(label || '=' || n)), ',') AS counters FROM (SELECT language, label, count(*) AS n FROM examples WHERE language IS NOT NULL AND label IS NOT NULL GROUP BY ALL) GROUP BY language")
def nested_counters(spark: SparkSession, sf: str) -> DataFrame:
    """S-26: a map of counters in each group, shown in the order of its keys; grown from counts, so no group is held by rows."""
    counted = table(spark, sf, "examples").where("language is not null and label is not null").groupBy("language", "label").agg(F.count(F.lit(1)).alias("n"))
    maps = counted.groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
    shown = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("language", F.array_join(F.array_sort(shown), ",").alias("counters"))


@query(f"WITH {_F}, s AS (SELECT path, CASE WHEN bool_or(sev IS NULL) THEN 2 WHEN bool_or(sev IN ('CRITICAL', 'HIGH')) THEN 1 ELSE 0 END AS s FROM f WHERE path IS NOT NULL AND path <> '' GROUP BY path) SELECT split_part(path, '/', 1) AS top, CASE max(s) WHEN 2 THEN 'failed' WHEN 1 THEN 'findings' ELSE 'clean' END AS status, count(*) AS files FROM s GROUP BY 1")
def workspace_status(spark: SparkSession, sf: str) -> DataFrame:
    """T-3: the status of a tree from those of its files: failed before findings before clean."""
    rows = findings(spark, sf).where("path is not null and path <> ''")
    per = rows.groupBy("path").agg(F.max(F.when(F.col("sev").isNull(), 2).when(F.col("sev").isin("CRITICAL", "HIGH"), 1).otherwise(0)).alias("s"))
    return per.groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.when(F.max("s") == 2, "failed").when(F.max("s") == 1, "findings").otherwise("clean").alias("status"), F.count(F.lit(1)).alias("files"))


_T_STATE = f"t AS (SELECT fp, arg_max(state, (updated_at, row_id)) AS state FROM (SELECT {k('fingerprint')} AS fp, replace(replace(lower(trim(state)), '-', '_'), ' ', '_') AS state, updated_at, row_id FROM triage) WHERE fp IS NOT NULL GROUP BY fp)"


@query(f"WITH {_F}, {_T_STATE} SELECT row_id, CASE state WHEN 'fixed' THEN 'true_positive' WHEN 'accepted_risk' THEN 'true_positive' ELSE 'false_positive' END AS label, 'Rule ' || rule || ' at ' || path || ':' || coalesce(CAST(line AS VARCHAR), '?') AS prompt FROM f JOIN t ON f.fp = t.fp WHERE state IN ('fixed', 'accepted_risk', 'false_positive') AND rule IS NOT NULL AND path IS NOT NULL")
def weak_labels(spark: SparkSession, sf: str) -> DataFrame:
    """T-4: training rows labelled by what triage did: reported ones are true, suppressed ones false, the others stay without a label and are left out."""
    from weftline.plans.store import triage

    states = triage(spark, sf).where("state in ('fixed', 'accepted_risk', 'false_positive')").select(F.col("fp").alias("t_fp"), "state")
    rows = findings(spark, sf).where("rule is not null and path is not null").join(states, F.col("fp") == F.col("t_fp"))
    prompt = F.concat(F.lit("Rule "), F.col("rule"), F.lit(" at "), F.col("path"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?")))
    return rows.select("row_id", F.when(F.col("state") == "false_positive", "false_positive").otherwise("true_positive").alias("label"), prompt.alias("prompt"))


_PAIRED = "'#ifndef OMITBAD' || chr(10) || text || chr(10) || '#endif /* OMITBAD */' || chr(10) || '#ifndef OMITGOOD' || chr(10) || 'fixed(' || record_id || ');' || chr(10) || '#endif'"


@query(f"WITH {_CODE} SELECT record_id, md5(chr(10) || text || chr(10) || chr(10)) AS flawed, md5(chr(10) || chr(10) || 'fixed(' || record_id || ');' || chr(10)) AS fixed FROM c WHERE text IS NOT NULL AND NOT contains(text, '#endif') AND NOT contains(text, '#ifndef')")
def paired_variants(spark: SparkSession, sf: str) -> DataFrame:
    """T-6: the flawed and the fixed variant of a text with blocks for either."""
    rows = _code(spark, sf).where(F.col("text").isNotNull() & ~F.contains("text", F.lit("#endif")) & ~F.contains("text", F.lit("#ifndef")))
    made = F.concat(F.lit("#ifndef OMITBAD\n"), "text", F.lit("\n#endif /* OMITBAD */\n#ifndef OMITGOOD\nfixed("), F.col("record_id").cast("string"), F.lit(");\n#endif"))
    v = C.split_variants(made)
    return rows.select("record_id", v.alias("v")).where("v is not null").select("record_id", F.md5("v.flawed").alias("flawed"), F.md5("v.fixed").alias("fixed"))


@query(f"WITH {_CODE} SELECT record_id, regexp_replace(text, '(?i)\\b[a-z0-9_]*(good|bad|vuln|flaw|safe|fix)[a-z0-9_]*\\b', 'neutral', 'g') AS text FROM c WHERE text IS NOT NULL AND regexp_matches(text, '(?i)(good|bad|vuln|flaw|safe|fix)')")
def neutral_names(spark: SparkSession, sf: str) -> DataFrame:
    """T-7: names that state the label, replaced by one that does not."""
    rows = _code(spark, sf).where(F.col("text").rlike("(?i)(good|bad|vuln|flaw|safe|fix)"))
    return rows.select("record_id", F.regexp_replace("text", r"(?i)\b[a-z0-9_]*(good|bad|vuln|flaw|safe|fix)[a-z0-9_]*\b", "neutral").alias("text"))


@query(
    """WITH n AS (SELECT cwe, count(*) AS n FROM code_findings WHERE cwe <> '' GROUP BY cwe), top AS (SELECT cwe FROM n ORDER BY n DESC, cwe LIMIT 40), r AS (SELECT record_id, cwe, sha256(CAST(record_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY cwe ORDER BY sha256(CAST(record_id AS VARCHAR))) AS k FROM code_findings WHERE cwe IN (SELECT cwe FROM top))
    SELECT record_id, cwe FROM (SELECT * FROM r WHERE k <= 50 ORDER BY h LIMIT 4000)"""
)
def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    """T-11: at most 40 weaknesses, 50 rows of each, 4,000 in all, in the order of a hash (a sampling operator: the caps are the feature)."""
    rows = table(spark, sf, "code_findings").where("cwe <> ''").select("record_id", "cwe", F.sha2(F.col("record_id").cast("string"), 256).alias("h"))
    top = rows.groupBy(F.col("cwe").alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(40)
    return W.top_per_key(rows.join(F.broadcast(top.select("c")), F.col("cwe") == F.col("c")), ["cwe"], ["h"], 50).orderBy("h").limit(4000).select("record_id", "cwe")


@query(
    f"""WITH {_F}, {_T_STATE}, b AS (SELECT rule, count(*) FILTER (WHERE state = 'false_positive') AS fp, count(*) FILTER (WHERE state IN ('fixed', 'accepted_risk')) AS tp FROM f JOIN t ON f.fp = t.fp WHERE rule IS NOT NULL GROUP BY rule), h AS (SELECT path, count(*) AS n FROM f WHERE path IS NOT NULL GROUP BY path)
    SELECT f.row_id, coalesce(b.fp + b.tp >= 5 AND b.fp / (b.fp + b.tp) > 0.8, false) AS low_precision, coalesce(b.fp + b.tp >= 3 AND b.tp / (b.fp + b.tp) > 0.7 AND NOT (b.fp + b.tp >= 5 AND b.fp / (b.fp + b.tp) > 0.8), false) AS high_precision, coalesce(h.n >= 5, false) AS hotspot FROM f LEFT JOIN b ON f.rule = b.rule LEFT JOIN h ON f.path = h.path"""
)
def feedback_flags(spark: SparkSession, sf: str) -> DataFrame:
    """T-19: findings flagged by what feedback says of their rule, and by how often their file occurs."""
    from weftline.plans.store import triage

    rows = findings(spark, sf).select("row_id", "fp", "rule", "path")
    said = rows.where("rule is not null").join(triage(spark, sf).select(F.col("fp").alias("t_fp"), "state"), F.col("fp") == F.col("t_fp"))
    per = said.groupBy(F.col("rule").alias("b_rule")).agg(F.count_if(F.col("state") == "false_positive").alias("bad"), F.count_if(F.col("state").isin("fixed", "accepted_risk")).alias("good"))
    n = F.col("bad") + F.col("good")
    low = (n >= 5) & (F.col("bad") > 0.8 * n)
    per = per.select("b_rule", low.alias("low"), ((n >= 3) & (F.col("good") > 0.7 * n) & ~low).alias("high"))
    hot = rows.where("path is not null").groupBy(F.col("path").alias("h_path")).agg((F.count(F.lit(1)) >= 5).alias("hot"))
    no = F.lit(False)
    return rows.join(per, F.col("rule") == F.col("b_rule"), "left").join(hot, F.col("path") == F.col("h_path"), "left").select("row_id", F.coalesce("low", no).alias("low_precision"), F.coalesce("high", no).alias("high_precision"), F.coalesce("hot", no).alias("hotspot"))


_PROOFS = [("todo", "# TODO later", "done"), ("eval", "x = eval(y)", "evaluate(y)"), ("http", "get('http://a')", "get('https://a')"), ("sql", "select a from b", "selection"), ("open", "reopen (x)", "y"), ("memcpy", "memcpy(a, b, c)", "memcpy(a)")]


@query("SELECT * FROM (VALUES ('todo'), ('eval'), ('http'), ('sql')) t(rule)")
def proved_rules(spark: SparkSession, sf: str) -> DataFrame:
    """T-22: candidates that meet their positive fixture and not their negative one (both are constants, and so is the SQL)."""
    fixtures = spark.createDataFrame(_PROOFS, "rule string, positive string, negative string")
    met = lambda c: F.coalesce(*[F.when(F.col("rule") == n, F.col(c).rlike(p)) for n, p in LINE_RULES], F.lit(False))
    return fixtures.where(met("positive") & ~met("negative")).select("rule")


@query(
    """WITH g AS (SELECT 'null paths' AS gate, avg(CASE WHEN path IS NULL THEN 1 ELSE 0 END) AS x, 0.05 AS a, 0.2 AS b FROM findings UNION ALL SELECT 'null severities', avg(CASE WHEN severity IS NULL THEN 1 ELSE 0 END), 0.05, 0.2 FROM findings UNION ALL SELECT 'severe', avg(CASE WHEN upper(trim(severity)) IN ('CRITICAL', 'HIGH') THEN 1 ELSE 0 END), 0.3, 0.6 FROM findings),
    r AS (SELECT gate, CASE WHEN x <= a THEN 0 WHEN x <= b THEN 1 ELSE 2 END AS rank, greatest(0, round(100 * (1 - x), 1)) AS score FROM g) SELECT gate, CASE rank WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS grade, score FROM r UNION ALL SELECT 'whole', CASE max(rank) WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, round(avg(score), 1) FROM r"""
)
def gate_grades(spark: SparkSession, sf: str) -> DataFrame:
    """T-23: independent threshold checks with a grade each, and over them the worst grade and the average score; one pass for all."""
    gates = [("null paths", F.col("path").isNull(), 0.05, 0.2), ("null severities", F.col("severity").isNull(), 0.05, 0.2), ("severe", F.coalesce(F.upper(F.trim("severity")).isin("CRITICAL", "HIGH"), F.lit(False)), 0.3, 0.6)]
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    one = table(spark, sf, "findings").agg(F.array(*[F.struct(F.lit(n).alias("gate"), share(c).alias("x"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, c, a, b in gates]).alias("g")).select(F.explode("g").alias("g")).select("g.*")
    rows = one.select("gate", F.when(F.col("x") <= F.col("a"), 0).when(F.col("x") <= F.col("b"), 1).otherwise(2).alias("rank"), F.greatest(F.lit(0.0), F.round(100 * (1 - F.col("x")), 1)).alias("score"))
    both = rows.unionByName(rows.agg(F.lit("whole").alias("gate"), F.max("rank").alias("rank"), F.round(F.avg("score"), 1).alias("score")))
    return both.select("gate", F.when(F.col("rank") == 0, "A").when(F.col("rank") == 1, "B").otherwise("C").alias("grade"), "score")


_LEVELS = 40


def _merkle_sql() -> str:
    steps = ["l0 AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS p, sha256(n_name) AS d FROM nation)"]
    steps += [f"l{i} AS (SELECT p // 2 AS p, CASE WHEN count(*) = 2 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE min(d) END AS d FROM l{i - 1} GROUP BY p // 2)" for i in range(1, _LEVELS)]
    return f"WITH {', '.join(steps)} SELECT d AS root FROM l{_LEVELS - 1}"


@query(_merkle_sql())
def merkle_of_nations(spark: SparkSession, sf: str) -> DataFrame:
    """X-4: the root over the nations' digests."""
    leaves = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("p"), F.sha2("n_name", 256).alias("d"))
    return spark.createDataFrame([(I.merkle_root(leaves, "p", "d"),)], "root string")


@query(
    f"""WITH r AS (SELECT {k('run_id')} AS run, status FROM runs), w AS (SELECT DISTINCT run FROM r WHERE run IS NOT NULL), g AS (SELECT {k('run_id')} AS run, count(*) AS n FROM findings WHERE {k('run_id')} IS NOT NULL GROUP BY 1), j AS (SELECT coalesce(w.run, g.run) AS shard, CASE WHEN w.run IS NULL THEN 'foreign' WHEN g.run IS NULL THEN 'missing' END AS problem, n FROM w FULL OUTER JOIN g ON w.run = g.run)
    SELECT CASE WHEN problem IS NULL THEN 'accepted' ELSE problem END AS state, count(*) AS shards, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM j GROUP BY 1"""
)
def folded_shards(spark: SparkSession, sf: str) -> DataFrame:
    """X-3: results of shards folded where exactly one answers for each that was asked; missing and foreign ones are refused and shown."""
    asked = table(spark, sf, "runs").select(norm_key("run_id").alias("run")).where("run is not null").distinct()
    results = table(spark, sf, "findings").select(norm_key("run_id").alias("shard")).where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    return I.fold_results(results, "shard", "n", asked, "run")


@query("WITH RECURSIVE c AS (SELECT o_custkey AS chain, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, CAST(o_orderkey AS VARCHAR) AS payload FROM orders), l AS (SELECT chain, seq, sha256('|' || payload) AS digest FROM c WHERE seq = 1 UNION ALL SELECT c.chain, c.seq, sha256(l.digest || '|' || c.payload) FROM l JOIN c ON c.chain = l.chain AND c.seq = l.seq + 1) SELECT chain, max(seq) AS links, arg_max(digest, seq) AS head, CASE WHEN max(seq) >= 11 THEN CAST(11 AS BIGINT) END AS first_broken FROM l GROUP BY chain")
def chained_orders(spark: SparkSession, sf: str) -> DataFrame:
    """X-5, X-6: real chains, each digest over the one before and the payload; every eleventh payload is then damaged, and checking recomputes every digest."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    seq = W.occurrence(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "seq").select(F.col("o_custkey").alias("chain"), F.col("seq").cast("long").alias("seq"), F.col("o_orderkey").cast("string").alias("payload"))
    chain = I.build_chain(seq, "chain", "seq", "payload")
    damaged = chain.withColumn("payload", F.when(F.col("seq") % 11 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    breaks = I.chain_breaks(damaged, ["chain"], "seq", "previous", "digest", F.col("payload"))
    heads = chain.groupBy(F.col("chain").alias("c")).agg(F.max("seq").alias("links"), F.max_by("digest", "seq").alias("head"))
    return heads.join(breaks, F.col("c") == F.col("chain"), "left").select(F.col("c").alias("chain"), "links", "head", "first_broken")


@query(
    f"""WITH r AS (SELECT {k('run_id')} AS run, arg_max(findings, (ingested_at, row_id)) AS claimed FROM runs WHERE {k('run_id')} IS NOT NULL AND findings IS NOT NULL GROUP BY 1), n AS (SELECT {k('run_id')} AS run, count(*) AS n FROM findings WHERE {k('run_id')} IS NOT NULL GROUP BY 1)
    SELECT r.run, CAST(claimed AS BIGINT) AS claimed, coalesce(n, 0) AS derived, CASE WHEN claimed = coalesce(n, 0) THEN 'verified' WHEN n IS NULL THEN 'refuted' ELSE 'differs' END AS verdict FROM r LEFT JOIN n ON r.run = n.run"""
)
def claimed_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A-29: what runs claim against what is there; runs without a row are refuted instead of left out."""
    claims = table(spark, sf, "runs").where("findings is not null").select(norm_key("run_id").alias("run"), F.struct("ingested_at", "row_id", "findings").alias("r")).where("run is not null").groupBy("run").agg(F.max("r")["findings"].cast("long").alias("claimed"))
    there = table(spark, sf, "findings").select(norm_key("run_id").alias("f_run")).where("f_run is not null").groupBy("f_run").agg(F.count(F.lit(1)).alias("n"))
    derived = F.coalesce("n", F.lit(0))
    verdict = F.when(F.col("claimed") == derived, "verified").when(F.col("n").isNull(), "refuted").otherwise("differs")
    return claims.join(there, F.col("run") == F.col("f_run"), "left").select("run", "claimed", derived.alias("derived"), verdict.alias("verdict"))


@query(
    f"""WITH {_CODE}, w AS (SELECT record_id AS id, unnest(regexp_extract_all(lower(description), '[\\pL\\pN_]+')) AS word FROM code_findings), n AS (SELECT id, word, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT count(*) AS t FROM code_findings), i AS (SELECT word, ln((t + 1) / (count(*) + 1)) + 1 AS idf FROM n, t GROUP BY word, t),
    v AS (SELECT id, n.word, n * idf AS x FROM n JOIN i ON n.word = i.word), p0 AS (SELECT p, unnest(regexp_extract_all(s, '[\\pL\\pN_]+')) AS word FROM (VALUES ('p1', 'request forgery reaches the remote address'), ('p2', 'value may exceed the buffer'), ('p3', 'step runs with wide scope')) q(p, s)), pn AS (SELECT p, word, count(*) AS n FROM p0 GROUP BY ALL), pv AS (SELECT p, pn.word, n * coalesce(idf, 1) AS x FROM pn LEFT JOIN i ON pn.word = i.word),
    lv AS (SELECT id, sqrt(sum(x * x)) AS l FROM v GROUP BY id), lp AS (SELECT p, sqrt(sum(x * x)) AS l FROM pv GROUP BY p)
    SELECT v.id AS record_id, pv.p AS pattern, round(sum(v.x * pv.x) / any_value(lv.l) / any_value(lp.l), 4) AS score FROM v JOIN pv ON v.word = pv.word JOIN lv ON v.id = lv.id JOIN lp ON pv.p = lp.p GROUP BY v.id, pv.p HAVING round(sum(v.x * pv.x) / any_value(lv.l) / any_value(lp.l), 4) >= 0.35"""
)
def weighted_pattern_matches(spark: SparkSession, sf: str) -> DataFrame:
    """J-10: cosine of weighted terms with a library of patterns (a fixed list); words that no text has weigh 1."""
    patterns = spark.createDataFrame([("p1", "request forgery reaches the remote address"), ("p2", "value may exceed the buffer"), ("p3", "step runs with wide scope")], "pattern string, text string")
    return C.weighted_cosines(table(spark, sf, "code_findings").select("record_id", "description"), "record_id", T.words(F.col("description")), patterns, least=0.35)


@query()
def near_clones(spark: SparkSession, sf: str) -> DataFrame:
    """J-9: classes and links of code texts whose multisets of tokens have a Jaccard measure of 0.75 at least; tested against brute force."""
    return C.near_duplicates(_code(spark, sf), "record_id", F.col("text"), least=0.75, shingles=T.numbered(T.code_words(F.col("text"), [])))


@query("SELECT record_id, labels.label FROM (SELECT record_id, regexp_extract(path, '([^/]*)$', 1) AS base FROM code_findings WHERE path IS NOT NULL) f LEFT JOIN (SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS base, upper(trim(severity)) AS label FROM findings WHERE path IS NOT NULL AND severity IS NOT NULL) labels ON f.base = labels.base")
def basename_labels(spark: SparkSession, sf: str) -> DataFrame:
    """J-31: labels joined by the last part of the path."""
    from weftline.operators import joins as J

    files = table(spark, sf, "code_findings").where("path is not null").select("record_id", "path")
    labels = table(spark, sf, "findings").where("path is not null and severity is not null").select(F.regexp_extract("path", "([^/]*)$", 1).alias("label_path"), F.upper(F.trim("severity")).alias("label")).distinct()
    return J.label_by_basename(files, "path", labels, "label_path").select("record_id", "label")


@query("WITH w AS (SELECT DISTINCT path FROM code_findings WHERE path IS NOT NULL AND path <> ''), i AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM findings WHERE contains(path, '/') UNION SELECT ''), m AS (SELECT w.path, max(length(folder)) AS n FROM w JOIN i ON folder = '' OR w.path = folder OR starts_with(w.path, folder || '/') GROUP BY w.path) SELECT path, CAST(n AS VARCHAR) AS version FROM m")
def nearest_folders(spark: SparkSession, sf: str) -> DataFrame:
    """J-30: what is installed at the deepest folder on the way up."""
    from weftline.operators import joins as J

    wanted = table(spark, sf, "code_findings").where("path is not null and path <> ''").select("path", F.lit("lib").alias("name")).distinct()
    folders = table(spark, sf, "findings").where(F.contains("path", F.lit("/"))).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    folders = folders.unionByName(spark.createDataFrame([("",)], "folder string"))
    installed = folders.select("folder", F.lit("lib").alias("has"), F.length("folder").cast("string").alias("version"))
    return J.nearest_ancestor(wanted, "path", "name", installed, "folder", "has", "version").select("path", "version")
