"""Queries that resolve, link, grade and match: names, imports, evidence, reachability, requirements, rule packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import norm_key
from weftline.operators import resolution as R
from weftline.plans.problems import _sql_key as k
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query


def _values(rows: list[tuple]) -> str:
    """Rows of texts and numbers as SQL; lists as DuckDB lists."""
    one = lambda v: "NULL" if v is None else "[" + ", ".join(map(one, v)) + "]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower()
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# a made-up program: definitions from parts, calls and aliases from line items
_PROGRAM = """d AS (SELECT DISTINCT 'm' || (p_partkey % 20) || CASE WHEN p_partkey % 7 = 0 THEN '.C' || (p_size % 3) ELSE '' END || '.f' || (p_partkey % 35) AS name FROM part),
    c AS (SELECT DISTINCT 'm' || (l_suppkey % 20) AS module, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || (l_linenumber % 2) || '.' ELSE 'obj.' END || 'f' || (l_partkey % 40) AS callee FROM lineitem),
    a AS (SELECT 'm' || (i % 20) AS module, 'a' || (i // 20) AS alias, 'm' || ((i * 3 + 1) % 20) AS stands_for FROM range(40) t(i))"""


def _program(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = lambda c: c.cast("string")
    p = F.col("p_partkey")
    names = F.concat(F.lit("m"), text(p % 20), F.when(p % 7 == 0, F.concat(F.lit(".C"), text(F.col("p_size") % 3))).otherwise(""), F.lit(".f"), text(p % 35))
    way = F.col("l_linenumber") % 3
    head = F.when(way == 0, "").when(way == 1, F.concat(F.lit("a"), text(F.col("l_linenumber") % 2), F.lit("."))).otherwise("obj.")
    calls = table(spark, sf, "lineitem").select(F.concat(F.lit("m"), text(F.col("l_suppkey") % 20)).alias("module"), F.concat(head, F.lit("f"), text(F.col("l_partkey") % 40)).alias("callee"))
    aliases = spark.range(40).select(F.concat(F.lit("m"), text(F.col("id") % 20)).alias("module"), F.concat(F.lit("a"), text(F.floor(F.col("id") / 20))).alias("alias"), F.concat(F.lit("m"), text((F.col("id") * 3 + 1) % 20)).alias("stands_for"))
    return calls, table(spark, sf, "part").select(names.alias("name")), aliases


@query(
    f"""WITH {_PROGRAM}, n AS (SELECT name, split_part(name, '.', 1) AS m, regexp_extract(name, '([^.]*)$', 1) AS s FROM d), im AS (SELECT m, s, min(name) AS one FROM n GROUP BY m, s HAVING count(*) = 1), g AS (SELECT s, min(name) AS one FROM n GROUP BY s HAVING count(*) = 1),
    q AS (SELECT c.*, regexp_extract(callee, '([^.]*)$', 1) AS short, split_part(callee, '.', 1) AS head, substr(callee, length(split_part(callee, '.', 1)) + 2) AS tail FROM c), b AS (SELECT q.*, a.stands_for, a.stands_for || CASE WHEN tail <> '' THEN '.' || tail ELSE '' END AS byname FROM q LEFT JOIN a ON q.module = a.module AND q.head = a.alias),
    r AS (SELECT b.module, b.callee, x.name AS x, im.one AS one, y.name AS y, i2.one AS below, g.one AS anywhere FROM b LEFT JOIN d x ON x.name = b.module || '.' || b.callee LEFT JOIN im ON im.m = b.module AND im.s = b.short LEFT JOIN d y ON y.name = b.byname
      LEFT JOIN im i2 ON i2.m = split_part(b.stands_for, '.', 1) AND i2.s = regexp_extract(b.byname, '([^.]*)$', 1) LEFT JOIN g ON g.s = b.short)
    SELECT module, callee, coalesce(x, one, y, below, anywhere, '') AS target, CASE WHEN x IS NOT NULL THEN 'own' WHEN one IS NOT NULL THEN 'module' WHEN coalesce(y, below) IS NOT NULL THEN 'alias' WHEN anywhere IS NOT NULL THEN 'global' ELSE 'none' END AS how FROM r"""
)
def call_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """J-23: called names resolved in their module, by alias, or where they are unique."""
    return R.resolve_calls(*_program(spark, sf))


_ENDINGS = [".py", ".js", ".ts", ".java", ".c", ".go", ".rb", ".sh"]
_TRIES = ["", *_ENDINGS, *[f"/index{e}" for e in _ENDINGS]]


@query(
    f"""WITH f AS (SELECT DISTINCT path FROM code_findings WHERE path IS NOT NULL AND path <> ''), i AS (SELECT path, './' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS specifier FROM f
      UNION SELECT path, '../' || regexp_replace(path, '\\.[^.]*$', '') FROM f UNION SELECT path, '../../../../../../up' FROM f),
    b AS (SELECT path, specifier, CASE WHEN specifier LIKE './%' THEN CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') || '/' ELSE '' END || substr(specifier, 3)
      WHEN specifier LIKE '../../%' THEN NULL WHEN NOT contains(path, '/') THEN NULL WHEN contains(regexp_replace(path, '/[^/]*$', ''), '/') THEN regexp_replace(path, '/[^/]*/[^/]*$', '') || '/' || substr(specifier, 4) ELSE substr(specifier, 4) END AS base FROM i),
    t AS (SELECT unnest({_TRIES}) AS ending, unnest(range({len(_TRIES)})) AS pos)
    SELECT b.path, b.specifier, arg_min(f.path, pos) AS target FROM b CROSS JOIN t JOIN f ON f.path = base || ending WHERE base IS NOT NULL GROUP BY b.path, b.specifier"""
)
def import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """G-10: relative imports to files, by candidates in a fixed order of endings."""
    files = table(spark, sf, "code_findings").select("path").where("path is not null and path <> ''").distinct()
    bare = F.regexp_replace("path", r"\.[^.]*$", "")
    own = files.select("path", F.concat(F.lit("./"), F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")).alias("specifier"))
    up = files.select("path", F.concat(F.lit("../"), bare).alias("specifier"))
    out = files.select("path", F.lit("../../../../../../up").alias("specifier"))
    return R.resolve_imports(own.unionByName(up).unionByName(out), files, _ENDINGS)


@query(
    f"""WITH t AS (SELECT DISTINCT {k('fingerprint')} AS target, path || ':' || line AS locator FROM findings WHERE {k('fingerprint')} IS NOT NULL),
    e AS (SELECT 'o' || opinion_id AS evidence, {k('finding')} AS ref, NULL AS locator FROM member_opinions UNION ALL SELECT 'c' || record_id, NULL, path || ':' || line FROM code_findings UNION ALL SELECT 'f' || row_id, NULL, path || ':' || line FROM findings),
    loc AS (SELECT locator, count(DISTINCT target) AS n, min(target) AS m FROM t WHERE locator IS NOT NULL GROUP BY locator),
    j AS (SELECT evidence, x.target AS direct, m, CASE WHEN x.target IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS n FROM e LEFT JOIN (SELECT DISTINCT target FROM t) x ON e.ref = x.target LEFT JOIN loc ON e.locator = loc.locator)
    SELECT evidence, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'unlinked' END AS state, CASE WHEN n = 1 THEN coalesce(direct, m) END AS target FROM j"""
)
def evidence_links(spark: SparkSession, sf: str) -> DataFrame:
    """J-20: evidence linked by reference or by place, where exactly one finding fits."""
    place = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"))
    rows = table(spark, sf, "findings")
    targets = rows.select(norm_key("fingerprint").alias("target"), place.alias("locator")).where("target is not null").distinct()
    none = F.lit(None).cast("string")
    said = table(spark, sf, "member_opinions").select(F.concat(F.lit("o"), F.col("opinion_id").cast("string")).alias("evidence"), norm_key("finding").alias("ref"), none.alias("locator"))
    seen = table(spark, sf, "code_findings").select(F.concat(F.lit("c"), F.col("record_id").cast("string")).alias("evidence"), none.alias("ref"), place.alias("locator"))
    own = rows.select(F.concat(F.lit("f"), F.col("row_id").cast("string")).alias("evidence"), none.alias("ref"), place.alias("locator"))
    return R.link_evidence(said.unionByName(seen).unionByName(own), targets)


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, value, event_id % 3 AS slot FROM events), p AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'signup' AND user_id % 2 = 0),
    r AS (SELECT f.event_id AS finding, count(*) AS paths, bool_and(c.value < 20) AS gated, min(1 + c.event_id % 4) AS hops FROM (SELECT * FROM e WHERE event_type = 'error') f JOIN (SELECT * FROM e WHERE event_type = 'purchase') c ON f.user_id = c.user_id AND f.slot = c.slot GROUP BY f.event_id)
    SELECT f.event_id AS finding, CASE WHEN gated THEN 'behind authentication' WHEN paths IS NOT NULL THEN 'unauthenticated' WHEN p.user_id IS NOT NULL THEN 'no path' ELSE 'unknown' END AS grade, coalesce(paths, 0) AS paths, hops
    FROM (SELECT * FROM e WHERE event_type = 'error') f LEFT JOIN r ON f.event_id = r.finding LEFT JOIN p ON f.user_id = p.user_id"""
)
def reachability_of_errors(spark: SparkSession, sf: str) -> DataFrame:
    """G-11: grades by paths and entry points: all gated, any not, none though entry points are known, nothing known."""
    rows = table(spark, sf, "events").withColumn("slot", F.col("event_id") % 3)
    errors = rows.where("event_type = 'error'").select(F.col("event_id").alias("finding"), F.col("user_id").alias("project"), "slot")
    buys = rows.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("slot").alias("s"), (F.col("value") < 20).alias("gated"), (1 + F.col("event_id") % 4).alias("hops"))
    paths = errors.join(buys, (F.col("project") == F.col("u")) & (F.col("slot") == F.col("s"))).select("finding", "gated", "hops")
    entries = rows.where("event_type = 'signup' and user_id % 2 = 0").select(F.col("user_id").alias("project"))
    return R.reachability_grades(errors.select("finding", "project"), paths, entries)


_STANCE = "CASE regexp_replace(upper(verdict), '[^A-Z]', '', 'g') WHEN 'EXPLOITABLE' THEN 'support' WHEN 'NOTEXPLOITABLE' THEN 'contest' ELSE 'none' END"
_ADJ = f"""f AS (SELECT DISTINCT {k('fingerprint')} AS finding FROM triage WHERE {k('fingerprint')} IS NOT NULL), e AS (SELECT {k('finding')} AS finding, member AS source, {_STANCE} AS stance FROM member_opinions),
    s AS (SELECT finding, source, bool_or(stance = 'support') AS s, bool_or(stance = 'contest') AS c FROM e WHERE stance <> 'none' GROUP BY finding, source), p AS (SELECT finding, bool_or(s) AS s, bool_or(c) AS c, bool_or(s AND c) AS x FROM s GROUP BY finding),
    adj AS (SELECT f.finding, CASE WHEN coalesce(c, false) THEN 'contested' WHEN coalesce(s, false) THEN 'supported' ELSE 'insufficient' END AS "class",
      concat_ws(',', CASE WHEN c THEN 'contesting evidence' END, CASE WHEN x THEN 'contradiction' END, CASE WHEN NOT coalesce(s, false) AND NOT coalesce(c, false) THEN 'no decisive evidence' END, CASE WHEN s THEN 'supporting evidence' END) AS reasons FROM f LEFT JOIN p ON f.finding = p.finding)"""


def _adjudicated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    known = table(spark, sf, "triage").select(norm_key("fingerprint").alias("finding")).where("finding is not null").distinct()
    bare = F.regexp_replace(F.upper("verdict"), "[^A-Z]", "")
    stance = F.when(bare == "EXPLOITABLE", "support").when(bare == "NOTEXPLOITABLE", "contest").otherwise("none")
    evidence = table(spark, sf, "member_opinions").select(norm_key("finding").alias("finding"), F.col("member").alias("source"), stance.alias("stance"))
    return known, evidence, R.adjudicate(known, evidence)


@query(f'WITH {_ADJ} SELECT finding, "class", reasons FROM adj')
def adjudication(spark: SparkSession, sf: str) -> DataFrame:
    """T-16: triaged findings as supported, contested or insufficient by the opinions on them."""
    return _adjudicated(spark, sf)[2]


@query(
    f"""WITH {_ADJ}, hot AS (SELECT path FROM findings WHERE upper(trim(severity)) = 'CRITICAL' AND path IS NOT NULL GROUP BY path), g AS (
      SELECT 'insufficient evidence' AS gap, count(*) AS n FROM adj WHERE "class" = 'insufficient' UNION ALL SELECT 'contested', count(*) FROM adj WHERE "class" = 'contested' UNION ALL SELECT 'contradictory input', count(*) FROM adj WHERE contains(reasons, 'contradiction')
      UNION ALL SELECT 'unknown stance', count(*) FROM e WHERE stance = 'none' UNION ALL SELECT 'unlinked evidence', count(*) FROM e WHERE finding IS NULL OR finding NOT IN (SELECT finding FROM f) UNION ALL SELECT 'no findings', CASE WHEN (SELECT count(*) FROM f) = 0 THEN 1 ELSE 0 END
      UNION ALL SELECT 'uncovered high risk', count(*) FROM hot WHERE path NOT IN (SELECT path FROM code_findings WHERE path IS NOT NULL))
    SELECT gap, n FROM g WHERE n > 0"""
)
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """T-17: what the adjudication could not cover, as counts that are not 0."""
    known, evidence, judged = _adjudicated(spark, sf)
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    linked = evidence.join(known.select(F.col("finding").alias("f")), F.col("finding") == F.col("f"), "left_anti")
    hot = table(spark, sf, "findings").where("upper(trim(severity)) = 'CRITICAL' and path is not null").select(F.col("path").alias("p")).distinct()
    covered = table(spark, sf, "code_findings").select("path").where("path is not null").distinct()
    return R.gap_rows(
        {
            "insufficient evidence": count(judged.where("class = 'insufficient'")),
            "contested": count(judged.where("class = 'contested'")),
            "contradictory input": count(judged.where(F.contains("reasons", F.lit("contradiction")))),
            "unknown stance": count(evidence.where("stance = 'none'")),
            "unlinked evidence": count(linked),
            "no findings": known.agg((F.count(F.lit(1)) == 0).cast("int").alias("n")),
            "uncovered high risk": count(hot.join(covered, F.col("p") == F.col("path"), "left_anti")),
        }
    )


_PACKAGES = ["requests", "openssl", "jwt", "yaml", "crypto", "log4j", "curl", "checkout", "postgres", "left-pad"]


@query(
    f"""WITH t AS (SELECT record_id, path, line, lower(coalesce(CASE WHEN kind = 'Finding' THEN source_snippet ELSE code END, '')) AS x FROM code_findings), p AS (SELECT unnest({_PACKAGES}) AS package)
    SELECT package, count(record_id) AS mentions, min(record_id) AS first_record, arg_min(path, record_id) AS path FROM p LEFT JOIN t ON contains(x, package) GROUP BY package"""
)
def package_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """J-16: packages (a fixed list) whose name stands in any code text, with the first place; one pass over the texts, no join of texts."""
    text = F.lower(F.coalesce(F.when(F.col("kind") == "Finding", F.col("source_snippet")).otherwise(F.col("code")), F.lit("")))
    hits = table(spark, sf, "code_findings").select("record_id", "path", F.explode(F.filter(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in _PACKAGES]), lambda x: x.isNotNull())).alias("package"))
    met = hits.groupBy(F.col("package").alias("p")).agg(F.count(F.lit(1)).alias("mentions"), F.min("record_id").alias("first_record"), F.min_by(F.struct("path"), "record_id")["path"].alias("path"))
    wanted = spark.createDataFrame([(p,) for p in _PACKAGES], "package string")
    return wanted.join(met, F.col("package") == F.col("p"), "left").select("package", F.coalesce("mentions", F.lit(0)).alias("mentions"), "first_record", "path")


_CONTROLS = [("A01", "access", ["CWE-22", "CWE-200", "CWE-352", "CWE-862"]), ("A02", "cryptography", ["CWE-327", "CWE-330", "CWE-295"]), ("A03", "injection", ["CWE-79", "CWE-89", "CWE-94", "CWE-78"]), ("A07", "authentication", ["CWE-287", "CWE-352"]), ("A09", "logging", ["CWE-99999"]), ("A11", "people", [])]


@query(
    f"""WITH ctl(control, title, cwes) AS (VALUES {_values(_CONTROLS)}), cc AS (SELECT control, unnest(cwes) AS cwe FROM ctl), own AS (SELECT record_id, cwe, upper(trim(severity)) AS sev FROM code_findings WHERE cwe <> ''),
    hit AS (SELECT control, record_id, any_value(sev) AS sev FROM cc JOIN own ON cc.cwe = own.cwe GROUP BY control, record_id), n AS (SELECT control, count(*) AS findings, CAST(count_if(sev IN ('CRITICAL', 'HIGH')) AS BIGINT) AS severe FROM hit GROUP BY control)
    SELECT ctl.control, CASE WHEN len(cwes) = 0 THEN 'not assessed' WHEN findings IS NOT NULL THEN 'failing' ELSE 'passing' END AS status, coalesce(findings, 0) AS findings, coalesce(severe, 0) AS severe FROM ctl LEFT JOIN n ON ctl.control = n.control"""
)
def control_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """J-17: findings to weaknesses to controls, many to many, with the status of each control."""
    controls = spark.createDataFrame(_CONTROLS, "control string, title string, cwes array<string>")
    mapped = F.broadcast(controls.select(F.col("control").alias("c"), F.explode("cwes").alias("w")))
    own = table(spark, sf, "code_findings").where("cwe <> ''").select("record_id", "cwe", F.upper(F.trim("severity")).alias("sev"))
    hit = own.join(mapped, F.col("cwe") == F.col("w")).groupBy("c").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("sev").isin("CRITICAL", "HIGH")).alias("severe"))
    status = F.when(F.size("cwes") == 0, "not assessed").when(F.col("findings").isNotNull(), "failing").otherwise("passing")
    return controls.join(hit, F.col("control") == F.col("c"), "left").select("control", status.alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("severe", F.lit(0)).alias("severe"))


_HINTS = [("spoofing", ["auth", "csrf"]), ("tampering", ["sqli", "cmdi", "deser", "path"]), ("disclosure", ["leak", "path", "ssrf"]), ("denial", ["dos", "race"]), ("elevation", ["eval", "auth", "priv"])]


@query(f"WITH h(category, hints) AS (VALUES {_values(_HINTS)}) SELECT DISTINCT record_id, h.category FROM code_findings JOIN h ON len(list_filter(hints, lambda x: contains(lower(rule_id), x))) > 0")
def threat_links(spark: SparkSession, sf: str) -> DataFrame:
    """J-18: findings linked to a category by the first of its hints that their rule contains, once a category; distinct rules are matched, not rows."""
    rows = table(spark, sf, "code_findings").select("record_id", "rule_id").where("rule_id is not null")
    low = F.lower(F.col("rule_id"))
    met = F.filter(F.array(*[F.when(F.coalesce(*[F.when(F.contains(low, F.lit(h)), F.lit(h)) for h in hints]).isNotNull(), F.lit(c)) for c, hints in _HINTS]), lambda x: x.isNotNull())
    rules = rows.select("rule_id").distinct().select(F.col("rule_id").alias("r"), F.explode(met).alias("category"))
    return rows.join(rules, F.col("rule_id") == F.col("r")).select("record_id", "category").distinct()


_PROFILES = [("flask", "python"), ("django", "python"), ("express", "javascript"), ("servlet", "java")]
_SOURCES = [("flask", "args"), ("flask", "form"), ("django", "get"), ("express", "query"), ("express", "body"), ("servlet", "parameter")]
_SINKS = [("python", "eval"), ("python", "system"), ("javascript", "eval"), ("java", "exec"), ("java", "query"), ("go", "exec")]


@query(f"WITH p(profile, language) AS (VALUES {_values(_PROFILES)}), s(profile, source) AS (VALUES {_values(_SOURCES)}), k(language, sink) AS (VALUES {_values(_SINKS)}) SELECT p.profile || '-' || source || '-' || sink AS rule, p.language, p.profile, source, sink FROM p JOIN s ON p.profile = s.profile JOIN k ON p.language = k.language")
def rule_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """J-19: a catalog of rules out of profiles, their sources and the sinks of their language."""
    make = spark.createDataFrame
    return R.expand_catalog(make(_PROFILES, "profile string, language string"), make(_SOURCES, "profile string, source string"), make(_SINKS, "language string, sink string"))


_POPULAR = ["requests", "numpy", "pandas", "flask", "urllib3", "pyyaml", "cryptography", "python-dateutil"]
_TAKEN = ["requets", "request", "numpys", "python-numpy", "panda", "flask-py", "urlib3", "yaml", "cryptographi", "dateutil", "left-pad", "pyflask"]


@query(
    f"""WITH own AS (SELECT DISTINCT replace(lower(({_TAKEN})[1 + p_partkey % {len(_TAKEN)}] || CASE WHEN p_size % 5 = 0 THEN 's' ELSE '' END), '-', '_') AS package FROM part), pop AS (SELECT unnest({[p.replace('-', '_') for p in _POPULAR]}) AS popular),
    x AS (SELECT package AS a, popular AS b, 1 - levenshtein(package, popular) / greatest(length(package), length(popular)) AS sim FROM own, pop WHERE package <> popular),
    r AS (SELECT a, b, 'similar' AS rule, round(sim, 4) AS similarity FROM x WHERE sim >= 0.85 UNION ALL
      SELECT a, b, 'derived', 0.95 FROM x WHERE b IN (replace(a, '-', '_'), replace(a, '_', '-'), replace(a, '-', ''), replace(a, '_', ''), a || 's', CASE WHEN length(a) > 3 AND suffix(a, 's') THEN left(a, length(a) - 1) ELSE a END,
        'python-' || a, 'py' || a, a || '-python', a || '-py', replace(a, 'python', ''), CASE WHEN prefix(a, 'py') THEN replace(a, 'py', '') ELSE a END) UNION ALL
      SELECT a, b, 'part', 0.7 FROM x WHERE length(a) > 3 AND length(b) > 3 AND (contains(a, b) OR contains(b, a)) AND abs(length(a) - length(b)) <= 3)
    SELECT a AS package, b AS popular, rule, CAST(similarity AS DOUBLE) AS similarity FROM r"""
)
def package_look_alikes(spark: SparkSession, sf: str) -> DataFrame:
    """S-11, S-12: names near, derived from or part of popular ones; the similarity is by edit distance (`sequence_ratio` gives the matching-blocks one)."""
    p = F.element_at(F.array(*[F.lit(x) for x in _TAKEN]), (1 + F.col("p_partkey") % len(_TAKEN)).cast("int"))
    return R.look_alikes(table(spark, sf, "part").select(F.concat(p, F.when(F.col("p_size") % 5 == 0, "s").otherwise("")).alias("p")), "p", _POPULAR)


_PACK = [("calls-eval", "call", ["eval", "exec"], None), ("weak-hash", "call", ["hashlib.md5", "md5", "sha1"], ["CWE-327", "CWE-330", "CWE-200"]), ("opens", "call", ["open", "fopen"], None)]
_FIXTURES = [("calls-eval", True, "call", "eval", None), ("calls-eval", False, "call", "evaluate", None), ("weak-hash", True, "call", "md5", "CWE-327"), ("weak-hash", False, "call", "md5", "CWE-79"), ("opens", True, "call", "reopen", None)]
_CALLS_SQL = "SELECT record_id, unnest(list_distinct(regexp_extract_all(CASE WHEN kind = 'Finding' THEN source_snippet ELSE code END, '([A-Za-z_][A-Za-z0-9_.]*)\\(', 1))) AS name, cwe FROM code_findings"


@query(f"WITH r(rule, kind, names, cwes) AS (VALUES {_values(_PACK)}), u AS (SELECT rule, unnest(names) AS n, cwes FROM r), c AS ({_CALLS_SQL}) SELECT rule, record_id AS row, name FROM c JOIN u ON c.name = u.n WHERE cwes IS NULL OR list_contains(cwes, cwe)")
def rule_pack_matches(spark: SparkSession, sf: str) -> DataFrame:
    """P-10, 2.13: rules as data (kinds, names, weaknesses) over the calls of every code text."""
    text = F.when(F.col("kind") == "Finding", F.col("source_snippet")).otherwise(F.col("code"))
    calls = table(spark, sf, "code_findings").select(F.col("record_id").alias("row"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\("), 1))).alias("name"), "cwe", F.lit("call").alias("kind"))
    return R.rule_matches(calls, spark.createDataFrame(_PACK, "rule string, kind string, names array<string>, cwes array<string>"))


@query("SELECT * FROM (VALUES ('opens', 'no negative fixture'), ('opens', 'positive fixture missed')) t(rule, problem)")
def rule_pack_errors(spark: SparkSession, sf: str) -> DataFrame:
    """P-10, 2.13: rules that may not be used as their fixtures are missing or come out wrong (the pack is a constant, and so is the SQL)."""
    make = spark.createDataFrame
    return R.pack_errors(make(_PACK, "rule string, kind string, names array<string>, cwes array<string>"), make(_FIXTURES, "rule string, positive boolean, kind string, name string, cwe string"))


@query(
    """WITH w AS (SELECT s_suppkey AS worker, ['r' || s_suppkey % 3, 'r' || s_suppkey % 5] AS roles, s_suppkey % 7 AS day, 8 AS a, 10 + s_suppkey % 10 AS b FROM supplier), s AS (SELECT n_nationkey AS shift, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 'r' || n_nationkey % 5 END AS role, n_nationkey % 7 AS day, 8 + n_nationkey % 4 AS x, 10 + n_nationkey % 4 + n_nationkey % 3 AS y FROM nation)
    SELECT shift, worker FROM s JOIN w ON s.day = w.day AND (role IS NULL OR list_contains(roles, role)) AND x >= a AND y <= b"""
)
def shift_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """J-21: who may take a shift by role and hours."""
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    role = lambda c, m: F.concat(F.lit("r"), (c % m).cast("string"))
    hours = F.create_map((s % 7).cast("int"), F.array(F.lit(8).cast("long"), 10 + s % 10))
    workers = table(spark, sf, "supplier").select(s.alias("worker"), F.array(role(s, 3), role(s, 5)).alias("roles"), hours.alias("hours"))
    shifts = table(spark, sf, "nation").select(n.alias("shift"), F.when(n % 6 != 0, role(n, 5)).alias("role"), (n % 7).cast("int").alias("day"), (8 + n % 4).alias("start"), (10 + n % 4 + n % 3).alias("end"))
    return R.eligible(workers, shifts)


@query()
def shift_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """X-9: shifts of each region filled one after another (sequential by nature; tested against a plain loop)."""
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    role = lambda c, m: F.concat(F.lit("r"), (c % m).cast("string"))
    hours = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.struct(d, F.array(F.lit(8).cast("double"), (12 + s % 9).cast("double")))))
    workers = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("site"), s.alias("worker"), F.array(role(s, 3), role(s, 5)).alias("roles"), hours.alias("hours"), (10 + s % 7).cast("double").alias("rate"), F.lit(16.0).alias("most"), (s % 3).alias("priority"))
    shifts = table(spark, sf, "nation").select(F.col("n_regionkey").alias("site"), n.alias("shift"), role(n, 5).alias("role"), (n % 7).cast("int").alias("day"), (8 + n % 4).cast("double").alias("start"), (10 + n % 4 + n % 3).cast("double").alias("end"), F.lit(1).alias("least"), F.lit(2).alias("most"))
    return R.assign_shifts(workers, shifts)


_HASH = "left(sha256(coalesce(path, '') || '|' || coalesce(CAST(line AS VARCHAR), '') || '|' || coalesce(rule_id, '')), 16)"


@query(f"WITH h AS (SELECT DISTINCT {_HASH} AS h FROM code_findings WHERE kind = 'AIFinding'), c AS (SELECT DISTINCT {_HASH} AS h, path, line, rule_id FROM code_findings UNION SELECT DISTINCT {_HASH}, path, line, rule_id FROM findings) SELECT c.h AS hash, path, line, rule_id FROM c JOIN h ON c.h = h.h")
def hash_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """J-24: which place and rule a stored hash stands for: an equality join on the hash of all that is known."""
    own = F.substring(F.sha2(F.concat_ws("|", F.coalesce("path", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("")), F.coalesce("rule_id", F.lit(""))), 256), 1, 16)
    code = table(spark, sf, "code_findings")
    places = ["path", "line", "rule_id"]
    known = code.select(own.alias("hash"), *places).unionByName(table(spark, sf, "findings").select(own.alias("hash"), *places)).distinct()
    return known.join(code.where("kind = 'AIFinding'").select(own.alias("h")).distinct(), F.col("hash") == F.col("h")).drop("h")


@query("WITH g AS (SELECT path, row_number() OVER (ORDER BY sha256('7' || chr(9) || path)) AS n, count(*) OVER () AS a FROM (SELECT DISTINCT path FROM code_findings WHERE path IS NOT NULL)) SELECT record_id, CASE WHEN n <= floor(a * 0.8) THEN 'train' ELSE 'test' END AS part FROM code_findings JOIN g USING (path)")
def path_split(spark: SparkSession, sf: str) -> DataFrame:
    """T-9: groups in the order of a hash, cut at exactly four fifths of them."""
    return R.ranked_split(table(spark, sf, "code_findings").select("record_id", "path"), "path", 7).select("record_id", "part")


@query("WITH g AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('3' || chr(9) || CAST(doc_id AS VARCHAR))) AS n, count(*) OVER () AS a FROM (SELECT DISTINCT doc_id FROM documents)), p AS (SELECT md5(text) AS h, n <= floor(a * 0.8) AS train FROM documents JOIN g USING (doc_id) WHERE text IS NOT NULL) SELECT count(*) AS held_out, CAST(count_if(h IN (SELECT h FROM p WHERE train)) AS BIGINT) AS overlapping FROM p WHERE NOT train")
def held_out_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """T-10: a holdout of single rows by rank of a hash, and how many of it are in the rest too."""
    parts = R.ranked_split(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h")), "doc_id", 3).where("h is not null")
    train = parts.where("part = 'train'").select(F.col("h").alias("t")).distinct()
    return parts.where("part = 'test'").join(train, F.col("h") == F.col("t"), "left").agg(F.count(F.lit(1)).alias("held_out"), F.count("t").alias("overlapping"))


@query()
def code_flows(spark: SparkSession, sf: str) -> DataFrame:
    """G-13: values from input calls that reach a sink, line after line; tested on fixtures."""
    text = F.when(F.col("kind") == "Finding", F.col("source_snippet")).otherwise(F.col("code"))
    rows = table(spark, sf, "code_findings").select("record_id", text.alias("text"))
    return R.local_flows(rows, "record_id", "text", ["input", "request.get", "os.getenv", "sys.argv", "getenv", "gets"], ["eval", "exec", "os.system", "subprocess.run", "system", "open"], ["quote", "shlex.quote", "escape", "int"])
