"""Queries that write files of their own into the shared folder and read them back, so that SQL over the tables can check readers and writers.

Inputs in other formats (manifests, lock files, logs, patches, pages) are made out of table columns as text and parsed again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import parse as P
from weftline.plans.registry import Registry
from weftline.session import ensure_checkpoint_dir
from weftline.sources import files as S
from weftline.sources import sinks as K
from weftline.sources.tables import table
from weftline.streaming import events as E

registry = Registry()
query = registry.query

#: Names of the sales columns and the headers that may stand for them.
ALIASES = {"date": ["order date", "day"], "amount": ["total", "price"], "quantity": ["qty", "units"], "product": ["sku"], "note": ["remark"]}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS rows, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity, round(sum(round(l_extendedprice, 2)), 2) AS amount, count(DISTINCT l_partkey) AS products FROM lineitem GROUP BY 1")
def sales_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1, P-1, S-1, S-2, S-5: line items written as CSV with other headers, separator, date and money formats, and read back by aliases."""
    path = _folder(spark, "csv")
    rows = table(spark, sf, "lineitem")
    day = F.when(F.col("l_linenumber") % 3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(F.col("l_linenumber") % 3 == 1, F.date_format("l_shipdate", "yyyyMMdd")).otherwise(F.date_format("l_shipdate", "yyyy/MM/dd"))
    money = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    written = rows.select(day.alias(" Order Date"), money.alias("Total"), F.col("l_quantity").cast("int").cast("string").alias("QTY"), F.col("l_partkey").cast("string").alias("sku"))
    written.write.option("header", True).option("sep", ";").csv(path)
    sales = S.sales_rows(S.read_csv(spark, path, ALIASES))
    return sales.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity"), F.round(F.sum("amount"), 2).alias("amount"), F.countDistinct("product").alias("products"))


@query("SELECT event_id, user_id, event_type FROM events")
def events_from_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-5: events as JSON lines among lines that are none; those are dropped."""
    path = _folder(spark, "jsonl")
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    rows.select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value")).unionByName(rows.select(F.concat(F.lit("{broken "), F.col("event_id").cast("string")).alias("value"))).write.text(path)
    return S.read_jsonl(spark, path, "event_id long, user_id long, event_type string")


@query("SELECT count(*) AS lines, CAST(sum(length(rule_id || path)) AS BIGINT) AS characters, CAST(0 AS BIGINT) AS gaps FROM code_findings WHERE rule_id IS NOT NULL AND path IS NOT NULL")
def scanned_tree(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-6, SRC-7, X-8: a tree of text files scanned without a size limit; the lines of all of them, and files left out."""
    path = _folder(spark, "tree")
    table(spark, sf, "code_findings").where("rule_id is not null and path is not null").select(F.concat("rule_id", "path").alias("value")).write.text(path)
    found = S.scan_files(spark, path, pattern="*.txt")
    lines = found.where("gap is null").select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("x")).where("x <> ''")
    gaps = found.agg(F.count("gap").alias("gaps"))
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("x")).alias("characters")).join(F.broadcast(gaps))


@query("SELECT count(*) AS files, CAST(sum(length(source_snippet)) AS BIGINT) AS bytes, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM (SELECT left(h, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS d FROM (SELECT sha256(CAST(record_id AS VARCHAR) || '|' || sha256(source_snippet)) AS h FROM code_findings WHERE source_snippet IS NOT NULL) GROUP BY 1), (SELECT source_snippet FROM code_findings WHERE source_snippet IS NOT NULL) GROUP BY ALL".replace("SELECT count(*) AS files, CAST(sum(length(source_snippet)) AS BIGINT) AS bytes, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM (", "SELECT (SELECT count(*) FROM code_findings WHERE source_snippet IS NOT NULL) AS files, (SELECT CAST(sum(octet_length(encode(source_snippet))) AS BIGINT) FROM code_findings WHERE source_snippet IS NOT NULL) AS bytes, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM (").replace(", (SELECT source_snippet FROM code_findings WHERE source_snippet IS NOT NULL) GROUP BY ALL", ""))
def snapshot_of_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-7: the digest of an unchanging snapshot of texts, whatever their order."""
    rows = table(spark, sf, "code_findings").where("source_snippet is not null")
    return S.snapshot_digest(rows.select(F.col("record_id").cast("string").alias("path"), F.octet_length("source_snippet").cast("long").alias("size"), F.sha2("source_snippet", 256).alias("sha256")))


@query("SELECT n_name AS name, n_nationkey AS version FROM nation WHERE n_nationkey % 2 = 1")
def files_not_seen(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-2: of files written for each nation those whose content a log does not have yet; a second copy of each counts once."""
    path = _folder(spark, "import")
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat_ws("|", "n_name", F.col("n_nationkey").cast("string")).alias("value"))
    rows.unionByName(rows).repartition(7).write.partitionBy("k").text(path)
    once = rows.where("k % 2 = 0").select(F.explode(F.array(F.md5(F.concat("value", F.lit("\n"))), F.md5(F.concat("value", F.lit("\n"), "value", F.lit("\n"))))).alias("md5"))
    fresh = S.new_files(spark, path, once).select("path")
    found = fresh.select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("int").alias("k")).distinct()
    return found.join(rows, "k").distinct().select(F.split("value", r"\|")[0].alias("name"), F.col("k").alias("version"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'Cargo.toml' ELSE 'package.json' END AS manifest, 'pkg' || p_size AS name, '1.' || p_size || '.0' AS version FROM part")
def manifest_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-12: dependencies out of manifests of three kinds."""
    p, name, version = F.col("p_partkey"), F.concat(F.lit("pkg"), F.col("p_size").cast("string")), F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0"))
    base = F.when(p % 3 == 0, "requirements.txt").when(p % 3 == 1, "Cargo.toml").otherwise("package.json")
    text = F.when(p % 3 == 0, F.concat(F.lit("# needs\n"), name, F.lit("=="), version, F.lit("\n"))).when(p % 3 == 1, F.concat(F.lit("[dependencies]\n"), name, F.lit(' = "^'), version, F.lit('"\n'))).otherwise(F.concat(F.lit('{"dependencies": {"'), name, F.lit('": "~'), version, F.lit('"}}')))
    made = table(spark, sf, "part").select(F.concat(p.cast("string"), F.lit("/"), base).alias("path"), text.alias("text"))
    return S.dependencies(made).select(F.substring_index("path", "/", 1).cast("long").alias("id"), "manifest", "name", "version")


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Cargo.lock' WHEN 1 THEN 'poetry.lock' WHEN 2 THEN 'Gemfile.lock' ELSE 'composer.lock' END AS lock, 'pkg' || p_size AS name, '2.' || p_size || '.1' AS version FROM part")
def lock_versions(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-13: pinned packages out of lock files of four kinds."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name, version = F.concat(F.lit("pkg"), size), F.concat(F.lit("2."), size, F.lit(".1"))
    block = F.concat(F.lit('[[package]]\nname = "'), name, F.lit('"\nversion = "'), version, F.lit('"\n'))
    gem = F.concat(F.lit("GEM\n  specs:\n    "), name, F.lit(" ("), version, F.lit(")\n"))
    composer = F.concat(F.lit('{"packages": [{"name": "'), name, F.lit('", "version": "v'), version, F.lit('"}]}'))
    base = F.when(p % 4 == 0, "Cargo.lock").when(p % 4 == 1, "poetry.lock").when(p % 4 == 2, "Gemfile.lock").otherwise("composer.lock")
    made = table(spark, sf, "part").select(F.concat(p.cast("string"), F.lit("/"), base).alias("path"), F.when(p % 4 <= 1, block).when(p % 4 == 2, gem).otherwise(composer).alias("text"))
    return S.locked_packages(made).select(F.substring_index("path", "/", 1).cast("long").alias("id"), "lock", "name", "version")


@query("SELECT p_partkey AS id, 'node_modules/lib' || p_size AS owner, 'lib' || p_size AS name, '3.' || p_size || '.0' AS version, 'dep' || (p_size % 7) AS wants FROM part")
def lock_requirements(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-13: installed packages and what they require, out of npm lock files."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit('{"packages": {"": {"version": null}, "node_modules/lib'), size, F.lit('": {"version": "3.'), size, F.lit('.0", "dependencies": {"dep'), (F.col("p_size") % 7).cast("string"), F.lit('": "^1"}}}}'))
    rows = S.lock_edges(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")))
    return rows.where("owner <> ''").select(F.col("path").cast("long").alias("id"), "owner", "name", "version", F.explode("wants").alias("wants"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'app/' || event_type || '.py' AS path, CAST(event_id % 500 AS INTEGER) AS line FROM events")
def log_places(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-16: levels and places out of log lines; lines without a level are left out."""
    e = F.col("event_id")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_type") == "error", " ERROR ").otherwise(" INFO "), F.lit("app/"), "event_type", F.lit(".py:"), (e % 500).cast("string"), F.lit(" event "), e.cast("string"))
    rows = table(spark, sf, "events")
    made = rows.select(line.alias("x")).unionByName(rows.select(F.concat(F.lit("noise "), e.cast("string")).alias("x")))
    return S.log_signals(made, "x").select(F.regexp_extract("message", "event ([0-9]+)", 1).cast("long").alias("event_id"), "level", "path", "line")


@query("SELECT 'f' || p_partkey || '.py' AS path, line, line % 2 = 1 AS covered FROM part, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS line)")
def covered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-16: lines out of coverage reports."""
    text = F.concat(F.lit('{"files": {"f'), F.col("p_partkey").cast("string"), F.lit('.py": {"executed_lines": [1, 3, 5], "missing_lines": [2, 4]}}}'))
    return S.coverage_lines(table(spark, sf, "part").select(text.alias("t")), "t")


@query("SELECT CAST(user_id AS VARCHAR) AS trace, CAST(event_id AS VARCHAR) AS span, event_type AS name, event_id % 1000 AS micros FROM events")
def span_times(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-16: spans out of traces in JSON lines, among lines that are none."""
    e = F.col("event_id")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("trace_id"), e.cast("string").alias("span_id"), F.col("event_type").alias("name"), e.alias("start_us"), (e + e % 1000).alias("end_us")))
    rows = table(spark, sf, "events")
    return S.trace_spans(rows.select(line.alias("x")).unionByName(rows.select(F.lit("no span").alias("x"))), "x").select("trace", "span", "name", "micros")


@query("SELECT o_orderkey AS id, 'src/' || o_custkey || '.py' AS file, 'total = ' || o_shippriority AS added FROM (SELECT o_orderkey, o_custkey, o_orderstatus AS o_shippriority FROM orders)")
def patched_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-14, W-11: added lines of patches with the commit and file of the headers above them."""
    o, rows = F.col("o_orderkey"), table(spark, sf, "orders")
    parts = [F.concat(F.lit("commit "), F.lpad(F.hex(o), 40, "0")), F.concat(F.lit("--- a/src/"), F.col("o_custkey").cast("string"), F.lit(".py")), F.concat(F.lit("+++ b/src/"), F.col("o_custkey").cast("string"), F.lit(".py")), F.lit(" context"), F.lit("-gone"), F.concat(F.lit("+total = "), "o_orderstatus")]
    lines = rows.select(o.alias("id"), F.posexplode(F.array(*[F.lower(p) if i == 0 else p for i, p in enumerate(parts)])).alias("position", "line"))
    return S.added_lines(lines, "id", "position", "line").where("commit is not null").select("id", "file", "added")


@query("SELECT n_nationkey AS id, n_name AS title, 'https://x.example/' || n_nationkey AS canonical, '2025-01-0' || (1 + n_nationkey % 9) AS published, 'About ' || n_name || chr(10) || 'key ' || n_nationkey AS text FROM nation")
def page_parts(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-18: title, address, date and visible text out of pages."""
    k = F.col("n_nationkey").cast("string")
    head = F.concat(F.lit("<html><head><title> "), "n_name", F.lit(" </title><link rel=canonical href='https://x.example/"), k, F.lit("'><meta property='article:published_time' content='2025-01-0"), (1 + F.col("n_nationkey") % 9).cast("string"), F.lit("'><script>var x = '<p>';</script></head>"))
    body = F.concat(F.lit("<body><h1>About "), "n_name", F.lit("</h1><style>p {}</style><p>key  "), k, F.lit("</p></body></html>"))
    return S.page_texts(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(head, body).alias("html")), "id", "html")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(s_suppkey % 7 + 6 AS INTEGER) ELSE 9 END AS opens, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 18 ELSE 17 END AS closes FROM supplier")
def opening_hours(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-4: hours of a day as text to a map from the day: off, ranges, and texts that cannot be read."""
    s = F.col("s_suppkey")
    text = F.when(s % 4 == 0, "off").when(s % 4 == 1, F.concat((s % 7 + 6).cast("string"), F.lit(" - 18"))).when(s % 4 == 2, "9-17").otherwise("whenever")
    rows = S.day_ranges(table(spark, sf, "supplier").select("s_suppkey", text.alias("mon")), ["mon"])
    return rows.select("s_suppkey", F.element_at("available", 0)[0].alias("opens"), F.element_at("available", 0)[1].alias("closes"))


@query("SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' GROUP BY 1")
def parameterized_sql(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-9: a statement with named parameters."""
    name = f"orders_{uuid.uuid4().hex}"
    table(spark, sf, "orders").createOrReplaceTempView(name)
    return S.run_sql(spark, f"SELECT o_orderpriority, count(*) AS orders FROM {name} WHERE o_totalprice > :least AND o_orderstatus = :status GROUP BY 1", least=1000, status="F")


@query("SELECT kind, count(*) AS rows FROM (SELECT DISTINCT 'once' AS kind, rule_id FROM code_findings WHERE rule_id IS NOT NULL UNION ALL SELECT 'all', rule_id FROM code_findings WHERE rule_id IS NOT NULL UNION ALL SELECT 'all', rule_id FROM code_findings WHERE rule_id IS NOT NULL) GROUP BY kind")
def appended_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-1, SNK-2, SNK-5, R-2: a batch added twice stays twice; added by key it stays once."""
    whole, once = _folder(spark, "append"), _folder(spark, "once")
    rows = table(spark, sf, "code_findings").where("rule_id is not null").select("rule_id")
    for _ in range(2):
        K.append(rows, whole)
        K.append_new(rows, once, "rule_id")
    read = spark.read.parquet
    both = read(whole).select(F.lit("all").alias("kind")).unionByName(read(once).select(F.lit("once").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT CASE WHEN upper(trim(severity)) IN ('CRITICAL', 'HIGH') THEN 'error' WHEN upper(trim(severity)) = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, count(*) AS findings, count(DISTINCT rule_id) AS rules FROM (SELECT DISTINCT rule_id, path, line, description, CASE WHEN upper(trim(severity)) IN ('CRITICAL', 'HIGH') THEN 'HIGH' WHEN upper(trim(severity)) = 'MEDIUM' THEN 'MEDIUM' ELSE 'x' END AS severity FROM code_findings WHERE rule_id IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL) GROUP BY 1")
def merged_reports(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-3: reports of all kinds of findings, merged and counted."""
    rows = table(spark, sf, "code_findings").where("rule_id is not null and path is not null and line is not null")
    rows = rows.select(F.concat_ws("-", "kind", "category").alias("run"), F.col("rule_id").alias("rule"), "path", "line", F.upper(F.trim("severity")).alias("sev"), F.col("description").alias("message"))
    return K.sarif_summary(K.to_sarif(rows, "weftline"), "sarif").select("level", "findings", "rules")


@query("SELECT p_brand AS project, count(DISTINCT p_size) AS packages FROM part GROUP BY p_brand")
def spdx_bills(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-4: bills as SPDX, read back and counted."""
    bills = K.to_spdx(table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.concat(F.lit("pkg"), F.col("p_size").cast("string")).alias("name"), F.lit("1").alias("version")), "project")
    read = F.from_json("bill", "struct<spdxVersion:string,packages:array<struct<name:string>>>")
    return bills.select("project", F.size(read["packages"]).alias("n")).groupBy("project").agg(F.sum("n").alias("packages"))


@query(
    """WITH dep AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'Org/Pkg' ELSE 'pkg' END || p_partkey % 6 AS name, CASE WHEN p_partkey % 11 = 0 THEN 'latest' ELSE (p_size % 5) || '.' || (p_partkey % 9) || '.0' END AS version, p_size % 5 AS a, p_partkey % 9 AS b FROM part),
    j AS (SELECT id, version, a, b, regexp_extract(lower(name), '([^/]*)$', 1) AS base FROM dep) SELECT id, CASE base WHEN 'pkg1' THEN 'A1' WHEN 'pkg2' THEN 'A2' ELSE 'A3' END AS advisory,
    CASE WHEN version = 'latest' THEN 'inconclusive' ELSE 'affected' END AS state FROM j WHERE (base = 'pkg1' AND (version = 'latest' OR a < 2 OR (a = 2 AND b < 5))) OR (base = 'pkg2' AND (version = 'latest' OR a >= 1)) OR (base = 'pkg4' AND (version = 'latest' OR a < 1 OR a >= 3))"""
)
def affected_packages(spark: SparkSession, sf: str) -> DataFrame:
    """J-7, S-22: packages in the range of an advisory by their name, else by the last part of it; versions that cannot be read stay as inconclusive."""
    from weftline.operators import joins as J

    p = F.col("p_partkey")
    name = F.concat(F.when(p % 4 == 0, "Org/Pkg").otherwise("pkg"), (p % 6).cast("string"))
    version = F.when(p % 11 == 0, "latest").otherwise(F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (p % 9).cast("string"), F.lit("0")))
    deps = table(spark, sf, "part").select(p.alias("id"), name.alias("name"), version.alias("version"))
    feed = spark.createDataFrame([("PKG1", "<2.5.0", "A1"), ("pkg2", ">=1.0,<9", "A2"), ("pkg4", "<1 || >=3.0.0", "A3")], "n string, spec string, advisory string")
    return J.affected_versions(deps, feed).select("id", "advisory", "state")


@query("SELECT count(*) AS events, count(DISTINCT user_id) AS users FROM events")
def stream_repeated_events(spark: SparkSession, sf: str) -> DataFrame:
    """R-7: every event delivered twice, the second time in another file, and kept once within the watermark."""
    path = _folder(spark, "twice")
    rows = table(spark, sf, "events")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(path)
    out = E.to_table(E.distinct_events(E.read_events(spark, path, pattern="*.parquet")), "append")
    return out.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))


@query(
    """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
    SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n"""
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """R-7: sessions as a stream that runs to its end."""
    out = E.to_table(E.sessions(E.read_events(spark, sf)), "complete")
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


@query("SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS at, round(value, 2) AS amount FROM events")
def parsed_times(spark: SparkSession, sf: str) -> DataFrame:
    """S-4, S-2: times with and without zone to UTC, and amounts with signs and marks."""
    e = F.col("event_id")
    local = F.when(e % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(e % 3 == 1, F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = table(spark, sf, "events").select("event_id", local.alias("t"), F.concat(F.lit("EUR "), F.format_number("value", 2)).alias("m"))
    return rows.select("event_id", P.parse_utc(F.col("t")).cast("timestamp_ntz").alias("at"), P.parse_money(F.col("m")).alias("amount"))
