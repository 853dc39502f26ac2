"""Queries on documents, code texts and training pairs as collections of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import parse as P
from weftline.functions import text as T
from weftline.operators import code as K
from weftline.operators import corpus as C
from weftline.operators import windows as W
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query

#: Line rules as data: name, pattern (in the common part of the Java and RE2 dialects).
LINE_RULES = [
    ("todo", r"(TODO|FIXME)"),
    ("eval", r"\beval\("),
    ("exec", r"(exec|system)\("),
    ("weak-hash", r"(?i)\b(md5|sha1)\b"),
    ("memcpy", r"\bmemcpy\("),
    ("open", r"\bopen\("),
    ("http", r"http://"),
    ("sql", r"(?i)select .* from "),
]
_RULE_SQL = "[" + ", ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN '{n}' END" for n, p in LINE_RULES) + "]"
_CODE = "c AS (SELECT record_id, CASE WHEN kind = 'Finding' THEN source_snippet ELSE code END AS text, path, kind, severity FROM code_findings)"


def _code(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "code_findings").select("record_id", F.when(F.col("kind") == "Finding", F.col("source_snippet")).otherwise(F.col("code")).alias("text"), "path", "kind", "severity")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "doc_kind", "path")


@query(
    f"""WITH {_CODE}, l AS (SELECT record_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM c WHERE text IS NOT NULL)
    SELECT record_id, CAST(line_no AS INTEGER) AS line_no, rule FROM (SELECT record_id, line_no, unnest({_RULE_SQL}) AS rule FROM l) WHERE rule IS NOT NULL"""
)
def rule_scan(spark: SparkSession, sf: str) -> DataFrame:
    """T-1, S-20, 2.13: rules as data over the lines of every code text."""
    return C.scan_lines(_code(spark, sf), "record_id", "text", LINE_RULES)


@query(
    f"""WITH {_CODE}, l AS (SELECT record_id, unnest(string_split(text, chr(10))) AS line FROM c WHERE text IS NOT NULL), known AS (SELECT DISTINCT rule_id FROM findings),
    h AS (SELECT rule, trim(line) AS line FROM (SELECT line, unnest({_RULE_SQL}) AS rule FROM l) WHERE rule IS NOT NULL AND rule NOT IN (SELECT rule_id FROM known WHERE rule_id IS NOT NULL))
    SELECT rule, count(DISTINCT line) AS distinct_lines, count(*) AS hits FROM h GROUP BY rule"""
)
def rule_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """T-22: rules that no run knows yet, with the distinct lines they would hit."""
    rows = _code(spark, sf).select(F.explode(F.split("text", "\n")).alias("line"))
    hits = rows.select(F.explode(F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in LINE_RULES]), lambda r: r.isNotNull())).alias("rule"), F.trim("line").alias("line"))
    known = table(spark, sf, "findings").select(F.col("rule_id").alias("k")).distinct()
    return hits.join(known, F.col("rule") == F.col("k"), "left_anti").groupBy("rule").agg(F.countDistinct("line").alias("distinct_lines"), F.count(F.lit(1)).alias("hits"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+', '<mail>', 'g'), '(?i)(password|token|secret)(\s*[=:]\s*)\S+', '\1\2<hidden>', 'g') AS text FROM documents"""
)
def masked_texts(spark: SparkSession, sf: str) -> DataFrame:
    """S-21: masking by pattern."""
    mail = F.regexp_replace("text", r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+", "<mail>")
    return _documents(spark, sf).select("doc_id", F.regexp_replace(mail, r"(?i)(password|token|secret)(\s*[=:]\s*)\S+", "$1$2<hidden>").alias("text"))


@query(
    """WITH ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text IS NOT NULL AND text <> ''), n AS (SELECT doc_id, c, count(*) AS n FROM ch GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS t FROM n GROUP BY doc_id)
    SELECT n.doc_id, round(-sum(n / t * log2(n / t)), 4) AS entropy FROM n JOIN t ON n.doc_id = t.doc_id GROUP BY n.doc_id""".replace("documents WHERE", "(SELECT doc_id, path AS text FROM documents) WHERE")
)
def path_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """A-19: character entropy inside the row."""
    return _documents(spark, sf).where("path is not null and path <> ''").select("doc_id", F.round(T.char_entropy(F.col("path")), 4).alias("entropy"))


@query()
def text_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """A-19: character entropy of the whole texts; tested against a plain count."""
    return _documents(spark, sf).where("text is not null and text <> ''").select("doc_id", F.round(T.char_entropy(F.col("text")), 4).alias("entropy"))


@query(
    r"""SELECT doc_id, CAST(len(list_filter(w, lambda x: length(x) >= 3)) AS INTEGER) AS words, CAST(len(list_distinct(list_filter(w, lambda x: length(x) >= 3))) AS INTEGER) AS distinct_words, CASE WHEN text = '' THEN 0 ELSE CAST(len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS INTEGER) END AS lines
    FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\pL\pN_]+') AS w FROM documents WHERE text IS NOT NULL)"""
)
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    """S-7, S-13, S-31, P-6: words, distinct words and lines of each text."""
    w = T.words(F.col("text"), 3)
    return _documents(spark, sf).where("text is not null").select("doc_id", F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct_words"), T.line_count(F.col("text")).alias("lines"))


@query(
    """WITH w AS (SELECT record_id AS id, unnest(regexp_extract_all(lower(description), '[\\pL\\pN_]+')) AS word FROM code_findings), n AS (SELECT id, word, count(*) AS n FROM w GROUP BY ALL), l AS (SELECT id, sum(n) AS len FROM n GROUP BY id),
    d AS (SELECT word, count(*) AS df FROM n GROUP BY word), t AS (SELECT count(*) AS total FROM code_findings)
    SELECT n.id AS record_id, n.word, round(n / len * (ln((total + 1) / (df + 1)) + 1), 6) AS weight FROM n JOIN l ON n.id = l.id JOIN d ON n.word = d.word, t"""
)
def tf_idf_weights(spark: SparkSession, sf: str) -> DataFrame:
    """S-14: term weights of the descriptions."""
    rows = table(spark, sf, "code_findings").select("record_id", "description")
    return C.tf_idf(rows, "record_id", T.words(F.col("description"))).withColumn("weight", F.round("weight", 6))


_PATTERNS = [("p1", "request forgery reaches the remote address"), ("p2", "value may exceed the buffer"), ("p3", "step runs with wide scope"), ("p4", "secret constant in source")]
_PAT_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _PATTERNS)


@query(
    f"""WITH w AS (SELECT record_id AS id, unnest(regexp_extract_all(lower(description), '[\\pL\\pN_]+')) AS word FROM code_findings), n AS (SELECT id, word, count(*) AS n FROM w GROUP BY ALL), l AS (SELECT id, sqrt(sum(n * n)) AS len FROM n GROUP BY id),
    pw AS (SELECT p, unnest(regexp_extract_all(lower(t), '[\\pL\\pN_]+')) AS word FROM (VALUES {_PAT_SQL}) AS v(p, t)), pn AS (SELECT p, word, count(*) AS n FROM pw GROUP BY ALL), pl AS (SELECT p, sqrt(sum(n * n)) AS len FROM pn GROUP BY p)
    SELECT record_id, pattern, score FROM (SELECT n.id AS record_id, pn.p AS pattern, round(sum(n.n * pn.n) / any_value(l.len) / any_value(pl.len), 4) AS score, row_number() OVER (PARTITION BY n.id ORDER BY round(sum(n.n * pn.n) / any_value(l.len) / any_value(pl.len), 4) DESC, pn.p) AS k
      FROM n JOIN pn ON n.word = pn.word JOIN l ON n.id = l.id JOIN pl ON pn.p = pl.p GROUP BY n.id, pn.p) WHERE score >= 0.35 AND k <= 3"""
)
def pattern_matches(spark: SparkSession, sf: str) -> DataFrame:
    """J-10, S-15: sparse cosine of descriptions with a pattern library, three best of each (the library is a fixed list)."""
    counts = lambda df, key: df.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    words = counts(table(spark, sf, "code_findings").select("record_id", F.explode(T.words(F.col("description"))).alias("word")), "record_id")
    lib = counts(spark.createDataFrame(_PATTERNS, "pattern string, t string").select("pattern", F.explode(T.words(F.col("t"))).alias("word")), "pattern").withColumnRenamed("n", "m").withColumnRenamed("word", "pword")
    length = words.groupBy(F.col("record_id").alias("r")).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    plen = lib.groupBy(F.col("pattern").alias("q")).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("plen"))
    dots = words.join(F.broadcast(lib), F.col("word") == F.col("pword")).groupBy("record_id", "pattern").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    scored = dots.join(length, F.col("record_id") == F.col("r")).join(F.broadcast(plen), F.col("pattern") == F.col("q")).select("record_id", "pattern", F.round(F.col("dot") / F.col("len") / F.col("plen"), 4).alias("score"))
    return W.top_per_key(scored.where("score >= 0.35"), ["record_id"], [F.desc("score"), "pattern"], 3)


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS \"group\", count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """J-11, T-13, O-2: equal texts share a group."""
    return C.duplicate_groups(_documents(spark, sf), "doc_id", F.col("text"))


@query("SELECT pair_id FROM (SELECT pair_id, row_number() OVER (PARTITION BY md5(trim(instruction, ' ')) ORDER BY pair_id) AS n FROM tool_use_training WHERE instruction IS NOT NULL) WHERE n = 1")
def distinct_instructions(spark: SparkSession, sf: str) -> DataFrame:
    """O-2, SNK-5: the first pair of every instruction."""
    rows = table(spark, sf, "tool_use_training").where("instruction is not null").select("pair_id", F.md5(F.trim("instruction")).alias("h"))
    return rows.groupBy("h").agg(F.min("pair_id").alias("pair_id")).select("pair_id")


@query(
    f"""WITH {_CODE}, ls AS (SELECT record_id, list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS a FROM c WHERE text IS NOT NULL),
    w AS (SELECT record_id, unnest(range(0, len(a) - 4)) AS i, a FROM ls WHERE len(a) >= 5), h AS (SELECT record_id, i, array_to_string(list_slice(a, i + 1, i + 5), chr(10)) AS t FROM w),
    s AS (SELECT DISTINCT record_id, i FROM h WHERE t IN (SELECT t FROM h GROUP BY t HAVING count(DISTINCT record_id) > 1)),
    g AS (SELECT record_id, i, sum(CASE WHEN i - p <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY record_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY record_id ORDER BY i) AS p FROM s))
    SELECT record_id, min(i) + 1 AS first, max(i) + 5 AS last FROM g GROUP BY record_id, run"""
)
def duplicate_spans(spark: SparkSession, sf: str) -> DataFrame:
    """J-12, T-14, W-12, S-8: runs of lines that other texts have too."""
    return C.shared_windows(_code(spark, sf), "record_id", F.col("text"), 5)


@query()
def near_duplicate_code(spark: SparkSession, sf: str) -> DataFrame:
    """J-9: classes and links of similar code texts (five-word shingles, Jaccard 0.8); tested against brute force."""
    return C.near_duplicates(_code(spark, sf), "record_id", F.col("text"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256('42' || chr(9) || source), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM documents WHERE source IS NOT NULL")
def source_split(spark: SparkSession, sf: str) -> DataFrame:
    """T-9, T-10: train and test by source, without leakage between them."""
    return C.group_split(_documents(spark, sf).where("source is not null").select("doc_id", "source"), "source", "42").select("doc_id", "part")


@query(
    """WITH p AS (SELECT md5(text) AS h, CASE WHEN CAST('0x' || substr(sha256('42' || chr(9) || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM documents WHERE text IS NOT NULL)
    SELECT count(*) AS test_texts, CAST(count_if(h IN (SELECT h FROM p WHERE part = 'train')) AS BIGINT) AS also_in_train FROM p WHERE part = 'test'"""
)
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """O-6: how many texts of a naive split lie on both sides."""
    parts = C.group_split(_documents(spark, sf).where("text is not null").select("doc_id", F.md5("text").alias("h")), "doc_id", "42")
    train = parts.where("part = 'train'").select(F.col("h").alias("t")).distinct()
    test = parts.where("part = 'test'").join(train, F.col("h") == F.col("t"), "left")
    return test.agg(F.count(F.lit(1)).alias("test_texts"), F.count("t").alias("also_in_train"))


@query(
    """SELECT language, label, example_id FROM (SELECT language, label, example_id, row_number() OVER (PARTITION BY language, label ORDER BY sha256(example_id), row_id) AS n FROM examples) WHERE n <= 50"""
)
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    """T-11, L-9: at most fifty of each stratum in the order of a hash (a sampling operator)."""
    rows = table(spark, sf, "examples").select("language", "label", "example_id", "row_id", F.sha2("example_id", 256).alias("h"))
    return W.top_per_key(rows, ["language", "label"], ["h", "row_id"], 50).select("language", "label", "example_id")


@query(
    """SELECT record_id, reason FROM (SELECT record_id, unnest([CASE WHEN path IS NULL OR path = '' THEN 'no path' END, CASE WHEN cwe IS NULL OR NOT regexp_matches(cwe, '^CWE-[0-9]+$') THEN 'bad cwe' END,
      CASE WHEN line IS NULL OR line <= 0 THEN 'bad line' END, CASE WHEN coalesce(source_snippet, code, '') = '' THEN 'no text' END]) AS reason FROM code_findings) WHERE reason IS NOT NULL"""
)
def manifest_errors(spark: SparkSession, sf: str) -> DataFrame:
    """T-12: a row for each failed check of each record."""
    c = F.col
    checks = [
        F.when(c("path").isNull() | (c("path") == ""), "no path"),
        F.when(c("cwe").isNull() | ~c("cwe").rlike("^CWE-[0-9]+$"), "bad cwe"),
        F.when(c("line").isNull() | (c("line") <= 0), "bad line"),
        F.when(F.coalesce("source_snippet", "code", F.lit("")) == "", "no text"),
    ]
    return table(spark, sf, "code_findings").select("record_id", F.explode(F.filter(F.array(*checks), lambda r: r.isNotNull())).alias("reason"))


@query(
    """SELECT fingerprint_key, kind, text FROM (SELECT row_id AS fingerprint_key, unnest([{'kind': 'review', 'text': 'Review ' || rule_id || ' at ' || path}, {'kind': 'fix', 'text': 'Fix ' || rule_id || ' (' || coalesce(severity, 'UNKNOWN') || ')'}], recursive := true) FROM findings WHERE rule_id IS NOT NULL AND path IS NOT NULL)"""
)
def finding_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """T-4, T-5, S-29, P-4: two texts from each row by templates."""
    rows = table(spark, sf, "findings").where("rule_id is not null and path is not null")
    two = F.array(F.struct(F.lit("review").alias("kind"), F.concat(F.lit("Review "), "rule_id", F.lit(" at "), "path").alias("text")), F.struct(F.lit("fix").alias("kind"), F.concat(F.lit("Fix "), "rule_id", F.lit(" ("), F.coalesce("severity", F.lit("UNKNOWN")), F.lit(")")).alias("text")))
    return rows.select(F.col("row_id").alias("fingerprint_key"), F.explode(two).alias("p")).select("fingerprint_key", "p.kind", "p.text")


@query(
    r"""SELECT record_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '/\*[\s\S]*?\*/', ' ', 'g'), '(//|#)[^\n]*', '', 'g'), '\s+', ' ', 'g')) AS code FROM (SELECT record_id, code AS text FROM code_findings WHERE code IS NOT NULL UNION ALL SELECT record_id, source_snippet FROM code_findings WHERE code IS NULL AND source_snippet IS NOT NULL)"""
)
def comment_free_code(spark: SparkSession, sf: str) -> DataFrame:
    """S-8, T-6, T-7: code without comments and with single blanks."""
    rows = table(spark, sf, "code_findings").select("record_id", F.coalesce("code", "source_snippet").alias("code")).where("code is not null")
    return rows.select("record_id", T.collapse(T.drop_comments(F.col("code"))).alias("code"))


@query(
    """SELECT path, string_agg(record_id, ',' ORDER BY line NULLS FIRST, record_id) AS parts, count(*) AS n FROM code_findings WHERE path IS NOT NULL AND kind = 'CIFinding' GROUP BY path HAVING count(*) BETWEEN 2 AND 200"""
)
def joined_parts(spark: SparkSession, sf: str) -> DataFrame:
    """T-15: the records of the parts of a case in their order, however many there are (the SQL stops at 200)."""
    rows = table(spark, sf, "code_findings").where("path is not null and kind = 'CIFinding'")
    held = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "record_id"))).alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return held.select("path", F.array_join(F.transform("a", lambda x: x["record_id"].cast("string")), ",").alias("parts"), "n")


@query()
def joined_part_texts(spark: SparkSession, sf: str) -> DataFrame:
    """T-15: the texts of the parts of a case in their order, in numbered chunks; tested against plain concatenation."""
    rows = table(spark, sf, "code_findings").where("path is not null and kind = 'CIFinding'")
    return C.joined_texts(rows.select("path", "line", "record_id", "code"), "path", ["line", "record_id"], "code")


@query(
    """SELECT pair_id, CAST((CASE WHEN output LIKE '%CWE-%' THEN 2 ELSE 0 END) + (CASE WHEN contains(output, 'because') THEN 1 ELSE 0 END) + (CASE WHEN contains(output, '```') THEN 3 ELSE 0 END) + (CASE WHEN length(output) > 200 THEN 1 ELSE 0 END) AS INTEGER) AS score FROM tool_use_training WHERE output IS NOT NULL"""
)
def rubric_scores(spark: SparkSession, sf: str) -> DataFrame:
    """T-18: weighted keywords."""
    o = F.col("output")
    points = [(o.contains("CWE-"), 2), (o.contains("because"), 1), (o.contains("```"), 3), (F.length(o) > 200, 1)]
    return table(spark, sf, "tool_use_training").where("output is not null").select("pair_id", sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0)).alias("score"))


@query(
    """WITH e AS (SELECT regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) AS ext, record_id FROM code_findings WHERE path IS NOT NULL), r AS (SELECT DISTINCT regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) AS ext FROM findings WHERE path IS NOT NULL)
    SELECT e.ext, count(*) AS files, bool_or(r.ext IS NOT NULL) AS examined FROM e LEFT JOIN r ON e.ext = r.ext GROUP BY e.ext"""
)
def language_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """T-21, S-23: kinds of files with and without findings."""
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    seen = table(spark, sf, "findings").where("path is not null").select(ext.alias("e")).distinct()
    per = table(spark, sf, "code_findings").where("path is not null").groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("files"))
    return per.join(F.broadcast(seen), F.col("ext") == F.col("e"), "left").select("ext", "files", F.col("e").isNotNull().alias("examined"))


@query(
    """WITH m AS (SELECT count(*) AS n, count_if(text IS NULL) AS nulls, count_if(text = '') AS empties, count(DISTINCT text) AS texts, count_if(lang IS NULL) AS no_lang FROM documents)
    SELECT reason, round(value, 6) AS value, value <= limit_ AS passed FROM (SELECT unnest([{'reason': 'null texts', 'value': nulls / n, 'limit_': 0.01}, {'reason': 'empty texts', 'value': empties / n, 'limit_': 0.005}, {'reason': 'copies', 'value': 1 - texts / n, 'limit_': 0.05}, {'reason': 'no language', 'value': no_lang / n, 'limit_': 0.05}], recursive := true) FROM m)"""
)
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """T-23: independent threshold checks over one-row aggregates, a row each."""
    m = _documents(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("a"), F.count_if(F.col("text") == "").alias("b"), F.countDistinct("text").alias("c"), F.count_if(F.col("lang").isNull()).alias("d"))
    n = F.col("n")
    checks = [("null texts", F.col("a") / n, 0.01), ("empty texts", F.col("b") / n, 0.005), ("copies", 1 - F.col("c") / n, 0.05), ("no language", F.col("d") / n, 0.05)]
    rows = m.select(F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), v.alias("v"), F.lit(x).alias("x")) for r, v, x in checks])).alias("c"))
    return rows.select("c.reason", F.round("c.v", 6).alias("value"), (F.col("c.v") <= F.col("c.x")).alias("passed"))


@query("SELECT pair_source, CAST(floor((row_number() OVER (PARTITION BY pair_source ORDER BY pair_id) - 1) / 64) AS BIGINT) AS batch, pair_id FROM tool_use_training")
def pair_batches(spark: SparkSession, sf: str) -> DataFrame:
    """W-18: consecutive batches of 64 inside a source."""
    return W.batches(table(spark, sf, "tool_use_training").select("pair_source", "pair_id"), "pair_id", 64, keys=["pair_source"]).select("pair_source", "batch", "pair_id")


@query("SELECT 'training' AS origin, pair_id AS id, md5(trim(instruction, ' ')) AS h FROM tool_use_training UNION ALL SELECT 'document', doc_id, md5(trim(text, ' ')) FROM documents")
def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    """O-1: sources side by side with their tag."""
    a = table(spark, sf, "tool_use_training").select(F.lit("training").alias("origin"), F.col("pair_id").alias("id"), F.md5(F.trim("instruction")).alias("h"))
    return a.unionByName(_documents(spark, sf).select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.md5(F.trim("text")).alias("h")))


@query(
    r"""WITH s AS (SELECT doc_id, unnest(string_split(text, '. ')) AS p, unnest(range(0, len(string_split(text, '. ')))) AS i FROM documents WHERE text IS NOT NULL),
    q AS (SELECT doc_id, i, p, CAST(10 * len(list_intersect(list_distinct(regexp_extract_all(lower(p), '[\pL\pN_]+')), ['buffer', 'length', 'copy', 'check'])) - i // 20 AS INTEGER) AS score FROM s WHERE length(p) BETWEEN 35 AND 600)
    SELECT doc_id, i AS position, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k FROM q WHERE score > 0) WHERE k = 1"""
)
def best_passages(spark: SparkSession, sf: str) -> DataFrame:
    """L-11: the passage of each text that meets a query best."""
    wanted = F.array(*[F.lit(w) for w in ("buffer", "length", "copy", "check")])
    parts = _documents(spark, sf).select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "p")).where(F.length("p").between(35, 600))
    score = (10 * F.size(F.array_intersect(F.array_distinct(T.words(F.col("p"))), wanted)) - F.floor(F.col("i") / 20)).cast("int")
    return W.first_per_key(parts.withColumn("score", score).where("score > 0"), ["doc_id"], [F.desc("score"), "i"]).select("doc_id", F.col("i").cast("long").alias("position"), "score")


@query(
    r"""SELECT doc_id, array_to_string(list_slice(g, 1, 3), '|') AS bigrams, CAST(len(g) AS INTEGER) AS n FROM (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN_]+') AS w FROM documents WHERE text IS NOT NULL))"""
)
def word_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    """W-14: the first three pairs of neighbouring words, and how many there are, as the SQL shows them."""
    g = T.ngrams(T.words(F.col("text")), 2)
    return _documents(spark, sf).where("text is not null").select("doc_id", F.array_join(F.slice(g, 1, 3), "|").alias("bigrams"), F.size(g).alias("n"))


@query()
def word_bigram_counts(spark: SparkSession, sf: str) -> DataFrame:
    """W-14: every pair of neighbouring words of each text with its count; tested against a plain count."""
    pairs = _documents(spark, sf).where("text is not null").select("doc_id", F.explode(T.ngrams(T.words(F.col("text")), 2)).alias("bigram"))
    return pairs.groupBy("doc_id", "bigram").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT record_id AS id, unnest(regexp_extract_all(lower(description), '[\\pL\\pN_]+')) AS word FROM code_findings), h AS (SELECT id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 1024 AS idx, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT id, sum(n) AS t FROM h GROUP BY id)
    SELECT h.id AS record_id, idx, CAST(n * 10000 // t AS BIGINT) AS value FROM h JOIN t ON h.id = t.id"""
)
def hashed_features(spark: SparkSession, sf: str) -> DataFrame:
    """S-16, S-9: feature hashing to fixed-point shares; the total comes from the row, so one exchange is enough."""
    words = T.words(F.col("description"))
    rows = table(spark, sf, "code_findings").select("record_id", F.explode(words).alias("w"), F.size(words).alias("t"))
    idx = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(1024))
    return rows.groupBy("record_id", idx.alias("idx"), "t").agg(F.count(F.lit(1)).alias("n")).select("record_id", "idx", F.floor(F.col("n") * 10000 / F.col("t")).alias("value"))


_URLS = "u AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s\"<>)]+')) AS url FROM documents WHERE text IS NOT NULL)"


@query()
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    """S-30, L-10, W-10: addresses in texts in canonical form, with the documents that name them."""
    urls = _documents(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"https?://[^\s\"<>)]+"), 0)).alias("url"))
    return urls.select("doc_id", P.canonical_url(F.col("url")).alias("url")).where("url <> ''").groupBy("url").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))


@query(
    """SELECT a.vec_id, b.label, round(sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)), 4) AS cosine FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) a
    JOIN (SELECT label, i, avg(y) AS y FROM (SELECT label, unnest(embedding)::DOUBLE AS y, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i) b ON a.i = b.i GROUP BY a.vec_id, b.label"""
)
def centroid_cosines(spark: SparkSession, sf: str) -> DataFrame:
    """S-15, 2.9: dense cosine of every vector with the centroid of every label (labels are few)."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dims = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centroids = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    packed = centroids.agg(F.collect_list(F.struct("label", "c")).alias("all"))
    pairs = rows.select("vec_id", "v").join(F.broadcast(packed)).select("vec_id", "v", F.explode("all").alias("k"))
    return pairs.select("vec_id", F.col("k.label").alias("label"), F.round(T.cosine(F.col("v"), F.col("k.c")), 4).alias("cosine"))


@query()
def function_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """S-19: measures of the functions in Python texts (needs a parser; tested on known functions)."""
    return K.function_metrics(_code(spark, sf).where("path like '%.py'"), "record_id", "text")


@query()
def changed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """T-8: windows around what an example changes in its parent (needs a differ; tested on known changes)."""
    from weftline.functions.keys import norm_key

    blobs = table(spark, sf, "blobs").where("payload is not null").groupBy(norm_key("digest").alias("d")).agg(F.min("payload").alias("t"))
    links = table(spark, sf, "examples").groupBy("example_id").agg(F.min(norm_key("content_digest")).alias("own"), F.min(norm_key("parent_digest")).alias("up")).where("own is not null and up is not null")
    texts = links.join(blobs.select(F.col("d").alias("own"), F.col("t").alias("after")), "own").join(blobs.select(F.col("d").alias("up"), F.col("t").alias("before")), "up")
    return K.changed_windows(texts, "example_id", "before", "after")


@query()
def fused_urls(spark: SparkSession, sf: str) -> DataFrame:
    """L-10: addresses by rank fusion, each source of documents being a search and each address in its documents a rank, however late."""
    urls = _documents(spark, sf).where("source is not null").select("doc_id", "source", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"https?://[^/\s\"<>)]+"), 0))).alias("u"))
    ranked = W.occurrence(urls, ["source"], ["doc_id", "u"], "rank").select("source", "rank", P.canonical_url(F.col("u")).alias("url")).where("url <> ''")
    return C.fuse_ranks(ranked.withColumn("overlap", F.lit(0)), "url", "source", "rank", "overlap")
