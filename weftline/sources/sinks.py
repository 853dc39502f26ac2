"""Writers and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Components of one document of a bill.
BILL_ITEMS = 10_000


def append(df: DataFrame, path: str) -> None:
    """SNK-1, SNK-2: adds rows to a table; Spark's committer makes a batch visible as a whole."""
    df.write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """SNK-5, R-2: adds only rows whose key the table lacks, of equal keys in `df` the least row; the number of rows added."""
    spark = df.sparkSession
    others = [c for c in df.columns if c != key]
    keyed = df.where(F.col(key).isNotNull())
    fresh = keyed.groupBy(key).agg(*[F.min(c).alias(c) for c in others]).select(*df.columns) if others else keyed.distinct()
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns)
    except Exception as error:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    added = fresh.count()
    if added:
        fresh.write.mode("append").parquet(path)
    return added


def to_sarif(findings: DataFrame, tool: str, *, run: str = "run", rule: str = "rule", path: str = "path", line: str = "line", severity: str = "sev", message: str = "message") -> DataFrame:
    """SNK-3: run, sarif: one report a run as JSON. A report is one value, so runs must fit a row."""
    level = F.when(F.col(severity).isin("CRITICAL", "HIGH"), "error").when(F.col(severity) == "MEDIUM", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col(path).alias("uri")).alias("artifactLocation"), F.struct(F.col(line).cast("int").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col(rule).alias("ruleId"), level.alias("level"), F.struct(F.col(message).alias("text")).alias("message"), F.array(place).alias("locations"))
    per = findings.groupBy(run).agg(F.array_sort(F.collect_list(result)).alias("results"))
    driver = F.struct(F.struct(F.lit(tool).alias("name")).alias("driver"))
    return per.select(run, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), "results")).alias("runs"))).alias("sarif"))


def from_sarif(reports: DataFrame, sarif: str) -> DataFrame:
    """SNK-3: the findings of reports: tool, rule, level, message, path, line."""
    schema = """struct<runs:array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,
    locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>>"""
    runs = reports.select(F.explode(F.from_json(sarif, schema)["runs"]).alias("r"))
    results = runs.select(F.col("r.tool.driver.name").alias("tool"), F.explode("r.results").alias("f"))
    place = F.col("f.locations")[0]["physicalLocation"]
    return results.select("tool", F.col("f.ruleId").alias("rule"), F.coalesce("f.level", F.lit("warning")).alias("level"), F.col("f.message.text").alias("message"), place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line"))


def to_bill(dependencies: DataFrame, project: str, *, name: str = "name", version: str = "version") -> DataFrame:
    """SNK-4: project, bill: the components of each project as CycloneDX JSON."""
    item = F.struct(F.lit("library").alias("type"), F.col(name).alias("name"), F.col(version).alias("version"))
    per = dependencies.groupBy(project).agg(F.array_sort(F.collect_set(item)).alias("components"))
    return per.select(project, F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), "components")).alias("bill"))


def to_spdx(dependencies: DataFrame, project: str, *, name: str = "name", version: str = "version") -> DataFrame:
    """SNK-4: project, part, bill: the components of each project as SPDX JSON, at most `BILL_ITEMS` a document, in order."""
    item = F.struct(F.concat(F.lit("SPDXRef-"), F.col(name), F.lit("-"), F.col(version)).alias("SPDXID"), F.col(name).alias("name"), F.col(version).alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"))
    placed = dependencies.select(project, name, version).distinct().withColumn("part", F.floor((F.row_number().over(Window.partitionBy(project).orderBy(name, version)) - 1) / BILL_ITEMS))
    per = placed.groupBy(project, "part").agg(F.array_sort(F.collect_list(item)).alias("packages"))
    return per.select(project, "part", F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col(project).alias("name"), "packages")).alias("bill"))


def sarif_summary(reports: DataFrame, sarif: str) -> DataFrame:
    """SNK-3: tool, level, findings, rules: reports merged (equal findings of several once) and counted."""
    merged = from_sarif(reports, sarif).select("tool", "rule", "level", "path", "line", "message").distinct()
    return merged.groupBy("tool", "level").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("rule").alias("rules"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or one without rows where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
