"""Readers for files: tables with aliased headers, line formats, trees of files, archives, captures, pages."""

from __future__ import annotations

import io
import ipaddress
import struct
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import parse as P
from weftline.functions.text import normal_header
from weftline.session import ship


def sniff_separator(spark: SparkSession, path: str, among: str = ",;\t|") -> str:
    """SRC-1: the separator that stands most often, outside of quotes, in the header line; a comma where none does."""
    first = spark.read.text(path).limit(1).select(F.regexp_replace("value", r"\"[^\"]*\"", "").alias("h")).first()
    header = first["h"] if first and first["h"] else ""
    return max(among, key=lambda c: (header.count(c), -among.index(c)))


def read_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]], *, separator: str | None = None) -> DataFrame:
    """SRC-1: a CSV whose headers are mapped to names: the first alias that a header equals. Names without one are null columns. The separator is found out unless given."""
    separator = separator or sniff_separator(spark, path)
    raw = spark.read.option("header", True).option("sep", separator).option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)
    by_header = {normal_header(c): c for c in reversed(raw.columns)}
    chosen = {name: next((by_header[a] for a in map(normal_header, [name, *wanted]) if a in by_header), None) for name, wanted in aliases.items()}
    return raw.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(name) for name, c in chosen.items()])


def sales_rows(raw: DataFrame) -> DataFrame:
    """SRC-1: typed rows of date, amount, quantity and whatever else there is; rows without a readable date or amount are dropped."""
    typed = raw.withColumns({"date": P.parse_date(F.col("date")), "amount": P.parse_money(F.col("amount")), "quantity": F.coalesce(P.parse_money(F.col("quantity")).cast("int"), F.lit(1))})
    return typed.where("date is not null and amount is not null")


def new_files(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """SRC-2: path and md5 of files whose content `log` (column md5) does not have yet; equal files count once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.md5("content").alias("md5"))
    return files.groupBy("md5").agg(F.min("path").alias("path")).join(log.select("md5"), "md5", "left_anti")


def day_ranges(df: DataFrame, days: list[str], name: str = "available") -> DataFrame:
    """SRC-4: columns of a day as "9-17" to one map from day number to [from, to]; off, no and blanks are absent, unreadable ones 9 to 17."""

    def one(day: str) -> Column:
        text = F.lower(F.trim(F.col(day)))
        a, b = F.regexp_extract(text, r"^(\d{1,2})\s*-\s*(\d{1,2})$", 1), F.regexp_extract(text, r"^(\d{1,2})\s*-\s*(\d{1,2})$", 2)
        span = F.when(a != "", F.array(a.try_cast("int"), b.try_cast("int"))).otherwise(F.array(F.lit(9), F.lit(17)))
        return F.when(~F.coalesce(text, F.lit("")).isin("", "off", "no", "n/a", "none", "-"), span)

    entries = F.array(*[F.struct(F.lit(i).alias("key"), one(d).alias("value")) for i, d in enumerate(days)])
    return df.withColumn(name, F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-5: JSON lines; lines that are none are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def scan_files(spark: SparkSession, path: str, *, pattern: str = "*", max_bytes: int | None = None, skipped: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """SRC-6, SRC-7, X-8: path, size, sha256, text, gap of the files of a tree. Folders in `skipped` are left out.

    A file that is not text (it has a zero byte), or is over `max_bytes` where that is set, comes out with a null text and the reason in gap.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    kept = files
    for folder in skipped:
        kept = kept.where(~F.contains(F.col("path"), F.lit(f"/{folder}/")))
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    gap = F.when(large, "too large").when(F.locate("\x00", F.decode("content", "ISO-8859-1")) > 0, "not text")
    return kept.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.when(gap.isNull(), F.decode("content", "UTF-8")).alias("text"), gap.alias("gap"))


def snapshot_digest(files: DataFrame) -> DataFrame:
    """SRC-7: files, bytes, digest: one digest over paths and contents, whatever their order; in two levels, by the first places of the file digests."""
    each = files.select(F.sha2(F.concat_ws("|", F.col("path"), F.col("sha256")), 256).alias("h"), "size")
    ranges = each.groupBy(F.substring("h", 1, 4).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")
    return ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"), F.sha2(whole, 256).alias("digest"))


def read_archives(spark: SparkSession, path: str, *, max_member: int | None = None) -> DataFrame:
    """SRC-8, X-8: archive, member, size, text, gap of ZIP archives, member by member.

    An unreadable archive or member, and a member over `max_member` bytes where that is set, have a null text and the reason in gap.
    """
    ship(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                    rows.append((name, None, None, None, "unreadable archive"))
                    continue
                with archive:
                    for m in archive.infolist():
                        if m.is_dir():
                            continue
                        text, gap = None, "too large" if max_member is not None and m.file_size > max_member else None
                        if not gap:
                            try:
                                text = archive.read(m).decode("utf-8", "replace")
                            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error, EOFError):
                                gap = "unreadable member"
                        rows.append((name, m.filename, m.file_size, text, gap))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "member", "size", "text", "gap"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "archive string, member string, size long, text string, gap string")


def run_sql(spark: SparkSession, statement: str, **values: object) -> DataFrame:
    """SRC-9: a query with named parameters, never pasted into its text."""
    return spark.sql(statement, args=values)


def schema_profile(df: DataFrame, name: str) -> DataFrame:
    """SRC-10: table, position, column, type, nullable; no row is read."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean")


# What SQL statements begin with; other texts are none.
SQL_VERBS = "SELECT WITH INSERT UPDATE DELETE MERGE REPLACE CREATE ALTER DROP TRUNCATE GRANT REVOKE BEGIN COMMIT ROLLBACK PRAGMA EXPLAIN VALUES CALL SET".split()


def sql_statements(texts: DataFrame, row: str, text: str) -> DataFrame:
    """SRC-11: row, position, verb, kind of the statements of SQL texts. Comments and the insides of literals split nothing."""
    bare = F.regexp_replace(F.col(text), r"(?s)/\*.*?\*/|--[^\n]*", " ")
    bare = F.regexp_replace(bare, r"'(?:[^']|'')*'", "''")
    parts = texts.select(row, F.posexplode(F.split(bare, ";")).alias("position", "_s")).withColumn("verb", F.upper(F.regexp_extract(F.trim("_s"), r"^\s*([A-Za-z]+)", 1))).where(F.col("verb").isin(*SQL_VERBS))
    kind = F.when(F.col("verb").isin("DROP", "TRUNCATE"), "destructive").when((F.col("verb") == "DELETE") & ~F.upper("_s").contains("WHERE"), "destructive").when(F.col("verb").isin("GRANT", "REVOKE"), "privileged")
    kind = kind.when(F.col("verb").isin("INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "ALTER", "REPLACE"), "write").otherwise("read")
    return parts.select(row, "position", "verb", kind.alias("kind"))


#: Line patterns of dependency manifests by file name: name in group 1, version in group 2.
MANIFESTS = {
    "requirements.txt": r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:==|>=|~=|<=|>|<)\s*([0-9][^\s;,#]*)",
    "Gemfile": r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"]\s*,\s*['\"][~>=<\s]*([0-9][^'\"]*)['\"]",
    "go.mod": r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]{2,}/\S+)\s+v([0-9]\S*)",
    "Cargo.toml": r"(?m)^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?\"[\^~=]?([0-9][^\"]*)\"",
    "package.json": r"\"([@A-Za-z0-9][@A-Za-z0-9._/-]*)\"\s*:\s*\"[\^~>=<v]*([0-9]+\.[0-9][^\"]*)\"",
    "composer.json": r"\"([a-z0-9_.-]+/[a-z0-9_.-]+)\"\s*:\s*\"[\^~>=<v]*([0-9][^\"]*)\"",
    "pom.xml": r"(?s)<artifactId>([^<]+)</artifactId>\s*<version>([^<$]+)</version>",
    "csproj": r"<PackageReference\s+Include=\"([^\"]+)\"\s+Version=\"([^\"]+)\"",
}


def dependencies(files: DataFrame) -> DataFrame:
    """SRC-12: path, manifest, name, version of the dependencies in manifests (path, text)."""
    base = F.substring_index("path", "/", -1)
    found = F.lit(None).cast("array<struct<name:string,version:string>>")
    for name, pattern in MANIFESTS.items():
        fits = base.endswith(".csproj") if name == "csproj" else base == name
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("name"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("version"))
        found = F.when(fits, F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), p["version"].alias("version")))).otherwise(found)
    return files.select("path", base.alias("manifest"), F.explode(found).alias("d")).select("path", "manifest", "d.name", "d.version")


def lock_edges(files: DataFrame) -> DataFrame:
    """SRC-13: path, owner, name, version, wants of npm lock files (format 2 and 3): installed packages and what they require."""
    schema = "struct<packages:map<string,struct<version:string,dependencies:map<string,string>>>>"
    packages = files.select("path", F.explode(F.from_json("text", schema)["packages"]).alias("at", "p"))
    name = F.regexp_extract("at", r"(?:^|.*node_modules/)((?:@[^/]+/)?[^/]+)$", 1)
    return packages.select("path", F.col("at").alias("owner"), name.alias("name"), F.col("p.version").alias("version"), F.coalesce(F.map_keys("p.dependencies"), F.array().cast("array<string>")).alias("wants"))


# Name and version of the packages in lock files of other kinds, by file name.
LOCKS = {
    "Cargo.lock": r"(?m)^name = \"([^\"]+)\"\r?\nversion = \"([^\"]+)\"",
    "poetry.lock": r"(?m)^name = \"([^\"]+)\"\r?\nversion = \"([^\"]+)\"",
    "yarn.lock": r"(?m)^\"?(@?[^@\s\"]+)@[^\n]*:\r?\n\s+version:? \"?([^\"\s]+)",
    "composer.lock": r"\"name\":\s*\"([^\"]+)\",\s*\"version\":\s*\"v?([^\"]+)\"",
    "Gemfile.lock": r"(?m)^    ([A-Za-z0-9_.-]+) \(([0-9][^)]*)\)",
    "packages.lock.json": r"\"([A-Za-z0-9_.-]+)\":\s*\{\s*\"type\":\s*\"[A-Za-z]+\",(?:\s*\"requested\":[^,]*,)?\s*\"resolved\":\s*\"([^\"]+)\"",
    "gradle.lockfile": r"(?m)^([^:#\s]+:[^:\s]+):([^=\s]+)=",
}


def locked_packages(files: DataFrame) -> DataFrame:
    """SRC-13: path, lock, name, version of the packages that lock files (path, text) pin; npm's are in lock_edges."""
    base = F.substring_index("path", "/", -1)
    found = F.lit(None).cast("array<struct<name:string,version:string>>")
    for name, pattern in LOCKS.items():
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("name"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("version"))
        found = F.when(base == name, F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), p["version"].alias("version")))).otherwise(found)
    return files.select("path", base.alias("lock"), F.explode(found).alias("d")).select("path", "lock", "d.name", "d.version").distinct()


def coverage_lines(reports: DataFrame, text: str) -> DataFrame:
    """SRC-16: path, line, covered out of coverage reports in JSON ({"files": {path: {"executed_lines": [], "missing_lines": []}}})."""
    schema = "struct<files:map<string,struct<executed_lines:array<int>,missing_lines:array<int>>>>"
    files = reports.select(F.explode(F.from_json(text, schema)["files"]).alias("path", "f"))
    one = lambda field, covered: F.transform(F.coalesce(F.col(f"f.{field}"), F.array().cast("array<int>")), lambda x: F.struct(x.alias("line"), F.lit(covered).alias("covered")))
    return files.select("path", F.explode(F.concat(one("executed_lines", True), one("missing_lines", False))).alias("l")).select("path", "l.line", "l.covered")


def trace_spans(lines: DataFrame, line: str) -> DataFrame:
    """SRC-16: trace, span, parent, name, micros out of spans in JSON lines; lines that are none, or without a trace and a span, are left out."""
    s = F.from_json(line, "struct<trace_id:string,span_id:string,parent_id:string,name:string,start_us:long,end_us:long>")
    rows = lines.select(s.alias("s")).where("s.trace_id is not null and s.span_id is not null")
    return rows.select(F.col("s.trace_id").alias("trace"), F.col("s.span_id").alias("span"), F.col("s.parent_id").alias("parent"), "s.name", (F.col("s.end_us") - F.col("s.start_us")).alias("micros"))


def added_lines(log: DataFrame, key: str, position: str, line: str) -> DataFrame:
    """SRC-14: added lines of a log with patches (key, position, line), with commit and file carried down from the headers."""
    from weftline.operators.windows import carry_forward

    text = F.col(line)
    marked = log.withColumns({"_c": F.when(text.rlike("^commit [0-9a-f]{7,}"), F.regexp_extract(text, "^commit ([0-9a-f]+)", 1)), "_f": F.when(text.startswith("+++ b/"), F.expr(f"substring(`{line}`, 7)"))})
    filled = carry_forward(carry_forward(marked, "_c", [key], [position], "commit"), "_f", [key], [position], "file")
    return filled.where(text.startswith("+") & ~text.startswith("+++")).select(key, position, "commit", "file", F.expr(f"substring(`{line}`, 2)").alias("added"))


# Length of the frame header by link type of a capture (Ethernet, loopback, raw IP), and where it says what follows.
LINK_HEADERS = {1: 14, 0: 4, 12: 0, 101: 0, 228: 0}
CAPTURE_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}


def _packet(frame: bytes, link: int) -> tuple | None:
    """src, dst, sport, dport, proto, payload of a frame that holds a whole IPv4 header, else None."""
    head = LINK_HEADERS.get(link)
    if head is None or link == 1 and frame[12:14] != b"\x08\x00":
        return None
    ip = memoryview(frame)[head:]
    if len(ip) < 20 or ip[0] >> 4 != 4 or (words := ip[0] & 0x0F) < 5 or len(ip) < 4 * words:
        return None
    whole = int.from_bytes(ip[2:4], "big")
    body = ip[4 * words : max(whole, 4 * words) if whole else len(ip)]
    ends = [str(ipaddress.IPv4Address(bytes(ip[a : a + 4]))) for a in (12, 16)]
    ports, skip, proto = (None, None), 0, {6: "tcp", 17: "udp"}.get(ip[9], "other")
    least = {"tcp": 20, "udp": 8, "other": 0}[proto]
    if least and len(body) >= least:
        ports = (int.from_bytes(body[0:2], "big"), int.from_bytes(body[2:4], "big"))
        skip = 4 * (body[12] >> 4) if proto == "tcp" else least
    return (*ends, *ports, proto, bytes(body[skip:]) if len(body) >= least else b"")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: ts, src, dst, sport, dport, proto, payload of the IPv4 packets in capture files.

    Both byte orders, micro- and nanoseconds, and the link types of LINK_HEADERS. A last frame that the file cuts off, frames of other
    protocols and files that are no captures give no row.
    """
    ship(spark)
    names = ["ts", "src", "dst", "sport", "dport", "proto", "payload"]
    kinds = [pa.float64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]

    def frames(content: bytes) -> Iterator[tuple]:
        order, unit = CAPTURE_MAGIC.get(content[:4], (None, 1))
        if order is None or len(content) < 24:
            return
        link = struct.unpack_from(f"{order}I", content, 20)[0] & 0xFFFF
        record = struct.Struct(f"{order}4I")
        at = 24
        while at + record.size <= len(content):
            seconds, fraction, kept, _ = record.unpack_from(content, at)
            begin, at = at + record.size, at + record.size + kept
            if at <= len(content) and (packet := _packet(content[begin:at], link)):
                yield (seconds + fraction / unit, *packet)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(row for content in batch.column(0).to_pylist() for row in frames(content)), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "ts double, src string, dst string, sport int, dport int, proto string, payload binary")


def log_signals(lines: DataFrame, line: str) -> DataFrame:
    """SRC-16: time, level, path, line number and message of log lines; lines without a level are left out."""
    pattern = r"^(\S+(?: \d\d:\d\d(?::\d\d)?)?)\s+\[?(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL)\]?\s+(.*)$"
    text = F.col(line)
    place = r"([\w./-]+\.\w+):(\d+)"
    message = F.regexp_extract(text, pattern, 3)
    return lines.select(
        F.regexp_extract(text, pattern, 1).alias("at"), F.regexp_extract(text, pattern, 2).alias("level"), F.regexp_extract(message, place, 1).alias("path"), F.regexp_extract(message, place, 2).try_cast("int").alias("line"), message.alias("message")
    ).where("level <> ''")


# Elements whose text is not shown, and those that break a line.
HIDDEN = frozenset(("script", "style", "noscript", "svg", "canvas", "template"))
BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.title, self.link, self.published, self.hidden, self.in_title = [], "", "", "", 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            self.text.append("\n")
        if tag == "title":
            self.in_title = True
        if tag == "link" and (a.get("rel") or "").lower() == "canonical":
            self.link = self.link or a.get("href") or ""
        if tag == "meta" and (a.get("property") or a.get("name") or "").lower() in ("article:published_time", "date", "pubdate"):
            self.published = self.published or a.get("content") or ""

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        elif tag in BLOCKS:
            self.text.append("\n")
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.text.append(data)


def page_texts(pages: DataFrame, row: str, html: str) -> DataFrame:
    """SRC-18: row, title, canonical, published, text of HTML pages."""
    ship(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                page = _Page()
                page.feed(content or "")
                page.close()
                lines = [" ".join(x.split()) for x in "".join(page.text).split("\n")]
                out.append((page.title.strip(), page.link, page.published, "\n".join(x for x in lines if x)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], names=[row, "title", "canonical", "published", "text"])

    kind = dict(pages.dtypes)[row]
    return pages.select(row, html).mapInArrow(read, f"{row} {kind}, title string, canonical string, published string, text string")
