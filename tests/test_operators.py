"""Operators of the core on small inputs, against plain algorithms."""

import hashlib
import json
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions import parse as P
from weftline.functions import text as T
from weftline.operators import corpus as C
from weftline.operators import graph as G
from weftline.operators import integrity as I
from weftline.operators import joins as J
from weftline.operators import windows as W
from weftline.sources import files as S
from weftline.sources import sinks as K


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2025-03-04", "2025-03-04"), ("03/04/2025", "2025-03-04"), ("31/12/2025", "2025-12-31"), ("31.12.2025", "2025-12-31"), ("20251231", "2025-12-31"), ("2025-03-04 10:11:12 and more", "2025-03-04"), ("nonsense", None), ("", None), (None, None)],
)
def test_dates(spark, text, want):
    got = one(spark, P.parse_date, text)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("text", "want"), [("$1,234.50", 1234.5), ("-3", -3.0), ("", None), ("x", None), (None, None)])
def test_money(spark, text, want):
    assert one(spark, P.parse_money, text) == want


@pytest.mark.parametrize(
    ("version", "spec", "want"),
    [
        ("1.0", "<1.0.1", True), ("1.0", "=1.0.0", True), ("1.0rc1", "<1.0", True), ("1.0.beta2", "<1.0rc1", True), ("2.0", "<1.0 || >=2.0", True), ("1.5", ">=1.0,<1.4", False),
        ("weird", "<1.0", None), ("1.0", "<weird", None), ("1.0", "<weird || >=1.0", True), ("1.0", "<weird,<0.5", False), ("10.0", ">9.9", True),
    ],
)
def test_versions_are_three_valued(spark, version, spec, want):
    assert spark.createDataFrame([(version, spec)], "v string, s string").select(P.in_range(F.col("v"), F.col("s"))).first()[0] is want


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://Example.COM:80/a?utm_source=x&b=2&a=1#f", "http://example.com/a?a=1&b=2"), ("https://x.y", "https://x.y/"), ("ftp://x.y/", ""), ("https://u:p@x.y/", ""), ("https://x.y:8443/p", "https://x.y:8443/p"), ("no", "")],
)
def test_urls(spark, url, want):
    assert one(spark, P.canonical_url, url) == want


def test_text_functions(spark):
    assert one(spark, T.char_entropy, "aabb") == 1.0
    assert one(spark, T.char_entropy, "") is None
    assert one(spark, lambda c: T.ngrams(F.split(c, " "), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda c: T.ngrams(F.split(c, " "), 3), "a b") == []
    assert one(spark, T.line_count, "a\nb\n") == 2
    assert one(spark, T.line_count, None) == 0


def test_windows(spark):
    days = spark.createDataFrame([(i, float(10 + i % 2)) for i in range(8)] + [(8, 100.0)], "d int, v double")
    z = {r.d: r.z for r in W.trailing_zscore(days, "v", "d").collect()}
    assert z[6] is None and z[8] > 10
    assert [r.change for r in W.percent_change(spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 10.0)], "d int, v double"), "v", "d", name="change").orderBy("d").collect()] == [None, None, 100.0]
    runs = W.islands(spark.createDataFrame([("a", x) for x in (1, 2, 2, 3, 7, 9, 10)], "k string, p int"), ["k"], "p")
    assert {(r.first, r.last, r.length) for r in runs.collect()} == {(1, 3, 3), (7, 7, 1), (9, 10, 2)}
    series = spark.sql("select date_add(date'2025-01-01', cast(id as int)) as day, cast(2 * id + 1 as double) as v from range(20)")
    assert [r.forecast for r in W.linear_forecast(series, "day", "v").orderBy("day").collect()] == [41.0 + 2 * i for i in range(7)]
    assert W.linear_forecast(series.limit(5), "day", "v").count() == 0


def test_range_joins_equal_brute_force(spark):
    rnd = random.Random(5)
    points = [(i, rnd.choice("ab"), rnd.randint(0, 400)) for i in range(150)]
    spans = [(rnd.choice("ab"), s, s + rnd.randint(0, 150), f"s{i}") for i, s in enumerate(rnd.randint(0, 400) for _ in range(40))]
    p, s = spark.createDataFrame(points, "id int, k string, x int"), spark.createDataFrame(spans, "k string, a int, b int, name string")
    got = {(r.id, r.name) for r in J.in_ranges(p, s, "k", "x", "a", "b").collect()}
    assert got == {(i, n) for i, k, x in points for q, a, b, n in spans if k == q and a <= x <= b}
    inner = {r.id: r.name for r in J.innermost(p, s, "id", "k", "x", "a", "b", "name").collect()}
    assert inner == {i: max((a, n) for q, a, b, n in spans if q == k and a <= x <= b)[1] for i, k, x in points if any(q == k and a <= x <= b for q, a, b, _ in spans)}
    near = {(r.id, r.y) for r in J.near(p, s.select("k", F.col("a").alias("y")), "k", "x", 7, other="y").collect()}
    assert near == {(i, a) for i, k, x in points for q, a, _, _ in spans if q == k and abs(a - x) <= 7}
    both = {(r.a, r.b) for r in J.overlapping(s.withColumn("id", F.monotonically_increasing_id()).select("k", F.col("name").alias("id"), "a", (F.col("b") + 1).alias("e")), "k", "id", "a", "e", width=50.0).collect()}
    assert both == {(m, n) for q, a, b, m in spans for r, c, d, n in spans if q == r and m < n and a < d + 1 and c < b + 1}


def test_prefixes_ancestors_and_matches(spark):
    rules = spark.createDataFrame([("A", 1), ("AB", 2), ("ABC", 3)], "p string, v int")
    got = J.longest_prefix(spark.createDataFrame([("ABX",), ("ABCD",), ("Z",), (None,)], "r string"), "r", rules, "p", "v", 0)
    assert {(r.r, r.v) for r in got.collect()} == {("ABX", 2), ("ABCD", 3), ("Z", 0), (None, 0)}
    installed = spark.createDataFrame([("", "x", "1"), ("a", "x", "2"), ("a/b", "y", "3")], "at string, has string, version string")
    wanted = spark.createDataFrame([("a/b/c", "x"), ("q", "x"), ("a/b/c", "y"), ("q", "y")], "path string, name string")
    assert {tuple(r) for r in J.nearest_ancestor(wanted, "path", "name", installed, "at", "has", "version").collect()} == {("a/b/c", "x", "2"), ("q", "x", "1"), ("a/b/c", "y", "3")}
    labels = J.label_by_basename(spark.createDataFrame([("d/e/f.c",), ("g.c",)], "path string"), "path", spark.createDataFrame([("f.c", 1)], "label_path string, l int"), "label_path")
    assert {(r.path, r.l) for r in labels.collect()} == {("d/e/f.c", 1), ("g.c", None)}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        if texts and rnd.random() < 0.6:
            words = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))]
        texts.append(" ".join(words))
    texts += ["", "one two", texts[0]]
    rows = list(enumerate(texts)) + [(999, None)]
    got = {r.i: (r.group, r.links) for r in C.near_duplicates(spark.createDataFrame(rows, "i int, t string"), "i", F.col("t")).collect()}
    sets = {i: frozenset(" ".join(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)) for i, t in rows if t is not None}
    sets[999] = frozenset()
    group = {i: min(j for j in sets if sets[j] == sets[i]) if sets[i] else i for i in sets}
    for i in sets:
        others = {group[j] for j in sets if sets[j] and sets[i] and group[j] != group[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert got[i] == (group[i], len(others))


def test_graph_operators(spark):
    rnd = random.Random(4)
    nodes = range(25)
    edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(40)})
    weights = {e: rnd.randint(1, 9) for e in edges}
    df = spark.createDataFrame([(a, b, weights[a, b]) for a, b in edges], "src int, dst int, w int")
    start = spark.createDataFrame([(edges[0][0],)], "n int")
    hops, front = {edges[0][0]: 0}, [edges[0][0]]
    while front:
        front = sorted({b for a, b in edges if a in front and b not in hops})
        hops |= {b: max(hops.values()) + 1 for b in front}
    found = G.reachable(df, start)
    assert {r.node: r.hops for r in found.rows.collect()} == hops and found.converged
    assert not G.reachable(df, start, max_rounds=1).converged or len(hops) == 1
    cost = {edges[0][0]: 0}
    for _ in nodes:
        for (a, b), w in weights.items():
            if a in cost:
                cost[b] = min(cost.get(b, 10**9), cost[a] + w)
    assert {r.node: r.cost for r in G.least_costs(df, start, "w").rows.collect()} == cost


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)]
    got = {r.node: r.component for r in G.strong_components(spark.createDataFrame(edges, "src int, dst int")).rows.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_spanning_forest(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(20), rnd.randrange(20), float(rnd.randint(1, 9))) for _ in range(40)]
    got = G.spanning_forest(spark.createDataFrame(edges, "src int, dst int, w double"), "w")
    parent = list(range(20))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total, count = 0.0, 0
    for w, a, b in sorted((w, a, b) for a, b, w in edges if a != b):
        if top(a) != top(b):
            parent[top(a)] = top(b)
            total, count = total + w, count + 1
    rows = got.rows.collect()
    assert got.converged and len(rows) == count and sum(r.weight for r in rows) == total


def test_code_measures_windows_fusion_and_disagreements(spark):
    from weftline.operators import code as K2

    code = "def f(a, *b, c=1):\n    if a and b:\n        for x in b:\n            pass\n    return [y for y in b if y]\n"
    rows = K2.function_metrics(spark.createDataFrame([(1, code), (2, "def broken("), (3, None)], "i int, t string"), "i", "t").collect()
    assert [tuple(r) for r in rows] == [(1, "f", 1, 5, 5, 2, 3)]
    got = K2.changed_windows(spark.createDataFrame([(1, "a\nb\nc", "a\nX\nc"), (2, "same", "same"), (3, None, "n")], "i int, x string, y string"), "i", "x", "y", size=2).collect()
    assert {(r.i, r.label, r.line, r.window) for r in got if r.i == 1} == {(1, 1, 1, "a\nb"), (1, 1, 2, "b\nc"), (1, 0, 1, "a\nX"), (1, 0, 2, "X\nc")} and not [r for r in got if r.i == 2]
    hits = spark.createDataFrame([("https://a", "q1", 1, 2), ("https://a", "q2", 10, 0), ("https://a", "q2", 11, 0), ("http://b", "q1", 60, 1)], "u string, q string, r int, o int")
    assert {tuple(r) for r in C.fuse_ranks(hits, "u", "q", "r", "o").collect()} == {("https://a", (117 + 16 + 5 + 18 + 4) + 4, 2), ("http://b", 8, 1)}
    words = ["w", "x", "y", "z"]
    passages = [(1, "s", words, ["3"], False, 9), (2, "t", words, ["4"], False, 8), (3, "u", words, [], True, 7), (4, "s", ["q"], ["9"], True, 6)]
    found = C.disagreements(spark.createDataFrame(passages, "i int, s string, w array<string>, n array<string>, x boolean, b int"), "i", "s", "w", "n", "x", best="b")
    assert {tuple(r) for r in found.collect()} == {(1, 2, "numbers"), (1, 3, "negation"), (2, 3, "negation")}


def test_partition_plans_and_chains(spark):
    items = spark.createDataFrame([(f"i{k}", float(k % 9)) for k in range(50)], "item string, cost double")
    plan = I.longest_first(items, "item", "cost", 4)
    assert I.cover_problems(plan, "item", items.select(F.col("item").alias("want")), "want").count() == 0
    report = I.balance(plan.join(items, "item"), "shard", "cost", 4).first()
    assert report.largest <= report.total / 4 * 4 / 3
    assert {tuple(r) for r in I.cover_problems(spark.createDataFrame([("a",), ("a",), ("z",)], "item string"), "item", spark.createDataFrame([("a",), ("b",)], "w0 string"), "w0").collect()} == {("duplicate", "a"), ("missing", "b"), ("foreign", "z")}
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = [h(str(i)) for i in range(5)]
    want = h(h(h(leaves[0] + leaves[1]) + h(leaves[2] + leaves[3])) + leaves[4])
    assert I.merkle_root(spark.createDataFrame(list(enumerate(leaves)), "p long, d string"), "p", "d") == want
    assert I.merkle_root(spark.createDataFrame([], "p long, d string"), "p", "d") is None
    chain, before = [], ""
    for i in range(6):
        digest = h(f"{before}|payload{i}")
        chain.append(("good", i, before, digest, f"payload{i}"))
        chain.append(("bad", i, before, digest, f"payload{i}" if i != 3 else "changed"))
        before = digest
    broken = I.chain_breaks(spark.createDataFrame(chain, "k string, seq int, prev string, digest string, payload string"), ["k"], "seq", "prev", "digest", F.col("payload"))
    assert {tuple(r) for r in broken.collect()} == {("bad", 3)}


def test_tables_with_aliases(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Order Date,Net Sales,Qty\n2025-01-02,\"$1,000.5\",3\nbad,1,1\n2025-01-03,,1\n")
    rows = S.sales_rows(S.read_csv(spark, str(tmp_path / "s.csv"), {"date": ["order date"], "amount": ["net sales"], "quantity": ["qty"], "product": []}))
    assert [(str(r.date), r.amount, r.quantity, r.product) for r in rows.collect()] == [("2025-01-02", 1000.5, 3, None)]
    shifts = S.day_ranges(spark.createDataFrame([("9-17", "off", "odd")], "mon string, tue string, wed string"), ["mon", "tue", "wed"]).first()
    assert shifts.available == {0: [9, 17], 2: [9, 17]}


def test_file_trees_archives_and_new_files(spark, tmp_path):
    (tmp_path / "t/node_modules").mkdir(parents=True)
    (tmp_path / "t/a.py").write_text("x = 1\n")
    (tmp_path / "t/b.py").write_text("x = 1\n")
    (tmp_path / "t/c.bin").write_bytes(b"a\x00b")
    (tmp_path / "t/node_modules/d.py").write_text("y")
    seen = S.scan_files(spark, str(tmp_path / "t"))
    assert sorted((r.path.rsplit("/", 1)[1], r.gap) for r in seen.collect()) == [("a.py", None), ("b.py", None), ("c.bin", "not text")]
    log = spark.createDataFrame([], "md5 string")
    fresh = S.new_files(spark, str(tmp_path / "t"), log)
    assert fresh.count() == 3 and S.new_files(spark, str(tmp_path / "t"), fresh.select("md5")).count() == 0
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.txt", "hello")
        z.writestr("n.txt", "x" * 20)
    (tmp_path / "bad.zip").write_bytes(b"no")
    got = {(r.member, r.text) for r in S.read_archives(spark, str(tmp_path / "*.zip"), max_member=10).collect()}
    assert got == {("m.txt", "hello"), ("n.txt", None), (None, None)}


def test_statements_manifests_logs_pages(spark):
    sql = "select 1; -- drop table x;\nDELETE FROM a; delete from a where b = ';'; /* ; */ DROP TABLE t; grant all"
    assert [(r.verb, r.kind) for r in S.sql_statements(spark.createDataFrame([(1, sql)], "i int, s string"), "i", "s").orderBy("position").collect()] == [
        ("SELECT", "read"), ("DELETE", "destructive"), ("DELETE", "write"), ("DROP", "destructive"), ("GRANT", "privileged")
    ]
    files = [("a/requirements.txt", "flask==2.0.1\n# no\nnumpy>=1.2 ; x"), ("go.mod", "require example.org/m v1.2.3\n"), ("x.csproj", '<PackageReference Include="P" Version="3.1" />'), ("other.txt", "flask==1")]
    assert {tuple(r)[2:] for r in S.dependencies(spark.createDataFrame(files, "path string, text string")).collect()} == {("flask", "2.0.1"), ("numpy", "1.2"), ("example.org/m", "1.2.3"), ("P", "3.1")}
    lock = json.dumps({"packages": {"": {"version": "1"}, "node_modules/@s/a": {"version": "2", "dependencies": {"b": "^1"}}}})
    assert {(r.name, r.version, tuple(r.wants)) for r in S.lock_edges(spark.createDataFrame([("p", lock)], "path string, text string")).collect()} == {("", "1", ()), ("@s/a", "2", ("b",))}
    log = [("l", i, x) for i, x in enumerate(["commit abcdef1234", "+++ b/f.py", "+new", " old", "+++ b/g.py", "+more"])]
    assert {(r.commit, r.file, r.added) for r in S.added_lines(spark.createDataFrame(log, "k string, i int, x string"), "k", "i", "x").collect()} == {("abcdef1234", "f.py", "new"), ("abcdef1234", "g.py", "more")}
    signal = S.log_signals(spark.createDataFrame([("2025-01-02T03:04:05Z ERROR boom at a/b.py:12 now",), ("plain",)], "x string"), "x").collect()
    assert [(r.level, r.path, r.line) for r in signal] == [("ERROR", "a/b.py", 12)]
    page = S.page_texts(spark.createDataFrame([(1, "<title>T</title><link rel=canonical href='u'><p>a&amp;b<script>x</script><div>c</div>"), (2, None)], "i int, h string"), "i", "h").orderBy("i").collect()
    assert (page[0].title, page[0].canonical, page[0].text, page[1].text) == ("T", "u", "a&b\nc", "")


def test_captures(spark, tmp_path):
    ip = bytes([0x45, 0, 0, 33, 0, 0, 0, 0, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2])
    frame = b"\x00" * 12 + b"\x08\x00" + ip + struct.pack(">HHHH", 1000, 53, 13, 0) + b"hello"
    ethernet, raw, unknown = (b"\x00" * 16 + struct.pack("<I", link) for link in (1, 101, 999))
    record = lambda data, kept=None: struct.pack("<IIII", 5, 500000, kept or len(data), len(data)) + data
    (tmp_path / "x.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + ethernet + record(frame) + record(frame[:30]) + record(frame, len(frame) + 9) + b"\x00\x00")
    (tmp_path / "raw.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + raw + record(frame[14:]))
    (tmp_path / "unknown.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + unknown + record(frame))
    assert [S.read_captures(spark, str(tmp_path / name)).count() for name in ("raw.pcap", "unknown.pcap")] == [1, 0]
    got = S.read_captures(spark, str(tmp_path / "x.pcap")).collect()
    assert [(r.ts, r.src, r.dst, r.sport, r.dport, r.proto, bytes(r.payload)) for r in got] == [(5.5, "10.0.0.1", "10.0.0.2", 1000, 53, "udp", b"hello")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "i int, t string")
    path = str(tmp_path / "table")
    assert K.append_new(df, path, "i") == 2 and K.append_new(df, path, "i") == 0
    assert K.read_or_empty(spark, path, "i int, t string").count() == 2 and K.read_or_empty(spark, path + "x", "i int").count() == 0
    rows = spark.createDataFrame([("r", "R1", "p", 3, "HIGH", "m")], "run string, rule string, path string, line int, sev string, message string")
    back = K.from_sarif(K.to_sarif(rows, "tool"), "sarif").first()
    assert (back.tool, back.rule, back.level, back.path, back.line, back.message) == ("tool", "R1", "error", "p", 3, "m")


def test_resumed_stream_sees_only_new_files(spark, tmp_path):
    from weftline.streaming import events as E

    (tmp_path / "in").mkdir()
    seen = []

    def put(i):
        spark.sql(f"select cast({i} as bigint) event_id, timestamp_ntz'2025-01-01 00:00:00' ts, cast(1 as bigint) user_id, 'click' event_type, 1.0D value, '' props").toPandas().to_parquet(tmp_path / f"in/events{i}.parquet", coerce_timestamps="us", index=False)

    def run():
        E.run_available(E.read_events(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r.event_id for r in df.collect()), "append", str(tmp_path / "check"))

    put(1)
    run()
    put(2)
    run()
    assert seen == [1, 2]


def test_row_order_and_partitions_change_nothing(spark):
    rows = [(i, f"t{i % 7}") for i in range(50)]
    df = spark.createDataFrame(rows, "i int, t string")
    a = {tuple(r) for r in C.duplicate_groups(df, "i", F.col("t")).collect()}
    assert a == {tuple(r) for r in C.duplicate_groups(df.repartition(9).orderBy(F.desc("i")), "i", F.col("t")).collect()}
