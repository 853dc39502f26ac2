"""Names, references, requirements and rule packs: orders of preference, ties, nulls and empty tables."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftline.functions import parse as P
from weftline.functions import text as T
from weftline.operators import corpus as C
from weftline.operators import integrity as I
from weftline.operators import joins as J
from weftline.operators import resolution as R


def test_calls_resolve_in_order(spark):
    definitions = spark.createDataFrame([(n,) for n in ("a.run", "a.C.walk", "b.run", "b.stop", "c.D.only", "c.E.twice", "b.F.twice", "d.twice", None)], "name string")
    aliases = spark.createDataFrame([("a", "x", "b"), ("a", "y", "c.D"), ("a", "z", "c")], "module string, alias string, stands_for string")
    calls = [("a", "run"), ("a", "obj.walk"), ("a", "x.stop"), ("a", "y.only"), ("a", "z.only"), ("e", "only"), ("e", "twice"), ("e", "none"), (None, "run"), ("a", ""), ("a", "run")]
    got = {(r.module, r.callee): (r.target, r.how) for r in R.resolve_calls(spark.createDataFrame(calls, "module string, callee string"), definitions, aliases).collect()}
    assert got == {
        ("a", "run"): ("a.run", "own"), ("a", "obj.walk"): ("a.C.walk", "module"), ("a", "x.stop"): ("b.stop", "alias"), ("a", "y.only"): ("c.D.only", "alias"), ("a", "z.only"): ("c.D.only", "alias"), ("e", "only"): ("c.D.only", "global"), ("e", "twice"): ("", "none"), ("e", "none"): ("", "none"),
    }


def test_imports_keep_to_the_tree(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.py", "src/a.js", "src/lib/index.js", "top.py", "src/b")], "path string")
    asked = [("src/x.py", "./a"), ("src/x.py", "../top"), ("src/x.py", "./lib"), ("src/x.py", "../../top"), ("src/x.py", "./b"), ("x.py", "./top"), ("src/x.py", "os"), (None, "./a"), ("src/x.py", None)]
    got = {(r.path, r.specifier): r.target for r in R.resolve_imports(spark.createDataFrame(asked, "path string, specifier string"), files, [".py", ".js"]).collect()}
    assert got == {("src/x.py", "./a"): "src/a.py", ("src/x.py", "../top"): "top.py", ("src/x.py", "./lib"): "src/lib/index.js", ("src/x.py", "./b"): "src/b", ("x.py", "./top"): "top.py"}


def test_evidence_needs_one_target(spark):
    targets = spark.createDataFrame([("f1", "p:1"), ("f2", "p:2"), ("f3", "p:2"), ("f1", "p:9")], "target string, locator string")
    evidence = spark.createDataFrame([("a", "f2", "p:1"), ("b", None, "p:1"), ("c", None, "p:2"), ("d", "gone", None), ("e", "gone", "p:9"), ("f", None, None)], "evidence string, ref string, locator string")
    got = {r.evidence: (r.state, r.target) for r in R.link_evidence(evidence, targets).collect()}
    assert got == {"a": ("linked", "f2"), "b": ("linked", "f1"), "c": ("ambiguous", None), "d": ("unlinked", None), "e": ("linked", "f1"), "f": ("unlinked", None)}


def test_grades_keep_unknown_apart(spark):
    findings = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p"), (4, "q"), (5, "p")], "finding int, project string")
    paths = spark.createDataFrame([(1, True, 3), (1, True, 2), (2, True, 1), (2, False, 5), (5, None, 1)], "finding int, gated boolean, hops int")
    got = {r.finding: (r.grade, r.paths, r.hops) for r in R.reachability_grades(findings, paths, spark.createDataFrame([("p",)], "project string")).collect()}
    assert got == {1: ("behind authentication", 2, 2), 2: ("unauthenticated", 2, 1), 3: ("no path", 0, None), 4: ("unknown", 0, None), 5: ("unauthenticated", 1, 1)}


def test_adjudication_classes(spark):
    findings = spark.createDataFrame([(x,) for x in "abcd"], "finding string")
    evidence = spark.createDataFrame([("a", "s", "support"), ("b", "s", "support"), ("b", "t", "contest"), ("c", "s", "maybe"), ("d", "s", "support"), ("d", "s", "contest"), ("z", "s", "support")], "finding string, source string, stance string")
    got = {r.finding: (r["class"], r.reasons) for r in R.adjudicate(findings, evidence).collect()}
    assert got == {"a": ("supported", "supporting evidence"), "b": ("contested", "contesting evidence,supporting evidence"), "c": ("insufficient", "no decisive evidence"), "d": ("contested", "contesting evidence,contradiction,supporting evidence")}


WORKERS = "site int, worker string, roles array<string>, hours map<int,array<double>>, rate double, most double, priority int"
SHIFTS = "site int, shift string, role string, day int, start double, end double, least int, most int"


def test_shifts_go_by_priority_hours_and_cost(spark):
    day = {0: [8.0, 18.0], 1: [8.0, 18.0]}
    workers = spark.createDataFrame([(1, "ann", ["cook"], day, 10.0, 8.0, 1), (1, "bob", ["cook", "bar"], day, 9.0, 40.0, 2), (1, "eve", ["bar"], None, 5.0, 40.0, 0)], WORKERS)
    shifts = spark.createDataFrame([(1, "s1", "cook", 0, 8.0, 14.0, 1, 1), (1, "s2", "cook", 0, 10.0, 15.0, 1, 1), (1, "s3", "cook", 1, 8.0, 14.0, 1, 2), (1, "s4", "bar", 1, 8.0, 9.0, 1, 1), (1, "s5", None, 1, 16.0, 18.0, 1, 1)], SHIFTS)
    rows = [(r.shift, r.worker) for r in R.assign_shifts(workers, shifts).collect()]
    # ann has two hours left on day 1, bob is busy in the bar's hour
    assert sorted(rows, key=str) == sorted([("s1", "ann"), ("s2", "bob"), ("s3", "bob"), ("s4", None), ("s5", "ann")], key=str)
    capped = {(r.shift, r.worker) for r in R.assign_shifts(workers, shifts, cap=60.0).collect()}
    assert ("s1", "ann") in capped and ("s2", None) in capped


def test_matching_blocks_ratio_and_squats(spark):
    pairs = [("requests", "request"), ("numpy", "NumPy"), ("", ""), ("abc", None)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(R.sequence_ratio("a", "b")).collect()]
    assert got == [None if b is None else pytest.approx(SequenceMatcher(None, a.lower(), b.lower()).ratio()) for a, b in pairs]
    rows = R.look_alikes(spark.createDataFrame([("py-flask",), ("Requests",), ("requets",), (None,), ("flask",)], "p string"), "p", ["flask", "requests"]).collect()
    assert {(r.package, r.popular, r.rule) for r in rows} == {("py_flask", "flask", "part"), ("requets", "requests", "similar")}


def test_rule_packs_need_fixtures(spark):
    rules = spark.createDataFrame([("r", "call", ["eval"], None), ("q", "call", ["md5"], ["C1"]), ("none", "call", [], None)], "rule string, kind string, names array<string>, cwes array<string>")
    fixtures = spark.createDataFrame([("r", True, "call", "eval", None), ("r", False, "call", "eval", "x"), ("q", True, "call", "md5", "C1"), ("q", False, "call", "md5", None)], "rule string, positive boolean, kind string, name string, cwe string")
    assert {tuple(r) for r in R.pack_errors(rules, fixtures).collect()} == {("r", "negative fixture met"), ("none", "no positive fixture"), ("none", "no negative fixture")}


def test_split_is_exact_and_keeps_groups(spark):
    rows = spark.createDataFrame([(i, f"g{i % 37}" if i % 10 else None) for i in range(500)], "i int, g string")
    got = R.ranked_split(rows, "g", 1).collect()
    part = {}
    for r in got:
        assert part.setdefault(r.g, r.part) == r.part
    assert sum(p == "train" for p in part.values()) == int(37 * 0.8) and len(part) == 37


def test_flows_line_after_line(spark):
    code = "a = input()\nb = a\neval(b)\nb = 1\neval(b)\nos.system(quote(a))\neval(input())\ndef f():\neval(a)"
    rows = R.local_flows(spark.createDataFrame([(1, code), (2, None), (3, "")], "i int, t string"), "i", "t", ["input"], ["eval", "os.system"], ["quote"]).collect()
    assert [(r.i, r.line, r.sink) for r in rows] == [(1, 3, "eval"), (1, 7, "eval")]


def test_perceptron_writes_down_its_mistakes():
    rows = [({"a": 1.0}, 1), ({"b": 1.0}, -1), ({"a": 1.0, "b": 0.5}, 1)]
    weights, ledger = R.perceptron(rows)
    assert ledger[0] == (0, 0, -1, 1) and all((1 if sum(weights.get(k, 0) * v for k, v in x.items()) > 0 else -1) == y for x, y in rows)
    assert R.perceptron([]) == ({}, [])


def test_versions_of_any_length_and_inconclusive_ones(spark):
    rows = [("1.2.3.4.5.6.7", "<1.2.3.4.5.6.8", True), ("1.0", "=1.0.0", True), ("1.0rc1", "<1.0", True), ("2.0.0.0", ">2", False), ("10.0", ">9.9", True), ("latest", ">1", None), ("0", "=0.0", True)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string, s string, w boolean").select(P.in_range(F.col("v"), F.col("s"))).collect()]
    assert got == [w for *_, w in rows]
    feed = spark.createDataFrame([("Pkg", "<2", "A")], "n string, spec string, advisory string")
    packages = spark.createDataFrame([(1, "org/PKG", "1.0"), (2, "pkg", "x"), (3, "pkg", "3"), (4, None, "1")], "id int, name string, version string")
    assert {tuple(r) for r in J.affected_versions(packages, feed).collect()} == {(1, "A", "affected"), (2, "A", "inconclusive")}


def test_prefixes_longer_than_32(spark):
    rules = spark.createDataFrame([("x" * 50, 2.0), ("x", 1.0)], "p string, v double")
    rows = spark.createDataFrame([("x" * 60,), ("x" * 40,), ("y",), (None,)], "t string")
    assert [r.v for r in J.longest_prefix(rows, "t", rules, "p", "v", 0.5).orderBy(F.length("t").desc_nulls_last()).collect()] == [2.0, 1.0, 0.5, 0.5]


def test_chains_and_folds(spark):
    chain = I.build_chain(spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "z"), ("b", 1, "x"), (None, 1, "x")], "k string, s int, p string"), "k", "s", "p")
    rows = chain.withColumn("p", F.coalesce("p", F.lit("")))
    assert I.chain_breaks(rows, ["k"], "s", "previous", "digest", F.col("p")).count() == 0
    bad = rows.withColumn("p", F.when((F.col("k") == "a") & (F.col("s") == 2), "other").otherwise(F.col("p")))
    assert [(r.k, r.first_broken) for r in I.chain_breaks(bad, ["k"], "s", "previous", "digest", F.col("p")).collect()] == [("a", 2)]
    results = spark.createDataFrame([("s1", 2), ("s2", 3), ("s2", 3), ("s9", 1)], "s string, n int")
    folded = {r.state: (r.shards, r.rows) for r in I.fold_results(results, "s", "n", spark.createDataFrame([("s1",), ("s2",), ("s3",)], "w string"), "w").collect()}
    assert folded == {"accepted": (1, 2), "duplicate": (1, 6), "missing": (1, 0), "foreign": (1, 1)}


def test_multisets_find_near_clones(spark):
    rnd = random.Random(7)
    words = ["a1", "b1", "c1", "d1", "e1"]
    texts = [[rnd.choice(words) for _ in range(rnd.randint(3, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.group, r.links) for r in C.near_duplicates(df, "i", F.col("t"), least=0.75, shingles=T.numbered(T.words(F.col("t")))).collect()}
    from collections import Counter

    bags = [Counter(t) for t in texts]
    classes = {}
    for i, b in enumerate(bags):
        classes.setdefault(frozenset(b.items()), i)
    similar = lambda a, b: sum((a & b).values()) >= 0.75 * sum((a | b).values())
    first = sorted(set(classes.values()))
    want = {i: (classes[frozenset(b.items())], sum(similar(b, bags[j]) for j in first if j != classes[frozenset(b.items())])) for i, b in enumerate(bags)}
    assert got == want


def test_files_beyond_old_limits_and_their_gaps(spark, tmp_path):
    from weftline.sources import files as S

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "big.txt").write_text("x" * (3 << 20))
    (tmp_path / "t" / "bin.txt").write_bytes(b"a\x00b")
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.gap, None if r.text is None else len(r.text)) for r in S.scan_files(spark, str(tmp_path / "t")).collect()}
    assert got == {"big.txt": (3 << 20, None, 3 << 20), "bin.txt": (3, "not text", None)}
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.txt", "y" * (2 << 20))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows = {(r.member, r.gap, None if r.text is None else len(r.text)) for r in S.read_archives(spark, str(tmp_path / "*.zip")).collect()}
    assert rows == {("m.txt", None, 2 << 20), (None, "unreadable archive", None)}
