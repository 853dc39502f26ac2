"""Whole jobs where a query once did less: no caps on rows, lengths or facts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import corpus as C
from weftline.operators import graph as G
from weftline.plans import catalog


def test_cases_of_many_parts_stay_whole(spark, tmp_path):
    rows = [(i, "CIFinding", "a.c", 300 - i, f"part {i}") for i in range(300)] + [(900, "CIFinding", "b.c", 1, "x"), (901, "CIFinding", "b.c", 2, None), (902, "CIFinding", "c.c", 1, "y"), (903, "Finding", "a.c", 1, "z")]
    spark.createDataFrame(rows, "record_id long, kind string, path string, line int, code string").write.parquet(str(tmp_path / "code_findings.parquet"))
    order = list(range(299, -1, -1))
    got = {r.path: (r.parts, r.n) for r in catalog.queries()["joined_parts"](spark, str(tmp_path)).collect()}
    assert got == {"a.c": (",".join(map(str, order)), 300), "b.c": ("900,901", 2)}
    chunks = catalog.queries()["joined_part_texts"](spark, str(tmp_path)).orderBy("path", "chunk").collect()
    assert [(r.path, r.chunk, r.parts, r.missing) for r in chunks] == [("a.c", 0, 256, 0), ("a.c", 1, 44, 0), ("b.c", 0, 2, 1)]
    assert "\n".join(r.text for r in chunks if r.path == "a.c") == "\n".join(f"part {i}" for i in order)
    assert chunks[-1].text is None


def plain_fusion(hits):
    """url -> score and queries, hit by hit in the order of query and rank."""
    rows = {}
    for url, q, r, o in sorted(hits, key=lambda h: (h[1], h[2], max(0, 120 - 3 * h[2]) + 8 * h[3])):
        s = max(0, 120 - 3 * r) + 8 * o + (5 if url.startswith("https:") else 0)
        if url not in rows:
            rows[url] = [s, {q}]
        else:
            row = rows[url]
            row[0] = max(row[0] + (0 if q in row[1] else 18), s) + 4
            row[1].add(q)
    return {u: (s, len(q)) for u, (s, q) in rows.items()}


def test_fusion_by_aggregation_equals_the_plain_fold(spark):
    rnd = random.Random(5)
    hits = [(rnd.choice(["https://a", "http://b", "http://c"]), f"q{rnd.randrange(6)}", rnd.randrange(1, 90), rnd.randrange(20)) for _ in range(300)] + [("https://d", "q1", 300, 0), ("http://e", "q2", 50, 0), ("http://e", "q2", 1, 9), ("http://e", "q3", 1, 30)]
    got = C.fuse_ranks(spark.createDataFrame(hits, "u string, q string, r int, o int"), "u", "q", "r", "o").collect()
    assert {r.u: (r.score, r.queries) for r in got} == plain_fusion(hits)


def test_addresses_after_rank_40_count(spark, tmp_path):
    rows = [(i, f"see http://h{i}.example/x", "en", "s", "k", "p") for i in range(60)] + [(100 + i, "https://late.example/", "en", "s", "k", "p") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, doc_kind string, path string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.url: (r.score, r.queries) for r in catalog.queries()["fused_urls"](spark, str(tmp_path)).collect()}
    assert len(got) == 61
    assert next(v for u, v in got.items() if "late" in u) == (5 + 4 + 4, 1)
    assert next(v for u, v in got.items() if "h0." in u) == (117, 1)


def reach(edges, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        fresh = [d for s, d in edges if s == at and d not in seen]
        seen.update(fresh)
        todo += fresh
    return seen


def test_graph_loops_run_over_all_suppliers_and_facts(spark, tmp_path):
    n, nation = 14, {i: i % 5 for i in range(1, 15)}
    spark.createDataFrame(list(nation.items()), "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    edges = [(i, i * 3 % n + 1) for i in nation] + [(i, i * 5 % n + 2) for i in nation if i % 3 == 0]
    nodes = {x for e in edges for x in e}
    far = {x: reach(edges, x) for x in nodes}
    got = {r.node: r.component for r in catalog.queries()["graph_strong_components_all"](spark, str(tmp_path)).collect()}
    assert got == {x: min(y for y in far[x] if x in far[y]) for x in nodes}
    facts = sorted(tuple(r) for r in catalog.queries()["graph_propagation_all"](spark, str(tmp_path)).collect())
    assert facts == sorted({(y, f"nation-{nation[x]}") for x in nation for y in far[x]})


def test_a_loop_that_its_bound_stops_is_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    with pytest.raises(RuntimeError):
        G.propagate(spark.createDataFrame([(0, "f")], "node long, fact string"), chain, max_rounds=3).whole()
    with pytest.raises(RuntimeError):
        G.strong_components(chain, max_rounds=1).whole()


def test_bigrams_and_entropy_cover_whole_texts(spark, tmp_path):
    rnd = random.Random(3)
    texts = {1: " ".join(rnd.choice(["Alpha", "beta,", "c_3", "é"]) for _ in range(3000)), 2: "one two three four five", 3: "x", 4: ""}
    rows = [(i, x, "en", "s", "k", "p") for i, x in texts.items()] + [(5, None, "en", "s", "k", "p")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, doc_kind string, path string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for i, x in texts.items():
        w = re.findall(r"\w+", x.lower())
        want.update((i, f"{a} {b}") for a, b in zip(w, w[1:], strict=False))
    got = {(r.doc_id, r.bigram): r.n for r in catalog.queries()["word_bigram_counts"](spark, str(tmp_path)).collect()}
    assert got == dict(want)
    entropy = {r.doc_id: r.entropy for r in catalog.queries()["text_entropy"](spark, str(tmp_path)).collect()}
    assert set(entropy) == {1, 2, 3}
    for i, e in entropy.items():
        n = len(texts[i])
        assert e == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(texts[i]).values()), abs=1e-3)


def test_long_chains_end_in_few_jobs(spark):
    """A ring and a chain through all nodes: round by round each would take hundreds of jobs."""
    ring, chain = [(i, (i + 1) % 700) for i in range(700)], [(i, i + 1) for i in range(1000, 1700)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("long chains", "strong components")
    try:
        found = G.strong_components(spark.createDataFrame([*ring, *chain], "src long, dst long"))
        got = {r.node: r.component for r in found.whole().collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == {i: 0 for i in range(700)} | {i: i for i in range(1000, 1701)}
    assert found.rounds == 1 and len(jobs.getJobIdsForGroup("long chains")) < 60


@pytest.mark.parametrize("one_task", [1, 6])
def test_strong_components_by_pieces_equal_those_of_one_task(spark, monkeypatch, one_task):
    rnd = random.Random(11)
    edges = [(str(rnd.randrange(18)), str(rnd.randrange(18))) for _ in range(24)] + [("x", "x"), (None, "1"), ("1", None)]
    known = [e for e in edges if None not in e]
    far = {x: reach(known, x) for x in {y for e in known for y in e}}
    want = {x: min(y for y in far[x] if x in far[y]) for x in far}
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.node: r.component for r in G.strong_components(df).whole().collect()} == want
    monkeypatch.setattr(G, "ONE_TASK", one_task)
    found = G.strong_components(df)
    assert {r.node: r.component for r in found.whole().collect()} == want and found.rounds > 1


@pytest.mark.parametrize("one_task", [0, 1 << 19])
def test_reachable_in_one_task_equals_rounds(spark, monkeypatch, one_task):
    monkeypatch.setattr(G, "ONE_TASK", one_task)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (7, 1), (None, 5), (4, None)], "src int, dst int")
    starts = spark.createDataFrame([(1,), (None,), (9,), (1 << 40,)], "n long")
    found = G.reachable(edges, starts)
    assert sorted(map(tuple, found.whole().collect())) == [(1, 0), (2, 1), (3, 1), (4, 2), (9, 0), (1 << 40, 0)]
    assert [(f.name, f.dataType.simpleString()) for f in found.rows.schema] == [("node", "bigint"), ("hops", "int")]
    assert {r.node: r.hops for r in G.impacted(edges, spark.createDataFrame([(3,)], "n int")).whole().collect()} == {3: 0, 2: 1, 1: 1, 7: 2}
    assert G.reachable(edges.limit(0), starts).whole().count() == 3 and G.reachable(edges, starts.limit(0)).whole().count() == 0


def test_impact_over_a_long_chain_takes_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(600)], "src long, dst long")
    spark.sparkContext.setJobGroup("impact", "impact")
    try:
        got = {r.node: r.hops for r in G.impacted(edges, spark.createDataFrame([(600,)], "n long")).whole().collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == {i: 600 - i for i in range(601)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("impact")) < 40


def test_facts_are_carried_further_than_300_edges(spark, tmp_path):
    n = 10_000
    spark.range(n).selectExpr("id AS s_suppkey", "cast(id % 5 AS int) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    behind = {i: {i * 3 % n + 1} | ({i * 5 % n + 2} if i % 3 == 0 else set()) for i in range(n)}
    want, deepest = set(), 0
    for s in range(4):
        hops = G.walk(behind, [s])
        deepest = max(deepest, *hops.values())
        want |= {(x, f"nation-{s % 5}") for x in hops}
    got = [tuple(r) for r in catalog.queries()["graph_propagation"](spark, str(tmp_path)).collect()]
    assert deepest > 300 and len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("one_task", [0, 16, 1 << 19])
def test_propagation_in_tasks_equals_rounds(spark, monkeypatch, one_task):
    monkeypatch.setattr(G, "ONE_TASK", one_task)
    edges = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)] + [(7, 0), (None, 9), (8, None), (0, 1)], "src int, dst int")
    facts = spark.createDataFrame([(0, "a"), (7, None), (None, "b"), (8, "c"), (6, "d"), (0, "a")], "node long, fact string")
    ring = range(5)
    want = {(i, "a") for i in ring} | {(i, None) for i in ring} | {(7, None), (None, "b"), (8, "c"), (None, "c"), (6, "d")}
    got = [tuple(r) for r in G.propagate(facts, edges).whole().collect()]
    assert len(got) == len(want) and set(got) == want


def test_multisets_are_sorted_once(spark):
    """The array inside the inner function was made again, parsed and sorted, for every item."""
    from weftline.functions import text as T

    df = spark.createDataFrame([(" ".join(f"name{i % 7}" for i in range(20)),), ("",), (None,)], "t string").select(T.numbered(T.words(F.col("t"))).alias("n"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert [r.n and sorted(r.n) for r in df.collect()] == [sorted(f"name{i % 7}#{i // 7 - 1}" for i in range(20)), [], None]


@pytest.mark.parametrize("least", [0.5, 0.6, 0.75, 0.8, 1.0])
def test_similar_sets_of_any_size_are_linked(spark, least):
    rnd = random.Random(9)
    sets = []
    for _ in range(120):
        size = rnd.choice([1, 2, 3, 4, 8, 16, 20, 60, 400])
        base = set(rnd.choice(sets)) if sets and rnd.random() < 0.7 else {f"x{rnd.randrange(900)}" for _ in range(size)}
        for _ in range(rnd.randrange(1 + len(base) // 3)):
            base.discard(rnd.choice(sorted(base)))
            base |= {f"x{rnd.randrange(900)}"} if rnd.random() < 0.5 else set()
        sets.append(frozenset(base))
    got = {r.i: (r.group, r.links) for r in C.near_duplicates(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "i int, s array<string>"), "i", F.lit(""), least=least, shingles=F.col("s")).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s if s else i, i)
    near = lambda a, b: a != b and a and b and len(a & b) >= least * len(a | b)
    distinct = [s for s in first if isinstance(s, frozenset)]
    assert got == {i: (first[s if s else i], sum(bool(near(s, o)) for o in distinct)) for i, s in enumerate(sets)}
