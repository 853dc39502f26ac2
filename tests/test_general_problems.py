"""Orphans, snapshot changes and hierarchies against brute force, and on empty, null, hot and clashing inputs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.functions.keys import norm_key
from weftline.operators.hierarchy import build_hierarchy, descendants
from weftline.operators.orphans import KeyFilter, find_orphans, orphan_counts, parent_keys
from weftline.operators.snapshots import number_in_series, snapshot_changes

T0 = datetime(2025, 1, 1)


def at(n):
    return T0 + timedelta(hours=n)


def key_of(text):
    if text is None:
        return None
    k = text.strip().lower()
    k = k[7:] if k.startswith("sha256:") else k
    return None if k in ("", "0" * 64) else k


def test_keys_in_all_written_forms(spark):
    forms = ["Ab", " ab\t", "SHA256:AB", "sha256:ab", "ab ", "", "  ", None, "0" * 64, "sha256:" + "0" * 64, "sha256:"]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "k string").select(norm_key("k")).collect()]
    assert got == ["ab"] * 5 + [None] * 6


CHILD = "row_id long, ref string, ingested_at timestamp, ref_key string, state string"
PARENT = "row_id long, k string, ingested_at timestamp, deleted_at timestamp, p_key string"


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    keys = [f"k{i}" for i in range(40)]
    write = lambda k: rnd.choice([k, k.upper(), f" {k}", f"sha256:{k}", f"SHA256:{k} "])
    parents = [(i, rnd.choice([None, " ", write(rnd.choice(keys[:25]))]) if rnd.random() < 0.1 else write(rnd.choice(keys[:25])), at(rnd.randint(0, 50)), at(60) if rnd.random() < 0.3 else None, "clash") for i in range(80)]
    # one key holds a third of all references
    children = [(i, None if rnd.random() < 0.05 else write("k3" if rnd.random() < 0.33 else rnd.choice(keys)), at(rnd.randint(0, 50)) if rnd.random() < 0.95 else None, "clash", "clash") for i in range(400)]
    got = {(r.row_id, r.orphan_kind) for r in find_orphans(spark.createDataFrame(children, CHILD), "ref", spark.createDataFrame(parents, PARENT), "k", deleted="deleted_at").collect()}
    facts = {}
    for i, k, t, gone, _ in parents:
        if key_of(k):
            facts.setdefault(key_of(k), []).append((t, i, gone is not None))
    want = set()
    for i, k, t, *_ in children:
        if not key_of(k):
            continue
        rows = facts.get(key_of(k))
        if not rows:
            want.add((i, "missing"))
        elif max(rows)[2]:
            want.add((i, "deleted"))
        elif t and min(rows)[0] > t:
            want.add((i, "late"))
    assert got == want


def test_orphans_of_empty_tables(spark):
    child = spark.createDataFrame([(1, "a", at(1), "", "")], CHILD)
    parent = spark.createDataFrame([], PARENT)
    assert [(r.row_id, r.orphan_kind) for r in find_orphans(child, "ref", parent, "k").collect()] == [(1, "missing")]
    assert find_orphans(spark.createDataFrame([], CHILD), "ref", parent, "k", deleted="deleted_at").count() == 0


def test_filter_never_denies_a_key_and_denies_most_others(spark):
    keys = KeyFilter(parent_keys(spark.createDataFrame([(f"a{i}",) for i in range(3000)], "k string"), "k"))
    probe = lambda prefix: spark.createDataFrame([(f"{prefix}{i}",) for i in range(3000)], "k string").where(keys.may_contain(F.col("k"))).count()
    assert probe("a") == 3000
    assert probe("b") < 150


def test_filter_of_bounded_size_stays_right(spark):
    parent = spark.createDataFrame([(i, f"a{i}", at(0), None, "") for i in range(60_000)], PARENT)
    small = KeyFilter(parent_keys(parent, "k"), max_bits=1 << 15)
    child = spark.createDataFrame([(i, f"a{i * 10_000}", at(1), "", "") for i in range(9)], CHILD)
    assert {r.row_id for r in find_orphans(child, "ref", parent, "k", known=small).collect()} == {6, 7, 8}


def test_orphan_counts_by_month(spark):
    refs = spark.createDataFrame([("a", datetime(2025, 1, 2)), ("a", datetime(2025, 1, 3)), ("a", None)], "ref_table string, ingested_at timestamp")
    bad = spark.createDataFrame([("a", datetime(2025, 1, 2), "late"), ("a", None, "late")], "ref_table string, ingested_at timestamp, orphan_kind string")
    assert {tuple(r) for r in orphan_counts(refs, bad).collect()} == {("a", "2025-01", "late", 1, 2), ("a", "unknown", "late", 1, 1)}


RECORDS = "snapshot string, key string, value string, version long, seq long"
SNAPS = "snapshot string, series string, seq long, last_seq long"


@pytest.mark.parametrize(("seed", "chunk", "part"), [(1, 4, 10), (2, 32, 50_000), (3, 1, 1)])
def test_changes_equal_brute_force(spark, seed, chunk, part):
    rnd = random.Random(seed)
    snaps, records, want = [], [], set()
    for s in range(4):
        state, before = {}, None
        n = rnd.randint(1, 5)
        for q in range(1, n + 1):
            name = f"s{s}-{q}"
            snaps.append((name, f"series{s}", q, n))
            if rnd.random() < 0.15:
                state = {}
            for _ in range(rnd.randint(0, 30)):
                state[f"k{rnd.randint(0, 200)}"] = rnd.choice(["", "low", "high"])
            for k in rnd.sample(sorted(state), min(len(state), rnd.randint(0, 5))):
                del state[k]
            for k, v in state.items():
                records.append((name, k, v, 9, 0))
                if rnd.random() < 0.1:
                    records.append((name, k, "old", 1, 0))
            if before is not None:
                want |= {(name, k, "added") for k in state.keys() - before.keys()} | {(name, k, "removed") for k in before.keys() - state.keys()} | {(name, k, "changed") for k in state.keys() & before.keys() if state[k] != before[k]}
            before = dict(state)
    records.append(("unknown", "x", "y", 1, 0))
    rows, listed = spark.createDataFrame(records, RECORDS).drop("seq"), spark.createDataFrame(snaps, SNAPS)
    got = {tuple(r) for r in snapshot_changes(rows, listed, chunk_rows=chunk, slice_rows=part).collect()}
    assert got == want
    # the way for lists too long to be broadcast gives the same
    assert {tuple(r) for r in snapshot_changes(rows, listed, chunk_rows=chunk, slice_rows=part, broadcast_bytes=0).collect()} == want


def test_changes_of_empty_tables(spark):
    none = spark.createDataFrame([], RECORDS).drop("seq")
    assert snapshot_changes(none, spark.createDataFrame([], SNAPS)).count() == 0
    assert snapshot_changes(none, spark.createDataFrame([("a", "s", 1, 2), ("b", "s", 2, 2)], SNAPS)).count() == 0


def test_numbering_over_periods(spark):
    rows = [("x", i, at(i * 400)) for i in range(12)] + [("y", 1, None), ("y", 2, at(1))]
    df = spark.createDataFrame(rows, "series string, snapshot int, created timestamp")
    got = {(r.series, r.snapshot): (r.seq, r.last_seq) for r in number_in_series(df, "series", ["created", "snapshot"], F.date_trunc("month", "created")).collect()}
    assert got == {("x", i): (i + 1, 12) for i in range(12)} | {("y", 1): (1, 2), ("y", 2): (2, 2)}


def brute_tree(parent):
    out = {}
    for n in parent:
        seen, path, x = set(), [], n
        while x is not None and x not in seen:
            seen.add(x)
            path.append(x)
            x = parent[x]
        out[n] = ("", -1, None) if x is not None else (path[-1], len(path) - 1, "/".join(reversed(path)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchy_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    parent = {}
    for i in range(150):
        name = f"n{i:03d}"
        parent[name] = None if i == 0 or rnd.random() < 0.05 else ("n000" if rnd.random() < 0.33 else f"n{rnd.randrange(i):03d}")
    for i in range(70):  # a long chain
        parent[f"c{i:03d}"] = f"c{i - 1:03d}" if i else None
    parent |= {"r1": "r2", "r2": "r3", "r3": "r1", "below": "r1", "lower": "below", "self": "self"}
    tree = build_hierarchy(spark.createDataFrame(list(parent.items()), "node string, parent string"), paths=True).collect()
    want = brute_tree(parent)
    assert {r.node: (r.root, r.depth, r.path) for r in tree} == want
    sound = {r.node: r for r in tree if r.depth >= 0}
    for a in sound.values():
        below = {b.node for b in sound.values() if b.root == a.root and a.lo < b.lo <= a.hi}
        assert below == {n for n, (_, d, p) in want.items() if d >= 0 and n != a.node and a.node in p.split("/")}
        assert a.size == len(below) + 1
    for root in {r.root for r in sound.values()}:
        assert sorted(r.lo for r in sound.values() if r.root == root) == list(range(1, sound[root].size + 1))


def test_hierarchy_of_nothing_and_of_rings_only(spark):
    assert build_hierarchy(spark.createDataFrame([], "node string, parent string")).count() == 0
    ring = build_hierarchy(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"))
    assert {(r.node, r.root, r.depth) for r in ring.collect()} == {("a", "", -1), ("b", "", -1)}


def test_descendants(spark):
    tree = build_hierarchy(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "node string, parent string"))
    assert {tuple(r) for r in descendants(tree, spark.createDataFrame([("b",), ("a",)], "x string")).collect()} == {("b", "c"), ("a", "b"), ("a", "c"), ("a", "d")}
