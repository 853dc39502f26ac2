"""Consensus: planted truth, planted reliabilities, and odd inputs."""

import random

import pytest

from weftline.llm.consensus import consensus

LABELS = ["A", "B", "C"]
SCHEMA = "item string, annotator string, label string, at int, tie int, votes string"


def planted(seed, items=600):
    rnd = random.Random(seed)
    quality = {f"good{i}": 0.85 for i in range(5)} | {f"poor{i}": 0.36 for i in range(6)} | {"wrong0": 0.05, "wrong1": 0.05}
    truth, rows = {}, []
    for i in range(items):
        truth[f"i{i}"] = t = rnd.choice(LABELS)
        for name, q in quality.items():
            if rnd.random() < 0.6:
                said = t if rnd.random() < q else rnd.choice([x for x in LABELS if x != t])
                rows.append((f"i{i}", name, said, 5, i, "clash"))
    return truth, rows, quality


def test_better_than_a_majority_and_right_about_annotators(spark):
    truth, rows, quality = planted(1)
    rows += [(f"i{i}", "rare", truth[f"i{i}"], 1, 0, "") for i in range(3)]
    result = consensus(spark.createDataFrame(rows, SCHEMA), LABELS)
    said = {r.item: r.label for r in result.items.collect()}
    votes = {}
    for item, _, label, *_ in rows:
        votes.setdefault(item, []).append(label)
    right = sum(said[i] == t for i, t in truth.items()) / len(truth)
    majority = sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in votes.items()) / len(votes)
    assert right > 0.9 and right > majority + 0.05
    reliability = {r.annotator: r.reliability for r in result.annotators.collect()}
    assert all(abs(reliability[n] - q) < 0.1 for n, q in quality.items())
    # three right answers don't make an annotator perfect: it is drawn to its type
    assert reliability["rare"] < 0.97


def test_last_opinion_counts_and_unreadable_ones_do_not(spark):
    rows = [("x", "a", "A", 1, 0, ""), ("x", "a", "B", 2, 0, ""), ("x", "a", "junk", 3, 0, ""), ("x", "b", "B", 1, 0, ""), ("x", None, "A", 1, 0, ""), (None, "b", "A", 1, 0, ""), ("y", "b", None, 1, 0, ""), ("z", "a", "C", None, 0, ""), ("x", "b", "B", 1, 0, "")]
    got = {r.item: (r.label, r.voters, r.agreement) for r in consensus(spark.createDataFrame(rows, SCHEMA), LABELS).items.collect()}
    assert got == {"x": ("B", 2, 1.0), "z": ("C", 1, None)}


def test_nothing_readable(spark):
    result = consensus(spark.createDataFrame([("x", "a", "junk", 1, 0, "")], SCHEMA), LABELS)
    assert result.items.count() == 0 and result.annotators.count() == 0


def test_partitions_change_nothing(spark):
    _, rows, _ = planted(3, items=80)
    df = spark.createDataFrame(rows, SCHEMA)
    first = {r.item: (r.label, round(r.support, 6)) for r in consensus(df, LABELS).items.collect()}
    assert first == {r.item: (r.label, round(r.support, 6)) for r in consensus(df.repartition(7).orderBy("label"), LABELS).items.collect()}


def test_annotators_in_a_table_give_the_same_consensus(spark):
    truth, rows, quality = planted(4, items=120)
    df = spark.createDataFrame(rows, SCHEMA)
    small, wide = consensus(df, LABELS), consensus(df, LABELS, max_annotators=3)
    assert small.converged and wide.converged
    by_driver = {r.item: (r.label, r.voters) for r in small.items.collect()}
    by_table = {r.item: (r.label, r.voters) for r in wide.items.collect()}
    assert by_driver.keys() == by_table.keys()
    assert sum(by_driver[i] == by_table[i] for i in by_driver) >= 0.98 * len(by_driver)
    reliability = {r.annotator: r.reliability for r in wide.annotators.collect()}
    assert reliability.keys() == quality.keys()
    assert all(abs(r.reliability - reliability[r.annotator]) < 0.1 for r in small.annotators.collect())


def test_a_model_that_still_moves_is_an_error(spark):
    _, rows, _ = planted(5, items=40)
    with pytest.raises(RuntimeError):
        consensus(spark.createDataFrame(rows, SCHEMA), LABELS, max_rounds=1)
