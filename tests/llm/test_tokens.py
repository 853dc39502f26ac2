"""Tokenization against the reference libraries, and packing."""

import random
from pathlib import Path

import pytest

from weftline.llm import packing as K
from weftline.llm import tokens as T

pytestmark = pytest.mark.skipif(not Path(T.tokenizer_path()).exists(), reason="no tokenizer files here")

ODD = ["", " ", "\n\n  x", "<|endoftext|> ordinary", "it's we'll 123 45", "äöü ß 漢字かな 🔥👩‍💻", "a\u00a0b\u200b\u2028c", "x" * 3000, "ab" * 2000, "=-" * 1000, "\t\t\tif x:\r\n", "\x00\x1c\x85", "e\u0301 é ﬁ ½"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_equals_the_reference_library(reference):
    automaton = T.load(T.tokenizer_path())
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("aaabbeentt hhiios.,=-_/\n  0123тäé漢🔥zZ'sd") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        ids = automaton.encode(text)
        assert list(ids) == reference(text)
        assert automaton.decode(list(ids)) == text


def test_small_automata_equal_plain_merging():
    rnd = random.Random(2)
    for _ in range(60):
        tokens = {i: bytes([97 + i]) for i in range(3)}
        merges = []
        while len(tokens) < 14:
            a, b = rnd.choice(list(tokens)), rnd.choice(list(tokens))
            if tokens[a] + tokens[b] not in tokens.values():
                merges.append((a, b, len(tokens)))
                tokens[len(tokens)] = tokens[a] + tokens[b]
        automaton = T.MergeAutomaton(tokens, merges)
        for _ in range(60):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14)))
            ids = [c - 97 for c in word]
            for a, b, both in merges:
                out, i = [], 0
                while i < len(ids):
                    if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                        out.append(both)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            assert list(automaton.encode_word(word)) == ids


def test_operator(spark):
    rows = [(1, "hello world", "clash"), (1, "hello world", ""), (2, None, None), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted((r.doc_id, list(r.ids)) for r in T.encode_texts(df).collect())
    assert [x[0] for x in out] == [1, 1, 2, 3] and out[0] == out[1] and out[0][1] and out[2][1] == out[3][1] == []
    assert {r.doc_id: r.text for r in T.decode_ids(T.encode_texts(df)).collect()} == {1: "hello world", 2: "", 3: ""}
    assert {r.doc_id: r.tokens for r in T.count_tokens(df).collect()} == {1: len(out[0][1]), 2: 0, 3: 0}
    assert T.encode_texts(df.limit(0)).count() == 0


def plain_first_fit(items, capacity):
    bins, out = [], {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        at = next((i for i, free in enumerate(bins) if free >= size), None)
        if at is None:
            bins.append(capacity)
            at = len(bins) - 1
        bins[at] -= size
        out[item] = at
    return out


def test_first_fit_equals_the_plain_algorithm():
    rnd = random.Random(3)
    for _ in range(50):
        capacity = rnd.randint(5, 40)
        items = [(i, rnd.randint(0, capacity)) for i in range(rnd.randint(1, 120))]
        got = {item: at for item, _, _, _, at in K.first_fit_decreasing(items, capacity)}
        assert got == plain_first_fit(items, capacity)


def test_packing_is_whole_and_within_capacity(spark):
    rnd = random.Random(4)
    sizes = {i: rnd.choice([0, rnd.randint(1, 300), rnd.randint(300, 3000)]) for i in range(500)}
    items = spark.createDataFrame([(i, n, 1) for i, n in sizes.items()] + [(900, None, 1)], "doc_id long, tokens int, grp int")
    kinds = spark.createDataFrame([("s", 512), ("l", 2048)], "container string, capacity int")
    packed = K.pack(items, kinds, group_items=200)
    rows = packed.collect()
    for name, capacity in (("s", 512), ("l", 2048)):
        load, parts = {}, {}
        for r in (r for r in rows if r.container == name):
            load[r.grp, r.bin] = load.get((r.grp, r.bin), 0) + r.tokens
            parts.setdefault(r.doc_id, []).append((r.part, r.start, r.tokens))
        assert max(load.values()) <= capacity
        for i, n in (sizes | {900: 0}).items():
            own = sorted(parts[i])
            assert sum(t for *_, t in own) == n and [s for _, s, _ in own] == [k * capacity for k in range(len(own))]
            assert len(own) == 1 or n > capacity
    fill = {r.container: r.fill for r in K.fill_rates(packed, kinds).collect()}
    assert min(fill.values()) > 0.95


def test_packing_of_nothing_and_bad_capacities(spark):
    items = spark.createDataFrame([], "doc_id long, tokens int")
    assert K.pack(items, spark.createDataFrame([("s", 5)], "container string, capacity int")).count() == 0
    assert K.pack(items, spark.createDataFrame([], "container string, capacity int")).count() == 0
    with pytest.raises(ValueError, match="positive"):
        K.pack(items, spark.createDataFrame([("s", 0)], "container string, capacity int"))
