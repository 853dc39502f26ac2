"""Encoding of texts with a public byte-level BPE tokenizer.

The merges are compiled into a deterministic automaton whose arcs are tokens and which accepts exactly the
token sequences that the tokenizer produces. It begins as one state with an arc for each byte; merge after
merge is then applied as a gadget: the state that token u leads to is copied without its arc v, all arcs u
are led to the copy, and an arc uv goes wherever v went. All arcs of one token always lead to one state, so
there is at most one state a token. A copy is not stored arc by arc but as what it lost and when: it shares
the losses of the state that it was copied from.

A word is encoded by running over its bytes once, from each reached place along the byte trie of the
vocabulary and then along an arc of the automaton. Each prefix of a word has exactly one accepted sequence,
so each place is reached once; going back from the end emits the arc labels. Arcs are looked up in a table
that fills as they are met. Decoding joins the bytes of the arc labels.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.workers import map_columns, spread

#: Where the public tokenizers are; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Fixed value: the pattern of byte-level BPE that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids, and arcs kept in the table; beyond that they are dropped and met anew.
KEPT_WORDS = 200_000
KEPT_ARCS = 2_000_000
NEVER = 1 << 60


def _byte_of() -> dict[str, int]:
    """The printable character that vocabulary files write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """Byte-level BPE as an automaton over tokens."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """`tokens`: the bytes of each id. `merges`: (left id, right id, id of both), the first applied first."""
        self.bytes_of = tokens
        size = max(tokens, default=-1) + 1
        self._left, self._right = [-1] * size, [-1] * size
        self._born = [-1] * size
        self._cut: dict[int, int] = {}  # arc v that the state behind u lost -> when
        self._arcs: dict[int, bool] = {}
        live = {i for i, b in tokens.items() if len(b) == 1}
        for when, (u, v, both) in enumerate(merges):
            if u not in live or v not in live or self._lost(u, v, when):
                continue  # no accepted sequence has u before v any more, so the gadget is empty
            self._left[both], self._right[both], self._born[both] = u, v, when
            live.add(both)
            self._cut[u << 20 | v] = when
        self._next: dict[int, int] = {}
        self._accept = [-1]
        for i in live:
            node = 0
            for b in tokens[i]:
                arc = node << 8 | b
                if (step := self._next.get(arc)) is None:
                    step = self._next[arc] = len(self._accept)
                    self._accept.append(-1)
                node = step
            self._accept[node] = i
        self._words: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(PATTERN).findall

    def _lost(self, u: int, v: int, until: int) -> bool:
        """Whether the state behind arc u has no arc v, looking at merges before `until`.

        The state is a copy of the one behind u's right part as that was when u was born, and so on: its
        losses are those of each such part up to the birth of the token above it. It has no arc v either
        if it had already lost the left part of v when v was born from that.
        """
        cut, born, left, right = self._cut, self._born, self._left, self._right
        part, bound = u, until
        while part >= 0:
            label, before = v, bound
            while label >= 0:
                when = cut.get(part << 20 | label, NEVER)
                if when < bound and when <= before:
                    return True
                before = min(before, born[label])
                label = left[label]
            bound = min(bound, born[part])
            part = right[part]
        return False

    def arc(self, u: int, v: int) -> bool:
        """Whether the state behind arc u has an arc v: v may follow u."""
        key = u << 20 | v
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) >= KEPT_ARCS:
                self._arcs.clear()
            known = self._arcs[key] = not self._lost(u, v, NEVER)
        return known

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-split word."""
        n, step, accept, arc = len(word), self._next.get, self._accept, self.arc
        by, start = [-1] * (n + 1), [-1] * (n + 1)
        for place in range(n):
            before = by[place]
            if before < 0 and place:
                continue
            node = 0
            for end in range(place, n):
                node = step(node << 8 | word[end])
                if node is None:
                    break
                token = accept[node]
                if token >= 0 and by[end + 1] < 0 and (not place or arc(before, token)):
                    by[end + 1], start[end + 1] = token, place
        ids, place = [], n
        while place > 0:
            ids.append(by[place])
            place = start[place]
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> array:
        """The ids of a whole text, without special tokens. Null and empty texts have none."""
        ids, words = array("i"), self._words
        for word in self._split(text or ""):
            known = words.get(word)
            if known is None:
                if len(words) >= KEPT_WORDS:
                    words.clear()
                known = words[word] = self.encode_word(word.encode("utf-8"))
            ids.extend(known)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def load(path: str) -> MergeAutomaton:
    """The automaton of a tokenizer file, compiled once a process."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    byte_of, vocab = _byte_of(), model["vocab"]
    plain = {token: i for token, i in vocab.items() if all(c in byte_of for c in token)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return MergeAutomaton({i: bytes(byte_of[c] for c in token) for token, i in plain.items()}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])


def tokenizer_path(folder: str = TOKENIZERS, name: str = TOKENIZER) -> str:
    return f"{folder}/{name}.json"


def _int_lists(values: list[array]) -> pa.Array:
    offsets, flat = array("i", [0]), array("i")
    for ids in values:
        flat.extend(ids)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode_texts(texts: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids of each row of `texts`, whole texts, no special tokens.

    Null and empty texts have an empty list; strings of special tokens are ordinary text. Every row comes
    out, repeated ids included. Only the two columns are read.
    """
    path = path or tokenizer_path()

    def run(columns: dict) -> dict:
        automaton = load(path)
        return {"doc_id": pa.array(columns["i"], pa.int64()), "ids": _int_lists([automaton.encode(t) for t in columns["t"]])}

    return map_columns(spread(texts.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t"))), run, "doc_id long, ids array<int>")


def count_tokens(texts: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, tokens: the length of each text as encode_texts has it; 0 for null and empty texts."""
    path = path or tokenizer_path()

    def run(columns: dict) -> dict:
        automaton = load(path)
        return {"doc_id": pa.array(columns["i"], pa.int64()), "tokens": pa.array([len(automaton.encode(t)) for t in columns["t"]], pa.int32())}

    return map_columns(spread(texts.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t"))), run, "doc_id long, tokens int")


def decode_ids(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, text: the text that each list of ids stands for; null lists give null."""
    path = path or tokenizer_path()

    def run(columns: dict) -> dict:
        automaton = load(path)
        return {"doc_id": pa.array(columns["doc_id"], pa.int64()), "text": pa.array([None if ids is None else automaton.decode(ids) for ids in columns["ids"]], pa.string())}

    return map_columns(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
