"""What needs a parser or a differ: measures of functions, windows around changes. Python runs on Arrow batches."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.session import ship

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)


def _measures(node: ast.AST) -> tuple[int, int]:
    """Cyclomatic complexity and depth of nesting of a function, nested functions left out."""
    paths, deepest = 1, 0
    stack = [(child, 0) for child in ast.iter_child_nodes(node)]
    while stack:
        n, depth = stack.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            continue
        paths += isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0)
        inside = depth + isinstance(n, _NESTING)
        deepest = max(deepest, inside)
        stack += [(child, inside) for child in ast.iter_child_nodes(n)]
    return paths, deepest


def function_metrics(texts: DataFrame, row: str, text: str) -> DataFrame:
    """S-19: row, name, line, lines, complexity, nesting, arguments of every function of Python texts; texts that are no Python give none."""
    ship(texts.sparkSession)
    kind = dict(texts.dtypes)[row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = ast.parse(code or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        paths, deepest = _measures(n)
                        a = n.args
                        out.append((key, n.name, n.lineno, n.end_lineno - n.lineno + 1, paths, deepest, len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [batch.schema.field(0).type, pa.string(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[row, "name", "line", "lines", "complexity", "nesting", "arguments"])

    return texts.select(row, text).mapInArrow(run, f"{row} {kind}, name string, line int, lines int, complexity int, nesting int, arguments int")


def changed_windows(pairs: DataFrame, row: str, before: str, after: str, *, size: int = 4, most: int = 6) -> DataFrame:
    """T-8: row, label, line, window: windows of `size` lines around each changed region, of the old text (label 1) and the new one (label 0).

    At most `most` windows of a region come out (that is the feature); regions are those of difflib.
    """
    ship(pairs.sparkSession)
    kind = dict(pairs.dtypes)[row]

    def around(lines: list[str], a: int, b: int) -> list[tuple[int, str]]:
        last = max(0, len(lines) - size)
        starts = range(max(0, min(a - size + 1, last)), min(max(a, b - 1), last) + 1)
        return [(s + 1, "\n".join(lines[s : s + size])) for s in list(starts)[:most]] if lines else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                old, new = (x or "").split("\n"), (y or "").split("\n")
                for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
                    if tag != "equal":
                        out += [(key, 1, at, w) for at, w in around(old, a, b)] + [(key, 0, at, w) for at, w in around(new, c, d)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[row, "label", "line", "window"])

    return pairs.select(row, before, after).mapInArrow(run, f"{row} {kind}, label int, line int, window string")
