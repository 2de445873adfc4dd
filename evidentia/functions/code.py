"""Python symbols of source files, those that a change touches, and unified diffs."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CHANGED = "path string, diff string, symbols array<struct<name:string,kind:string,side:string,first:int,last:int>>"


def _symbols(text: str) -> list[tuple[str, str, int, int]]:
    """name, kind, first and last line of classes and functions, nested ones dotted; none where the text does not parse."""
    try:
        todo = [("", ast.parse(text))]
    except (SyntaxError, ValueError):
        return []
    found = []
    while todo:
        prefix, parent = todo.pop(0)
        for node in getattr(parent, "body", []):
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "CLASS" if isinstance(node, ast.ClassDef) else "FUNCTION"
                found.append((prefix + node.name, kind, node.lineno, node.end_lineno))
                todo.append((f"{prefix}{node.name}.", node))
    return found


def _touched(path: str, old: str, new: str) -> list[tuple[str, str, str, int, int]]:
    before, after = old.splitlines(), new.splitlines()
    blocks = [b for b in difflib.SequenceMatcher(None, before, after).get_opcodes() if b[0] != "equal"]
    if not blocks or not path.lower().endswith(".py"):
        return []
    sides = {"BEFORE": (old, [(b[1] + 1, b[2]) for b in blocks]), "AFTER": (new, [(b[3] + 1, b[4]) for b in blocks])}
    hit = [(name, kind, side, first, last) for side, (text, spans) in sides.items() for name, kind, first, last in _symbols(text) if any(a <= b and first <= b and a <= last for a, b in spans)]
    return hit or [("<module>", "MODULE", "AFTER", 1, max(len(after), 1))]


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, old, new in zip(frame["path"], frame["before"], frame["after"]):
            old, new = old or "", new or ""
            diff = "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}"))
            rows.append((path, diff, _touched(path, old, new)))
        yield pd.DataFrame(rows, columns=["path", "diff", "symbols"])


def changed_files(files: DataFrame) -> DataFrame:
    """path, diff, symbols of files(path, before, after): the symbols whose lines a change touches, on either side.

    A change outside all symbols is the module's. Each file is one row of one task; nulls are empty files.
    """
    return files.select("path", "before", "after").mapInPandas(_compare, CHANGED)
