"""Python sources as adapter rows: one task parses a batch of files with the standard syntax tree."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tierwalk.sources.graph import raw_schema


def parse(path: str, text: str) -> dict:
    """Classes, functions and methods as nodes; containment, bases, imports and calls as edges named as written."""
    out = {"path": path, "language": "python", "hash": hashlib.sha256(text.encode()).hexdigest(), "parsed_ok": True, "nodes": [], "edges": []}
    module = path.removesuffix(".py").replace("/", ".")

    def node(kind: str, name: str, qname: str, line: int) -> None:
        out["nodes"].append({"kind": kind, "name": name, "qualified_name": qname, "line_start": line, "is_test": name.startswith("test_") or "/tests/" in f"/{path}"})

    def edge(kind: str, source: str, raw: str, line: int, target: str | None = None) -> None:
        out["edges"].append({"kind": kind, "source_qname": source, "target_qname": target, "target_raw": raw, "line": line, "confidence_tier": "RESOLVED" if target else "HEURISTIC", "args": None})

    node("File", path.rsplit("/", 1)[-1], path, 1)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out | {"parsed_ok": False}
    work: list[tuple[ast.AST, str, bool]] = [(tree, path, False)]
    while work:
        at, owner, in_class = work.pop()
        for child in ast.iter_child_nodes(at):
            inside, of_class = owner, in_class
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(child, ast.ClassDef)
                inside = f"{owner}::{child.name}" if owner != path else f"{module}.{child.name}"
                node("Class" if is_class else "Method" if in_class else "Function", child.name, inside, child.lineno)
                edge("CONTAINS", owner, inside, child.lineno, inside)
                for base in child.bases if is_class else ():
                    edge("EXTENDS", inside, ast.unparse(base), child.lineno)
                of_class = is_class
            elif isinstance(child, ast.Import | ast.ImportFrom):
                for alias in child.names:
                    edge("IMPORTS", owner, ".".join(filter(None, (getattr(child, "module", None), alias.name))), child.lineno)
            elif isinstance(child, ast.Call):
                edge("CALLS", owner, ast.unparse(child.func), child.lineno)
            work.append((child, inside, of_class))
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Adapter rows of all .py files under a folder, with paths relative to it."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.py", recursiveFileLookup=True).selectExpr("_metadata.file_path as at", "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([parse(a.split(folder.rstrip("/") + "/", 1)[-1], t) for a, t in zip(frame["at"], frame["value"], strict=True)], columns=["path", "language", "hash", "parsed_ok", "nodes", "edges"])

    return found.mapInPandas(run, raw_schema())
