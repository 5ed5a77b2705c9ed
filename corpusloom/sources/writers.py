"""Sinks: JSON lines, split folders, one file per key, reports. Spark's commit protocol makes a write whole or absent."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, drop: list[str] = (), overwrite: bool = False, files: int | None = None) -> None:
    """JSON lines without the internal columns; an existing folder is an error unless it may be overwritten."""
    out = df.drop(*drop)
    (out.coalesce(files) if files else out).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", overwrite: bool = False) -> None:
    """One folder per split; readers of one split read that folder only. Rows are gathered by split without one task per split."""
    df.write.partitionBy(split).mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_texts(df: DataFrame, root: str, parts: list[str], text: str, suffix: str, encoding: str = "utf-8") -> None:
    """One file per row under ``root/part/.../part.suffix``, written where the rows are. ``root`` must be a folder that all executors share."""
    from .readers import safe_name

    root = root.removeprefix("file://").replace("file:", "", 1) if root.startswith("file:") else root

    def run(rows) -> None:
        for row in rows:
            *folders, name = (safe_name(str(row[p])) for p in parts)
            folder = os.path.join(root, *folders)
            os.makedirs(folder, exist_ok=True)
            with tempfile.NamedTemporaryFile("w", encoding=encoding, newline="", dir=folder, delete=False) as f:
                f.write(row[text] or "")
            os.replace(f.name, os.path.join(folder, f"{name}.{suffix}"))

    df.select(*parts, text).foreachPartition(run)


def write_report(value: object, path: str) -> None:
    """A small JSON report, by a temporary file and a rename."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, delete=False) as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.write("\n")
    os.replace(f.name, path)


def markdown_table(df: DataFrame, title: str = "", most: int = 1000) -> str:
    """A report's rows as a Markdown table; more rows than ``most`` are an error, as a report is small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")

    def cell(value: object) -> str:
        return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")

    lines = [f"# {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"


def percentage(count: int, total: int) -> str:
    """A share for reading; comparisons use the counts."""
    return f"{100 * count / total:.2f}%" if total else "0.00%"
