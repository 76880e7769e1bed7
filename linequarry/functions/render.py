"""Results as text lines and JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_text(hits: DataFrame, key: str = "path") -> DataFrame:
    """rendered: path:line:column:preview."""
    return hits.select(F.concat_ws(":", F.col(key).cast("string"), "line", "column", "preview").alias("rendered"))


def window_text(rows: DataFrame, key: str = "path") -> DataFrame:
    """rendered: path:line:text."""
    return rows.select(F.concat_ws(":", F.col(key).cast("string"), "line", "text").alias("rendered"))


def context_text(rows: DataFrame, key: str = "path") -> DataFrame:
    """rendered: path:line:role:text."""
    return rows.select(F.concat_ws(":", F.col(key).cast("string"), "line", "role", "text").alias("rendered"))


def as_json(rows: DataFrame) -> DataFrame:
    """json: each row as an object."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def report_parts(head: dict, name: str, rows: DataFrame | None, tail: dict, indent: bool = False) -> Iterator[str]:
    """A report's JSON in pieces: head's members, the rows as the list `name`, tail's members. Rows come partition by partition; the driver never holds them all."""
    member = lambda k, v: f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False, indent=2 if indent else None)}"
    gap = "\n  " if indent else ""
    yield "{" + gap + "".join(f"{member(k, v)}, {gap}" for k, v in head.items()) + f"{json.dumps(name)}: ["
    for i, r in enumerate(as_json(rows).toLocalIterator() if rows is not None else ()):
        yield ("," if i else "") + gap + r.json
    yield "]" + "".join(f", {gap}{member(k, v)}" for k, v in tail.items()) + ("\n}" if indent else "}")


def summary(expression: str, stats: dict) -> list[str]:
    """The footer of a text report."""
    names = ("files_discovered", "files_scanned", "files_skipped", "matches_found", "bytes_scanned")
    out = [f"expression: {expression}", *(f"{k.replace('_', ' ')}: {stats[k]}" for k in names)]
    out.append("timings ms: " + " ".join(f"{k.removesuffix('_ms')}={v:.3f}" for k, v in stats["timings"].items()))
    return out + [f"largest file: {f['path']} ({f['bytes']} bytes)" for f in stats["largest_files"][:1]]
