"""Reports on the driver: JSON and readable text, from ordered findings."""

from __future__ import annotations

import json
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.dimensions import BUILTIN_RULES, SYMBOLS
from prosescan.operators.locate import numbered_findings, place
from prosescan.sources.documents import STDIN

VERSION = 1
TINTS = {"low": "\x1b[36m", "medium": "\x1b[33m", "high": "\x1b[31m"}


def ordered(located: DataFrame, docs: DataFrame) -> list:
    """Findings with their document's name, in the order of documents, then of spans, then of detectors."""
    return located.join(docs.select("doc_ord", "name"), "doc_ord").orderBy("doc_ord", "start", "end", "det", "seq").collect()


def shared_places(shared: DataFrame, docs: DataFrame) -> list[tuple[str, list]]:
    """What is shared, with its places in order: by first occurrence."""
    line, column = place(F.col("text"), F.col("start"))
    upto = F.substring(F.col("text").cast("binary"), F.lit(1), F.col("end").cast("int")).cast("string")
    end_line, end_column = place(F.col("text"), F.octet_length(F.substring(upto, F.lit(1), F.length(upto) - 1)))
    rows = shared.join(docs, "doc_ord").select("run_doc", "run_start", "matched", "doc_ord", "start", "name", line.alias("line"), column.alias("column"), end_line.alias("end_line"), end_column.alias("end_column")).orderBy("run_doc", "run_start", "doc_ord", "start").collect()
    return [(next(iter(places := list(group))).matched, places) for _, group in groupby(rows, key=lambda r: (r.run_doc, r.run_start))]


def json_rows(located: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_ord, place and json: each finding as a line of JSON, where it is found; to be written as text by any sink of Spark's."""
    named = numbered_findings(located.join(docs.select("doc_ord", F.col("name").alias("path")), "doc_ord"))
    entry = F.struct("rule_id", "rule_name", "severity", "kind", "path", "line", "column", "matched", "expected")
    return named.select("doc_ord", "place", F.to_json(entry).alias("json"))


def to_json(found: Iterable, shared: Iterable[tuple[str, list]], dictionary: str | None = None) -> str:
    findings = []
    for r in found:
        entry = {"rule_id": r.rule_id, "rule_name": r.rule_name, "severity": r.severity, "kind": r.kind, "path": r.name, "line": r.line, "column": r.column, "matched": r.matched}
        findings.append(entry if r.expected is None else entry | {"expected": r.expected})
    report = {"version": VERSION, "dictionary": dictionary, "findings": findings}
    rule_id, name, severity, kind = BUILTIN_RULES["shared"]
    runs = [{"rule_id": rule_id, "rule_name": name, "severity": severity, "kind": kind, "matched": matched, "occurrences": [{"path": p.name, "line": p.line, "column": p.column} for p in places]} for matched, places in shared]
    return json.dumps(report | ({"cross_file": runs} if runs else {}), indent=2, ensure_ascii=False)


def _origin(r) -> str:
    end = r.end_column if r.line == r.end_line else f"{r.end_line}:{r.end_column}"
    span = f"{r.line}:{r.column}-{end}"
    return span if r.name == STDIN else f"{r.name}:{span}"


def _quoted(text: str) -> str:
    return "\n     ".join(x.removesuffix("\r") for x in text.removesuffix("\n").split("\n"))


def to_text(found: Iterable, shared: Iterable[tuple[str, list]], colour: bool = False) -> str:
    """An entry for each span: its rules, its place, and each distinct text once."""
    out = []
    tint = lambda severity, x: f"{TINTS[severity]}{x}\x1b[0m" if colour else x
    for _, group in groupby(found, key=lambda r: (r.doc_ord, r.start, r.end)):
        rows = list(group)
        out += [f"{tint(r.severity, f'{SYMBOLS[r.severity]} {r.severity}')} {r.kind} {r.rule_id}" for r in rows]
        texts = list(dict.fromkeys(_quoted(r.matched) + (f" → {r.expected}" if r.expected is not None else "") for r in rows))
        out += [f"  ├─ {_origin(rows[0])}", *(f"  ├─ {t}" for t in texts[:-1]), f"  └─ {texts[-1]}"]
    rule_id, _, severity, kind = BUILTIN_RULES["shared"]
    for matched, places in shared:
        out += [f"{tint(severity, f'{SYMBOLS[severity]} {severity}')} {kind} {rule_id}", *(f"  ├─ {_origin(p)}" for p in places), f"  └─ {_quoted(matched)}"]
    return "".join(x + "\n" for x in out)
