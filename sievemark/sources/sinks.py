"""Report sinks: JSON lines, JSON Schema, HTML, text, audit log."""

from __future__ import annotations

import json
import textwrap
from datetime import UTC, datetime
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.functions.ladder import LABELS


def json_reports(findings: DataFrame, folder: str) -> None:
    """A JSON object per report with its findings, most severe first."""
    rows = findings.groupBy("doc_key").agg(F.max("severity").alias("overall"), F.sort_array(F.collect_list(F.struct((-F.col("severity")).alias("order"), "detector_id", "severity", *[c for c in findings.columns if c not in ("doc_key", "severity", "detector_id")]))).alias("f"))
    rows.select("doc_key", "overall", F.transform("f", lambda x: x.dropFields("order")).alias("findings")).write.json(folder)


def _schema_of(kind: T.DataType) -> dict:
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: _schema_of(f.dataType) | ({} if not f.nullable else {"nullable": True}) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _schema_of(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": _schema_of(kind.valueType)}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.IntegralType):
        return {"type": "integer"}
    if isinstance(kind, T.NumericType):
        return {"type": "number"}
    return {"type": "string", "format": "date-time"} if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else {"type": "string"}


def json_schema(df: DataFrame, title: str = "report") -> str:
    """The JSON Schema of a relation's rows."""
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title} | _schema_of(df.schema), indent=1)


def terminal_report(reports: DataFrame, findings: DataFrame, doc_key: str, width: int = 100) -> str:
    """One report as lines of text: its summary, then its findings from the most severe on."""
    head = reports.where(F.col("doc_key") == doc_key).first()
    rows = findings.where(F.col("doc_key") == doc_key).orderBy(F.desc("severity"), "detector_id", "summary").collect()
    lines = [doc_key, "=" * min(width, len(doc_key)), *textwrap.wrap(head.summary if head else "No findings.", width)]
    for r in rows:
        lines += textwrap.wrap(f"[{LABELS[r.severity]}] {r.detector_id}: {r.summary}", width, subsequent_indent="    ")
    return "\n".join([*lines, "Anomalies to look into; each may have an innocent explanation."])


def audit_log(spark: SparkSession, folder: str, run_id: str, events: list[tuple[str, dict]]) -> None:
    """K7: appends a run's events as JSON lines (run_id, at, event, details), in their order."""
    now = datetime.now(UTC).isoformat().replace("+00:00", "Z")
    rows = [(run_id, k, now, name, json.dumps(details, sort_keys=True)) for k, (name, details) in enumerate(events)]
    spark.createDataFrame(rows, "run_id string, position int, at string, event string, details string").coalesce(1).write.mode("append").json(folder)


def html_report(findings: DataFrame, doc_key: str) -> str:
    """The page of one report. It states anomalies to look into, not verdicts."""
    rows = findings.where(F.col("doc_key") == doc_key).orderBy(F.desc("severity"), "detector_id").collect()
    items = "".join(f"<li class='{LABELS[r.severity].lower()}'><b>{escape(r.detector_id)}</b> {LABELS[r.severity]}: {escape(str(r.asDict().get('summary') or ''))}</li>" for r in rows)
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{escape(doc_key)}</title><h1>{escape(doc_key)}</h1><p>Anomalies to look into; each may have an innocent explanation.</p><ul>{items}</ul>"
