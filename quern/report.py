"""The report of a run: figures as JSON, and a page that stands by itself."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quern import __version__
from quern.config import Config
from quern.operators import metrics
from quern.operators.mapping import Match


@dataclass
class Report:
    run_id: str
    generated_at: str
    version: str
    config_file: str
    config_sha256: str
    duration_seconds: float
    files_read: int
    totals: dict[str, int]
    conflicts_held: int
    fields: list[dict] = field(default_factory=list)
    sources: list[dict] = field(default_factory=list)
    mappings: list[dict] = field(default_factory=list)
    exception_kinds: list[dict] = field(default_factory=list)
    conflicts: list[dict] = field(default_factory=list)

    @classmethod
    def build(cls, spark: SparkSession, config: Config, published: DataFrame, exceptions: DataFrame, matches: list[tuple[str, Match]], file_rows: dict[str, int], totals: dict[str, int], conflicts_held: int, run_id: str, started: datetime, config_path: Path, config_sha: str) -> Report:
        """All that is collected here is a row for each field, file, kind or held conflict. Percentages are rounded as Python rounds."""
        names = [f.name for f in config.fields]
        filled = {r.field: r for r in metrics.completeness(published, names).collect()}
        listed = [(f, m.source, m.target, m.method, m.score, m.reason) for f, m in matches]
        mapping = spark.createDataFrame(listed, "file string, source string, target string, method string, score double, reason string")
        broken = {r.field: r.rows for r in metrics.violating_rows(exceptions, mapping).collect()}
        rows_in = totals["rows_in"]
        pct = lambda part, whole: round(100 * part / whole, 1) if whole else None
        fields = [{"name": f.name, "type": f.type, "required": f.required, "completeness_pct": pct(filled[f.name].filled, filled[f.name].rows), "validity_pct": round(100 * (1 - broken.get(f.name, 0) / rows_in), 1) if rows_in else None} for f in config.fields]
        scores = metrics.source_scores(spark.createDataFrame(list(file_rows.items()), "file string, rows long"), exceptions) if file_rows else None
        sources = [{"file": r.file, "rows": r.rows, "errors": r.error_rows, "warnings": r.warnings, "score": r.score} for r in scores.orderBy("file").collect()] if scores is not None else []
        kinds = [r.asDict() for r in metrics.by_kind(exceptions).collect()]
        held = [{"files": r.file, "column": r["column"], "values": r.value, "reason": r.reason} for r in exceptions.where("kind = 'conflict' and severity = 'error'").orderBy("file", "column", "reason").collect()]
        decisions = [dict(zip(("file", "source_column", "target", "method", "score", "reason"), x, strict=True)) for x in listed]
        now = datetime.now(UTC)
        return cls(run_id, started.isoformat(timespec="seconds"), __version__, config_path.name, config_sha, (now - started).total_seconds(), len(file_rows), totals, conflicts_held, fields, sources, decisions, kinds, held)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2) + "\n"

    @classmethod
    def from_json(cls, text: str) -> Report:
        return cls(**json.loads(text))


def _table(title: str, rows: list[dict]) -> str:
    if not rows:
        return f"<h2>{escape(title)}</h2><p>None.</p>"
    head = "".join(f"<th>{escape(str(k).replace('_', ' '))}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def render(report: Report) -> str:
    """HTML without anything from elsewhere; every value is escaped."""
    style = "body{font:14px system-ui,sans-serif;max-width:70em;margin:2em auto;padding:0 1em}table{border-collapse:collapse;width:100%}td,th{border:1px solid #bbb;padding:.3em .5em;text-align:left;vertical-align:top}"
    parts = [_table("Totals", [report.totals]), _table("Fields", report.fields), _table("Sources", report.sources), _table("Exceptions by kind", report.exception_kinds), _table("Held conflicts", report.conflicts), _table("Mapping decisions", report.mappings)]
    return f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>Run {escape(report.run_id)}</title><style>{style}</style></head><body><h1>Run {escape(report.run_id)}</h1><p>{escape(report.generated_at)}, {escape(report.config_file)}</p>{''.join(parts)}</body></html>\n"


def write_report(report: Report, html: Path, data: Path | None = None) -> None:
    html.write_text(render(report), encoding="utf-8")
    if data:
        data.write_text(report.to_json(), encoding="utf-8")
