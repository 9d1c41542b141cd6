"""Publishing the governed dataset: only what the last run recorded, and not after errors unless forced; every attempt is recorded."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quern import manifest
from quern.config import Config, ConfigError
from quern.credentials import ENV_NAME, SecretError, redact_text
from quern.sources.discover import RUNS
from quern.targets.base import Outcome, Target, TargetError
from quern.targets.databases import Postgres, Sqlite
from quern.targets.services import Rest, Salesforce

_KEYS = {
    "sqlite": {"path", "table"}, "postgres": {"table", "dsn_env"}, "rest": {"url", "auth", "token_env", "api_key_header", "batch_size", "timeout_seconds", "max_retries"},
    "salesforce": {"object", "external_id_field", "field_map", "login_url", "auth_flow", "api_version", "batch_size", "timeout_seconds", "max_retries", "client_id_env", "client_secret_env", "username_env", "password_env"},
}
_REQUIRED = {"sqlite": {"table"}, "postgres": {"table"}, "rest": {"url"}, "salesforce": {"object", "external_id_field", "field_map"}}


class PublishError(RuntimeError):
    def __init__(self, message: str):
        super().__init__(redact_text(message))


@dataclass
class PublishReport:
    target: str
    type: str
    destination: str
    source_run: str
    rows: int
    forced: bool = False
    outcome: str = "planned"
    rows_sent: int = 0
    rows_failed: int = 0
    plan: list[str] = field(default_factory=list)
    manifest: Path | None = None
    exceptions: Path | None = None


def check_target(name: str, spec: dict) -> None:
    """A target's section; unknown keys are refused, so that a pasted secret fails at once."""
    kind = spec.get("type")
    if kind not in _KEYS:
        raise ConfigError(f"target '{name}': unknown type {kind!r}")
    unknown = set(spec) - _KEYS[kind] - {"type", "key_columns"}
    missing = _REQUIRED[kind] - set(spec)
    if unknown or missing:
        raise ConfigError(f"target '{name}': unknown {sorted(unknown)}, missing {sorted(missing)}")
    for k, v in spec.items():
        if k.endswith("_env") and not ENV_NAME.match(str(v)):
            raise ConfigError(f"target '{name}': {k} must name an environment variable, never hold the secret")
    if kind == "rest" and not str(spec["url"]).startswith(("http://", "https://")):
        raise ConfigError(f"target '{name}': url must be http or https")
    if kind == "salesforce" and (spec["external_id_field"] not in spec["field_map"].values() or not str(spec.get("login_url", "https://")).startswith("https://")):
        raise ConfigError(f"target '{name}': field_map must map a field onto the external id, and login_url must be https")


def build_target(name: str, spec: dict, config: Config, root: Path) -> Target:
    check_target(name, spec)
    keys = list(spec.get("key_columns") or config.validation.keys)
    if spec["type"] == "sqlite":
        return Sqlite(name, spec, keys, root)
    return {"postgres": Postgres, "rest": Rest, "salesforce": Salesforce}[spec["type"]](name, spec, keys)


def select_target(config: Config, name: str | None) -> tuple[str, dict]:
    if not config.targets:
        raise PublishError("no publish targets configured")
    if name is None and len(config.targets) == 1:
        return next(iter(config.targets.items()))
    if name not in config.targets:
        raise PublishError((f"no target named '{name}'" if name else "several targets are configured") + "; name one of: " + ", ".join(sorted(config.targets)))
    return name, config.targets[name]


def governed_dataset(spark: SparkSession, config: Config, root: Path) -> tuple[DataFrame, dict]:
    """The last run's dataset and manifest, if the file is still what the run wrote."""
    found = manifest.latest_of_kind(root / RUNS, "run")
    path = root / config.output.directory / f"{config.output.dataset_name}.parquet"
    if found is None or not path.is_file():
        raise PublishError("no completed run to publish")
    if found[1].get("outputs", {}).get(path.name, {}).get("sha256") != manifest.sha256_file(path):
        raise PublishError(f"{path.name} does not match the latest run manifest (run {found[1].get('run_id')}): it is stale or was altered; run again first")
    return spark.read.parquet(str(path)), found[1]


def publish_dataset(spark: SparkSession, config: Config, root: Path, target_name: str | None = None, dry_run: bool = False, force: bool = False) -> PublishReport:
    root = root.resolve()
    name, spec = select_target(config, target_name)
    frame, run = governed_dataset(spark, config, root)
    errors = int(run.get("totals", {}).get("errors", 0))
    if errors and not force and not dry_run:
        raise PublishError(f"refusing to publish: the latest run ({run.get('run_id')}) recorded {errors} error-severity exception(s); fix the sources and run again, or force it")
    target = build_target(name, spec, config, root)
    report = PublishReport(name, spec["type"], target.describe(), str(run.get("run_id")), frame.count(), bool(force and errors))
    if dry_run:
        report.plan = ([f"NOTE: a real publish would refuse: the source run recorded {errors} error-severity exception(s)"] if errors and not force else []) + [redact_text(x) for x in target.plan(frame)]
        return report
    started = datetime.now(UTC)
    try:
        outcome: Outcome = target.publish(frame)
    except (TargetError, SecretError) as exc:
        report.outcome = "failed"
        report.manifest = _record(root, report, started)
        raise PublishError(f"publish to target '{name}' failed: {exc}") from exc
    report.rows_sent, report.rows_failed = outcome.rows_sent, len(outcome.failures)
    report.outcome = "published" if not outcome.failures else "partial" if outcome.rows_sent else "failed"
    if outcome.failures:
        report.exceptions = root / config.output.directory / "publish-exceptions.csv"
        with report.exceptions.open("w", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            w.writerow(["file", "row", "column", "value", "kind", "severity", "reason"])
            w.writerows([f"target:{name}", "", ", ".join(target.keys), x.key, "publish_failed", "error", redact_text(f"{x.code}: {x.message}")] for x in outcome.failures)
    report.manifest = _record(root, report, started)
    return report


def _record(root: Path, report: PublishReport, started: datetime) -> Path:
    body = {k: getattr(report, k) for k in ("target", "type", "destination", "source_run", "rows", "forced", "outcome", "rows_sent", "rows_failed")}
    body["destination"] = redact_text(body["destination"])
    return manifest.write_chained(manifest.create_run_folder(root / RUNS, started), "publish", started, datetime.now(UTC), {"publish": body})
