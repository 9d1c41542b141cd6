"""Command line: init, confirm, profile, run, review, resolve, publish, schedule, daemon, report, verify.

Exit codes: 0 done, 1 failed, 2 done with error-severity exceptions (run) or rows that weren't sent (publish).
"""

from __future__ import annotations

import argparse
import json
import os
import signal
import subprocess
import sys
from pathlib import Path

from quern import assist, manifest, scaffold, scheduler
from quern.config import ConfigError, load_config
from quern.credentials import SecretError
from quern.logs import configure_logging
from quern.operators import remediate
from quern.pipeline import PipelineError, append_resolution, load_exceptions, run_pipeline
from quern.publish import PublishError, publish_dataset
from quern.session import local_session
from quern.sources.discover import RUNS
from quern.targets.base import TargetError

REVIEW = "mapping-review.yaml"


def _run(a: argparse.Namespace) -> int:
    config, root = load_config(a.config), a.config.resolve().parent
    spark = local_session()
    result = run_pipeline(spark, config, root, a.config, assist.accepted_mappings(root / REVIEW, config), samples=a.assist)
    print(json.dumps(result.totals))
    if a.assist and result.unmapped_samples:
        try:
            assist.propose(result.unmapped_samples, config).save(root / REVIEW)
            print(f"proposals written to {root / REVIEW}")
        except assist.AssistError as exc:
            print(exc, file=sys.stderr)
    return 2 if result.totals["errors"] else 0


def _init(a: argparse.Namespace) -> int:
    if a.config.exists() and not a.force:
        raise ConfigError(f"{a.config} exists; use --force to overwrite it")
    profiles = scaffold.profile_folder(local_session(), a.folder)
    a.config.write_text(scaffold.propose_config(profiles, str(a.folder)), encoding="utf-8")
    print(f"{a.config}: review each PROPOSED mark")
    return 0


def _confirm(a: argparse.Namespace) -> int:
    text, n = scaffold.confirm_text(a.config.read_text(encoding="utf-8"))
    if n:
        a.config.write_text(text, encoding="utf-8")
    print(f"{n} mark(s) removed")
    return 0


def _profile(a: argparse.Namespace) -> int:
    profiles = scaffold.profile_folder(local_session(), a.folder, a.max_file_size_mb)
    a.output.write_text(json.dumps({"files": profiles}, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    print(a.output)
    return 0


def _review(a: argparse.Namespace) -> int:
    path = a.config.resolve().parent / REVIEW
    review = assist.Review.load(path)
    if a.accept_all or a.reject_all:
        review.decide("accepted" if a.accept_all else "rejected")
        review.save(path)
    for s in review.suggestions:
        print(f"{s.status}: {s.column} -> {s.target} ({s.confidence:g})")
    return 0


def _resolve(a: argparse.Namespace) -> int:
    config, root = load_config(a.config), a.config.resolve().parent
    spark = local_session()
    if not load_exceptions(spark, root, config).where(f"id = '{a.id}'").take(1) if a.id.isalnum() else True:
        raise PipelineError(f"no exception with the id {a.id} in the last run")
    values = dict(x.split("=", 1) for x in a.set)
    problems = remediate.check_correction(spark, config, values)
    if problems:
        raise PipelineError("; ".join(problems))
    append_resolution(root, a.id, "corrected", a.note, values)
    print("recorded; it is applied by the next run")
    return 0


def _publish(a: argparse.Namespace) -> int:
    r = publish_dataset(local_session(), load_config(a.config), a.config.resolve().parent, a.target, a.dry_run, a.force)
    print("\n".join(r.plan) if a.dry_run else f"{r.outcome}: {r.rows_sent} sent, {r.rows_failed} failed, to {r.destination}")
    return 2 if r.rows_failed else 0


def _schedule(a: argparse.Namespace) -> int:
    root = a.config.resolve().parent
    cron = scheduler.Cron.parse(a.expression) if a.expression else scheduler.read_schedule(root)
    if a.expression:
        scheduler.write_schedule(root, cron)
    print(cron.line(root))
    return 0


def _daemon(a: argparse.Namespace) -> int:
    """run: the loop itself; start, stop and status: of a loop in the background; unit: a systemd service for it."""
    root = a.config.resolve().parent
    pid = scheduler.running(root)
    if a.action == "status":
        print(f"running as process {pid}" if pid else "not running")
        return 0 if pid else 3
    if a.action == "unit":
        print(scheduler.unit(root, sys.executable), end="")
        return 0
    if a.action == "stop":
        if pid:
            os.kill(pid, signal.SIGTERM)
        print(f"process {pid} was told to stop" if pid else "not running")
        return 0 if pid else 3
    if a.action == "start":
        if pid:
            raise scheduler.SchedulerError(f"process {pid} runs this project already")
        scheduler.read_schedule(root)  # a loop without one would end at once
        command = [sys.executable, "-m", "quern", "daemon", "run", "--config", str(a.config.resolve()), *(["--webhook", a.webhook] if a.webhook else [])]
        with (root / "quern-daemon.log").open("a", encoding="utf-8") as log:
            child = subprocess.Popen(command, cwd=root, stdout=log, stderr=log, stdin=subprocess.DEVNULL, start_new_session=True)
        print(f"started as process {child.pid}")
        return 0
    held = scheduler.claim(root)
    try:
        scheduler.loop(root, lambda: _run(argparse.Namespace(config=a.config, assist=False)), webhook=a.webhook)
    finally:
        held.unlink(missing_ok=True)
    return 0


def _report(a: argparse.Namespace) -> int:
    from quern.report import Report, write_report

    runs = a.config.resolve().parent / RUNS
    found = runs / a.run if a.run else (manifest.latest_of_kind(runs, "run") or [runs])[0].parent
    if not (found / "report.json").is_file():
        raise PipelineError("no report of such a run")
    write_report(Report.from_json((found / "report.json").read_text(encoding="utf-8")), a.output)
    print(a.output)
    return 0


def _verify(a: argparse.Namespace) -> int:
    print("\n".join(manifest.verify_chain(a.config.resolve().parent / RUNS)))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description=__doc__.splitlines()[0])
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, f, **extra) -> argparse.ArgumentParser:
        c = sub.add_parser(name, **extra)
        c.add_argument("--config", type=Path, default=Path("quern.yaml"))
        c.set_defaults(do=f)
        return c

    add("run", _run).add_argument("--assist", action="store_true")
    c = add("init", _init)
    c.add_argument("folder", type=Path)
    c.add_argument("--force", action="store_true")
    add("confirm", _confirm)
    c = add("profile", _profile)
    c.add_argument("folder", type=Path)
    c.add_argument("--output", type=Path, default=Path("profile.json"))
    c.add_argument("--max-file-size-mb", type=int, default=100)
    c = add("review", _review)
    c.add_argument("--accept-all", action="store_true")
    c.add_argument("--reject-all", action="store_true")
    c = add("resolve", _resolve)
    c.add_argument("id")
    c.add_argument("--set", action="append", required=True, metavar="FIELD=VALUE")
    c.add_argument("--note", default="")
    c = add("publish", _publish)
    c.add_argument("target", nargs="?")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--force", action="store_true")
    add("schedule", _schedule).add_argument("expression", nargs="?")
    c = add("daemon", _daemon)
    c.add_argument("action", nargs="?", default="run", choices=["run", "start", "stop", "status", "unit"])
    c.add_argument("--webhook")
    c = add("report", _report)
    c.add_argument("--run")
    c.add_argument("--output", type=Path, default=Path("report.html"))
    add("verify", _verify)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    configure_logging(a.verbose)
    try:
        return a.do(a)
    except (ConfigError, PipelineError, PublishError, TargetError, SecretError, scheduler.SchedulerError, assist.AssistError, manifest.ManifestError) as exc:
        print(exc, file=sys.stderr)
        return 1
