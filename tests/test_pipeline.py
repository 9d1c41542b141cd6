"""Whole runs on small projects, publishing, and the parts round them."""

import json
import sqlite3
import urllib.error
from datetime import datetime, timedelta

import pytest
import yaml

from quern import assist, manifest, publish, scaffold, scheduler
from quern.config import ConfigError, config_from, load_config
from quern.credentials import clear_secrets, redact_text
from quern.pipeline import append_resolution, load_exceptions, run_pipeline
from quern.sources.discover import discover_sources
from quern.sources.files import ReaderError, read_table
from quern.sources.xlsx import read_sheet, write_sheet
from quern.targets import http

FIELDS = [
    {"name": "customer_id", "type": "string", "required": True, "synonyms": ["customer number", "cust id", "client id"]},
    {"name": "full_name", "type": "string", "required": True, "synonyms": ["name", "customer name", "client"]},
    {"name": "email", "type": "string", "synonyms": ["e-mail", "email address"], "rules": [{"rule": "regex", "pattern": "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$", "severity": "warning"}]},
    {"name": "signup_date", "type": "date", "synonyms": ["date joined"]},
    {"name": "lifetime_value", "type": "float", "synonyms": ["ltv", "total spend"], "rules": [{"rule": "range", "min": 0, "severity": "warning"}]},
    {"name": "active", "type": "boolean", "synonyms": ["is active"]},
]
NORTH = "customer_id,full_name,email,signup_date,lifetime_value,active\nN-1,Ada Moss,ada@x.org,2023-04-12,1520.75,true\nN-2,Ben Fern,ben@x.org,2022-11-30,310.00,false\nN-3,Cy Reed,cy@x.org,2024-01-08,95.20,true\nN-4,Di Vale,di@x.org,2023-08-21,2200.00,true\n"
SOUTH = 'Client ID,Customer Name,E-Mail,Date Joined,Total Spend,Is Active,Notes\nS-1,Ed Low,ed@x.net,14/02/2023,"1,204.50",yes,by phone\nS-2,Fay O\'Hill,fay@x.net,03/11/2022,88.00,no,\nS-3,Gus Pike,gus@x.net,29/07/2023,n/a,yes,later\nS-4,Hal Ray,hal@x.net,08/01/2024,"2,450.00",no,\n'
EAST = "Cust ID,Name,E-Mail,Date Joined,LTV,Is Active\nN-1,Ada Moss,ada@x.org,12/04/2023,1600.00,true\nE-1,Ike Sol,not-a-mail,10/02/2024,450.00,true\nE-2,Jo Tarn,jo@x.org,15/03/2024,-20.00,false\nN-4,Di Vale,,21/08/2023,2200.00,yes\n"
WEST = [["CUSTOMER_NUMBER", "FullName", "Email Address", "Signup Date", "LTV", "Active"], ["W-1", "Kit Uhl", "kit@x.org", "05 Mar 2024", 640.1, "Y"], ["W-2", "Lou Vim", "lou@x.org", "17 Sep 2022", 1875.0, "N"], ["W-3", "May Web", "may@x.org", "sometime in June", 52.35, "Y"], ["W-4", "Ned Yew", "ned@x.org", "22 Dec 2023", 990.0, "N"]]


@pytest.fixture
def project(tmp_path):
    (tmp_path / "sources").mkdir()
    for n, t in (("north.csv", NORTH), ("south.csv", SOUTH), ("east.csv", EAST)):
        (tmp_path / "sources" / n).write_text(t)
    (tmp_path / "sources" / "west.xlsx").write_bytes(write_sheet(WEST))
    raw = {"fields": FIELDS, "sources": ["sources/*"], "validation": {"keys": ["customer_id"]}, "targets": {"db": {"type": "sqlite", "table": "customers"}, "api": {"type": "rest", "url": "https://x.test/in", "auth": "bearer", "token_env": "QUERN_TEST_TOKEN", "batch_size": 4, "max_retries": 1}}}
    (tmp_path / "quern.yaml").write_text(yaml.safe_dump(raw))
    return tmp_path


def run(spark, root):
    return run_pipeline(spark, load_config(root / "quern.yaml"), root, root / "quern.yaml")


def test_run_correct_publish(spark, project, monkeypatch):
    r = run(spark, project)
    assert r.totals == {"rows_in": 16, "rows_published": 11, "rows_held": 4, "rows_superseded": 1, "rows_remediated": 0, "errors": 3, "warnings": 4}
    assert set(r.unmapped_samples) == {"Notes"} and set(r.unmapped_samples["Notes"]) == {"by phone", "later"}
    config = load_config(project / "quern.yaml")
    rows = spark.read.parquet(str(r.outputs["consolidated.parquet"])).collect()
    merged = next(x for x in rows if x.customer_id == "N-4")
    assert merged.email == "di@x.org" and merged["_source_file"] == "sources/east.csv; sources/north.csv"
    report = json.loads((r.manifest.parent / "report.json").read_text())
    assert {s["file"]: s["score"] for s in report["sources"]} == {"sources/east.csv": 88, "sources/north.csv": 100, "sources/south.csv": 69, "sources/west.xlsx": 75}
    assert "<script" not in r.outputs["report.html"].read_text()

    with pytest.raises(publish.PublishError, match="refusing"):
        publish.publish_dataset(spark, config, project, "db")
    done = publish.publish_dataset(spark, config, project, "db", force=True)
    assert (done.outcome, done.rows_sent, done.forced) == ("published", 11, True)
    publish.publish_dataset(spark, config, project, "db", force=True)  # upserts: the same rows again
    with sqlite3.connect(project / "published.db") as db:
        assert db.execute("select count(*), sum(active) from customers").fetchone()[0] == 11

    sent = []

    class Reply:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b""

    def send(request, timeout):
        sent.append(json.loads(request.data))
        if len(sent) > 1:
            raise urllib.error.URLError("down: s3cret")
        return Reply()

    monkeypatch.setenv("QUERN_TEST_TOKEN", "s3cret")
    monkeypatch.setattr(http, "send", send)
    monkeypatch.setattr(http, "sleep", lambda s: None)
    out = publish.publish_dataset(spark, config, project, "api", force=True)
    assert (out.outcome, out.rows_sent, out.rows_failed, len(sent)) == ("partial", 4, 7, 3)
    assert "s3cret" not in out.exceptions.read_text() and redact_text("s3cret") == "[redacted]"
    clear_secrets()

    bad = load_exceptions(spark, project, config).where("kind = 'coercion' and file like '%south%'").first()
    assert bad.target_field == "lifetime_value"
    append_resolution(project, bad.id, "corrected", "checked", {"lifetime_value": "12.5"})
    again = run(spark, project)
    assert (again.totals["rows_published"], again.totals["rows_held"], again.totals["rows_remediated"], again.resolutions) == (12, 3, 1, [bad.id])

    ids = manifest.verify_chain(project / "runs")
    assert len(ids) == 5
    r.outputs["consolidated.parquet"].write_bytes(b"x")
    with pytest.raises(publish.PublishError, match="does not match"):
        publish.publish_dataset(spark, config, project, "db", force=True)
    (project / "runs" / ids[1] / "manifest.json").write_text("{}")
    with pytest.raises(manifest.ManifestError):
        manifest.verify_chain(project / "runs")


def test_bad_files(spark, project):
    s = project / "sources"
    (s / "empty.csv").write_text("")
    (s / "long.csv").write_text("customer_id,full_name\na,b\nc,d,e\n")
    (s / "only.csv").write_text("customer_id,full_name\n")
    (s / "lost.csv").write_text("full_name\nx\n")
    (s / "fake.xlsx").write_text("no workbook")
    (s / "x.txt").write_text("x")
    (s / ".hidden.csv").write_text("x")
    r = run(spark, project)
    e = load_exceptions(spark, project, load_config(project / "quern.yaml")).collect()
    kinds = {(x.file.split("/")[-1], x.kind) for x in e}
    assert {("empty.csv", "file_unreadable"), ("long.csv", "file_unreadable"), ("fake.xlsx", "file_unreadable"), ("x.txt", "file_skipped"), ("lost.csv", "missing_required_column"), ("lost.csv", "rule_required")} <= kinds
    assert r.totals["rows_in"] == 17 and r.totals["rows_in"] == r.totals["rows_published"] + r.totals["rows_held"] + r.totals["rows_superseded"]


def test_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,name,id\n1,"a\nb",x\n\n2,,\n3\n', encoding="utf-8")
    df = read_table(spark, str(p))
    assert df.columns == ["_row", "id", "name", "id_duplicated_0"]
    assert [tuple(r) for r in df.orderBy("_row").collect()] == [(2, "1", "a\nb", "x"), (3, "2", None, None), (4, "3", None, None)]
    p.write_text("id,_row\n1,2\n")
    with pytest.raises(ReaderError, match="reserved"):
        read_table(spark, str(p))
    p.write_text("one\na\n\nb\n")
    assert [r.one for r in read_table(spark, str(p)).orderBy("_row").collect()] == ["a", None, "b"]
    rows = list(read_sheet(write_sheet([["h", "k"], [1.0, 2.5], [True, "<&>"], [None, None]])))
    assert rows == [["h", "k"], ["1", "2.5"], ["true", "<&>"], [None, None]]


def test_discovery(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x")
    (tmp_path / "in" / "big.csv").write_bytes(b"x" * (1024 * 1024 + 1))
    (tmp_path / "in" / "out.csv").symlink_to("/etc/hostname")
    c = config_from({"fields": [{"name": "a", "type": "string"}], "sources": ["in/*.csv", "**/*.csv"], "limits": {"max_file_size_mb": 1}})
    files, skipped = discover_sources(c, tmp_path)
    assert [f.name for f in files] == ["a.csv"] and {s["kind"] for s in skipped} == {"file_skipped"} and len(skipped) >= 2


def test_scaffold(spark, project):
    profiles = scaffold.profile_folder(spark, project / "sources")
    text = scaffold.propose_config(profiles, "sources")
    (project / "p.yaml").write_text(text)
    with pytest.raises(ConfigError, match="PROPOSED"):
        load_config(project / "p.yaml")
    confirmed, n = scaffold.confirm_text(text)
    (project / "p.yaml").write_text(confirmed)
    assert n > 10 and "PROPOSED" not in confirmed
    assert any(f.type == "date" for f in load_config(project / "p.yaml").fields)


@pytest.mark.parametrize("text,after,want", [("*/15 * * * *", (2024, 1, 1, 0, 1), (2024, 1, 1, 0, 15)), ("0 9 * * 1-5", (2024, 1, 5, 10, 0), (2024, 1, 8, 9, 0)), ("0 0 29 2 *", (2023, 3, 1, 0, 0), (2024, 2, 29, 0, 0)), ("0 0 13 * 5", (2024, 1, 1, 0, 0), (2024, 1, 5, 0, 0)), ("@weekly", (2024, 1, 1, 0, 0), (2024, 1, 7, 0, 0)), ("5 4 * * 7", (2024, 1, 1, 0, 0), (2024, 1, 7, 4, 5))])
def test_cron(text, after, want):
    assert scheduler.Cron.parse(text).next_after(datetime(*after)) == datetime(*want)


@pytest.mark.parametrize("text", ["* * * *", "60 * * * *", "*/0 * * * *", "a * * * *", "5-1 * * * *"])
def test_cron_refused(text):
    with pytest.raises(scheduler.SchedulerError):
        scheduler.Cron.parse(text)


def test_cron_loop(tmp_path):
    scheduler.write_schedule(tmp_path, scheduler.Cron.parse("*/5 * * * *"))
    clock, runs = [datetime(2024, 1, 1)], []

    def sleep(s):
        from datetime import timedelta

        clock[0] += timedelta(seconds=s)

    assert scheduler.loop(tmp_path, lambda: runs.append(clock[0]) or 0, lambda: clock[0], sleep, times=2) == 2
    assert [r.minute for r in runs] == [5, 10]
    with pytest.raises(scheduler.SchedulerError, match="never"):
        scheduler.Cron.parse("0 0 31 2 *").next_after(datetime(2024, 1, 1))


def test_assist(tmp_path, monkeypatch):
    c = config_from({"fields": FIELDS, "assist": {"provider": "openai_compatible", "base_url": "https://x.test/v1", "model": "m"}})
    with pytest.raises(assist.AssistUnavailable):
        monkeypatch.delenv(assist.KEY_ENV, raising=False)
        assist.propose({"Buyer": ["Ann 12"]}, c)
    answer = 'Sure: [{"column": "Buyer", "target": "full_name", "confidence": 140}, {"column": "Buyer", "target": "email"}, {"column": "Zz", "target": null}, {"column": "Ref", "target": "nope"}, 5]'
    shown = []
    monkeypatch.setenv(assist.KEY_ENV, "k")
    monkeypatch.setattr(assist, "post_json", lambda url, h, body, t: shown.append(body) or {"choices": [{"message": {"content": answer}}]})
    review = assist.propose({"Buyer": ["Ann 12"], "Ref": []}, c)
    assert [(p.column, p.target, p.confidence, p.samples) for p in review.suggestions] == [("Buyer", "full_name", 100.0, ["Ann ##"])]
    assert "Ann 12" not in json.dumps(shown)
    path = tmp_path / "r.yaml"
    review.save(path)
    assert assist.accepted_mappings(path, c) == {} == assist.accepted_mappings(tmp_path / "none.yaml", c)
    again = assist.Review.load(path)
    assert again.suggestions == review.suggestions and again.about["model"] == "m"
    again.decide("accepted")
    again.decide("rejected")  # decides only what is pending
    again.save(path)
    assert assist.accepted_mappings(path, c) == {"buyer": "full_name"}
    path.write_text("proposals: [{column: Buyer, target: full_name, status: perhaps}]")
    with pytest.raises(assist.AssistError):
        assist.Review.load(path)
    answer = "I can't tell."
    with pytest.raises(assist.AssistError):
        assist.propose({"Buyer": []}, c)
    answer = 'one {"broken {"column": "Buyer", "target": null}'
    assert [s.target for s in assist.propose({"Buyer": []}, c).suggestions] == [None]


def test_daemon(tmp_path, capsys, monkeypatch):
    from quern import cli

    config = ["--config", str(tmp_path / "quern.yaml")]
    assert cli.main(["daemon", "status", *config]) == 3 == cli.main(["daemon", "stop", *config])
    assert cli.main(["daemon", "start", *config]) == 1  # no schedule
    assert cli.main(["daemon", "unit", *config]) == 0 and "ExecStart=" in capsys.readouterr().out
    held = scheduler.claim(tmp_path)
    assert cli.main(["daemon", "status", *config]) == 0
    held.write_text("999999999")
    assert scheduler.running(tmp_path) is None
    told, clock = [], [datetime(2024, 1, 1)]
    scheduler.write_schedule(tmp_path, scheduler.Cron.parse("0 * * * *"))
    monkeypatch.setattr(scheduler, "notify", lambda url, payload: told.append((url, payload["exit_code"])))

    def sleep(s):
        clock[0] += timedelta(seconds=s)

    scheduler.loop(tmp_path, lambda: 2, lambda: clock[0], sleep, times=1, webhook="http://hook")
    assert told == [("http://hook", 2)]
    monkeypatch.undo()
    assert not scheduler.notify("http://127.0.0.1:9/", {})


def test_targets_refused():
    for spec in ({"type": "sqlite", "table": "t", "password": "x"}, {"type": "rest", "url": "ftp://x"}, {"type": "rest", "url": "https://x", "token_env": "my secret"}, {"type": "salesforce", "object": "A", "external_id_field": "E", "field_map": {"a": "B"}}):
        with pytest.raises(ConfigError):
            publish.check_target("t", spec)


def test_salesforce(spark, monkeypatch):
    from quern.targets.services import Salesforce

    replies = [{"access_token": "tok", "instance_url": "https://i.test"}, [{"success": True}, {"success": False, "errors": [{"statusCode": "BAD", "message": "no"}]}]]
    monkeypatch.setattr(http, "request_json", lambda *a, **k: replies.pop(0))
    for k in ("CLIENT_ID", "CLIENT_SECRET"):
        monkeypatch.setenv(f"QUERN_SF_{k}", "v")
    t = Salesforce("s", {"object": "A", "external_id_field": "E", "field_map": {"id": "E"}}, ["id"])
    out = t.publish(spark.createDataFrame([("1",), ("2",), (" ",)], "id string").coalesce(1))
    assert out.rows_sent == 1 and {f.code for f in out.failures} == {"BAD", "MISSING_EXTERNAL_ID"}
    clear_secrets()


def test_stream(spark, tmp_path):
    from quern.streaming.batches import start

    c = config_from({"fields": [{"name": "id", "type": "string", "required": True}, {"name": "n", "type": "integer"}]})
    src = tmp_path / "in"
    spark.createDataFrame([("f", 2, "a", "1"), ("f", 3, "", "2"), ("f", 4, "b", "x")], "_source_file string, _row long, id string, n string").write.parquet(str(src))
    stream = spark.readStream.schema("_source_file string, _row long, id string, n string").parquet(str(src))
    q = start(stream, c, {"id": "id", "n": "n"}, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["a"]
    assert {r.kind for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"rule_required", "coercion"}
