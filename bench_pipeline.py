"""Times a whole run (read, map, coerce, validate, reconcile, write, report, manifest) over generated CSV files and checks its totals.

python bench_pipeline.py ROWS [FILES]: four dialects of headings and dates, a faulty e-mail in 997 rows, a negative value in 1,499, a thousands
separator in 23, and 50 keys that consecutive files share. Generating isn't timed, nor is starting the session.
"""

from __future__ import annotations

import csv
import json
import sys
import tempfile
import time
from datetime import date, timedelta
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADINGS = [
    ["customer_id", "full_name", "email", "signup_date", "lifetime_value", "active"],
    ["Client ID", "Customer Name", "E-Mail", "Date Joined", "Total Spend", "Is Active"],
    ["Cust ID", "Name", "E-Mail", "Date Joined", "LTV", "Is Active"],
    ["CUSTOMER_NUMBER", "FullName", "Email Address", "Signup Date", "LTV", "Active"],
]
DATES = ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %b %Y", "%Y/%m/%d"]
SHARED = 50


def generate(folder: Path, rows: int, files: int) -> int:
    """Writes the files; returns their rows."""
    each, total = rows // files, 0
    for f in range(files):
        with (folder / f"source_{f}.csv").open("w", newline="", encoding="utf-8") as out:
            w = csv.writer(out)
            w.writerow(HEADINGS[f % 4])
            for i in range(f * each - (SHARED if f else 0), (f + 1) * each):
                value = "-12.50" if i % 1499 == 7 else f"1,{i % 900 + 100}.75" if i % 23 == 0 else f"{i % 9000}.25"
                day = date(2015, 1, 1) + timedelta(days=i % 3000)
                w.writerow([f"C-{i:09d}", f"Person {i}", f"p{i}" if i % 997 == 3 else f"p{i}@example.org", day.strftime(DATES[i % 5]), value, "Yes" if i % 2 else "no"])
                total += 1
    return total


def main() -> None:
    from quern.config import config_from
    from quern.pipeline import run_pipeline
    from quern.session import local_session

    rows, files = int(sys.argv[1]), int(sys.argv[2]) if len(sys.argv) > 2 else 4
    fields = [
        {"name": "customer_id", "type": "string", "required": True, "synonyms": ["customer number", "cust id", "client id"]},
        {"name": "full_name", "type": "string", "required": True, "synonyms": ["name", "customer name"]},
        {"name": "email", "type": "string", "synonyms": ["e-mail", "email address"], "rules": [{"rule": "regex", "pattern": "[^@\\s]+@[^@\\s]+\\.[^@\\s]+", "severity": "warning"}]},
        {"name": "signup_date", "type": "date", "synonyms": ["date joined"]},
        {"name": "lifetime_value", "type": "float", "synonyms": ["ltv", "total spend"], "rules": [{"rule": "range", "min": 0, "severity": "warning"}]},
        {"name": "active", "type": "boolean", "synonyms": ["is active"]},
    ]
    spark = local_session(name="quern-bench", memory="16g", spark__ui__showConsoleProgress="false")
    for attempt in range(3):
        with tempfile.TemporaryDirectory() as t:
            root = Path(t)
            total = generate(root, rows, files)
            (root / "quern.yaml").write_text("{}")
            config = config_from({"fields": fields, "sources": ["*.csv"], "validation": {"keys": ["customer_id"]}, "limits": {"max_file_size_mb": 2000}})
            start = time.perf_counter()
            r = run_pipeline(spark, config, root, root / "quern.yaml", samples=False)
            took = time.perf_counter() - start
            assert r.totals["rows_in"] == total and r.totals["rows_superseded"] == SHARED * (files - 1) and not r.totals["rows_held"], r.totals
            print(json.dumps({"attempt": attempt, "rows": total, "seconds": round(took, 2), "rows_per_second": round(total / took), **r.totals}), flush=True)


if __name__ == "__main__":
    main()
