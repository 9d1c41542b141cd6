"""Logging: one line of key=value, or of JSON where QUERN_LOG_FORMAT is json; secrets redacted in both."""

from __future__ import annotations

import json
import logging
import os

from quern.credentials import RedactingFilter, redact_text

FORMAT = "ts=%(asctime)s level=%(levelname)s logger=%(name)s msg=%(message)s"
DATES = "%Y-%m-%dT%H:%M:%S"


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        text = record.getMessage() + ("\n" + self.formatException(record.exc_info) if record.exc_info else "")
        return json.dumps({"ts": self.formatTime(record, DATES), "level": record.levelname, "logger": record.name, "msg": redact_text(text)}, ensure_ascii=False)


def configure_logging(verbose: bool = False) -> None:
    logging.basicConfig(level=logging.DEBUG if verbose else logging.WARNING, format=FORMAT, datefmt=DATES)
    for handler in logging.getLogger().handlers:
        if os.environ.get("QUERN_LOG_FORMAT", "").strip().lower() == "json":
            handler.setFormatter(JsonFormatter())
        if not any(isinstance(f, RedactingFilter) for f in handler.filters):
            handler.addFilter(RedactingFilter())
