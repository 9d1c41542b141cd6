"""Secrets: named in the configuration, taken from the environment or the keyring, and kept out of every text."""

from __future__ import annotations

import logging
import os
import re

ENV_NAME = re.compile(r"^[A-Z][A-Z0-9_]*$")
SERVICE = "quern"
REDACTED = "[redacted]"
_known: set[str] = set()


class SecretError(RuntimeError):
    """A secret isn't there."""


def register_secret(value: str) -> None:
    if value:
        _known.add(value)


def clear_secrets() -> None:
    _known.clear()


def redact_text(text: str) -> str:
    """Without any registered secret; longer ones first, so that none leaves a part of another behind."""
    for s in sorted(_known, key=len, reverse=True):
        text = text.replace(s, REDACTED)
    return text


def _from_keyring(name: str) -> str | None:
    try:
        import keyring
    except ImportError:
        return None
    try:
        return keyring.get_password(SERVICE, name)
    except Exception:  # no keyring on this machine
        return None


def resolve_secret(name: str, purpose: str) -> str:
    value = os.environ.get(name, "").strip() or _from_keyring(name)
    if not value:
        raise SecretError(f"{purpose} needs the secret {name}: set it in the environment or the keyring")
    register_secret(value)
    return value


class RedactingFilter(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = redact_text(record.getMessage()), ()
        return True
