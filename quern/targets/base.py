"""What a publish target is, and what all of them share."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from itertools import islice

from pyspark.sql import DataFrame

from quern.credentials import redact_text


class TargetError(RuntimeError):
    """A publish failed; the message holds no secret."""

    def __init__(self, message: str):
        super().__init__(redact_text(message))


@dataclass(frozen=True)
class Failure:
    key: str
    code: str
    message: str


@dataclass
class Outcome:
    destination: str
    rows_sent: int = 0
    failures: list[Failure] = field(default_factory=list)


class Target(ABC):
    """describe, plan (a dry run) and publish. Rows come through toLocalIterator, one partition at a time."""

    def __init__(self, name: str, spec: dict, keys: list[str]):
        self.name, self.spec, self.keys = name, spec, keys

    @abstractmethod
    def describe(self) -> str: ...

    @abstractmethod
    def plan(self, frame: DataFrame) -> list[str]: ...

    @abstractmethod
    def publish(self, frame: DataFrame) -> Outcome: ...


def json_safe(value: object) -> object:
    return value.isoformat() if isinstance(value, date | datetime) else value


def iter_records(frame: DataFrame) -> Iterator[dict[str, object]]:
    for row in frame.toLocalIterator(prefetchPartitions=True):
        yield {k: json_safe(v) for k, v in row.asDict().items()}


def batched(records: Iterator, size: int) -> Iterator[list]:
    while part := list(islice(records, size)):
        yield part


def quote_ident(name: str) -> str:
    if "\x00" in name:
        raise TargetError("an identifier can't hold NUL")
    return '"' + name.replace('"', '""') + '"'


def key_of(record: dict[str, object], keys: list[str]) -> str:
    return "/".join(str(record.get(k, "")) for k in keys)
