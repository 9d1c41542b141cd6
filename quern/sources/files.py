"""CSV and XLSX files as rows of text cells, many files at once.

Each file is read whole by one task (sources are limited in size), so that rows have their numbers, and a file that can't be read gives
one error and no rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, _row long, cells array<string>, error string"
#: Rows that go out in one batch.
BATCH = 10_000
csv.field_size_limit(1 << 30)


class ReaderError(RuntimeError):
    """A source can't be read; the message says why."""


def _csv_rows(data: bytes) -> Iterator[list[str | None]]:
    """Records in order, invalid bytes as U+FFFD. Blank lines are left out unless there is but one column."""
    text = data.decode("utf-8", "replace").removeprefix("﻿")
    single = None
    for row in csv.reader(io.StringIO(text, newline=""), strict=True):
        if single is None:
            if not row:
                continue
            single = len(row) == 1
        if row:
            yield [c or None for c in row]
        elif single:
            yield [None]


def table_rows(path: str, data: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells), the headings being row 1; short rows are filled with nulls. Raises ReaderError."""
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        rows = iter(_csv_rows(data) if suffix == "csv" else _sheet_rows(data))
        heading = next(rows, None)
        if heading is None:
            raise ReaderError("the file holds no headings")
        names = [h if h is not None else f"column_{i + 1}" for i, h in enumerate(heading)]
        seen: dict[str, int] = {}
        for i, n in enumerate(names):
            seen[n] = seen.get(n, -1) + 1
            if seen[n]:
                names[i] = f"{n}_duplicated_{seen[n] - 1}"
        if "_row" in names:
            raise ReaderError("a column is named '_row', which is reserved")
        yield 1, names
        for i, cells in enumerate(rows, 2):
            if len(cells) > len(names):
                raise ReaderError(f"row {i} has {len(cells)} cells for {len(names)} headings")
            yield i, cells + [None] * (len(names) - len(cells))
    except (ValueError, csv.Error) as exc:
        raise ReaderError(str(exc)) from exc


def _sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    from quern.sources.xlsx import read_sheet

    yield from read_sheet(data)


def _arrow_cells(columns: list[pa.Array]) -> pa.ListArray:
    """One list of cells for each row, from columns of text."""
    n, k = len(columns[0]), len(columns)
    order = np.arange(n * k).reshape(k, n).T.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.concat_arrays(columns).take(pa.array(order)))


def _fast_csv(data: bytes) -> tuple[list[str], pa.Table] | None:
    """Headings and cells by pyarrow's reader; null where the file needs the careful one: ragged rows, one column, faulty headings."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        data = data.decode("utf-8", "replace").encode("utf-8")
    head = next(csv.reader(io.StringIO(data[: 1 << 20].decode("utf-8", "ignore").removeprefix("\ufeff"), newline="")), [])
    if len(head) < 2 or len(set(head)) < len(head) or "" in head or "_row" in head:
        return None
    names = [str(i) for i in range(len(head))]
    ragged: list[int] = []

    def invalid(row) -> str:
        ragged.append(row.actual_columns)
        return "skip"

    try:
        table = pacsv.read_csv(
            pa.py_buffer(data),
            read_options=pacsv.ReadOptions(column_names=names, skip_rows=0, use_threads=False, block_size=max(1 << 20, len(data) + 1)),
            parse_options=pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=invalid, ignore_empty_lines=True),
            convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True),
        )
    except pa.ArrowInvalid:
        return None
    return None if ragged or table.num_rows == 0 else (head, table)


def _file_batches(path: str, data: bytes) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(row numbers, cells) of a file in order; raises ReaderError before anything goes out."""
    fast = _fast_csv(data) if path.lower().endswith(".csv") else None
    if fast is not None:
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in fast[1].columns]
        n = fast[1].num_rows
        for i in range(0, n, BATCH):
            part = [c.slice(i, BATCH) for c in columns]
            yield pa.array(np.arange(i + 1, i + 1 + len(part[0]), dtype=np.int64)), _arrow_cells(part)
        return
    rows = list(table_rows(path, data))
    for i in range(0, len(rows), BATCH):
        numbers, cells = zip(*rows[i : i + BATCH], strict=True)
        yield pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))


def _read(batches: Iterator[pa.RecordBatch], heads_only: bool = False) -> Iterator[pa.RecordBatch]:
    names = ["path", "_row", "cells", "error"]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            path = path.as_py()
            try:
                for numbers, cells in _file_batches(path, content.as_py()):
                    if heads_only:
                        numbers, cells = numbers[:1], cells[:1]
                    n = len(numbers)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), n), numbers, cells, pa.nulls(n, pa.string())], names=names)
                    if heads_only:
                        break
            except ReaderError as exc:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.string())), pa.array([str(exc)])], names=names)


def read_tables(spark: SparkSession, paths: list[str], heads_only: bool = False) -> DataFrame:
    """path, _row (1 for the headings), cells, error; a file that can't be read is one row with an error and no number.

    With ``heads_only`` each file gives its headings, or its error, after it was read whole. Of the files' bytes a task holds one file's at a
    time and the next: files are put into partitions by size.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(lambda it: _read(it, heads_only), _SCHEMA).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One file with its own headings as columns of text, and _row from 2. Raises ReaderError if it can't be read."""
    rows = read_tables(spark, [path])
    first = rows.where("_row = 1 or error is not null").first()
    if first is None or first.error is not None:
        raise ReaderError(first.error if first else "the file is empty")
    return rows.where("_row > 1").select("_row", *[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(first.cells)])
