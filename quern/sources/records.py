"""Comma-separated records, one a row, parsed beside the reasons why some can't be.

The parser is pyarrow's CSV reader, run on each Arrow batch: its callback for invalid rows sets records with a wrong number of
cells aside. Broken quoting is looked for before, as a reader would run on into the next record.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import is_blank

#: A record whose quoting is whole: each cell is quoted, with doubled quotes inside, or holds no quote.
WHOLE = r'\A(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*\z'
#: The same without a line break outside quotes, which a CSV reader would take for the end of the record.
ONE_LINE = r'\A(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*\z'
#: Bytes of records that are parsed at once.
CHUNK_BYTES = 32 << 20
_CELL = re.compile(r'(?:^|,)(?:"((?:[^"]|"")*)"|([^",]*))', re.S)


def split_record(line: str) -> list[str]:
    """The cells of one record whose quoting is whole."""
    return [a.replace('""', '"') if a or m.startswith(('"', ',"')) else b for m, a, b in ((x[0], x[1] or "", x[2] or "") for x in _CELL.finditer(line))]


def _parse_chunk(lines: list[tuple[int, str]], width: int, cells: list, bad: set[int]) -> None:
    """Fills ``cells`` at each record's number, or adds the number to ``bad`` where it hasn't ``width`` cells."""

    def rejected(row) -> str:
        bad.add(int(row.text.partition(",")[0]))
        return "skip"

    names = [str(i) for i in range(width + 1)]
    data = "\n".join(f"{i},{line}" for i, line in lines).encode("utf-8", "surrogatepass")
    table = pacsv.read_csv(
        io.BytesIO(data),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 16, len(data) + 1)),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=rejected, ignore_empty_lines=False),
        convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False, check_utf8=False),
    )
    columns = [c.to_pylist() for c in table.columns]
    for row in zip(*columns, strict=True):
        cells[int(row[0])] = list(row[1:])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, width = batch.column("_line"), batch.column("_width").to_pylist()
        whole = pc.match_substring_regex(raw, WHOLE).to_pylist()
        single = pc.match_substring_regex(raw, ONE_LINE).to_pylist()
        lines = raw.to_pylist()
        cells: list = [None] * len(lines)
        reason: list = [None] * len(lines)
        bad: set[int] = set()
        todo: dict[int, list[tuple[int, str]]] = {}
        held: dict[int, int] = {}
        for i, line in enumerate(lines):
            if line is None or not line.strip():
                reason[i] = "blank"
            elif not whole[i]:
                reason[i] = "quoting"
            elif width[i] is None or width[i] == 0 or not single[i]:
                got = split_record(line)
                if width[i] is None or len(got) == width[i]:
                    cells[i] = got
                else:
                    bad.add(i)
            else:
                w = width[i]
                todo.setdefault(w, []).append((i, line))
                held[w] = held.get(w, 0) + len(line)
                if held[w] > CHUNK_BYTES:
                    _parse_chunk(todo.pop(w), w, cells, bad)
                    held[w] = 0
        for w, rows in todo.items():
            _parse_chunk(rows, w, cells, bad)
        for i in bad:
            reason[i] = "field_count"
        keys = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("_line", "_width")]
        names = [n for n in batch.schema.names if n not in ("_line", "_width")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(cells, pa.list_(pa.string())), pa.array(reason, pa.string())], names=[*names, "cells", "reason"])


def parse_records(df: DataFrame, line: str, width: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default every other column) with cells (array of strings) and reason.

    reason: blank (null, empty or white space only), quoting (a quote opens and never closes, something other than a comma follows
    a closing quote, or an unquoted cell holds a quote), field_count (the number of cells isn't ``width``), or null, and only then
    cells is not null. Without a width (null) any number of cells will do. A quoted cell may hold commas, doubled quotes and line
    breaks; cells are as typed, not stripped. Rows keep their number; an empty table gives an empty one.
    """
    keep = [c for c in df.columns if c != line] if keep is None else keep
    src = df.select(*keep, F.col(line).cast("string").alias("_line"), (F.lit(None) if width is None else width).cast("int").alias("_width"))
    schema = T.StructType([*(f for f in src.schema.fields if f.name in keep), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())])
    return src.mapInArrow(_parse, schema)


def parse_files(df: DataFrame, file: str = "file_name", number: str = "line_no", line: str = "raw_line") -> DataFrame:
    """Each record below a file's headings, with its file's headings: file, number, headings, cells, reason.

    A file's headings are its record number 1; of several such records the smallest counts, and a file without one has null
    headings, any number of cells then being right. Blank lines are left out. The headings (one record a file) meet the records in
    a join on the file, which adaptive execution splits where one file holds very many of them.
    """
    first = df.where(F.col(number) == 1).groupBy(F.col(file).alias("_file")).agg(F.min(line).alias("_heading"))
    heads = parse_records(first, "_heading").select("_file", F.col("cells").alias("headings"))
    rows = df.where((F.col(number) != 1) & ~is_blank(F.col(line))).select(file, number, line)
    joined = rows.join(heads, F.col(file) == F.col("_file"), "left").drop("_file")
    return parse_records(joined, line, F.size("headings"), [file, number, "headings"])
