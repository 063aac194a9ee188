"""One text file written by many tasks: parts in key order, each at its byte offset.

Rows are dealt once, by ranges of the key; each task numbers the bytes of its lines and
stores both. The parts' sizes (one row a part) give every part's offset in the
file. Then all tasks write their lines into one new file, each at its own place, and the driver
renames it when the bytes written add up. A task that runs twice writes the same bytes to the
same place. Needs a path that the driver and all executors see as a file system (as a
shared mount); elsewhere write a folder of parts (``csv_io.write_submission``).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import share_package
from .storage import store_rows


def local_path(path: str) -> str:
    """The file system path of a plain path or a ``file:`` URI; another scheme is an error."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"a single file needs a shared file system path, not {u.scheme}: write a folder of parts there")
    return unquote(u.path) if u.scheme else path


def placed_lines(lines: DataFrame, order: list[str], separator: str, rows_per_part: int) -> DataFrame:
    """(part, offset, line) of (order..., line) rows: parts are ranges of the key, offset counts the part's bytes before the line,
    each line with the separator before it."""
    n = max(1, -(-lines.count() // rows_per_part))
    gap = len(separator.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) + gap
            end = at + np.cumsum(size)
            if len(end):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(end), part), pa.int32()), pa.array(end - size), batch.column(0)], ["part", "offset", "line"])
                at = int(end[-1])

    dealt = lines.repartitionByRange(n, *order).sortWithinPartitions(*order, "line").select("line")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("line", T.StringType())])
    return dealt.mapInArrow(run, schema)


def write_single_file(rows: DataFrame, line: Column, order: list[str], path: str, header: str, separator: str = "\r\n",
                      rows_per_part: int = 200_000) -> int:
    """Write header and lines, joined by the separator (none at the end), in the order of the columns ``order``; returns the bytes.

    The file appears under its name when it is complete; a file of that name is replaced. A null line is an error; no rows give the header alone.
    """
    share_package(rows.sparkSession)
    path = local_path(path)
    line = F.when(line.isNull(), F.raise_error(F.lit("a line of the file is null")).cast("string")).otherwise(line)
    # stored before it is counted and ranged: all three see the same rows
    lines = store_rows(rows.select(*order, line.alias("line")), "lines")
    placed = store_rows(placed_lines(lines, order, separator, rows_per_part), "placed-lines")
    gap = len(separator.encode())
    sizes = placed.groupBy("part").agg(F.max(F.col("offset") + F.octet_length("line") + F.lit(gap)).alias("n")).collect()  # one row a part
    starts, total = {}, len(header.encode())
    for r in sorted(sizes, key=lambda r: r.part):
        starts[r.part] = total
        total += r.n
    new = f"{path}.{uuid.uuid4().hex}.tmp"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(new, "wb") as f:
        f.write(header.encode())
        f.truncate(total)
    tie = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, fd = 0, os.open(new, os.O_WRONLY)
        try:
            for batch in batches:
                begin, end, held = 0, 0, []
                for part, offset, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    place, own = starts[part] + offset, tie + text.encode()
                    if place != end and held:
                        written += write_at(fd, b"".join(held), begin)
                        held = []
                    if not held:
                        begin = end = place
                    held.append(own)
                    end += len(own)
                if held:
                    written += write_at(fd, b"".join(held), begin)
            os.fsync(fd)
        finally:
            os.close(fd)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    done = placed.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    if done + len(header.encode()) != total or os.path.getsize(new) != total:
        raise OSError(f"{path}: {done} bytes written of {total - len(header.encode())}; is the path shared by all executors?")
    os.replace(new, path)
    return total


def write_at(fd: int, data: bytes, place: int) -> int:
    done = 0
    while done < len(data):
        done += os.pwrite(fd, data[done:], place + done)
    return done
