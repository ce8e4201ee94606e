"""Lines of text in bz2 files, packed by Python's library in the tasks, as a sink.

Spark's own text writer packs bz2 in Java with blocks of 900 kB, which on wikitext takes longer than
all the rest of writing and reading a dump. These are usual bz2 files too, one per task.
"""

from __future__ import annotations

import bz2
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Blocks of 100 kB are sorted within the processor's caches.
LEVEL = 1
# Files lie here until all tasks have ended; readers pass over it.
UNFINISHED = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    """The name of a task's file; none without rows."""

    name: str | None


class Bz2Lines(DataSource):
    """A folder of bz2 files on a file system that driver and executors have mounted."""

    @classmethod
    def name(cls) -> str:
        return "bz2_lines"

    def writer(self, schema: StructType, overwrite: bool) -> Bz2Writer:
        return Bz2Writer(self.options["path"])


class Bz2Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Write the lines of a task; no two attempts share a file."""
        batches = (batch for batch in iterator if batch.num_rows)
        first = next(batches, None)
        if first is None:
            return Written(None)
        name = f"part-{uuid.uuid4().hex}.txt.bz2"
        with bz2.open(os.path.join(self.folder, UNFINISHED, name), "wb", compresslevel=LEVEL) as file:
            for batch in chain([first], batches):
                # As with Spark's writer a null is an empty line.
                file.write(b"".join([(line or b"") + b"\n" for line in batch.column(0).to_pylist()]))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        for message in messages:
            if message and message.name:
                os.replace(os.path.join(self.folder, UNFINISHED, message.name), os.path.join(self.folder, message.name))
        # Files of attempts that did not count stay hidden there.
        with suppress(OSError):
            os.rmdir(os.path.join(self.folder, UNFINISHED))

    def abort(self, messages: list[Written | None]) -> None:
        """What failed tasks have left stays hidden."""


def mounted_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that Spark's ``path`` names if it is one of a mounted file system."""
    found = re.fullmatch(r"(file:(?://(?=/))?)?(/(?!/).*)", path)
    if found and not found[1]:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
        return found[2] if default.startswith("file:") else None
    return found[2] if found else None


def write_lines(lines: DataFrame, value: Column, folder: str) -> None:
    """Write ``value`` as lines into a new ``folder``."""
    os.makedirs(folder)
    os.mkdir(os.path.join(folder, UNFINISHED))
    lines.sparkSession.dataSource.register(Bz2Lines)
    # As bytes, which need not be decoded to be packed.
    lines.select(value.cast("binary")).write.format(Bz2Lines.name()).mode("append").save(folder)
