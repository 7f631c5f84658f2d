"""Helpers shared by the operators: tables, stored intermediates, bounded samples, Arrow batches."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brinewave.session import shared_folder
from brinewave.session import stored_table as stored  # noqa: F401  (used by the operators)

#: words of the count contracts: runs of anything but blank, tab, newline, VT, FF and CR
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: bytes of text a task works on at a time; one longer text is worked on alone
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_stored(df: DataFrame) -> None:
    """Remove a table made by ``stored`` that nothing will read again."""
    files = df.inputFiles()
    if files:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: dict[str, str] = {}


def arrow_map(df: DataFrame, work: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package sent along, so that workers can import it."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        base = f"{tempfile.mkdtemp(prefix='brinewave-code-')}/{package.name}"
        _SHIPPED[context.applicationId] = shutil.make_archive(base, "zip", package.parent, package.name)
        context.addPyFile(_SHIPPED[context.applicationId])
    return df.mapInArrow(work, schema)


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def bounded_sample(df: DataFrame, keys: list[str], limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows with the smallest seeded hash of ``keys``.

    For model fitting only. A hash threshold from the row count thins the rows before
    they are ordered, so no more than about twice the limit ever meets.
    """
    total = df.count()
    mark = F.xxhash64(F.lit(seed), *keys)
    if total > 2 * limit:
        top = int(2.0 * limit / total * (1 << 62)) - (1 << 61)
        df = df.where(F.shiftright(mark, 2) < top)
    return df.orderBy(mark, *keys).limit(limit)


def text_slices(batch: pa.RecordBatch, column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``most`` characters; null is empty text."""
    texts, first, held = [], 0, 0
    for row, text in enumerate(batch.column(column)):
        value = text.as_py() or ""
        if texts and held + len(value) > most:
            yield first, texts
            texts, first, held = [], row, 0
        texts.append(value)
        held += len(value)
    if texts:
        yield first, texts


def map_texts(df: DataFrame, keys: list[str], fields: str, work: Callable[[list[str]], dict[str, list]], text: str = "text") -> DataFrame:
    """One output row per input row: the key columns and what ``work`` makes of the texts.

    ``work`` gets a slice of texts and returns, by name, the columns in ``fields`` (DDL).
    The text may itself be one of the keys.
    """
    source = df.select(*keys) if text in keys else df.select(*keys, F.col(text))
    schema = StructType([source.schema[i] for i in range(len(keys))] + StructType.fromDDL(fields).fields)
    arrow = to_arrow_schema(schema)
    names = arrow.names[len(keys):]
    at = source.columns.index(text)

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, at):
                made = work(texts)
                part = batch.slice(first, len(texts))
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keys))]
                columns += [pa.array(made[n], type=arrow.field(len(keys) + i).type) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return arrow_map(source, run, schema)
