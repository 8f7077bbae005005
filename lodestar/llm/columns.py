"""Helpers shared by the corpus operators: word splitting and Arrow column functions."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Lower-cases A-Z, keeps a-z, 0-9 and every byte above 0x7F, and blanks the rest.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def plain_words(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a null has none."""
    return text.translate(WORD_BYTES).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space after lower-casing A-Z; a null has none."""
    return text.lower().split() if text else []


def column_function(make: Callable[[], Callable[[list], list]], fields: dict[str, str] | str):
    """A Spark column function from ``make()``, which each task calls once for a function of a list of values.

    Strings arrive as UTF-8 bytes. ``fields`` is one type, or names and types of a struct whose
    values the function returns as tuples. The result counts as nondeterministic, so that the
    optimizer evaluates it once however often its fields are used.
    """
    if isinstance(fields, str):
        kind, ddl = ARROW[fields], fields
    else:
        kind = pa.struct([(name, ARROW[t]) for name, t in fields.items()])
        ddl = ", ".join(f"`{name}` {t}" for name, t in fields.items())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        function = make()
        for values in batches:
            if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
                values = values.cast(pa.binary())
            yield pa.array(function(values.to_pylist()), type=kind)

    return arrow_udf(run, ddl).asNondeterministic()


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(df: DataFrame) -> list:
    """The columns of ``df`` by their names, whatever these hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, on a local master, one of our own where that is unset."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lodestar-")
    if not held.isDefined():
        context.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it from there on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
