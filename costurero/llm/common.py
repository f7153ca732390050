"""Helpers the operators share: inputs, stored intermediates, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import costurero.llm

# Tasks get the operators' code with the plan; executors need no copy of this package.
cloudpickle.register_pickle_by_value(costurero.llm)

#: White space that separates words: blank and the controls from tab to carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

#: Rows and bytes of one Arrow batch, so that a task holds a bounded piece of a partition.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, by Spark's own reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one of its own only for a local session that names none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Shuffle files of a finished job go at once: what is kept of it has been written to the shared folder.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there: later jobs neither recompute nor lose them.

    One folder per call; whoever owns the shared folder empties it after the job, as with checkpoints.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) of every row, written once: the number tells rows apart whatever ids they share or lack."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))


def deal(spark: SparkSession, buckets: int) -> int:
    """Partitions for so many buckets of bounded size: a few buckets each, which a task takes one after the other."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets // 4 + 1, 32_000))


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Rows through a function of Python columns, batch by batch.

    `make` runs once per task and gives the function, which may keep bounded state such as a word cache.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            if batch.num_rows:
                out = function(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)


def byte_words(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes: bytes.split() cuts exactly at the six blanks."""
    return text.encode("utf-8").split() if text else []
