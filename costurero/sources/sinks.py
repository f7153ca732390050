"""Result export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Quotes inside a value are doubled and a null becomes empty text, as spreadsheet users expect.
_CSV = {
    "header": True,
    "nullValue": "",
    "emptyValue": "",
    "quote": '"',
    "escape": '"',
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
}


def write_csv(df: DataFrame, path: str) -> None:
    """Write ``df`` as a folder of CSV parts, each with a header and no index column."""
    df.write.mode("errorifexists").options(**_CSV).csv(path)


#: Partition columns of a laid-out table are named after their instant column with this in front.
PART = "_mes_"


def lay_out(df: DataFrame, table: str, bucket: str, buckets: int, instant: str | None = None) -> None:
    """Write ``df`` as a catalog table in ``buckets`` buckets of the column ``bucket``, sorted by it.

    With an ``instant`` column the table is partitioned by its month too, so that a date range reads only its months.
    Rows are dealt by the buckets' own hash first: a task writes one bucket, at most one file a month. Two tables in
    equally many buckets of one id join without a shuffle.
    """
    rows = df.repartition(buckets, bucket)
    if instant is not None:
        rows = rows.withColumn(PART + instant, F.trunc(F.to_date(instant), "MM"))
    writer = rows.write.format("parquet").mode("errorifexists").bucketBy(buckets, bucket).sortBy(bucket)
    (writer if instant is None else writer.partitionBy(PART + instant)).saveAsTable(table)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.options(**_CSV).schema(schema).csv(path)


def _in_text() -> dict[str, str]:
    """The file's options without the header, which a line of text has not."""
    return {k: str(v) for k, v in _CSV.items() if k != "header"}


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as the line that ``write_csv`` would write, in a column ``LINEA``."""
    return df.select(F.to_csv(F.struct(*df.columns), _in_text()).alias("LINEA"))


def from_csv_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    """Rows from lines of ``csv_lines``, as ``read_csv`` would read them."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return lines.select(F.from_csv("LINEA", ddl, _in_text()).alias("row")).select("row.*")
