"""Results out: batches to a client, JSON rows, tables created and rewritten."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import store


def batched(items: Iterable, n: int) -> Iterator[list]:
    it = iter(items)
    while part := list(islice(it, n)):
        yield part


def send(df: DataFrame, client: Callable[[list], None], n: int = 100) -> None:
    """Rows to ``client`` n at a time, from the workers; a task that is retried sends its rows again, so they need keys."""

    def each(rows: Iterator) -> None:
        for part in batched(rows, n):
            client(part)

    df.foreachPartition(each)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def create(spark: SparkSession, path: str, schema: StructType, partition_by: list[str] = ()) -> None:
    """An empty table at ``path`` unless there is one."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partition_by).parquet(path)


def check_dimension(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """The rows, failing in the task that meets a vector of another length."""
    return df.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector's length isn't {dim}"))))


def upsert_into(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> DataFrame:
    """Write the table at ``path`` with ``new`` merged in to a version of its own beside it; returns the merged rows.

    Readers of the old files aren't disturbed: the new version is complete before its name is known.
    """
    old = spark.read.parquet(path)
    n = spark.sparkContext.applicationId
    target = f"{path.rstrip('/')}-{n}-{spark.sql('SELECT uuid()').first()[0]}"
    store.upsert(old, new, keys).write.parquet(target)
    return spark.read.parquet(target)
