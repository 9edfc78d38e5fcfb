"""The query catalogue: name -> Spark query and, where SQL can say it, the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewise.functions.scale import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


class Tables:
    """Lazy readers of the tables in a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def stream(self, name: str, files_per_batch: int = 1) -> DataFrame:
        """The table's files as a stream."""
        schema = getattr(self, name).schema
        reader = self._spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(f"{self._folder}/{name}*.parquet")

    def drained(self, stream: DataFrame, mode: str = "append") -> DataFrame:
        """Everything a stream's input gives, run to its end and stored in a new folder of the shared one."""
        folder = shared_folder(self._spark)
        # A complete result replaces the one before it.
        place = lambda number: 0 if mode == "complete" else number
        store = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={place(number)}")
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(store)
        writer.trigger(availableNow=True).start().awaitTermination()
        return self._spark.read.schema(stream.schema).parquet(f"{folder}/rows/*")


def register(name: str, query: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Add a query over the tables; its dates are read in UTC."""
    if name in QUERIES:
        raise ValueError(f"Query '{name}' is registered twice")

    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(Tables(spark, folder))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql
