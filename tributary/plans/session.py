"""Small helpers for plans: input tables, and lineage cut by files that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, which all executors share."""
    return f"{_shared(spark)}/{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder (one under the warehouse where none is set, as in tests)."""
    _shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same for wide rows: columns in files of that folder, so that later steps read only those that they need."""
    at = checkpoint_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to all cores in small parts by a key: what is made of a few short columns in a task can be much longer
    than they are, and a table of one file would be one task's."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by keys in many parts that are not put together again, so that what a task sorts or holds stays small."""
    return df.repartition(_many(df.sparkSession), *keys)


def _many(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)


class Laid:
    """Rows in files of the checkpoint folder, dealt by keys to many parts that joins by all of these keys take as they lie,
    however often; a checkpoint forgets its parts where plans adapt, so every join would move it again. Rows may be added."""

    def __init__(self, spark: SparkSession, *keys: str):
        # fewer than a shuffle's parts would be moved
        self.n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        self.spark, self.keys = spark, keys
        self.name, self.at = f"laid_{uuid.uuid4().hex}", checkpoint_folder(spark)

    def add(self, df: DataFrame) -> Laid:
        """Writes rows that are dealt by the keys already, as what such a join gives, or few."""
        df.write.bucketBy(self.n, *self.keys).option("path", self.at).mode("append").saveAsTable(self.name)
        return self

    def deal(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.n, *self.keys)

    def rows(self) -> DataFrame:
        return self.spark.read.table(self.name)

    def done(self) -> DataFrame:
        """The rows; the table's name is given up, its files stay."""
        out = self.rows()
        self.spark.sql(f"DROP TABLE {self.name}")
        return out


def laid(df: DataFrame, *keys: str, once: Callable[[DataFrame], DataFrame] = DataFrame.distinct) -> DataFrame:
    """The distinct rows of ``df`` (or what ``once`` makes of those that share the keys), laid by keys."""
    to = Laid(df.sparkSession, *keys)
    return to.add(once(to.deal(df))).done()
