"""Helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = bytes.maketrans(UPPER_AZ.encode(), LOWER_AZ.encode())


def lower_az(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER_AZ, LOWER_AZ)


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes other than space and 0x09-0x0D."""
    return text.translate(_TO_LOWER).split()


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a session without one, as in tests, gets its own."""
    if (where := spark.conf.get("spark.checkpoint.dir", None)) is None:
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Settings of a store's jobs: their shuffle files go with the job, and plans as text, which hold long literals, are cut.
_JOB = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "20000"}


@contextmanager
def lean_jobs(spark: SparkSession) -> Iterator[None]:
    """Jobs run in here leave no shuffle files and no long plan texts behind; otherwise both stay until the driver collects garbage."""
    before = {k: spark.conf.get(k) for k in _JOB}
    try:
        for k, v in _JOB.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Store:
    """Tables written to the shared folder, so that a lost executor costs a re-read and not the lineage.

    ``release`` deletes tables that later ones have replaced.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.paths = spark, f"{folder(spark)}/llm-{uuid.uuid4().hex}", {}
        self.tables: dict[str, str] = {}

    def put(self, name: str, df: DataFrame, together: int | None = None) -> DataFrame:
        """``together``: rows of a row group, which a reader decodes at once; else Parquet looks at its size after 100 rows only."""
        path = f"{self.at}/{name}"
        limit = {"parquet.block.row.count.limit": together} if together else {}
        with lean_jobs(self.spark):
            df.write.options(compression="zstd", **limit).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def put_by(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """As ``put``, bucketed by ``key``, so that grouping by it needs no shuffle; few long rows."""
        table, path = f"llm_{uuid.uuid4().hex}", f"{self.at}/{name}"
        with lean_jobs(self.spark):
            df.write.bucketBy(shuffles(self.spark), key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
        self.paths[name], self.tables[name] = path, table
        return self.spark.table(table)

    def release(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Recent(dict):
    """Results of ``find`` by key, at most ``limit`` of them. At half of that, those not asked for since the last half go."""

    def __init__(self, find: Callable, limit: int):
        super().__init__()
        self.find, self.half, self.before = find, limit // 2, {}

    def __missing__(self, key):
        if (found := self.before.get(key, self)) is self:
            found = self.find(key)
        self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > self.half:
            self.before = dict(self)
            self.clear()


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
