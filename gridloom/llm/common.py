"""What the corpus operators share: scratch tables on shared storage, word splitting, hash bounds."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bounds of what a Python worker gets at once. A row is never cut, so one longer text is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: Bits of a set's picture: at most PICTURE_BITS / 64 rows, whatever the set's size.
PICTURE_BITS = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme. A local one is made only where the session names
    none and driver and executors are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Arrow batches stay small enough for long texts, by rows and by bytes. The session keeps these bounds, as plans run later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Tables of one run in the shared folder: each cuts lineage and outlives the executor that wrote it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        prepare(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        self.settle()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(conf).delete(p, True)

    def settle(self) -> None:
        """Lets the driver release shuffle files of finished steps."""
        gc.collect()
        self.spark._jvm.System.gc()


def picture(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The values of ``key`` as a bit map ``(slot, bits)`` of PICTURE_BITS / 64 rows at most, so that it may be broadcast at any size."""
    each = ids.select(F.pmod(F.xxhash64(key), F.lit(PICTURE_BITS)).alias("h"))
    return each.groupBy(F.shiftright("h", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))


def pictured(rows: DataFrame, of: DataFrame, key: str = "doc_id", inside: bool = True) -> DataFrame:
    """The rows whose key the picture has, which are those of the set and a few others, or the rows that are surely not in it.

    It keeps rows that cannot matter out of a shuffle; what is left is joined by the key.
    """
    cols = rows.columns
    hashed = rows.withColumn("picture_h", F.pmod(F.xxhash64(key), F.lit(PICTURE_BITS)))
    met = hashed.join(F.broadcast(of.select(F.col("slot").alias("picture_slot"), F.col("bits").alias("picture_bits"))), F.shiftright("picture_h", 6) == F.col("picture_slot"), "left")
    hit = F.coalesce(F.expr("(shiftright(picture_bits, cast(picture_h & 63 as int)) & 1L) = 1L"), F.lit(False))
    return met.filter(hit if inside else ~hit).select(*cols)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space; null has no words."""
    return text.encode("utf-8", "replace").translate(LOWER_BYTES).split() if text else []


def crc_of(col: str):
    """crc32 of an id as text; a null id has none."""
    return F.crc32(F.col(col).cast("string"))


def smallest(df: DataFrame, n: int, *by) -> DataFrame:
    """A bounded sample that repeats: the n rows of smallest hash."""
    return df.orderBy(*by).limit(n)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
