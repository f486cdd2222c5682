"""What the corpus operators share: tables by name, scratch tables and Arrow batch helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ARROW_ROWS rows and ARROW_BYTES, so that long texts keep a batch within memory."""
    for key, most, usual in (("maxRecordsPerBatch", ARROW_ROWS, "10000"), ("maxBytesPerBatch", ARROW_BYTES, str(2**31 - 1))):
        held = int(spark.conf.get(f"spark.sql.execution.arrow.{key}", usual))
        if not 0 < held <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all run in this process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="dispatchgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_remove_local, root)
    return root.rstrip("/")


def _remove_local(root: str) -> None:
    import shutil

    shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


_MADE: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    """Remove what scratch folders are left when the driver ends; results that read from them have been written by then."""
    for spark, base in _MADE:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # the JVM may be gone
            return


class Scratch:
    """Intermediate tables written to the shared folder; they cut lineage, outlive executors and go when the driver ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
        _MADE.append((spark, self.base))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.coalesce(self._most_files()).write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _most_files(self) -> int:
        """Files of a table at the most: four tasks a core, and no fewer than an eighth of the shuffle's partitions; where
        partitions are many for the data, the folder would fill with tiny files."""
        return max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8, 32)

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads, and let Spark clean shuffles that nothing holds."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)

    def release(self) -> None:
        """Ask the driver to collect what no plan refers to, which frees those shuffles' disk."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and the whole text, null as empty; other columns play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


#: A bitmap has between these many bits.
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 29


class Bitmap:
    """Hashed doc_ids, eight bits or more to an id up to MOST_BITS (64 MB) in all, as rows of 2**15 bits to broadcast."""

    def __init__(self, ids: DataFrame):
        self.bits = LEAST_BITS
        while self.bits < min(8 * ids.count(), MOST_BITS):
            self.bits *= 2
        place = ids.select(self._place().alias("p"))
        self.rows = place.groupBy(F.expr("bitmap_bucket_number(p)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("__bits"))

    def _place(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.bits))

    def split(self, docs: DataFrame, inside: bool = True) -> DataFrame:
        """doc_id and text of the documents that the bitmap may hold (a join on doc_id makes it exact), or of all others."""
        probe = docs.select("doc_id", "text", self._place().alias("__p"))
        probe = probe.select("doc_id", "text", F.expr("bitmap_bucket_number(__p)").alias("__bucket"), F.expr("bitmap_bit_position(__p)").alias("__at"))
        byte = F.conv(F.hex(F.substring("__bits", (F.floor(F.col("__at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = F.expr("doc_id is not null") & F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("__at") % 8)) % 2 == 1, F.lit(False))
        # The rows are bounded by MOST_BITS, so the broadcast is too.
        return probe.join(F.broadcast(self.rows), "__bucket", "left").where(held if inside else ~held).select("doc_id", "text")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
