"""Stored tables that are loaded again and again: upserts by key, appends by load, each load once.

A table that takes upserts is cut into buckets of its key, a folder each. A load rewrites the buckets that
hold one of its keys and no other file. Every load has an id. The rows are replaced first, which can be
repeated without harm, and the id is noted last: a load that was cut short is simply run again, and one
that has been noted is left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.operators import quality
from haulscope.session import written

BUCKET = "bucket"
DONE = "_SUCCESS"


def _exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is absent."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory())


@dataclass(frozen=True)
class KeyedTable:
    """A table in ``folder`` with one row a key. Choose ``buckets`` so that one holds some hundred MB: it is
    what a load of a single key rewrites. It cannot be changed later."""

    spark: SparkSession
    folder: str
    key: str
    buckets: int = 64

    @property
    def _rows(self) -> str:
        return f"{self.folder}/rows"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def has(self, load_id: str) -> bool:
        return _exists(self.spark, f"{self.folder}/loads/{quote(load_id, safe='')}/{DONE}")

    def read(self) -> DataFrame:
        """All rows, without the bucket."""
        return self.spark.read.parquet(self._rows).drop(BUCKET)

    def upsert(self, rows: DataFrame, load_id: str, policy: str = "update") -> bool:
        """Load rows (``row_num`` orders those of one key) and tell whether anything had to be done.

        ``update`` replaces the stored rows of the load's keys, ``skip`` adds new keys only, ``cancel`` raises
        if a key is there or comes twice. Rows without a key cannot be loaded twice safely and are an
        error. Columns that the stored table does not have are left out.
        """
        if self.has(load_id):
            return False
        if not rows.where(F.col(self.key).isNull()).isEmpty():
            raise ValueError(f"rows without {self.key}")
        if _exists(self.spark, self._rows):
            # No more than there are buckets.
            touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]
            stored = self.spark.read.parquet(self._rows).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        else:
            stored = rows.drop("row_num").limit(0)
        merged = quality.resolve_duplicates(stored, rows, policy, self.key)
        # The new buckets are complete before the first old one goes.
        self._replace(written(merged.withColumn(BUCKET, self._bucket()), "upsert"))
        self._note(rows, load_id)
        return True

    def _replace(self, staged: DataFrame) -> None:
        writer = staged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self._rows)

    def _note(self, rows: DataFrame, load_id: str) -> None:
        note = rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("load_id", F.lit(load_id))
        note.write.mode("overwrite").parquet(f"{self.folder}/loads/{quote(load_id, safe='')}")


def append_once(rows: DataFrame, folder: str, load_id: str) -> bool:
    """Append rows as one load, in a folder of its own, and tell whether anything had to be done.

    A load that was cut short is replaced when it is run again; one that is complete is left alone.
    """
    target = f"{folder}/load={quote(load_id, safe='')}"
    if _exists(rows.sparkSession, f"{target}/{DONE}"):
        return False
    rows.write.mode("overwrite").parquet(target)
    return True


def read_loads(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all complete loads, with ``load``, the id of each."""
    names = [n for n in _children(spark, folder) if n.startswith("load=")]
    done = [f"{folder}/{n}" for n in names if _exists(spark, f"{folder}/{n}/{DONE}")]
    if not done:
        raise ValueError(f"no complete load in {folder}")
    rows = spark.read.parquet(*done)
    place = F.regexp_extract(F.col("_metadata.file_path"), "/load=([^/]*)/[^/]*$", 1)
    # The id is quoted in the folder's name, and the name once more in the path.
    return rows.withColumn("load", F.url_decode(F.url_decode(place)))
