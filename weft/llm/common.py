"""Helpers the corpus operators share: shared-folder tables, checked broadcasts, stable hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows (of a few short columns) that an operator hands to a broadcast join.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all nodes share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weft-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stash:
    """Intermediate Parquet tables in the shared folder. ``drop`` removes one that nothing lazy reads any more; what
    is left goes when the driver ends, as results may read it until then."""

    #: All stashes of this driver that haven't been removed.
    made: list[Stash] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        Stash.made.append(self)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        path, fs = self._at("")
        fs.deleteOnExit(path)

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def remove(self) -> None:
        """Remove all tables of this stash."""
        path, fs = self._at("")
        fs.delete(path, True)
        Stash.made.remove(self)

    def drop(self, name: str) -> None:
        path, fs = self._at(name)
        fs.delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most that many rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def join_checked(big: DataFrame, little: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``little`` where its counted rows stay under the bound; shuffle both sides otherwise."""
    return big.join(F.broadcast(little) if small(little, rows) else little, on, how)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that on pure ASCII and is much faster there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
