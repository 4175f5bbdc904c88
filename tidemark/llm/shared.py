"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: a word is a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of the frames that ``write_table`` gave.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that
    is unset and all runs on one machine (tests) a temporary folder is made
    and set; elsewhere executors could not read it, which is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of any executor:
    later stages read the files again instead of repeating the work.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    frame = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[frame] = path
    return frame


def drop_tables(*frames: DataFrame) -> None:
    """Remove what ``write_table`` wrote for these frames; nothing that is still to be computed may read them."""
    for frame in frames:
        if path := _folders.pop(frame, None):
            spark = frame.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_crc32(column: str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def whole_text(column: str = "text") -> Column:
    """The text itself, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))
