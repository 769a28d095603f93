"""What the training-data operators share: folders, tables, byte tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to lower case; every other byte of UTF-8 stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: A-Z to lower case, ASCII that is neither digit nor letter to a blank: the
#: pieces that bytes.split() then gives are the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

_shipped: "weakref.WeakSet" = weakref.WeakSet()
_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let the executors import this package wherever it was started from."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    _shipped.add(sc)
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if top in os.environ.get("PYTHONPATH", "").split(":"):
        return
    folder = tempfile.mkdtemp(prefix="marginalia-ship-")
    with zipfile.ZipFile(f"{folder}/marginalia_pkg.zip", "w") as z:
        for d, _, names in os.walk(f"{top}/marginalia"):
            for n in names:
                if n.endswith(".py"):
                    z.write(f"{d}/{n}", os.path.relpath(f"{d}/{n}", top))
    sc.addPyFile(f"{folder}/marginalia_pkg.zip")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir where it is set.

    Where it is unset a temporary folder takes its place, in local mode only: on
    a cluster no other machine would see it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.get(spark.sparkContext.applicationId)
        if not base:
            base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder; removed when the application ends unless kept."""
    path = f"{shared_dir(spark)}/marginalia/{name}-{uuid.uuid4().hex}"
    if not keep:
        hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hp)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation
    of everything before.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def drop_table(df: DataFrame) -> None:
    """Remove a materialize()d table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def col(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(df: DataFrame) -> list[Column]:
    """All columns of df."""
    return [col(c) for c in df.columns]


def own_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def own_prefix(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def path_exists(spark: SparkSession, path: str) -> bool:
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
