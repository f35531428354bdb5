"""Table reading and shared scratch storage for the operators of this package."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import shared_dir

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back.

    It cuts lineage and survives lost executors. The table stays until the program ends or
    clear() is called, as lazily evaluated frames may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str) -> str:
    """A column name that no caller's table has."""
    return f"{name}_{uuid.uuid4().hex}"


def mark() -> int:
    """How many tables save() has written so far, for clear()."""
    return len(_written)


def clear(start: int = 0, end: int | None = None) -> None:
    """Delete the tables that save() wrote between two marks; their readers must be done."""
    for i, (spark, path) in enumerate(_written[start:end], start):
        if path:
            try:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            except Exception as e:  # the session has ended: nothing is left to call
                if "Py4J" not in type(e).__name__ and not isinstance(e, (AttributeError, ConnectionError)):
                    raise
            _written[i] = (spark, "")


atexit.register(clear)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: how many buckets a job needs follows from it."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


#: Ids up to this number (8 bytes each) are broadcast to pick rows; beyond it, rows are shuffled.
BROADCAST_IDS = 2_000_000


def rows_with(docs: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of docs whose `col` is in ids (nulls match nulls): by broadcast up to BROADCAST_IDS, else by a shuffle."""
    name = fresh("id")
    ids = ids.select(F.col(col).alias(name)).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[col].eqNullSafe(F.col(name)), "left_semi")
