"""Shared plumbing: table access, the shared scratch folder and staged tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes kept in a word after A-Z became a-z: digits, letters and all bytes of non-ASCII characters.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and returns the maximal runs of digits, a-z and non-ASCII characters; null has none."""
    return text.encode().translate(WORD_TABLE).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame) -> DataFrame:
    """Only the two columns that operators read, so that other columns' names can't clash."""
    ship(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: glibc's mallopt: how much freed memory stays at the top of the heap, from what size on a block is mapped by itself, and the most heaps.
_MALLOPT = {-1: 4 << 20, -3: 4 << 20, -8: 2}


def _give_back() -> None:
    """Returns what earlier tasks of this worker freed to the system; workers are reused and would hold it.

    Large blocks are mapped by themselves from now on, so that they go back as soon as they are freed. Left
    alone, glibc raises that size with each block freed, up to 32 MB, and keeps what is below it; Arrow's own pool keeps what it had, too.
    """
    libc = ctypes.CDLL(None)
    if pa.default_memory_pool().backend_name != "system":
        pa.default_memory_pool().release_unused()
        pa.set_memory_pool(pa.system_memory_pool())
        if hasattr(libc, "mallopt"):
            for k, v in _MALLOPT.items():
                libc.mallopt(k, v)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker holds few texts as Python objects at a time; an idle worker gives its memory back."""
    _give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    _give_back()


_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp()) / f"{root.name}_sources.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        _SHIPPED.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (local mode)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="vertexflow-")
        _drop_on_exit(spark, _OWN[app])
    return _OWN[app]


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _drop_on_exit(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the application ends."""
    path = f"{shared_dir(spark)}/vf-{name}-{uuid.uuid4().hex}"
    _drop_on_exit(spark, path)
    return path


#: Settings while a table is staged: drop a query's shuffle files when the query has ended; rows of texts that executor and worker hold at once, twice each.
_STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and rereads it: cuts lineage, is computed once, survives lost executors.

    The shuffle files of the written query go with its end, as nothing reads them any more.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), {k: spark.conf.get(k) for k in _STAGING}
    try:
        for k, v in _STAGING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that isn't taken, whatever its case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns as one struct), id and th (hash of the text): names that can't clash with those of docs."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
