"""Small helpers that the corpus operators share: tables, the shared folder, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import scratch, shared_folder, written

__all__ = ["drop_memories", "drop_table", "fresh", "open_for_read", "open_for_write", "scratch", "shared_folder", "table", "text_of", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_memories() -> None:
    """Frees what a worker process has kept since it did other operators' tasks: the token
    encoders' memories of words, and what Arrow holds unused."""
    import gc
    import sys

    import pyarrow as pa

    for name in ("tokens", "piece_tokens"):
        kept = getattr(sys.modules.get(f"ledgerloom.llm.{name}"), "_loaded", None)
        if kept:
            kept.clear()
            gc.collect()
    pa.default_memory_pool().release_unused()


def drop_table(df: DataFrame) -> None:
    """Deletes the files behind a table made by written() once nothing needs it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that none of df's columns has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def open_for_write(uri: str):
    """A binary stream for a new file at any address that pyarrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_for_read(uri: str):
    """A seekable binary stream."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))
    return store.open_input_file(path)
