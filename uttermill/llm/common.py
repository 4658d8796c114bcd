"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: cuts
    lineage and survives lost executors (the commit protocol drops the files
    of failed attempts)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or ``name`` with underscores in front until no column of
    ``taken`` has it (column names are compared without case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def bound(expr: Column, use) -> Column:
    """``use(expr)`` with ``expr`` computed once a row: a lambda variable is
    never inlined, while a column that a lambda mentions may be."""
    return F.transform(F.array(expr), use)[0]


def release_memory() -> None:
    """Gives memory that this Python worker has freed back to the system.
    Workers outlive their tasks and stages; what the allocators of Arrow and C
    keep would count against the executor in all later ones."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def row_key(id_col: str, text: str) -> Column:
    """A string that tells rows apart by id (null has its own) and text."""
    return F.concat(F.coalesce(F.concat(F.lit("i"), F.col(f"`{id_col}`").cast("string")), F.lit("n")), F.lit(":"),
                    F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


# --- files of own formats in the shared folder ------------------------------

def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file that all executors share."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file written under an attempt's own name and renamed when complete,
    so that a failed or repeated task leaves either nothing or a whole file."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        head, tail = posixpath.split(self.path)
        self.fs.create_dir(head, recursive=True)
        self.temp = f"{head}/.{tail}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


def open_input(uri: str):
    f, path = filesystem(uri)
    return f.open_input_file(path)
