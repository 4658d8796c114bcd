"""Token ids in compressed files (see ``rangecoder`` for the format).

Documents are ranged by id over the tasks and sorted; each task encodes its
texts and writes one file of segments, named by its place in the order, under
an attempt's own name that is renamed when whole. A manifest table lists the
files. Reading decodes every segment, checks every block, and adds the ids in
earlier files (a running sum over the manifest, a row a file).

A null text is empty: its end id alone. Null ids come first and are read back
as null; repeated rows are stored once each; an empty table gives an empty
manifest; other columns are not stored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import AtomicFile, open_input, release_memory, text_or_empty, written
from .rangecoder import pack_segment, read_segment
from .tokens import coder

#: Ids in a segment, about, and bytes encoded at a time (they bound the memory of a task).
SEGMENT_IDS = 8_000_000
ENCODE_BYTES = 20 << 20
NULL_NAME = -2**63

MANIFEST = "file_no long, path string, n_docs long, n_ids long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _parts(batch: pa.RecordBatch):
    """Ids and texts of about ENCODE_BYTES at a time."""
    names = batch.column(0).fill_null(NULL_NAME).to_numpy(zero_copy_only=False)
    texts = batch.column(1).cast(pa.string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, before = 0, 0
    while first < len(names):
        last = 1 + int(np.searchsorted(ends, before + ENCODE_BYTES))
        yield names[first:last], texts[first:last]
        first, before = last, int(ends[min(last, len(ends)) - 1])


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text",
          segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes the ids of all documents in ascending id order; the manifest."""
    folder = scratch_path(docs.sparkSession, "token-ids")

    def task(batches):
        from pyspark import TaskContext
        words = coder(tokenizer, spaces_count=True)
        number = TaskContext.get().partitionId()
        path = f"{folder}/ids-{number:08d}.bin"
        out, waiting = None, []
        n_docs = n_ids = in_segment = 0

        def flush():
            nonlocal out, n_docs, n_ids, in_segment
            if waiting:
                out = out or AtomicFile(path)
                out.write(pack_segment(*map(np.concatenate, zip(*waiting))))
                n_docs, n_ids = n_docs + sum(len(x[0]) for x in waiting), n_ids + in_segment
                waiting.clear()
                in_segment = 0

        for batch in batches:
            for names, texts in _parts(batch):
                ids, sizes = words.encode_flat(texts)
                ids = np.insert(ids, np.cumsum(sizes), np.uint16(end_id))
                ends = np.cumsum(sizes + 1)
                first = begin = 0
                while first < len(names):  # documents up to where the segment is full
                    last = min(len(names), 1 + int(np.searchsorted(ends, begin + segment_ids - in_segment)))
                    end = int(ends[last - 1])
                    waiting.append((names[first:last], sizes[first:last].astype(np.uint64) + np.uint64(1),
                                    ids[begin:end]))
                    in_segment += end - begin
                    first, begin = last, end
                    if in_segment >= segment_ids:
                        flush()
            batch = names = texts = ids = None
            release_memory()
        flush()
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [path], "n_docs": [n_docs],
                                              "n_ids": [n_ids], "n_bytes": [out.size]})

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text).alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(ranged.mapInArrow(task, MANIFEST), "token-manifest")


def read_files(manifest: DataFrame):
    """The manifest's rows, a file a task, each with the ids before it."""
    before = F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    return files.repartition(max(1, manifest.count()))


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: the id, how many ids stand before
    it in all files, how many it has, and their crc32."""
    def task(batches):
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["before"]):
                with open_input(path) as stream:
                    while (segment := read_segment(stream)) is not None:
                        names, sizes, ids = segment
                        wide = ids.astype("<u4")
                        ends = np.cumsum(sizes.astype(np.int64))
                        begins = ends - sizes.astype(np.int64)
                        yield pd.DataFrame({
                            "doc_id": pd.array([None if n == NULL_NAME else n for n in names.tolist()], "Int64"),
                            "start": begins + start, "n_tokens": ends - begins,
                            "ids_crc32": [zlib.crc32(wide[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]})
                        start += len(ids)

    return read_files(manifest).mapInPandas(task, DOCUMENTS)


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id and its ids as an array, from the files."""
    def task(batches):
        for pdf in batches:
            for path in pdf["path"]:
                with open_input(path) as stream:
                    while (segment := read_segment(stream)) is not None:
                        names, sizes, ids = segment
                        yield pd.DataFrame({
                            "doc_id": pd.array([None if n == NULL_NAME else n for n in names.tolist()], "Int64"),
                            "ids": np.split(ids.astype(np.int32), np.cumsum(sizes.astype(np.int64))[:-1])})

    return read_files(manifest).mapInPandas(task, "doc_id long, ids array<int>")
