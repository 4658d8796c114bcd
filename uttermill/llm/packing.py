"""Cost-balanced packing of token ids into training sequences.

The attention cost of a piece of n tokens is estimated as ``LINEAR`` n +
``QUADRATIC`` n^2. Documents are taken in descending length and go to the
sequence of lowest cost among those with enough token capacity left; documents
longer than a sequence are cut into full sequences first, and what fits
nowhere whole is cut to fill the roomiest sequences. Each task packs the
documents it reads in groups of about ``GROUP_TOKENS`` tokens, without a
shuffle. A group's capacities are full sequences plus, for the rest, sequences
of the powers of two that sum to it, so nothing is padded.

A null text is an empty document: its end id alone. Repeated rows are packed
once each; an empty table packs nothing; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, text_or_empty
from .tokens import coder

CAPACITY = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Tokens that a task packs together (bounds its memory).
GROUP_TOKENS = 4_000_000
#: Characters encoded at a time.
ENCODE_CHARS = 8 << 20

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def capacities(total: int, capacity: int) -> list[int]:
    """Full sequences, then the powers of two of the rest."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece. Sequences
    are filled to their capacity, so offsets have no gaps."""
    room = capacities(sum(sizes), capacity)
    filled = [0] * len(room)
    out = []

    def put(doc, start, n, seq):
        out.append((doc, start, n, seq, filled[seq]))
        filled[seq] += n
        room[seq] -= n

    at = 0
    rests = []
    for doc, n in enumerate(sizes):
        whole = n // capacity
        for k in range(whole):
            put(doc, k * capacity, capacity, at)
            at += 1
        if n % capacity:
            rests.append((doc, whole * capacity, n % capacity))
    rests.sort(key=lambda x: -x[2])
    # what a shorter sequence lacks counts as spent, so that the cheapest has the
    # most room at first; equal costs go by number
    spent = {s: cost(capacity - room[s]) for s in range(at, len(room))}
    heap = [(c, s) for s, c in spent.items()]
    heapq.heapify(heap)
    roomy = [(-room[s], s) for s in range(at, len(room))]
    heapq.heapify(roomy)

    def largest():
        while roomy and -roomy[0][0] != room[roomy[0][1]]:
            heapq.heappop(roomy)
        return roomy[0][1]

    for doc, start, n in rests:
        while n:
            big = largest()
            if room[big] < n:  # fits nowhere whole: fill the roomiest and go on with the rest
                seq, m = big, room[big]
            else:
                aside = []
                while True:
                    c, seq = heapq.heappop(heap)
                    if c != spent[seq] or not room[seq]:
                        continue
                    if room[seq] >= n:
                        break
                    aside.append((c, seq))
                for x in aside:
                    heapq.heappush(heap, x)
                m = n
            put(doc, start, m, seq)
            start, n = start + m, n - m
            spent[seq] += cost(m)
            if room[seq]:
                heapq.heappush(heap, (spent[seq], seq))
                heapq.heappush(roomy, (-room[seq], seq))
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row a piece: the document, where the piece starts in its ids, its
    length and crc32, the document's tokens, the sequence and the offset in it.
    ``tokenizer``: path of a tokenizers file whose words drop white space."""
    def task(batches):
        from pyspark import TaskContext
        words = coder(tokenizer, spaces_count=False)
        sequence = TaskContext.get().partitionId() << 32
        ids, names, total = [], [], 0

        def flush():
            nonlocal sequence
            rows = []
            for doc, start, n, seq, offset in pack([len(x) for x in ids], capacity):
                crc = zlib.crc32(ids[doc][start:start + n].astype("<u4").tobytes())
                rows.append((names[doc], start, n, crc, len(ids[doc]), sequence + seq, offset))
            sequence = 1 + max(r[5] for r in rows)
            return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype(
                {"doc_id": "Int64"})

        def chunks(pdf):
            some, n = [], 0
            for row in zip(pdf["id"], pdf["text"]):
                some.append(row)
                n += len(row[1])
                if n >= ENCODE_CHARS:
                    yield some
                    some, n = [], 0
            if some:
                yield some

        for pdf in batches:
            for some in chunks(pdf):
                for (name, _), found in zip(some, words.encode([t for _, t in some])):
                    ids.append(np.append(found, np.uint16(end_id)))
                    names.append(None if pd.isna(name) else int(name))
                    total += len(found) + 1
                    if total >= group_tokens:
                        yield flush()
                        ids, names, total = [], [], 0
            pdf = some = found = None
            release_memory()
        if ids:
            yield flush()
            ids, names = [], []
            release_memory()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text).alias("text"))
    return rows.mapInPandas(task, PIECES)
