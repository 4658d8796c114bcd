"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at most ``2 r`` bits apart have a common variant at most ``r``
bits from each. Every distinct fingerprint emits all its variants within
``r`` = 2 bits (2 081 of them); variants are shuffled by their leading bits,
equal variants meet, colliding pairs are deduplicated and verified.

Only (bucket, fingerprint) crosses the network: a fingerprint goes to the
buckets that its variants fall into, and the bucket's task lists the variants
there. All fingerprints on one variant are linked by the star around the
smallest of them (any two are within 4 bits of each other, so the star loses
no connection and no pair list grows with the square of a group). Buckets
above ``bucket_variants`` are dealt on by a linear hash of the variant, so a
hot region of fingerprints is split over tasks. Components of the links are
found by alternating large and small stars on tables in the shared folder.

A null or blank text has fingerprint zero and is linked like any other; equal
texts share a fingerprint, hence a component; an empty table gives an empty
table; other columns pass through.
"""

from __future__ import annotations

import math
from itertools import combinations
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, release_memory, row_key, text_or_empty, written

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Variants that one task lists at a time, about; more are dealt to more tasks.
BUCKET_VARIANTS = 2_000_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles."""
    import xxhash
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1:] if len(parts) >= words else [ends[-1]]
    first = [0] + [e + 1 for e in ends[:n - 1]]
    digest = xxhash.xxh64_digest
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        h = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[i:i + (1 << 16)], last[i:i + (1 << 16)])])
        total += np.unpackbits(np.frombuffer(h, dtype=np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint_column(text, words: int = SHINGLE_WORDS):
    """Signed 64-bit value of the fingerprint (bit pattern unchanged)."""
    @pandas_udf("long")
    def f(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            found = pd.Series(np.array([fingerprint(x, words) for x in t], dtype=np.uint64).view(np.int64))
            del t
            yield found
            release_memory()
    return f(text)


# --- links ------------------------------------------------------------------

def flips(bits: int, most: int) -> np.ndarray:
    """All masks over the lowest ``bits`` bits with at most ``most`` set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)],
                    dtype=np.uint64)


def mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """Hash of 64-bit values to ``bits`` bits that is linear over xor."""
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(43))
    out = x ^ (x >> np.uint64(bits))
    for k in range(2, 64 // bits + 1):
        out = out ^ (x >> np.uint64(bits * k if bits * k < 64 else 63))
    return out & np.uint64((1 << bits) - 1)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of n vertices."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == label).all():
            return label
        label = new


def links_of_bucket(fps: np.ndarray, bucket: int, prefix: int, radius: int,
                    part: int = 0, part_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest linked fingerprint) for the fingerprints that
    share a variant whose leading ``prefix`` bits are ``bucket`` (and whose
    linear hash is ``part``). ``fps``: distinct unsigned fingerprints."""
    fps = np.sort(fps)
    low = 64 - prefix
    used = (np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(bucket)).astype(int)
            if prefix else np.zeros(len(fps), int))
    tail = fps & np.uint64((1 << low) - 1 if low < 64 else 2**64 - 1)
    id_bits = max(1, int(len(fps) - 1).bit_length())
    odd = np.uint64(0x9E3779B97F4A7C15)

    def key_of(v):
        return (v * odd) >> np.uint64(id_bits)  # the top bits of a multiplicative hash

    keys = []
    for k in range(radius + 1):
        masks = flips(low, radius - k)
        ids = np.flatnonzero(used == k)
        if not len(ids):
            continue
        classes = mixed(masks, part_bits) if part_bits else None
        own = mixed(tail[ids], part_bits) if part_bits else None
        for c in np.unique(own) if part_bits else [None]:
            some = ids if c is None else ids[own == c]
            m = masks if c is None else masks[classes == (c ^ np.uint64(part))]
            if len(m) and len(some):
                v = key_of(tail[some][:, None] ^ m[None, :]) << np.uint64(id_bits)
                keys.append((v | some.astype(np.uint64)[:, None]).ravel())
    if not keys:
        return fps[:0], fps[:0]
    keys = np.concatenate(keys)
    keys.sort()
    run = keys >> np.uint64(id_bits)
    same = np.concatenate([[False], run[1:] == run[:-1]])
    if not same.any():
        return fps[:0], fps[:0]
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
    at = np.flatnonzero(same)
    ids_mask = np.uint64((1 << id_bits) - 1)
    a, b = keys[heads[at]] & ids_mask, keys[at] & ids_mask
    pairs = np.unique((a << np.uint64(32)) | b)
    a, b = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(2**32 - 1)).astype(np.int64)
    close = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius
    if not close.all():  # two variants with one hash met: list that hash's members by exact variant
        wrong = set(zip(a[~close].tolist(), b[~close].tolist()))
        extra = []
        for h, i in zip(heads[at].tolist(), at.tolist()):
            if (int(keys[h] & ids_mask), int(keys[i] & ids_mask)) in wrong:
                stop = np.searchsorted(run, run[h], side="right")
                seen: dict[int, int] = {}
                for j in (keys[h:stop] & ids_mask).astype(int).tolist():
                    v = tail[j] ^ flips(low, radius - used[j])
                    for x in v[key_of(v) << np.uint64(id_bits) >> np.uint64(id_bits) == run[h]].tolist():
                        if seen.setdefault(x, j) != j:
                            extra.append((seen[x], j))
        a = np.concatenate([a[close], np.array([x for x, _ in extra], dtype=np.int64)])
        b = np.concatenate([b[close], np.array([x for _, x in extra], dtype=np.int64)])
    label = components(len(fps), a, b)
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_variants: int = BUCKET_VARIANTS) -> DataFrame:
    """(fp, root) links that connect all fingerprints of ``fps.fp`` (distinct
    longs) at most ``max_bits`` (even) bits apart."""
    radius = max_bits // 2
    ball = len(flips(64, radius))
    prefix = max(1, min(20, math.ceil(math.log2(max(2, fps.count() * ball / bucket_variants)))))
    masks = [int(m) for m in flips(prefix, radius)]
    lead = F.shiftrightunsigned("fp", 64 - prefix)
    sent = fps.select("fp", F.explode(F.array(*[lead.bitwiseXOR(F.lit(m)) for m in masks])).alias("bucket"))
    # variants that a bucket will list: by the flips already spent on the leading bits
    spent = F.bit_count(lead.bitwiseXOR(F.col("bucket")))
    volume = F.lit(1).cast("long")
    for k in range(radius + 1):
        volume = F.when(spent == k, F.lit(len(flips(64 - prefix, radius - k)))).otherwise(volume)
    hot = (sent.groupBy("bucket").agg(F.sum(volume).alias("n"))
           .where(F.col("n") > 2 * bucket_variants)
           .select("bucket", F.ceil(F.log2(F.col("n") / bucket_variants)).cast("int").alias("part_bits")))
    dealt = (sent.join(hot, "bucket", "left").fillna(0, ["part_bits"])
             .select("fp", "bucket", "part_bits", F.explode(F.sequence(
                 F.lit(0), (F.pow(F.lit(2), F.col("part_bits")) - 1).cast("int"))).alias("part")))

    def find(key, pdf):
        bucket, part, part_bits = (int(x) for x in key)
        fp, root = links_of_bucket(pdf["fp"].to_numpy(np.int64).view(np.uint64), bucket, prefix, radius,
                                   part, part_bits)
        release_memory()
        return pd.DataFrame({"fp": fp.view(np.int64), "root": root.view(np.int64)})

    found = dealt.groupBy("bucket", "part", "part_bits").applyInPandas(find, "fp long, root long")
    return found.distinct()


def connected(edges: DataFrame, a: str = "fp", b: str = "root") -> DataFrame:
    """(node, component): the smallest node of each node's component, by
    alternating large and small stars. Every round is a table in the shared
    folder; degrees are never gathered, minima are aggregated map-side."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where("u <> v").distinct(), "stars")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        # greatest first: an edge goes from the larger node to the smaller
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def grouped(docs: DataFrame, id_col: str, text: str, words: int, max_bits: int, *more) -> DataFrame:
    """id, fp, root (the smallest fingerprint of the group), component_id, and
    the ``more`` columns, of every row."""
    own = written(docs.select(F.col(f"`{id_col}`").alias("id"), *more,
                              fingerprint_column(text_or_empty(text), words).alias("fp")), "fingerprints")
    reps = written(own.groupBy("fp").agg(F.min("id").alias("rep")), "representatives")
    comp = connected(links(reps.select("fp"), max_bits))
    rooted = (reps.join(comp, reps.fp == comp.node, "left")
              .select("fp", "rep", F.coalesce("component", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return own.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col``, ``fp`` (signed fingerprint) and ``component_id`` (smallest
    id reachable over links of at most ``max_bits`` bits) of every row."""
    return grouped(docs, id_col, text, words, max_bits).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
               max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group: the one with the smallest id (null after all
    others; of several rows with that id the one with the smallest text digest,
    of rows equal in both, one). Rows are told apart by id and text, so rows
    that share an id, null included, stay if their texts are in different groups."""
    key = fresh("row_key", docs.columns)
    keyed = docs.withColumn(key, row_key(id_col, text))
    groups = grouped(keyed, id_col, text, words, max_bits, F.col(key).alias("key"))
    first = groups.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))["key"].alias(key)).select(key)
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).drop(key)
