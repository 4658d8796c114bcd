"""Registered queries: each operator over its whole table, as
(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, host_quality, line_dedup, merkle, packing, pii, prefix_trie, simhash, suffix_dedup,
               token_store, url_filter, vector_dedup, warc)
from .common import table, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register
def op1_suffix_dedup(spark, sf_dir):
    """Bytes of each document covered by a 50-byte string of an earlier one."""
    return suffix_dedup.mark(table(spark, sf_dir, "documents"))


#: The captures' fetch times and the list edits are derived from the tables:
#: a page was fetched page_id * 7919 mod 43 200 minutes into January 2024; an
#: event edits the list named by its type at its time, for the host (or the
#: host without its first label, for odd users) of the page with the event's number.
FETCHED = "timestamp'2024-01-01' + make_dt_interval(0, 0, page_id * 7919 % 43200)"


@register
def op2_url_filter(spark, sf_dir):
    """Each page with the lists on which its host stood when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    n = max(1, pages.count())
    edits = (table(spark, sf_dir, "events")
             .select((F.col("event_id") % n).alias("page_id"), F.col("event_type").alias("list"),
                     F.col("ts").alias("at"), (F.col("user_id") % 3 != 0).alias("active"),
                     (F.col("user_id") % 2 == 1).alias("parent"))
             .join(pages.select("page_id", url_filter.host(F.col("url")).alias("host")), "page_id"))
    domain = F.when(F.col("parent"), F.regexp_replace("host", r"^[^.]*\.(?=[^.]*\.[^.]*\.)", "")).otherwise(
        F.col("host"))
    judged = url_filter.listed(pages, edits.select("list", domain.alias("domain"), "at", "active"))
    return judged.select("page_id", "url", F.array_join("lists", ",").alias("lists"),
                         (F.size("lists") == 0).alias("allowed"))


@register
def op3_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, and the item."""
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("consistency", F.round("consistency", 6))


@register
def op4_token_store(spark, sf_dir):
    """Token ids of all documents, written to compressed files and read back."""
    manifest = token_store.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_store.read_documents(manifest)


@register
def op5_simhash(spark, sf_dir):
    """SimHash fingerprint and near-duplicate component of each document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op6_packing(spark, sf_dir):
    """All documents packed into sequences of at most 4 096 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


@register
def op7_warc(spark, sf_dir):
    """Pages written as WARC archives, normalised, and read back."""
    whole = warc.write_pages(table(spark, sf_dir, "pages"))
    return warc.read_archives(warc.normalise(whole, spark)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op8_pii(spark, sf_dir):
    """Spans of personal data in each document."""
    found = table(spark, sf_dir, "documents").select("doc_id", pii.pii(text_or_empty()).alias("p"))
    return found.select("doc_id", "p.n_email", "p.n_ip", "p.n_card", "p.n_phone",
                        F.sha2(F.col("p.base"), 256).alias("base_sha256"), "p.spans",
                        *[f"p.n_{k}" for k in pii.EXTRA_KINDS])


@register
def op9_line_dedup(spark, sf_dir):
    """Each document without cross-site boilerplate lines."""
    done = line_dedup.dedup(table(spark, sf_dir, "documents"), counts=True)
    return done.select("doc_id", "n_lines", "n_removed", "text")


@register
def op10_host_quality(spark, sf_dir):
    """Counts and verdict of each document."""
    judged = host_quality.judge(table(spark, sf_dir, "documents"), columns=["doc_id"])
    q = judged.columns[-1]
    return judged.select("doc_id", *[f"{q}.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@register
def op11_prefix_trie(spark, sf_dir):
    """Nodes of the trie of the conversations, rebuilt with shared starts."""
    seqs = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_starts(seqs)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The columns of a document that its leaf covers, in this order.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@register
def op12_merkle_manifest(spark, sf_dir):
    """Merkle proof of each document; where 7 divides the id's crc32, n_chars
    is tampered with (one more), and the root folded from the tampered leaf."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    altered = merkle.leaf(*[F.col("n_chars") + F.when(tampered, 1).otherwise(0) if c == "n_chars" else F.col(c)
                            for c in LEAF_COLUMNS])
    proven = merkle.manifest(table(spark, sf_dir, "documents"), LEAF_COLUMNS, carry={"altered": altered})
    return proven.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        merkle.folded(F.col("altered"), F.col("proof")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


@register
def op13_vector_dedup(spark, sf_dir):
    """Number of links and component of each vector."""
    return vector_dedup.near_groups(table(spark, sf_dir, "embeddings"))
