"""Every registered query against a plain Python version (SQL oracles are
compared by the general oracle test)."""

import zlib
from collections import defaultdict

import pandas as pd
import pytest

import corpus_pipeline
from uttermill.llm.queries import QUERIES, tokenizer
from uttermill.session import prepare

from . import reference as ref


@pytest.fixture(scope="module")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


def rows(spark, sf, name):
    prepare(spark)
    return QUERIES[name](spark, sf).collect()


def test_op1(spark, sf, docs):
    got = sorted(tuple(r) for r in rows(spark, sf, "op1_suffix_dedup"))
    assert got == sorted(ref.substring_dedup(list(zip(docs.doc_id.tolist(), docs.text))))


def test_op3_exact_passages(spark, sf, docs):
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    truth = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, x in zip(items.item_id, items.text) if x in t}
    got = {(r.doc_id, r.item_id) for r in rows(spark, sf, "op3_decontamination")}
    assert truth and got == truth


def encoded(name, texts, end_id):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer(name))
    return [e.ids + [end_id] for e in t.encode_batch(list(texts), add_special_tokens=False)]


def test_op4(spark, sf, docs):
    docs = docs.sort_values("doc_id")
    want, start = [], 0
    for i, ids in zip(docs.doc_id.tolist(), encoded("byte_bpe_50k.json", docs.text, 0)):
        want.append((i, start, len(ids), ref.crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in rows(spark, sf, "op4_token_store")) == want


def test_op5(spark, sf, docs):
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows(spark, sf, "op5_simhash"))
    assert got == sorted(ref.near_groups(list(zip(docs.doc_id.tolist(), docs.text))))


def check_packing(pieces, ids_of, capacity=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids_of)
    for doc, ps in by_doc.items():
        ids, at = ids_of[doc], 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == ref.crc(ids[at:at + p.length])
            at += p.length
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == capacity or at < capacity and at & (at - 1) == 0  # no padding


def test_op6(spark, sf, docs):
    check_packing(rows(spark, sf, "op6_packing"),
                  dict(zip(docs.doc_id, encoded("word_bpe_49k.json", docs.text, 2))))


def test_op8(spark, sf, docs):
    import hashlib
    for r in rows(spark, sf, "op8_pii"):
        spans = ref.base_spans(docs.text[docs.doc_id == r.doc_id].iloc[0])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.spans.startswith(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]


def test_pipeline(spark, sf, docs):
    d = docs
    stay = ref.host_verdicts(list(zip(d.doc_id, d.source, d.text)))
    d = d[d.doc_id.isin(stay)]
    judged = {r.doc_id: r for r in rows(spark, sf, "op10_host_quality")}
    assert {i for i, r in judged.items() if r.kept} == stay
    d = d.assign(text=d.doc_id.map(ref.line_dedup(list(zip(d.doc_id, d.source, d.text)))))
    near = ref.near_groups(list(zip(d.doc_id.tolist(), d.text)))
    d = d[d.doc_id.isin([i for i, _, c in near if i == c])]
    items = pd.read_parquet(f"{sf}/benchmark.parquet").text
    d = d[[not any(x in t for x in items) for t in d.text]]
    got = corpus_pipeline.run(spark, sf).collect()
    check_packing(got, dict(zip(d.doc_id, encoded("word_bpe_49k.json", d.text, 2))))

