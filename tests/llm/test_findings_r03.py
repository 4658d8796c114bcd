"""Steps that the check of round 3 found too slow: what they must not do, and that their results stay."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from uttermill.llm import suffix_dedup, tokens, warc
from uttermill.llm.queries import tokenizer
from uttermill.session import prepare

BOTH = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def library_ids(name, texts):
    from tokenizers import Tokenizer
    return [x.ids for x in Tokenizer.from_file(tokenizer(name)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,spaces", BOTH)
def test_pieces_of_two_batches_are_learned_once(monkeypatch, name, spaces):
    monkeypatch.setattr(tokens, "MEMORY", 300)
    coder = tokens.WordCoder(tokenizer(name), spaces)
    learned, learn = Counter(), coder._learn
    monkeypatch.setattr(coder, "_learn", lambda new: (learned.update(new.to_pylist()), learn(new)))
    for k in range(8):
        texts = [f"common words, stay. {'x' * j}rare{k}q{j}!! a\tb\nnewly" for j in range(120)] + ["", "\n", " "]
        assert [x.tolist() for x in coder.encode(texts)] == library_ids(name, texts)
        assert len(coder.known) <= 300 + 300
    assert learned["words,"] == learned["stay."] == 1
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 100)
    assert [x.tolist() for x in coder.encode(texts * 2)] == library_ids(name, texts * 2)


@pytest.mark.parametrize("name,spaces", BOTH)
def test_ids_of_words_before_symbols(name, spaces):
    rng = random.Random(3)
    words = ["Word", "\xc4rger", "\xf1and\xfa", "don't", "x", "\xdfen", "1a", "\xb5m"]
    marks = ["", "", ".", ",", ".%%%", "***", "!!", "'", "'s", "_", "~|", "<|", "]\\", "--'", "\"", "`^", "—"]
    texts = ["".join(rng.choice(words) + rng.choice(marks) + rng.choice([" ", " ", "\n", "", "\n\n"])
                     for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    coder = tokens.WordCoder(tokenizer(name), spaces)
    ids, sizes = coder.encode_flat(pa.array(texts))
    want = library_ids(name, texts)
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    # words before a run of symbols go straight to the merges, with the plain ones
    whole, encode_whole = [], coder.encode_whole
    coder._forget()
    coder.encode_whole = lambda text: (whole.append(text), encode_whole(text))[1]
    coder.encode(["a word.%%% and\nanother%%% Yes*** no,"])
    assert not any("%%%" in text for text in whole)


def test_store_of_many_segments(spark):
    from uttermill.llm import token_store
    prepare(spark)
    rows = [(i if i % 50 else None, f"text {i} " * (i % 90) or None) for i in range(400)]
    manifest = token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                                 tokenizer("byte_bpe_50k.json"), 0, segment_ids=1000)
    want = Counter((i, tuple(ids) + (0,)) for (i, _), ids in zip(
        rows, library_ids("byte_bpe_50k.json", [t or "" for _, t in rows])))
    assert Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_ids(manifest).collect()) == want
    got = sorted(token_store.read_documents(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_copies_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 400, np.uint8)
    text = np.concatenate([np.append(passage, rng.integers(65, 91, 60, np.uint8)) for _ in range(60)])
    at = np.flatnonzero(np.arange(len(text)) % 460 < 350)  # windows of 50 bytes within the copies
    words = suffix_dedup.words_at(text, ">")
    sorted_rows = []

    def counted(sort, rows):
        return lambda x, *a, **k: (sorted_rows.append(rows(x)), sort(x, *a, **k))[1]

    with monkeypatch.context() as m:
        m.setattr(np, "argsort", counted(np.argsort, len))
        m.setattr(np, "lexsort", counted(np.lexsort, lambda keys: len(keys[0])))
        suffix_dedup.sort_directly(at, words, 50)
    assert sum(sorted_rows) <= 1.1 * len(at)


@pytest.mark.parametrize("letters,depth", [(2, 28), (3, 50), (26, 50)])
def test_direct_sort_of_ties(letters, depth):
    rng = np.random.default_rng(letters)
    text = np.tile(rng.integers(97, 97 + letters, 700, np.uint8), 3)
    text[rng.integers(0, len(text), 40)] = 65
    at = rng.permutation(len(text))[:1500]
    data = text.tobytes() + bytes(64)
    got = [data[i:i + depth] for i in suffix_dedup.sort_directly(at, suffix_dedup.words_at(text, ">"), depth)]
    assert got == sorted(data[i:i + depth] for i in at)
    at = np.sort(at)
    owner = rng.integers(0, 99, len(at))
    least = {}
    for i, o in zip(at.tolist(), owner.tolist()):
        least[data[i:i + depth]] = min(o, least.get(data[i:i + depth], o))
    assert suffix_dedup.smallest_owner(text, at, owner, depth).tolist() == [least[data[i:i + depth]] for i in at]


WARC_ROWS = [(i if i % 9 else None, f"http://h{i}.example/\xfc", "<p>\xe9\U0001f600" * (i % 5) + f"{i % 40}" * (i % 3))
             for i in range(300)] + [(7, "u", "other"), (7, "u", None), (8, None, "")]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("min_bytes", [0, 3])
def test_revisits_on_both_joins(spark, monkeypatch, broadcast, min_bytes):
    prepare(spark)
    if not broadcast:
        monkeypatch.setattr(warc, "broadcast_if_small", lambda df: df)
    pages = spark.createDataFrame(WARC_ROWS, "page_id long, url string, html string").repartition(4)
    out = warc.read_archives(warc.normalise(warc.write_pages(pages, min_bytes=min_bytes), spark)).collect()
    least, want = {}, Counter()
    for i, _, t in WARC_ROWS:
        least[t or ""] = min(least.get(t or "", 2**63 - 1), 2**63 - 1 if i is None else i)
    for i, _, t in WARC_ROWS:
        body = (t or "").encode()
        again = len(body) >= min_bytes and least[t or ""] != (2**63 - 1 if i is None else i)
        want[(i, len(body), warc.base32_sha1(body), "revisit" if again else "response",
              least[t or ""] if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want


def test_payloads_are_digested_once_before_they_move(spark, monkeypatch, tmp_path):
    """The digests are written once; neither they nor the sample for the ranges read them off the payloads again."""
    prepare(spark)
    names, write = [], warc.written

    def noted(df, name):
        names.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("sha1(")))
        return write(df, name)

    monkeypatch.setattr(warc, "written", noted)
    spark.createDataFrame(WARC_ROWS, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    warc.write_pages(spark.read.parquet(f"{tmp_path}/pages"))
    assert names == [("warc-digests", 1), ("warc-revisits", 0)]
