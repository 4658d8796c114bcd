"""Vector neighbours at size: few products are measured in doubles, a task per
pair of blocks, one first step for both answers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from uttermill.functions import unit
from uttermill.operators import vector_index


def unit_rows(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def plain(names, mine, visit, words, vecs, of, n):
    """Per name the (-cosine, word) of its n nearest."""
    sims = np.einsum("id,jd->ij", mine, vecs)
    return [sorted((-sims[i, j], words[j]) for j in range(len(words))
                   if visit[i, of[j]] and words[j] != names[i] and np.isfinite(sims[i, j]))[:n]
            for i in range(len(names))]


def rows(got, words, count):
    out = [[] for _ in range(count)]
    for r, c, sim in zip(*got):
        out[r].append((-sim, words[c]))
    return [sorted(x) for x in out]


def close(got, want):
    assert [[w for _, w in x] for x in got] == [[w for _, w in x] for x in want]
    assert all(np.allclose([s for s, _ in a], [s for s, _ in b], atol=1e-12) for a, b in zip(got, want))


@pytest.mark.parametrize("bounds", [(512, 1024, 1 << 18), (7, 13, 50), (16, 5, 1000)])
@pytest.mark.parametrize("copies", [0, 120])
def test_closest_of_a_block_is_that_of_all_pairs(monkeypatch, bounds, copies):
    for name, bound in zip(("ROWS", "COLS", "HELD"), bounds):
        monkeypatch.setattr(vector_index, name, bound)
    rng = np.random.default_rng(41)
    vecs = unit_rows(rng, 300, 6)
    of = rng.integers(0, 5, 300)
    vecs[:copies], of[:copies] = vecs[0], 2
    vecs[150] = np.nan
    words = [f"w{i}" for i in rng.permutation(300)]
    pick = rng.integers(0, 300, 80)
    names, mine, visit = [words[i] for i in pick[:70]] + [f"x{i}" for i in range(10)], vecs[pick], rng.random((80, 5)) < 0.6
    first = rows(vector_index.closest(pa.array(names), mine, visit, pa.array(words), vecs, of, 3), words, 80)
    close(first, plain(names, mine, visit, words, vecs, of, 3))
    least = np.array([-x[-1][0] if len(x) == 3 else np.nan for x in first])
    more = rows(vector_index.closest(pa.array(names), mine, ~visit, pa.array(words), vecs, of, 3, least), words, 80)
    assert all(-s >= l - 1e-9 for x, l in zip(more, least) for s, _ in x)
    close([sorted(a + b)[:3] for a, b in zip(first, more)], plain(names, mine, visit | True, words, vecs, of, 3))


def test_few_pairs_are_measured_in_doubles(monkeypatch):
    rng = np.random.default_rng(42)
    mine, vecs = unit_rows(rng, 400, 16), unit_rows(rng, 4000, 16)
    vecs[1000:2000] = vecs[0]  # copies: only the smallest words can be among the nearest
    of, visit = np.repeat(np.arange(4), 1000), np.ones((400, 4), dtype=bool)
    of[1000:2000] = 0
    words = [f"w{i:04}" for i in range(4000)]
    names, measured, einsum = [f"x{i}" for i in range(400)], [], np.einsum
    monkeypatch.setattr(vector_index.np, "einsum", lambda *a: measured.append(len(a[1])) or einsum(*a))
    got = rows(vector_index.closest(pa.array(names), mine, visit, pa.array(words), vecs, of, 3), words, 400)
    monkeypatch.undo()
    close(got, plain(names, mine, visit, words, vecs, of, 3))
    assert 3 * 400 <= sum(measured) < 0.02 * mine.shape[0] * vecs.shape[0]


@pytest.mark.parametrize("pairs", [4096, 1])
def test_words_in_tasks_of_one_pair_of_blocks(spark, monkeypatch, pairs):
    rng = np.random.default_rng(43)
    vecs = unit_rows(rng, 900, 5)
    vecs[::3] = 0.95 * vecs[1] + 0.3 * vecs[::3]
    vecs[400:500], vecs[20] = vecs[7], np.nan
    words = [f"w{i:03}" for i in range(900)]
    monkeypatch.setattr(vector_index, "BLOCK", 300)
    monkeypatch.setattr(vector_index, "PAIRS", pairs)
    index = vector_index.VectorIndex(spark.createDataFrame(list(zip(words, vecs.tolist())), "word string, vec array<double>"), lists=9)
    asked = index.members.select(F.col("_v").alias("_q"), "_vec")
    got = {}
    for r in index.nearest(asked, 3, probes=2).collect():
        got.setdefault(r._q, []).append((-r.sim, r.synonym))
    x = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    want = plain(words, x, np.ones((900, 1), dtype=bool), words, x, np.zeros(900, dtype=int), 3)
    for w, x in zip(words, want):
        assert np.allclose([s for s, _ in sorted(got.get(w, []))], [s for s, _ in x]), w
    assert [w for _, w in sorted(got["w450"])] == ["w007", "w400", "w401"]
    if pairs > 1:  # hashed pairs of blocks share partitions
        found = index.best(index.asked[3], 3)
        _, blocks = index.dealt(index.members, "_v", index.size, vector_index.BLOCK, "_b")
        assert found.rdd.getNumPartitions() == blocks ** 2


def test_unit_finds_the_length_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), (None,), ([],)], "vec array<double>").select(unit("vec").alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], None, []]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "/ SQRT" not in plan.upper()  # within the step of each element


def test_both_answers_take_one_first_step(spark, monkeypatch):
    rng = np.random.default_rng(44)
    df = spark.createDataFrame([(f"w{i}", v) for i, v in enumerate(unit_rows(rng, 300, 4).tolist())], "word string, vec array<double>")
    index, steps, best = vector_index.VectorIndex(df, lists=10), [], vector_index.VectorIndex.best

    def counted(self, *args, **more):
        steps.append(more)
        return best(self, *args, **more)

    monkeypatch.setattr(vector_index.VectorIndex, "best", counted)
    words = index.members.select(F.col("_v").alias("_q"), "_vec")
    some, all_ = index.nearest(words, 3, probes=2, exact=False), index.nearest(words, 3, probes=2)
    assert steps == [{}, {"rest": True}]
    assert 0 < vector_index.recall(some, all_) < 1 and all_.count() == 900
    fewer = words.where("_q < 'w2'")
    assert index.nearest(fewer, 3, probes=2).select("_q").distinct().count() == fewer.count()
    assert index.nearest(words, 2, probes=2).count() == 600
