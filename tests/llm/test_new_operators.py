"""Prefix trie, Merkle manifest and vector near-duplicates against plain versions."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from pyspark.sql import functions as F
from uttermill.llm import merkle, prefix_trie, vector_dedup
from uttermill.session import prepare

from . import reference as ref

# --- trie -----------------------------------------------------------------------


def rebuilt(turns):
    """turns: (conv_id, turn, role, text) -> {conv_id: [(role, text)]}."""
    convs = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(ts, key=lambda v: v[:2])] for c, ts in convs.items()}
    out = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    return out


def plain_trie(turns):
    convs = rebuilt(turns)
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha256(
        ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items())


def trie_rows(spark, turns, shard_turns, parts=8):
    df = spark.createDataFrame([(*t, 1, "x") for t in turns],
                               "conv_id long, turn int, role string, text string, key int, turns string").repartition(4)
    seqs = prefix_trie.with_shared_starts(prefix_trie.sequences(df))
    got = prefix_trie.trie(seqs, shard_turns).select(
        "conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-1)), "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256")
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("shard_turns,seed", [(10**6, 1), (12, 2), (30, 3), (12, 4)])
def test_trie_over_shards(spark, shard_turns, seed):
    prepare(spark)
    rng = random.Random(seed)
    turns = []
    for c in rng.sample(range(400), 60):
        turns += [(c, t, rng.choice(["user", "bot"]), rng.choice(["é", "b", "cc"])) for t in range(rng.randint(1, 6))]
    turns += [(500 + 5 * i, t, "user", "same") for i in range(40) for t in range(9)]  # many copies over many shards
    turns += [(900, t, "user", f"long {t}") for t in range(700)]
    assert trie_rows(spark, turns, shard_turns) == plain_trie(turns)


def test_trie_odd_rows(spark):
    prepare(spark)
    turns = [(0, None, "user", "first"), (0, 1, None, None), (0, 1, None, None), (7, 3, "", ""), (8, 0, "a", "é" * 9000),
             (None, 0, "user", "no conversation"), (13, 0, "user", "x")]
    assert trie_rows(spark, turns, 2) == plain_trie(turns)
    assert trie_rows(spark, [], 2) == []


def test_findclose_against_a_stack():
    rng = np.random.default_rng(1)
    for n, up in ((1, 0.5), (600, 0.5), (40_000, 0.52), (9_000, 0.99)):
        bits, depth = [1], 1
        while len(bits) < 2 * n:
            step = 1 if depth == 1 or rng.random() < up else 0
            bits.append(step)
            depth += 2 * step - 1
        bits += [0] * depth
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        bp = prefix_trie.Parentheses(np.array(bits, dtype=np.uint8))
        assert bp.findclose(bp.opens).tolist() == [close[i] for i in bp.opens.tolist()]


# --- manifest -----------------------------------------------------------------------


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes, fanout):
    """(root, proofs) of digests in order; a proof is [(at, others)]."""
    proofs, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        new, members = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i:i + fanout]
            for k, g in enumerate(groups[i:i + fanout]):
                for leaf in g:
                    proofs[leaf].append((k, run[:k] + run[k + 1:]))
            new.append(h(*run))
            members.append([x for g in groups[i:i + fanout] for x in g])
        nodes, groups = new, members
    return nodes[0], proofs


def plain_manifest(rows, fanout):
    """rows: (id, group, text) -> sorted (id, leaf, subroot, root, proof)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, h(*map(field, r)), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in order]
    root, tops = plain_tree([t[0] for t in trees], fanout)
    out = []
    for g, (sub, proofs), top in zip(order, trees, tops):
        for x, p in zip(sorted(groups[g], key=lambda x: x[:3]), proofs):
            out.append((str(x[3]), x[2], sub, root, str(p + top)))
    return sorted(out)


@pytest.mark.parametrize("fanout,leaves,seed", [(2, 1, 1), (2, 4, 2), (3, 9, 3), (5, 5, 4), (2, 4096, 5)])
def test_manifest_against_plain(spark, fanout, leaves, seed):
    prepare(spark)
    rng = random.Random(seed)
    sizes = {None: 3, "de": 1, "en": 90, "é": 17, "z": 2, "fr": 33, "": 5}
    rows = [(i if rng.random() < 0.95 else None, g, rng.choice(["a", None, "", "ü"])) for g, n in sizes.items()
            for i in rng.sample(range(1000), n)]
    rows += rows[:4]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, lang string, text string, part int").repartition(3)
    got = merkle.manifest(df, ["doc_id", "lang", "text"], fanout=fanout, partition_leaves=leaves,
                          carry={"at": F.length("text")})
    found = got.withColumn("ok", merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).collect()
    assert all(r.ok for r in found)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, str([(x.at, list(x.others)) for x in r.proof]))
                  for r in found) == plain_manifest(rows, fanout)
    assert merkle.manifest(df.limit(0), ["doc_id", "lang", "text"]).collect() == []
    one = merkle.manifest(df.limit(1), ["doc_id", "lang", "text"]).collect()
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof == []


def test_a_changed_column_breaks_the_proof(spark, sf):
    prepare(spark)
    from uttermill.llm.queries import QUERIES
    rows = QUERIES["op12_merkle_manifest"](spark, sf).collect()
    assert {r.doc_id for r in rows if not r.verified} == {r.doc_id for r in rows if crc32(str(r.doc_id).encode()) % 7 == 0}
    assert len({r.root for r in rows}) == 1


# --- vectors ------------------------------------------------------------------------


def plain_links(vectors, cosine=0.9):
    """(n_links, smallest index reachable) of each vector; None links with nothing."""
    n, u = len(vectors), []
    for v in vectors:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        u.append(np.array(v, dtype=float) / np.linalg.norm(v) if ok else None)
    near = [[j for j in range(n) if j != i and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j])
             and u[i] @ u[j] >= cosine] for i in range(n)]
    return [len(x) for x in near], ref.groups(n, lambda i, j: j in near[i])


def vector_rows(spark, vectors, kind="float", **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)],
                               f"vec_id long, embedding array<{kind}>, n int, root string").repartition(3)
    got = sorted(vector_dedup.near_groups(df, **options).collect(), key=lambda r: r.vec_id)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return [r.n_links for r in got], [r.component_id for r in got]


@pytest.mark.parametrize("options", [{}, {"reach": None}, {"block": 40}, {"sample": 30, "max_lists": 5, "block": 25}])
def test_vectors_against_all_pairs(spark, options):
    prepare(spark)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 60, 240)] + rng.normal(size=(240, 16)) * rng.choice([0.05, 0.2, 0.35], (240, 1))
    hot = np.repeat(base[:1], 40, axis=0) * rng.uniform(0.5, 2, (40, 1))  # one direction
    vectors = [v.tolist() for v in np.concatenate([base, near, hot, near[:30]]).astype(np.float32)]
    assert vector_rows(spark, vectors, **options) == plain_links(vectors)


def test_recall_at_the_threshold(spark):
    """Random pairs at cosines from 0.9 to 0.92 among random vectors: at least 0.99 of all links are found."""
    prepare(spark)
    rng = np.random.default_rng(5)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    w = rng.normal(size=a.shape)
    w -= (w * a).sum(axis=1)[:, None] * a
    w /= np.linalg.norm(w, axis=1)[:, None]
    c = rng.uniform(0.9, 0.92, (len(a), 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * w])
    x = x[rng.permutation(len(x))]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T >= 0.9).sum(axis=1) - 1)
    got = np.array(vector_rows(spark, x.tolist(), "double")[0])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_vectors_odd_rows(spark):
    prepare(spark)
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [2.0, 0.0], None, [0.0, 0.0], [nan, 1.0], [1.0, inf], [1.0, None], [], [1.0, 0.0, 0.0],
               [1e-30, 1e-31], [1e30, 0.0], [-0.0, 1.0], [0.0, 1.0], [1.0], [3.0], [-1.0]]
    assert vector_rows(spark, vectors) == plain_links(vectors)
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.1]), (None, [0.0, 1.0]), (5, [1.0, 0.1])],
                               "vec_id long, embedding array<double>")
    got = sorted(map(str, vector_dedup.near_groups(df).collect()))
    assert got == sorted(["Row(vec_id=None, n_links=2, component_id=5, kept=False)",
                          "Row(vec_id=5, n_links=2, component_id=5, kept=True)",
                          "Row(vec_id=5, n_links=2, component_id=5, kept=True)",
                          "Row(vec_id=None, n_links=0, component_id=None, kept=True)"])
    assert vector_dedup.near_groups(df.limit(0)).collect() == []
    assert vector_dedup.near_groups(df.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).count() == 4


def test_codes_lose_no_pair():
    rng = np.random.default_rng(8)
    x = vector_dedup.unit(np.concatenate([rng.normal(size=(300, 24)), rng.normal(size=(1, 24)) + rng.normal(size=(200, 24)) * 0.2]))
    index = vector_dedup.Index(x[::3], 6)
    home, code, error, visits = index.place(x, np.sqrt(1 - 0.81))
    cosines = x @ x.T
    for which in range(6):
        m = np.flatnonzero(home == which)
        found = set()
        for a, b in vector_dedup.candidates(index, which, x, code[m], error[m], 0.9):
            found |= set(zip(a.tolist(), m[b].tolist()))
        assert {(i, j) for i in range(len(x)) for j in m.tolist() if cosines[i, j] >= 0.9} <= found
        assert all(which in visits[i] for i in range(len(x)) for j in m.tolist()
                   if cosines[i, j] >= 0.9 and home[i] >= which)
