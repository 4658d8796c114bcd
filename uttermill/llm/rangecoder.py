"""Adaptive context-mixing range coder for token ids, many blocks at a time.

A segment holds the ids of consecutive documents in blocks of equal length.
Each block has its own state, reset at its start, so any block can be decoded
alone; a crc32 of its ids checks it. Three predictions are mixed for every id:

* order 2: the id that last followed this pair of ids in the block,
* order 1: the id that last followed this id in the block,
* order 0: the id frequencies of the segment, kept in its header.

The weights of the orders are probabilities that adapt in each block, by how
often the order-2 prediction has held and whether order 1 agrees. The mixture
gives the id's interval of a carry-less range coder (64-bit state, 32-bit
words). The blocks of a segment are the lanes of numpy arrays: one step codes
one id of every block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
LANES = 4096
CLASS_BITS, ID_BITS = 12, 20
_U = np.uint64
_WORD = _U(2**32 - 1)
MAGIC = b"UMIDS001"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2^ID_BITS, at least one for each id that occurs."""
    total = 1 << ID_BITS
    n = max(1, int(counts.sum()))
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.int64) * (total - np.count_nonzero(counts)) // n + 1), 0)
    over = int(f.sum()) - total
    if over > 0:  # take what is too much from the most frequent ids
        for i in np.argsort(-f, kind="stable"):
            cut = min(over, int(f[i]) - 1)
            f[i] -= cut
            over -= cut
            if not over:
                break
    elif over < 0:
        f[np.argmax(f)] -= over
    return f


class _Lanes:
    """State of all blocks of a segment, and the mixture of their next ids."""

    #: What a weight moves to (of 2^16) when its order is right or wrong, so
    #: that every share of 2^CLASS_BITS stays above zero.
    RIGHT, WRONG = 63_900, 48

    def __init__(self, lanes: int, block: int):
        bits = max(4, int(block - 1).bit_length())
        self.base = np.arange(lanes, dtype=np.int64) << bits
        self.mask = (1 << bits) - 1
        self.seen1 = np.zeros(lanes << bits, np.int32)  # id + 1, 0 for none
        self.seen2 = np.zeros(lanes << bits, np.int32)  # and above bit 17 how often it held in a row
        self.contexts = np.arange(lanes, dtype=np.int64) * 8
        self.hold2 = np.full(lanes * 8, 1 << 14, np.int64)
        self.hold1 = np.full(lanes * 8, 1 << 13, np.int64)
        self.id1 = np.zeros(lanes, np.int64)
        self.id2 = np.zeros(lanes, np.int64)

    def predict(self):
        """Predictions (id + 1) of order 2 and 1, and the shares of 2^CLASS_BITS
        that go to order 2, to order 1 and to order 0."""
        self.at1 = self.base + (self.id1 * 40503 >> 4 & self.mask)
        self.at2 = self.base + (self.id1 * 60493 + self.id2 * 33391 >> 3 & self.mask)
        p1, e2 = self.seen1.take(self.at1), self.seen2.take(self.at2)
        p2 = e2 & 0x1FFFF
        self.held = e2 >> 17
        self.ctx = self.contexts + (self.held * 2 + (p1 == p2))
        self.w2, self.w1 = self.hold2.take(self.ctx), self.hold1.take(self.ctx)
        a = self.w2 >> 4
        left = 4096 - a
        b = (left * self.w1 >> 16) + 1
        return p1, p2, a.view(np.uint64), b.view(np.uint64), (left - b).view(np.uint64)

    def update(self, ids, next_ids, hit1, at_hit2):
        """``ids`` and ids + 1 (as stored), the lanes' order-1 hits, and the
        numbers of the lanes with order-2 hits."""
        new2 = self.w2 + (self.WRONG - self.w2 >> 5)
        new1 = self.w1 + (hit1 * (self.RIGHT - self.WRONG) + self.WRONG - self.w1 >> 5)
        if len(at_hit2):
            w = self.w2[at_hit2]
            new2[at_hit2] = w + (self.RIGHT - w >> 5)
            new1[at_hit2] = self.w1[at_hit2]
        self.hold2[self.ctx] = new2
        self.hold1[self.ctx] = new1
        self.seen1[self.at1] = next_ids
        self.seen2[self.at2] = next_ids
        if len(at_hit2):
            self.seen2[self.at2[at_hit2]] += np.minimum(self.held[at_hit2] + 1, 3) << 17
        self.id2, self.id1 = self.id1, ids


def _intervals(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return f.astype(np.uint64), (np.cumsum(f) - f).astype(np.uint64)


class _Range:
    """Intervals of the range coder: a 64-bit low end and a range, of which a
    32-bit word leaves whenever the range is below 2^32 (if the interval then
    straddles a word boundary it is cut there, so no carry can occur)."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.size = np.full(lanes, 2**64 - 1, np.uint64)

    def narrow(self, unit, start, size):
        """Takes the interval; the lanes whose top word is settled, and those words."""
        self.low += start * unit
        self.size = size * unit
        go = np.flatnonzero(self.size <= _WORD)
        low, rng = self.low[go], self.size[go]
        cut = (low ^ (low + rng)) > _WORD
        rng = np.where(cut, (~low + _U(1)) & _WORD, rng)
        self.low[go] = low << _U(32)
        self.size[go] = rng << _U(32)
        return go, low >> _U(32)


def encode_blocks(ids: np.ndarray, f: np.ndarray) -> list[bytes]:
    """The code of each row of ``ids`` (lanes, block); ``f``: frequencies()."""
    lanes, block = ids.shape
    freq, cum = _intervals(f)
    state, coder = _Lanes(lanes, block), _Range(lanes)
    out, at = np.zeros((lanes, block + 2), np.uint32), np.zeros(lanes, np.int64)
    flat, rows = out.reshape(-1), np.arange(lanes, dtype=np.int64) * (block + 2)
    shift = _U(ID_BITS)
    columns = np.ascontiguousarray(ids.T)
    with np.errstate(over="ignore"):
        for column in columns:
            x, stored = column.astype(np.int64), column.astype(np.int32) + np.int32(1)
            p1, p2, a, b, rest = state.predict()
            hit2 = np.flatnonzero(p2 == stored)
            hit1 = p1 == stored
            hit1[hit2] = False
            start, size = ((a + b) << shift) + rest * cum.take(x), rest * freq.take(x)
            if len(hit2):
                start[hit2] = 0
                size[hit2] = a[hit2] << shift
            one = np.flatnonzero(hit1)
            if len(one):
                start[one] = a[one] << shift
                size[one] = b[one] << shift
            go, word = coder.narrow(coder.size >> _U(32), start, size)
            flat[rows[go] + at[go]] = word
            at[go] += 1
            state.update(x, stored, hit1, hit2)
    every = np.arange(lanes)
    for part in (coder.low >> _U(32), coder.low & _WORD):
        out[every, at] = part
        at += 1
    return [out[i, :at[i]].astype("<u4").tobytes() for i in range(lanes)]


def decode_blocks(codes: list[bytes], block: int, f: np.ndarray) -> np.ndarray:
    """Inverse of encode_blocks for any blocks of one segment."""
    lanes = len(codes)
    freq, cum = _intervals(f)
    slots = np.repeat(np.arange(len(f), dtype=np.uint16), f)
    width = max(map(len, codes)) // 4 + 2
    words = np.zeros((lanes, width), np.uint64)
    for i, c in enumerate(codes):
        words[i, :len(c) // 4] = np.frombuffer(c, "<u4")
    flat, rows = words.reshape(-1), np.arange(lanes, dtype=np.int64) * width
    code = (words[:, 0] << _U(32)) | words[:, 1]
    at = np.full(lanes, 2, np.int64)
    state, coder = _Lanes(lanes, block), _Range(lanes)
    out = np.zeros((block, lanes), np.uint16)
    shift, top = _U(ID_BITS), (1 << ID_BITS) - 1
    with np.errstate(over="ignore"):
        for t in range(block):
            p1, p2, a, b, rest = state.predict()
            unit = coder.size >> _U(32)
            v = np.minimum((code - coder.low) // unit, _WORD)
            from0 = (a + b) << shift
            other = v >= from0
            slot = ((v - from0) * other).astype(np.float64) / rest  # exact: 32 bits over 12
            x = slots.take(np.minimum(slot.astype(np.int64), top)).astype(np.int64)
            known = np.flatnonzero(~other)
            second = v[known] < a[known] << shift
            hit2, one = known[second], known[~second]
            hit1 = np.zeros(lanes, bool)
            hit1[one] = True
            x[hit2] = p2[hit2] - 1
            x[one] = p1[one] - 1
            start, size = from0 + rest * cum.take(x), rest * freq.take(x)
            if len(known):
                start[hit2] = 0
                size[hit2] = a[hit2] << shift
                start[one] = a[one] << shift
                size[one] = b[one] << shift
            go, _ = coder.narrow(unit, start, size)
            code[go] = (code[go] << _U(32)) | flat[rows[go] + np.minimum(at[go], width - 1)]
            at[go] += 1
            state.update(x, (x + 1).astype(np.int32), hit1, hit2)
            out[t] = x
    return np.ascontiguousarray(out.T)


# --- segments ---------------------------------------------------------------

def _packed(a: np.ndarray) -> bytes:
    z = zlib.compress(a.tobytes(), 6)
    return struct.pack("<I", len(z)) + z


def pack_segment(names: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: documents' int64 names and token counts, and all their ids
    in a row (16 bits). Layout: magic, body length, counts (documents, ids,
    block length, ids of the vocabulary part); zlib tables of names, counts,
    frequencies; then for each block its code length and crc32; then the codes."""
    n = len(ids)
    block = int(min(BLOCK, max(256, -(-n // LANES))))
    lanes = -(-n // block)
    padded = np.zeros(lanes * block, np.uint16)
    padded[:n] = ids
    f = frequencies(np.bincount(padded, minlength=1))
    codes = encode_blocks(padded.reshape(lanes, block), f) if n else []
    crcs = [zlib.crc32(ids[i * block:(i + 1) * block].astype("<u4").tobytes()) for i in range(lanes)]
    index = np.array([[len(c), k] for c, k in zip(codes, crcs)], dtype="<u4").reshape(-1, 2)
    body = b"".join([struct.pack("<QQII", len(names), n, block, len(f)), _packed(names.astype("<i8")),
                     _packed(sizes.astype("<u8")), _packed(f.astype("<u4")), _packed(index), *codes])
    return MAGIC + struct.pack("<Q", len(body)) + body


def read_segment(stream) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The next segment's names, counts and ids; None at the end of the file.
    A block whose ids do not have its crc32 raises ValueError."""
    head = stream.read(len(MAGIC) + 8)
    if not head:
        return None
    if head[:len(MAGIC)] != MAGIC:
        raise ValueError("not a segment")
    body = stream.read(struct.unpack("<Q", head[len(MAGIC):])[0])
    docs, n, block, width = struct.unpack_from("<QQII", body)
    at = struct.calcsize("<QQII")
    tables = []
    for kind in ("<i8", "<u8", "<u4", "<u4"):
        size, = struct.unpack_from("<I", body, at)
        tables.append(np.frombuffer(zlib.decompress(body[at + 4:at + 4 + size]), kind))
        at += 4 + size
    names, sizes, f, index = tables
    codes = []
    for size, _ in index.reshape(-1, 2).tolist():
        codes.append(body[at:at + size])
        at += size
    ids = decode_blocks(codes, block, f.astype(np.int64)).reshape(-1)[:n] if codes else np.zeros(0, np.uint16)
    for i, (_, crc) in enumerate(index.reshape(-1, 2).tolist()):
        if zlib.crc32(ids[i * block:(i + 1) * block].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    assert len(names) == docs and len(f) == width
    return names, sizes, ids
