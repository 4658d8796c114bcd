"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def substring_dedup(rows, length=50):
    """rows: (doc_id, text); ids distinct."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, words=4):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + words]) for i in range(max(1, len(ws) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_groups(rows, bits=4):
    """[(doc_id, fingerprint, component)]; ids distinct."""
    fps = [simhash(t) for _, t in rows]
    root = groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= bits)
    least = defaultdict(list)
    for r, (i, _) in zip(root, rows):
        least[r].append(i)
    return [(i, f, min(least[r])) for (i, _), f, r in zip(rows, fps, root)]


def luhn(number):
    d = [int(c) for c in number][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        n = re.sub("[ -]", "", m[0])
        if 16 <= len(n) <= 19 and luhn(n):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                  if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def quality_counts(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    rep = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def host_verdicts(rows, habit=0.05):
    """rows: (doc_id, host, text) -> ids of the documents that stay."""
    counts = {i: quality_counts(t) for i, _, t in rows}
    lines = {i: sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n")) for i, _, t in rows}
    breaks = {i: {"symbols": c[2] > 0.1 * c[0], "dup_lines": c[3] > 0.3 * lines[i],
                  "word_length": not 3 <= c[1] / max(c[0], 1) <= 10} for i, c in counts.items()}
    hosts = defaultdict(list)
    for i, h, _ in rows:
        hosts[h].append(i)
    bad = set()
    for r in ("symbols", "dup_lines", "word_length"):
        rates = {h: sum(breaks[i][r] for i in ids) / len(ids) for h, ids in hosts.items()}
        m = sum(rates.values()) / len(rates)
        v = sum((x - m) ** 2 for x in rates.values()) / len(rates)
        k = min(1000, max(1, m * (1 - m) / v - 1)) if v > 0 else 1000
        for h, ids in hosts.items():
            p = (rates[h] * len(ids) + m * k) / (len(ids) + k)
            if p - (p * (1 - p) / (len(ids) + k + 1)) ** 0.5 >= habit:
                bad.add((h, r))
    return {i for i, h, _ in rows if counts[i][0] >= 50 and 100 * counts[i][4] <= 50 * counts[i][0]
            and not any(breaks[i][r] and (h, r) in bad for r in breaks[i])}


def line_dedup(rows, min_sites=10):
    """rows: (doc_id, source, text), distinct ids -> {doc_id: text}."""
    blanks = " \t\x0b\x0c\r"
    sites, first = defaultdict(set), {}
    for i, s, t in sorted(rows, key=lambda r: r[0]):
        for p, line in enumerate((t or "").split("\n")):
            if x := line.strip(blanks):
                sites[x].add(s)
                first.setdefault(x, (i, p))
    out = {}
    for i, s, t in rows:
        keep = [line for p, line in enumerate((t or "").split("\n"))
                if len(sites.get(line.strip(blanks), ())) < min_sites or first[line.strip(blanks)] == (i, p)]
        out[i] = None if t is None else "\n".join(keep)
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
