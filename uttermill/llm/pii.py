"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass (at-signs,
plus signs, digits, URL schemes, identifier cues); a deterministic parser for
each kind expands an anchor to its boundaries and validates it. Parsers read
whole texts; positions are code points, end exclusive.

Base kinds are email, ip, card and phone. The method adds url (credentials in
a URL), iban (check digits after the cue), account (digits after the cue) and
secret: values assigned to a name that ends in token, secret, key, password or
the like (quoted, or unquoted with a digit), bearer tokens, keys with a known
prefix and private key blocks.

A null text has no spans; repeated rows are handled one by one; an empty table
gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("url", "iban", "account", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS
#: Cues (compared in lower case) that open an identifier.
CUES = {"://": "url", "iban": "iban", "account": "account", "acct": "account"}
#: Names to which a secret is assigned, and known openings of secrets (fixed values, lower case).
SECRET_NAMES = ("token", "secret", "api_key", "api-key", "apikey", "access_key", "private_key", "client_key",
                "password", "passwd", "pwd")
SECRET_OPENINGS = ("akia", "asia", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "aiza",
                   "eyj", "bearer ", "-----begin ")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USERINFO = re.compile(r"://([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[:\s]{0,3}([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:\s?(?:no|number|nr)\.?)?[:#\s]{1,3}([0-9]{8,17})(?![0-9A-Za-z])", re.I)
PASSWORD = re.compile(r"=([^\s,;&\"']{6,})")
ASSIGNED = re.compile(r"""["']?\s{0,3}(?::=|=>|[:=])\s{0,3}(?:"(?P<a>[^"\s]{8,})"|'(?P<b>[^'\s]{8,})'"""
                      r"""|(?P<c>(?=[^\s"',;&]*[0-9])[^\s"',;&]{12,}))""")
OPENED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:gh[pos]_|github_pat_)[A-Za-z0-9_]{20,}"
                    r"|glpat-[A-Za-z0-9_-]{20,}|xox[bp]-[A-Za-z0-9-]{20,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}"
                    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")
BEARER = re.compile(r"[Bb]earer ([A-Za-z0-9._~+/-]{16,}=*)")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]+-----END [A-Z ]*PRIVATE KEY-----)?")

_AUTOMATON = None


def automaton():
    """One automaton a Python worker, over text whose A-Z are lower-cased."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick
        a = ahocorasick.Automaton()
        for cue, kind in CUES.items():
            a.add_word(cue, (kind, len(cue)))
        for cue in SECRET_NAMES + SECRET_OPENINGS:
            a.add_word(cue, ("secret", len(cue)))
        a.add_word("@", ("email", 1))
        a.add_word("+", ("phone", 1))
        for d in "0123456789":
            a.add_word(d, ("digit", 1))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid_iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def match_iban(text: str, at: int) -> re.Match | None:
    """The longest run of groups after the cue whose check digits hold; groups
    of an upper-case word behind it are left off."""
    m = IBAN.match(text, at)
    while m and not valid_iban(m[1]):
        cut = m[1].rfind(" ")
        m = IBAN.match(text, at, m.start(1) + cut) if cut > 0 else None
    return m


def match_secret(text: str, at: int, size: int) -> tuple[int, int] | None:
    """The secret behind a name, or the one that opens here."""
    cue = text[at:at + size].lower()
    if cue in SECRET_NAMES:
        m = ASSIGNED.match(text, at + size)
        if m:
            return m.span(m.lastgroup)
        m = PASSWORD.match(text, at + size) if cue == "password" else None
        return m.span(1) if m else None
    if at and text[at - 1].isalnum() and text[at - 1].isascii():
        return None  # inside a word
    if cue == "bearer ":
        m = BEARER.match(text, at)
        return m.span(1) if m else None
    m = (KEY_BLOCK if cue[0] == "-" else OPENED).match(text, at)
    return m.span() if m else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of KINDS, then by start."""
    text = text or ""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(("email", "ip", "card", "phone", "url", "iban", "account", "secret"), 0)
    for last, (kind, size) in automaton().iter(text.translate(_LOWER)):
        at = last - size + 1
        if kind == "digit":
            if at >= done["ip"]:
                if m := IP.match(text, at):
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                        found["ip"].append(m.span())
                else:
                    done["ip"] = DIGITS.match(text, at).end()
            if at >= done["card"]:
                if m := CARD.match(text, at):
                    done["card"] = m.end()
                    number = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(number) <= 19 and luhn(number):
                        found["card"].append(m.span())
                else:
                    done["card"] = at + 1
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                done["email"] = m.end()
        elif kind == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    found["phone"].append(m.span())
        elif kind == "secret":
            if at >= done["secret"] and (span := match_secret(text, at, size)):
                found["secret"].append(span)
                done["secret"] = span[1]
        elif at >= done[kind]:
            if kind == "url":
                m, group = USERINFO.match(text, at), 1
            elif kind == "iban":
                m, group = match_iban(text, at + size), 1
            else:
                m, group = ACCOUNT.match(text, at + size), 1
            if m:
                found[kind].append(m.span(group))
                done[kind] = m.end()
    return [(k, s, e) for k in KINDS for s, e in found[k]]


PII_TYPE = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
                        + [T.StructField(c, T.StringType()) for c in ("base", "spans")])


def _row(text) -> tuple:
    spans = find_spans(text)
    joined = [f"{k}:{s}:{e}" for k, s, e in spans]
    n_base = sum(k in BASE_KINDS for k, _, _ in spans)
    return (*[sum(x[0] == k for x in spans) for k in KINDS], ",".join(joined[:n_base]), ",".join(joined))


@pandas_udf(PII_TYPE)
def _pii(text: pd.Series) -> pd.DataFrame:
    names = [f"n_{k}" for k in KINDS]
    out = pd.DataFrame([_row(t) for t in text], columns=[*names, "base", "spans"])
    return out.astype(dict.fromkeys(names, "int64"))


def pii(text: Column) -> Column:
    """Struct of counts by kind, ``base`` (base spans as kind:start:end, comma
    joined) and ``spans`` (all spans, joined likewise)."""
    return _pii(text)


@pandas_udf(T.StringType())
def _masked(text: pd.Series) -> pd.Series:
    def mask(t):
        out, at = [], 0
        for k, s, e in sorted(find_spans(t), key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += [t[at:s], f"<{k}>"]
                at = e
            elif e > at:  # overlaps an earlier span: that one's mark stands for both
                at = e
        return "".join(out) + (t or "")[at:]
    return text.map(mask)


def masked(text: Column) -> Column:
    """The text with each span replaced by ``<kind>``."""
    return _masked(text)
