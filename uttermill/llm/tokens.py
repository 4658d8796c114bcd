"""Token ids of whole texts with the tokenizers library, word by word.

Both public vocabularies split a text at white space before any merge, so the
ids of a text are those of its pieces in a row. Each distinct piece is encoded
once and kept, as an Arrow array with its ids, in a bounded memory of the
worker, so that pieces never become Python strings one by one; texts in which a
split could change the result (white space next to a space or newline or at
the start, or the literal of an added token such as "<|endoftext|>", which has
an id of its own) are encoded whole.
"""

from __future__ import annotations

import re
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers, and bytes of them and their ids; beyond that
#: it keeps those found in two batches or more, if they are less than half of it.
MEMORY, MEMORY_BYTES = 2_000_000, 128 << 20

#: The characters that stand for bytes in byte-level vocabularies: printable
#: Latin-1 bytes for themselves, the others for U+0100 and up, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _PRINTABLE]
BYTE_CHARS = {**{b: chr(b) for b in _PRINTABLE}, **{b: chr(256 + i) for i, b in enumerate(_OTHER)}}

_LOADED: dict[str, "WordCoder"] = {}


def coder(path: str, spaces_count: bool) -> "WordCoder":
    """One coder a worker and vocabulary file. ``spaces_count``: white space
    belongs to the tokens (byte-level vocabulary); else it is dropped."""
    if path not in _LOADED:
        _LOADED[path] = WordCoder(path, spaces_count)
    return _LOADED[path]


#: One Latin word, perhaps behind a newline or before a run of symbols (one pre-token; not the apostrophe, which may
#: open a contraction). These letters (below U+0250, without U+0130) are in NFC and have one lower case each.
LETTERS = "[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+"
SYMBOLS = r"[!-&(-/:-@\[-`{-~]+"
#: What the library's pre-tokenizer makes of each byte; 0 becomes the blank that separates pre-tokens here.
BYTE_TABLE = " " + "".join(BYTE_CHARS[b] for b in range(1, 256))


class WordCoder:
    def __init__(self, path: str, spaces_count: bool):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaces_count = spaces_count
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        self.plain = f"^{r'\n?' if spaces_count else ''}{LETTERS}({SYMBOLS})?$"
        vocabulary = self.tokenizer.get_vocab().items()
        self.closes = np.zeros(1 << 16, bool)
        self.closes[[i for t, i in vocabulary if t.endswith("</w>")]] = True
        if spaces_count:
            self.opens = np.zeros(1 << 16, bool)
            self.opens[[i for t, i in vocabulary if t[0] in "\u0120\u010a"]] = True
        else:
            self.separator = self.encode_whole("\0")[0]
        self._forget()

    def _forget(self) -> None:
        # by place: a piece (a text's first one behind a blank), in how many batches it was found (up to two),
        # where its ids stand and how many there are (-1: none of its own); rooms double as they fill
        self.known = pa.array([], pa.string())
        self.found = np.zeros(1 << 16, np.uint8)
        self.starts = np.zeros(1 << 16, np.int32)
        self.sizes = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint16)
        self.n_ids = 0

    def _beyond(self, share: int) -> bool:
        return len(self.known) > MEMORY // share or self.known.nbytes + 2 * self.n_ids > MEMORY_BYTES // share

    def _shrink(self) -> None:
        """Forgets the pieces that only one batch had, or all."""
        keep = np.flatnonzero(self.found[:len(self.known)] > 1)
        self.known = self.known.take(pa.array(keep))
        starts, self.sizes = self.starts[keep], self.sizes[keep]
        own = np.maximum(self.sizes, 0)
        self.ids = self._joined(starts, own)
        self.starts, self.n_ids = (np.cumsum(own) - own).astype(np.int32), len(self.ids)
        self.found = np.ones(len(keep), np.uint8)
        if self._beyond(2):
            self._forget()

    def _joined(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The remembered ids of pieces, in a row."""
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        at += np.repeat(starts - ends + sizes, sizes)
        return self.ids.take(at)

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def _add(self, places: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        assert len(starts) == len(places)
        end = self.n_ids + len(ids)
        if end > len(self.ids):
            self.ids = np.resize(self.ids, max(end, 2 * len(self.ids)))
        self.ids[self.n_ids:end] = ids
        self.starts[places], self.sizes[places] = starts + self.n_ids, sizes
        self.n_ids = end

    def _learn_plain(self, places: np.ndarray, pieces: pa.Array) -> None:
        """Plain pieces as the library's pre-tokens straight to its merges; ids
        are cut where a token opens a piece or closes a word."""
        if not self.spaces_count:
            marked = pc.match_substring_regex(pieces, f"{SYMBOLS}$").to_numpy(zero_copy_only=False)
        cuts = np.append(np.arange(0, len(pieces), 2048, dtype=np.int32), np.int32(len(pieces)))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), pieces), "\0 " if self.spaces_count else "\0")
        for i, text in zip(cuts.tolist(), joined.to_pylist()):
            if self.spaces_count:  # a blank opens a piece unless its newline does
                text = (" " + text).replace("\0 \n", "\0\n")
                text = text[1:] if text.startswith(" \n") else text
            else:
                text = text.lower()
            text = re.sub(SYMBOLS, "\0\\g<0>", text)
            pre = charmap_decode(text.encode(), "strict", BYTE_TABLE)[0]
            ids = np.array(self.merges.encode_batch_fast([pre], add_special_tokens=False)[0].ids, np.uint16)
            if self.spaces_count:
                starts = np.flatnonzero(self.opens[ids])
            else:
                words = 1 + marked[i:i + 2048].astype(np.int64)
                starts = np.append(0, np.flatnonzero(self.closes[ids])[np.cumsum(words) - 1][:-1] + 1)
            self._add(places[i:i + 2048], starts, np.diff(np.append(starts, len(ids))), ids)

    def _learn(self, new: pa.Array) -> None:
        """Encode the new pieces, hundreds in one text whose ids are cut at
        piece starts (a token that begins with a blank) or at separators."""
        first, n = len(self.known), len(self.known) + len(new)
        if n > len(self.starts):
            self.starts, self.sizes, self.found = (np.resize(x, max(n, 2 * len(x)))
                                                   for x in (self.starts, self.sizes, self.found))
        self.found[first:n] = 0
        self.known = pa.concat_arrays([self.known, new])
        rest = []
        plain = pc.match_substring_regex(new, self.plain)
        for i, piece in zip(np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist(),
                            new.filter(pc.invert(plain)).to_pylist()):
            place = first + i
            if self._unsafe(piece):
                self.sizes[place] = -1
            elif not piece:  # between blanks that no token holds
                self.sizes[place] = 0
            else:
                rest.append((place, piece))
        plain = plain.to_numpy(zero_copy_only=False)
        if plain.any():
            self._learn_plain(first + np.flatnonzero(plain), new.filter(pa.array(plain)))
        for i in range(0, len(rest), 512):
            places, some = zip(*rest[i:i + 512])
            if self.spaces_count:  # a text's first piece has no blank before it: give it a newline, drop that id
                ids = self.encode_whole("".join("\n" + p[1:] if p[0] == " " else p if p[0] == "\n"
                                                else " " + p for p in some))
                starts = np.flatnonzero(self.opens[ids])
                sizes = np.diff(np.append(starts, len(ids)))
                head = np.fromiter((p[0] == " " for p in some), bool, len(some))
                starts, sizes = starts + head, sizes - head
            else:
                ids = self.encode_whole(" \0 ".join(some))
                ends = np.append(np.flatnonzero(ids == self.separator), len(ids))
                starts = np.append(0, ends[:-1] + 1)
                sizes = ends - starts
            self._add(np.array(places), starts, sizes, ids)

    def _unsafe(self, piece: str) -> bool:
        """A piece whose neighbourhood the tokenizer would see differently."""
        if any(a in piece for a in self.added):
            return True
        if not self.spaces_count:
            return "\0" in piece
        # behind the newline that stands before a first piece, white space would join it
        p = piece.removeprefix(" ")
        return not p or p[-1].isspace() or (p is not piece and p[0].isspace())

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (16 bits: both vocabularies are below
        65 536), and how many each text has."""
        if self._beyond(1):
            self._shrink()
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        # Arrow splits the texts and finds their distinct pieces and which of them are new
        lines = pc.replace_substring(texts, "\n", " \n" if self.spaces_count else " ")
        pieces = pc.split_pattern(lines, " ")
        del lines
        offsets, flat = pieces.offsets.to_numpy(), pieces.values
        coded = flat.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        if self.spaces_count:  # a text's first piece has no blank before it
            heads = pc.binary_join_element_wise("", flat.take(pa.array(offsets[:-1])), " ").dictionary_encode()
            code = code.copy()
            code[offsets[:-1]] = heads.indices.to_numpy() + len(distinct)
            distinct = pa.concat_arrays([distinct, heads.dictionary])
        del pieces, flat, coded
        place = pc.index_in(distinct, value_set=self.known)
        fresh = pc.is_null(place)
        place = pc.fill_null(place, 0).to_numpy().copy()
        unknown = np.flatnonzero(fresh.to_numpy(zero_copy_only=False))
        place[unknown] = len(self.known) + np.arange(len(unknown), dtype=np.int32)
        if len(unknown):
            self._learn(distinct.filter(fresh))
        del distinct, fresh
        self.found[place] = np.minimum(self.found[place], 1) + 1
        sizes = self.sizes[place].take(code)
        whole = np.unique(np.searchsorted(offsets, np.flatnonzero(sizes < 0), side="right") - 1)
        np.maximum(sizes, 0, out=sizes)
        ids = self._joined(self.starts[place].take(code), sizes)
        sizes = np.add.reduceat(sizes, offsets[:-1], dtype=np.int64)
        if len(whole):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in whole.tolist():
                parts[i] = self.encode_whole(texts[i].as_py()) if texts[i].as_py() else np.zeros(0, np.uint16)
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, sizes = self.encode_flat(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []
