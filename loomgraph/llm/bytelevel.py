"""Byte-level BPE of many texts: texts are cut where the pre-tokenizer always cuts, and each different piece is encoded once."""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a worker keeps at most; beyond, a piece is encoded again each time it comes. No effect on results.
KEPT_PIECES = 1_200_000
#: Bytes that stand for themselves in the byte-level alphabet; the others are the characters from 256 on, in order.
_itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_itself))}
_SPACE, _LETTERS = chr(_ALPHABET[32]), {b: k for b, k in _ALPHABET.items() if b != 10}
#: One pre-token for certain: letters, or signs, a space before them or not; and letters with Latin-1 ones, of two bytes, among them.
_ASCII, _LATIN = r"^ ?([A-Za-z]+|[!-/:-@\[-`{-~]+)$", r"^ ?([A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+$"

#: Kinds of bytes: what is certain to be a letter, a sign, an apostrophe or a digit, and single spaces and line ends.
_OTHER, _LETTER, _SIGN, _APOSTROPHE, _DIGIT, _BLANK, _LINE, _LATIN_END = range(8)


def _kind(b: int) -> int:
    c = chr(b)
    if b < 128 and c.isalnum():
        return _LETTER if c.isalpha() else _DIGIT
    return {" ": _BLANK, "\n": _LINE, "'": _APOSTROPHE}.get(c, _SIGN if 32 < b < 127 else _OTHER)


def _cut_between(before: int, after: int) -> bool:
    if after in (_BLANK, _LINE):
        return before not in (_OTHER, _BLANK, _LINE)
    if before in (_LETTER, _LATIN_END):
        return after in (_SIGN, _APOSTROPHE)
    return before == _SIGN and after == _LETTER


_KINDS = bytes(map(_kind, range(256)))
_PAIRS = bytes(k < 128 and _cut_between(k >> 4, k & 15) for k in range(256))


def cuts(data: bytes) -> np.ndarray:
    """For each byte, whether every text with these neighbours is cut before it.

    The pre-tokenizer takes contractions, then runs of letters, of digits or of signs with one space before them, then white space. So
    it cuts before white space behind anything else; behind a line end that stands alone; between a letter and a sign; and
    between a sign and a letter, but for apostrophes. Characters count only where their kind is certain: ASCII,
    and Latin-1 letters.
    """
    a = np.frombuffer(data, np.uint8)
    out = np.zeros(len(a), bool)
    if len(a) < 3:
        return out
    kinds = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
    lead = np.flatnonzero(a[:-1] == 0xC3)
    after = a[lead + 1]
    kinds[lead[(after != 0x97) & (after != 0xB7)] + 1] = _LATIN_END
    pairs = (kinds[:-1] << 4) | kinds[1:]
    out[1:] = np.frombuffer(pairs.tobytes().translate(_PAIRS), bool)
    line = np.flatnonzero(kinds[1:-1] == _LINE) + 1
    before, behind = kinds[line - 1], kinds[line + 1]
    alone = (before != _OTHER) & (before != _BLANK) & (before != _LINE) & (behind != _OTHER) & (behind < _BLANK)
    out[line[alone] + 1] = True
    return out


class ByteLevelEncoder:
    """Encodes texts with a tokenizers file that is byte-level BPE with the usual split and no normaliser.

    Any other file's texts are encoded as wholes. Pieces that are one pre-token go to the file's model by themselves, many
    at a time, and their ids are parted by the tokens' lengths in bytes; others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in (c := t["content"]) or c.isalnum() or not any(map(str.isalnum, c)) for t in spec["added_tokens"]) and spec["model"].get("end_of_word_suffix") is None and spec["model"].get("continuing_subword_prefix") is None
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        #: Pieces by number; the ids of the kth are flat[begin[k] : begin[k] + count[k]].
        self.kept: dict[bytes, int] = {}
        self.begin, self.count, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")
        if self.by_piece:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.model._resize_cache(0)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.size[k] = len(token)

    def _new(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(pieces in another order, how many ids each has, their ids one after another)."""
        kinds = pa.array(pieces, pa.binary())
        ascii_one, latin_one = (pc.match_substring_regex(kinds, r).to_numpy(zero_copy_only=False) for r in (_ASCII, _LATIN))
        order, counts, ids = [], [], []
        for own, is_ascii in ((ascii_one, True), (latin_one & ~ascii_one, False)):
            one = [pieces[k] for k in np.flatnonzero(own).tolist()]
            if not one:
                continue
            lines = [b"\n".join(one[k : k + 4000]).decode("latin-1") for k in range(0, len(one), 4000)]
            lines = [x.replace(" ", _SPACE) if is_ascii else x.translate(_LETTERS) for x in lines]
            found = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(lines, add_special_tokens=False)])
            stops = np.searchsorted(np.cumsum(self.size[found]), np.cumsum(np.fromiter(map(len, one), np.int64, len(one)))) + 1
            order += one
            counts.append(np.diff(stops, prepend=0))
            ids.append(found)
        other = [pieces[k] for k in np.flatnonzero(~(ascii_one | latin_one)).tolist()]
        if other:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([p.decode() for p in other], add_special_tokens=False)]
            order += other
            counts.append(np.array([len(x) for x in found]))
            ids += found
        return order, np.concatenate(counts), np.concatenate(ids)

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, count) of each piece's ids in the third array; what is new is kept, while there is room."""
        at = np.fromiter(map(self.kept.get, pieces, repeat(-1)), np.int64, len(pieces))
        begin, count, flat = self.begin, self.count, self.flat
        new = np.flatnonzero(at < 0).tolist()
        if new:
            order, n, ids = self._new([pieces[k] for k in new])
            begin, count, flat = np.concatenate([begin, len(flat) + np.cumsum(n) - n]), np.concatenate([count, n]), np.concatenate([flat, ids])
            places = dict(zip(order, range(len(self.begin), len(begin)), strict=True))
            at[new] = [places[pieces[k]] for k in new]
            if len(self.kept) < KEPT_PIECES:
                self.kept.update(places)
                self.begin, self.count, self.flat = begin, count, flat
        return begin[at], count[at], flat

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); a null text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_piece:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(size)))
        if not offsets[-1]:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        first = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
        data = texts.buffers()[2].slice(first, int(offsets[-1]))
        plain = data.to_pybytes()
        cut = cuts(plain)
        for token in self.special:
            at = plain.find(token)
            while at >= 0:
                cut[at + 1 : at + len(token)] = False
                at = plain.find(token, at + len(token))
        cut[offsets[:-1][size > 0]] = True
        starts = np.append(np.flatnonzero(cut), len(plain))
        small = len(plain) < 1 << 31
        kind = (pa.binary(), np.int32) if small else (pa.large_binary(), np.int64)
        pieces = pa.Array.from_buffers(kind[0], len(starts) - 1, [None, pa.py_buffer(starts.astype(kind[1])), data])
        numbered = pieces.dictionary_encode()
        begin, n, flat = self.ids_of(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = numbered.indices.to_numpy()
        each = n[at]
        done = np.zeros(len(at) + 1, np.int32)
        np.cumsum(each, out=done[1:])
        ids = flat[np.arange(done[-1], dtype=np.int32) + np.repeat((begin[at] - done[:-1]).astype(np.int32), each)]
        return ids, np.diff(done[np.searchsorted(starts, offsets)]).astype(np.int64)
