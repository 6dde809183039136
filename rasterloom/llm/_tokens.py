"""Token ids of whole texts by the tokenizers library, which is asked once for each distinct unit of text.

Both byte-level vocabularies used here split a text by a pattern before any merge. A unit is a run of bytes at whose edges that
pattern always splits: white space with the letters, digits or marks that follow, or a whole word where a word has an apostrophe
or characters of which it is not plain to which class they belong. So the ids of a text are those of its units in order. A
worker keeps the ids of the units it has met, up to MOST_UNITS of them; units are found by a hash and then compared byte by byte. A
text with white space above ASCII, or with a unit whose hash is another unit's, is encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rasterloom.llm import _text

#: Units whose ids a worker keeps; beyond that it starts anew.
MOST_UNITS = 1_500_000

_OTHER, _SPACE, _LETTER, _DIGIT, _MARK, _LATIN = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[[*range(0x30, 0x3A)]] = _DIGIT
_CLASS[[b for b in range(0x21, 0x7F) if not _CLASS[b] and b != 0x27]] = _MARK
_CLASS[0xC3] = _LATIN

_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    key = os.path.abspath(path), str(os.path.getmtime(path))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]


def forget() -> None:
    """Drops this worker's encoders."""
    _ENCODERS.clear()


def _wide_space(raw: np.ndarray) -> np.ndarray:
    """Where a white-space character above ASCII may begin."""
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if not len(lead):
        return lead
    one = raw[np.minimum(lead + 1, len(raw) - 1)]
    two = raw[np.minimum(lead + 2, len(raw) - 1)]
    at = raw[lead]
    found = (at == 0xC2) & ((one == 0x85) | (one == 0xA0))
    found |= (at == 0xE1) & (one == 0x9A) & (two == 0x80)
    found |= (at == 0xE2) & (((one == 0x80) & ((two <= 0x8A) | ((two >= 0xA8) & (two <= 0xAF)))) | ((one == 0x81) & (two == 0x9F)))
    found |= (at == 0xE3) & (one == 0x80) & (two == 0x80)
    return lead[found]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: The vocabulary drops white space and lower-cases, and marks the last token of a word.
        self.drops_space = bool(spec["normalizer"])
        vocabulary = spec["model"]["vocab"]
        self.size = max(vocabulary.values()) + 1
        end = spec["model"].get("end_of_word_suffix") or ""
        self.last = np.zeros(self.size + 8, bool)
        self.width = np.zeros(self.size + 8, np.int64)
        for token, i in vocabulary.items():
            self.last[i] = bool(end) and token.endswith(end)
            self.width[i] = len(token)
        self.newline = self._ids(["\n"])[0] if not self.drops_space else []
        self._reset()

    def _reset(self) -> None:
        self.known, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        #: The bytes of the known units in the order they were met, and each one's place there.
        self.bytes, self.place = _text.Words(*[np.empty(0, np.uint8)] * 3), np.empty(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of units, and whether each is of one plain class."""
        kind = _CLASS[raw]
        latin = kind == _LATIN
        if latin.any():
            i = np.flatnonzero(latin)
            after = raw[np.minimum(i + 1, len(raw) - 1)]
            good = (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7) & (i + 1 < len(raw))
            kind[i] = np.where(good, _LETTER, _OTHER)
            kind[i[good] + 1] = _LETTER
        space = kind == _SPACE
        start, end, _ = _text.words(kind, at, np.arange(256) == _SPACE)
        odd = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(kind == _OTHER, out=odd[1:])
        plain_word = odd[end] == odd[start]
        change = np.zeros(len(raw), bool)
        change[1:] = (kind[1:] != kind[:-1]) & ~space[1:] & ~space[:-1]
        if self.drops_space:
            change |= kind == _DIGIT
        row_start = at[:-1][at[:-1] < len(raw)]
        change[row_start] = False
        cut = np.flatnonzero(change)
        if len(cut) and len(start):
            word = np.searchsorted(start, cut, "right") - 1
            ok = (word >= 0) & plain_word[np.maximum(word, 0)]
            ok &= cut > start[np.maximum(word, 0)]
            cut, word = cut[ok], word[ok]
        else:
            cut = word = np.empty(0, np.int64)
        starts = np.concatenate((start, cut))
        order = np.argsort(starts, kind="stable")
        starts, of = starts[order], np.concatenate((np.arange(len(start)), word))[order]
        ends = np.append(starts[1:], 0)[: len(starts)]
        last = np.append(of[1:] != of[:-1], True) if len(of) else np.empty(0, bool)
        ends[last] = end[of[last]]
        plain = plain_word[of]
        if not self.drops_space and len(starts):
            # White space belongs to the word that follows in the same text; at a text's end it is a unit of its own.
            first = np.append(True, of[1:] != of[:-1])
            before = np.append(0, end)[of]
            floor = at[np.searchsorted(at, starts, "right") - 1]
            starts = np.where(first, np.maximum(before, floor), starts)
        if not self.drops_space:
            tail = np.maximum(at[:-1], np.append(0, end)[np.searchsorted(end, at[1:], "right")]) if len(end) else at[:-1]
            rows = np.flatnonzero(tail < at[1:])
            if len(rows):
                starts = np.concatenate((starts, tail[rows]))
                ends = np.concatenate((ends, at[rows + 1]))
                plain = np.concatenate((plain, np.zeros(len(rows), bool)))
                order = np.argsort(starts, kind="stable")
                starts, ends, plain = starts[order], ends[order], plain[order]
        return starts, ends, plain

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows and the first of each row."""
        wide = _wide_space(raw)
        if len(wide):
            return self._with_whole(raw, at, np.unique(np.searchsorted(at, wide, "right") - 1))
        starts, ends, plain = self._units(raw, at)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(at), np.int64)
        units = _text.Words(raw, starts, ends, lower=self.drops_space)
        distinct, first, inverse = np.unique(units.hashes, return_index=True, return_inverse=True)
        place = self._known(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.known) + len(new) > MOST_UNITS:
                self._reset()
                new = np.arange(len(distinct))
            i = first[new]
            self._learn(distinct[new], units.taken(i), raw, starts[i], ends[i], plain[i])
            place = self._known(distinct)
        right = units.same(np.arange(len(starts)), units, first[inverse]) & units.same(first, self.bytes, self.place[place])[inverse]
        if not right.all():
            return self._with_whole(raw, at, np.unique(np.searchsorted(at, starts[~right], "right") - 1))
        place = place[inverse]
        n, of = self.n[place], self.at[place]
        to = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.arange(to[-1]) + np.repeat(of - to[:-1], n)]
        return ids, to[np.searchsorted(starts, at)]

    def _with_whole(self, raw: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, parts, to = set(rows.tolist()), [], [0]
        for i in range(len(at) - 1):
            own = raw[at[i] : at[i + 1]]
            ids = np.array(self._ids([own.tobytes().decode("utf-8")])[0], np.int32) if i in whole else self.encode(own, np.array([0, len(own)]))[0]
            parts.append(ids)
            to.append(to[-1] + len(ids))
        return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(to)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[i] == hashes, i, -1)

    def _learn(self, hashes: np.ndarray, units: _text.Words, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        lone, joined = [], []
        data = raw.tobytes()
        texts = [data[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        blank = "\t\n\v\f\r "
        for i, (t, p) in enumerate(zip(texts, plain.tolist(), strict=True)):
            (joined if (p if self.drops_space else t.strip(blank)) else lone).append(i)
        n = np.zeros(len(texts), np.int64)
        ids: dict[int, np.ndarray] = {}
        for i in range(0, len(lone), 1000):
            part = lone[i : i + 1000]
            for j, own in zip(part, self._ids([texts[j] for j in part]), strict=True):
                ids[j] = np.array(own, np.int32)
                n[j] = len(own)
        step = 200
        groups = [joined[i : i + step] for i in range(0, len(joined), step)]
        for k in range(0, len(groups), 64):
            some = groups[k : k + 64]
            for group, own in zip(some, self._ids([self._joined(texts, g) for g in some]), strict=True):
                got = np.array(own, np.int32)
                for j, part in zip(group, self._parted(got, texts, group), strict=True):
                    ids[j] = part
                    n[j] = len(part)
        flat = np.concatenate([ids[i] for i in range(len(texts))]) if texts else np.empty(0, np.int32)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.used : self.used + len(flat)] = flat
        at = self.used + np.concatenate(([0], np.cumsum(n)))[:-1]
        self.used += len(flat)
        where = np.searchsorted(self.known, hashes)
        place = len(self.bytes.size) + np.arange(len(hashes))
        self.bytes = self.bytes.joined(units)
        self.known, self.at, self.n, self.place = (np.insert(a, where, b) for a, b in ((self.known, hashes), (self.at, at), (self.n, n), (self.place, place)))

    def _joined(self, texts: list[str], group: list[int]) -> str:
        if self.drops_space:
            return " ".join([texts[i] for i in group])
        return "".join([texts[i] if texts[i][0] in "\t\n\v\f\r " else "\n" + texts[i] for i in group])

    def _parted(self, ids: np.ndarray, texts: list[str], group: list[int]) -> list[np.ndarray]:
        if self.drops_space:
            return np.split(ids, np.flatnonzero(self.last[ids])[:-1] + 1)
        lead = [texts[i][0] not in "\t\n\v\f\r " for i in group]
        size = np.cumsum([len(texts[i].encode("utf-8")) + x for i, x in zip(group, lead, strict=True)])
        cut = np.searchsorted(np.cumsum(self.width[ids]), size)[:-1] + 1
        return [p[1:] if x else p for p, x in zip(np.split(ids, cut), lead, strict=True)]


def encoded(batches: Iterator[pa.RecordBatch], path: str, doc_id: str = "doc_id", text: str = "text") -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, ids of all of them, first id of each) for runs of rows of a bounded size."""
    own = encoder(path)
    for batch in batches:
        docs = batch.column(batch.schema.get_field_index(doc_id)).to_pylist()
        for i, j, raw, at in _text.chunks(batch, text):
            ids, to = own.encode(raw, at)
            yield docs[i:j], ids, to
