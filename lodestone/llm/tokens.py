"""Whole-text tokenising that gives the library's own ids, by batches.

Texts are cut only where the pre-tokenizer cuts in any case: after an ASCII letter before an ASCII mark or digit, at the first
white space after a character that is none, and around special tokens. Equal pieces of a batch are encoded once; ids of
pieces met before come from a memo in two generations, of which the older is dropped when the younger is full. Unseen pieces
of letters alone, which are one word of the pre-tokenizer, go to the library's model at once; others through all its steps.
"""
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.common import trim

MEMO, SLICE, JOINED, PLAIN = 100_000, 1 << 20, 1 << 16, 8192  # pieces a generation, bytes a slice, bytes of unseen pieces a call, plain pieces at once
_LETTER, _MARK, _SPACE = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[*range(33, 65), *range(91, 97), *range(123, 127)]] = _MARK
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
# ASCII letters and U+00C0 to U+00FF but for the two signs among them, after a space where that belongs to the word
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORDS = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_FOLDED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
# (normalizer, pre-tokenizer) of which plain pieces are known to be one word each
_KNOWN = {
    rb" ?" + _LETTERS: (None, _BYTES | {"use_regex": True}),
    _LETTERS: ({"type": "Sequence", "normalizers": _FOLDED}, {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": _WORDS, "behavior": "Removed", "invert": True}, _BYTES | {"use_regex": False}]}),
}
# the character that stands for each byte in a byte-level vocabulary
_SHOWN = np.arange(256, dtype="<u4")
_OTHER = np.array([*range(33), *range(127, 161), 173])
_SHOWN[_OTHER] = 256 + np.arange(len(_OTHER))
_loaded: dict[str, "Encoder"] = {}


def _flat(lens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places starts[i], ... starts[i] + lens[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lens)
    total = ends[-1] if len(ends) else 0
    kind = np.int32 if max(total, starts.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((starts - ends + lens).astype(kind), lens)
    out += np.arange(total, dtype=kind)
    return out


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.t = path, Tokenizer.from_file(path)
        spec = json.loads(self.t.to_str())
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.pattern = re.compile(b"|".join(map(re.escape, self.special)))
        self.sep, self.sep_id = next(iter(self.special.items()))
        self.drops_space = bool(spec["normalizer"])  # white space is dropped, case folded
        known = next((k for k, x in _KNOWN.items() if x == (spec["normalizer"], spec["pre_tokenizer"])), None)
        odd = spec["model"]["type"] != "BPE" or spec["model"]["dropout"] or any(x["normalized"] for x in spec["added_tokens"])
        self.plain = re.compile(known) if known and not odd else None
        self.model = self.t.model
        self.young, self.old = {}, {}

    def one(self, text: str | None, end: int) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text (null: empty), then `end`."""
        return self.batch(pa.array([text or ""], pa.string()), end)[0].tobytes()

    def slices(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, places of the rows' ids) of slices of about SLICE bytes."""
        at, ends = 0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield at, *self.batch(texts.slice(at, upto - at), end)
            at = upto
        trim()

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each followed by `end`, and the n + 1 places where they start and end."""
        texts = texts.fill_null("").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        ids, counts = self._segments(data, bounds)
        places = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.full(places[-1], end, "<u4")
        own = np.ones(len(out), bool)
        own[places[1:] - 1] = False
        out[own] = ids
        return out, places

    def _segments(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and their number by text, cut around special tokens first."""
        raw, at, cuts = data.tobytes(), 0, []
        while m := self.pattern.search(raw, at):
            k = np.searchsorted(bounds, m.start(), "right")
            inside = m.end() <= bounds[k]
            if inside:
                cuts.append((m.start(), m.end(), self.special[m.group()]))
            at = m.end() if inside else m.start() + 1
        if not cuts:
            return self._pieces(data, bounds)
        starts = np.array([c[0] for c in cuts])
        parts = np.sort(np.concatenate([bounds, starts, np.array([c[1] for c in cuts])]), kind="stable")
        # empty segments are harmless; a special token's own bytes are encoded and then replaced
        ids, counts = self._pieces(data, parts)
        split = np.split(ids, np.cumsum(counts)[:-1])
        known = {a: x for a, _, x in cuts}
        for i in range(len(counts)):
            if parts[i + 1] > parts[i] and int(parts[i]) in known:
                split[i] = np.array([known[int(parts[i])]], "<u4")
        text = np.searchsorted(bounds, parts[:-1], "right") - 1
        lens = np.array(list(map(len, split)))
        return np.concatenate(split), np.bincount(np.minimum(text, len(bounds) - 2), lens, len(bounds) - 1).astype(np.int64)

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece starts in data, the bytes that stay, and the pieces' ends in them."""
        n = len(data)
        first = np.zeros(n + 1, bool)
        if self.drops_space:
            # ASCII capitals fold here where no combining mark can follow
            big = (data >= 65) & (data <= 90)
            big[:-1] &= data[1:] < 128
            data = data + (big.astype(np.uint8) << 5)
        kind = _KIND[data]
        first[1:n] = (kind[:-1] == _LETTER) & (kind[1:] == _MARK)
        first[bounds] = True
        if self.drops_space:
            stay = kind != _SPACE
            first[1:n] |= ~stay[:-1]
            at = np.flatnonzero(first[:n] & stay)
            before = np.cumsum(stay, dtype=np.int32 if n < 1 << 31 else np.int64)
            return at, data[stay], np.append(before[at] - 1, before[-1])
        gap = np.flatnonzero((kind[1:] == _SPACE) & (kind[:-1] != _SPACE)) + 1
        prev, lead = data[gap - 1], data[np.maximum(gap - 2, 0)]
        for back in (3, 4):
            lead = np.where(lead >= 0xC0, lead, data[np.maximum(gap - back, 0)])
        # the characters U+0085, U+00A0 and some of U+1000 to U+3FFF are white space: no cut after any of those
        sure = np.where(prev < 128, (prev > 32) & (prev < 127), ((lead > 0xC2) & (lead < 0xE1)) | (lead > 0xE3))
        first[gap[sure]] = True
        at = np.flatnonzero(first[:n])
        return at, data, np.append(at, n)

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(bounds) - 1, np.int64)
        at, data, ends = self._cuts(data, bounds)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        which, ids = coded.indices.to_numpy(), self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, many = np.cumsum(lens) - lens, lens[which]
        out = np.frombuffer(b"".join(ids), "<u4")[_flat(many, starts[which])] if len(ids) else np.zeros(0, "<u4")
        total = np.concatenate([[0], np.cumsum(many)])
        return out, np.diff(total[np.searchsorted(at, bounds)])

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        got = list(map(young.get, pieces))
        new = []
        for i in [i for i, x in enumerate(got) if x is None]:
            p = pieces[i]
            if (x := old.get(p)) is not None:
                got[i] = young[p] = x
            else:
                new.append(i)
        plain = [i for i in new if self.plain.fullmatch(pieces[i])] if self.plain else []
        for k in range(0, len(plain), PLAIN):
            self._words(pieces, plain[k : k + PLAIN], got)
        group, size = [], 0
        for i in [i for i in new if got[i] is None]:
            group.append(i)
            size += len(pieces[i])
            if size > JOINED:
                self._encode(pieces, group, got)
                group, size = [], 0
        self._encode(pieces, group, got)
        for i in new:
            if len(pieces[i]) < 40:
                young[pieces[i]] = got[i]
        if len(young) > MEMO:
            self.young, self.old = {}, young
        return got

    def _words(self, pieces: list[bytes], group: list[int], got: list) -> None:
        """The model's ids of each plain piece, in lower case where the tokenizer folds it."""
        data = np.frombuffer(b"".join([pieces[i] for i in group]), np.uint8)
        if self.drops_space:
            # 0x80 to 0x9E are the second bytes of the capitals U+00C0 to U+00DE and of nothing else
            big = (data >= 65) & (data <= 90) | (data >= 0x80) & (data <= 0x9E)
            data = data + (big.astype(np.uint8) << 5)
        text, at, ids, ends, tokens = _SHOWN[data].tobytes().decode("utf-32-le"), 0, [], [], self.model.tokenize
        for i in group:
            upto = at + len(pieces[i])
            ids += [x.id for x in tokens(text[at:upto])]
            ends.append(4 * len(ids))
            at = upto
        raw, at = np.array(ids, "<u4").tobytes(), 0
        for i, upto in zip(group, ends, strict=True):
            got[i], at = raw[at:upto], upto

    def _encode(self, pieces: list[bytes], group: list[int], got: list) -> None:
        """One library call for all pieces of the group, with a special token between them."""
        if not group:
            return
        text = self.sep.join(pieces[i] for i in group).decode("utf-8", "replace")
        ids = np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(ids == self.sep_id)
        if len(cut) != len(group) - 1:
            raise ValueError("a piece holds a special token")
        for i, a, b in zip(group, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True):
            got[i] = ids[a:b].tobytes()


def encoder(name: str) -> Encoder:
    import public_tokenizers as p

    if name not in _loaded:
        _loaded[name] = Encoder(p.path(name))
    return _loaded[name]
