"""Token ids by the tokenizers library, with a bounded cache of parts.

The tokenizer normalises, cuts a text by a pattern and merges within each part, so a text's ids
are those of its parts in order. Texts of plain letters (ASCII, and Latin-1 ones in their two
bytes), digits, signs and white space are lower-cased and cut here, a megabyte of bytes at a time;
each distinct part is looked up once, and the library's model gives the ids of new ones. Any other
text is cut at white space and its pieces go to the whole tokenizer. Tests hold the result against
the library's own ``encode``.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa

from . import kernel as K

DEFAULT = "word_bpe_49k.json"
#: Cached parts in one worker: about 200 bytes each.
CACHE = 600_000
#: Byte-level alphabets spell bytes without a visible Latin-1 character by those from U+0100 on; a blank stays here.
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELT = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)} | {0x20: 0x20}
#: Classes of bytes in lower-cased plain text: 0 white space, 1 letter, 2 digit, 3 sign; 4 is not plain.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[0x20, 9, 10, 13]] = 0
_CLASS[48:58] = 2
_CLASS[97:123] = _CLASS[65:91] = _CLASS[0x80:0xC0] = _CLASS[0xC3] = 1
_APOSTROPHE = 39
#: The endings that the tokenizer's pattern keeps with an apostrophe.
_ENDINGS = (b"re", b"ve", b"ll", b"s", b"t", b"m", b"d")


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, name: str = DEFAULT, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else tokenizer_path(name))
        self.known: dict[bytes, bytes] = {}
        self.cache = cache
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the cuts here are this tokenizer's; texts of any other file go to the library whole
        self.plain = os.path.basename(name) == DEFAULT
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Parts that the pattern doesn't cut: straight to the library's model, in the bytes' own letters."""
        for i in range(0, len(new), 512):
            part = new[i : i + 512]
            spelt = b" ".join(part).decode("latin-1").translate(_SPELT)
            ids = np.array(self.words.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) != len(part):
                self.known.update((w, self._library(w.decode())) for w in part)
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def _lookup(self, parts: list[bytes]) -> list[bytes]:
        new = [w for w in parts if w not in self.known]
        if new and len(self.known) + len(new) > self.cache:
            self.known.clear()
            new = parts
        self._learn(new)
        return [self.known[w] for w in parts]

    def _pieces(self, raw: bytes) -> np.ndarray:
        """The ids of a text of any characters."""
        if any(t in raw for t in self.added) or not self.plain:
            return np.frombuffer(self._library(raw.decode()), "<u4")
        pieces = [p for p in raw.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").split(b" ") if p]
        known: dict[bytes, bytes] = {p: b"" for p in pieces}
        for p in known:
            known[p] = self._library(p.decode())
        return np.frombuffer(b"".join([known[p] for p in pieces]), "<u4")

    def _chunk(self, c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk in order, and how many each has."""
        buf, n = c.buf, len(c)
        counts = np.zeros(n, np.int64)
        low = buf.copy()
        low[(buf >= 65) & (buf <= 90)] += 32
        after_c3 = np.zeros(len(buf), bool)
        after_c3[1:] = buf[:-1] == 0xC3
        low[after_c3 & (buf >= 0x80) & (buf <= 0x9E)] += 32
        kind = _CLASS[buf]
        # a continuation byte stands after C3 alone, and the signs U+00D7 and U+00F7 are no letters
        odd = (kind == 4) | ((buf >= 0x80) & (buf < 0xC0) & ~after_c3) | (after_c3 & ((buf == 0x97) | (buf == 0xB7)))
        odd[:-1] |= (buf[:-1] == 60) & (buf[1:] == 124)  # an added token may begin here
        bad = np.diff(np.concatenate([[0], np.cumsum(odd)])[c.off]) > 0 if self.plain else np.ones(n, bool)
        kind[np.repeat(bad, np.diff(c.off))] = 0
        cut = np.ones(len(buf) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut[c.off] = True
        bounds = np.flatnonzero(cut)
        # an apostrophe alone before a letter takes some endings with it
        for i in np.flatnonzero((low[bounds[:-1]] == _APOSTROPHE) & (kind[bounds[:-1]] == 3) & (np.diff(bounds) == 1)).tolist():
            at = int(bounds[i])
            if at + 1 in c.off[np.searchsorted(c.off, at + 1) :][:1] or at + 1 >= len(buf) or kind[at + 1] != 1:
                continue
            letters = low[at + 1 : int(bounds[i + 2])].tobytes()
            took = next((e for e in _ENDINGS if letters.startswith(e)), None)
            if took:
                cut[at + 1] = False
                cut[at + 1 + len(took)] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        is_part = kind[starts] != 0
        starts, ends = starts[is_part], ends[is_part]
        h, first, back = np.unique(K.Hasher(low).ranges(starts, ends), return_index=True, return_inverse=True)
        raw = low.tobytes()
        ids = self._lookup([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        size = np.array([len(x) // 4 for x in ids], np.int64)
        values = np.frombuffer(b"".join(ids), "<u4")
        take = size[back]
        at = np.cumsum(take) - take
        origin = (np.cumsum(size) - size)[back]
        out = values[np.repeat(origin - at, take) + np.arange(int(take.sum()))]
        by_row = np.searchsorted(starts, c.off)
        totals = np.concatenate([[0], np.cumsum(take)])
        counts[:] = np.diff(totals[by_row])
        if bad.any():
            own = {i: self._pieces(buf[c.off[i] : c.off[i + 1]].tobytes()) for i in np.flatnonzero(bad).tolist()}
            edge = totals[by_row]
            out = np.concatenate([own[i] if i in own else out[edge[i] : edge[i + 1]] for i in range(n)])
            for i, x in own.items():
                counts[i] = len(x)
        return out, counts

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and the offsets of the texts; a null is empty."""
        parts, counts = [], []
        for c in K.chunks(column, 1 << 20):
            ids, n = self._chunk(c)
            off = np.cumsum(n)
            parts.append(np.insert(ids, off, end))
            counts.append(n + 1)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0)).astype("<u4", copy=False), offsets


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = DEFAULT) -> Encoder:
    """One encoder a worker process and tokenizer file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def crc(b: bytes | memoryview) -> int:
    return zlib.crc32(b)
