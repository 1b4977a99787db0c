"""Token ids of a tokenizers BPE file, computed once per distinct chunk of text.

Chunks are runs without ASCII white space, which this kind of tokenizer never
joins. Chunks of plain Latin-1 text are split and merged here, many words at a
time; any other chunk goes through the tokenizer itself.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

from ._words import Words

_NONE = np.int32(2**31 - 1)
_MULT = np.uint32(0x9E3779B1)
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+")
#: The splitting pattern and normalizer that the merging below stands for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_LONGEST = 48
_MARK_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKS = frozenset(_MARK_CHARS.encode())


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Tokens:
    #: Chunks kept between blocks; the store is emptied when full, which changes no result.
    KEPT = 300_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model, norm, pre = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        split = (pre.get("pretokenizers") or [{}])[0]
        self.merging = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("ignore_merges")
            and [x["type"] for x in norm.get("normalizers", [])] == _NORMALIZERS and split.get("pattern", {}).get("Regex") == _PATTERN and len(model["vocab"]) <= 65536
        )
        special = [re.escape(t["content"].encode()) for t in spec["added_tokens"]]
        self.special_pattern = re.compile(b"|".join(special) if special else b"(?!)")
        self.kept: dict[bytes, bytes] = {}
        if self.merging:
            vocab = model["vocab"]
            chars = _byte_chars()
            self.inner = np.array([vocab[c] for c in chars], np.int32)
            self.last = np.array([vocab[c + "</w>"] for c in chars], np.int32)
            self.slots = np.zeros(1 << 18, np.uint32)
            self.rank = np.full(1 << 18, _NONE, np.int32)
            self.merged = np.zeros(len(model["merges"]) + 1, np.int32)
            for r, pair in enumerate(model["merges"]):
                a, b = pair if isinstance(pair, list) else pair.split(" ")
                self.merged[r] = vocab[a + b]
                key = (vocab[a] << 16 | vocab[b]) + 1
                s = key * int(_MULT) % (1 << 32) >> 14
                while self.slots[s] and self.slots[s] != key:
                    s = (s + 1) % (1 << 18)
                if not self.slots[s]:
                    self.slots[s], self.rank[s] = key, r
            self.split = regex.compile(_PATTERN)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)) + np.uint32(1)
        slot = (key * _MULT) >> np.uint32(14)
        seen = self.slots[slot]
        out = np.where(seen == key, self.rank[slot], _NONE)
        left = np.flatnonzero((seen != key) & (seen != 0))
        while left.size:
            slot[left] = (slot[left] + np.uint32(1)) & np.uint32((1 << 18) - 1)
            seen = self.slots[slot[left]]
            same = seen == key[left]
            out[left[same]] = self.rank[slot[left[same]]]
            left = left[~same & (seen != 0)]
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids (two bytes each) of words that the splitting pattern leaves whole."""
        out: list[bytes] = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(lens[order])) + 1) if len(words) else []:
            size = int(lens[rows[0]])
            for at in range(0, len(rows), 32768):
                part = rows[at : at + 32768]
                raw = np.frombuffer(b"".join([words[k] for k in part.tolist()]), np.uint8).reshape(-1, size)
                for live, ids in self._merge(raw):
                    flat, width = ids.astype("<u2").tobytes(), 2 * ids.shape[1]
                    for n, k in enumerate(part[live].tolist()):
                        out[k] = flat[n * width : n * width + width]
        return out

    def _merge(self, raw: np.ndarray):
        """(rows, their ids) as rows come to an end; every live row merges its best pair once a round, so all are of one length."""
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        rows = np.arange(len(ids))
        rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while True:
            n, width = ids.shape
            if width == 1:
                yield rows, ids
                return
            best = rank.argmin(axis=1)
            low = rank[np.arange(n), best]
            done = low == _NONE
            if done.any():
                yield rows[done], ids[done]
                live = ~done
                if not live.any():
                    return
                rows, ids, rank, best, low = rows[live], ids[live], rank[live], best[live], low[live]
                n = len(rows)
            line = np.arange(n)
            columns = np.arange(width - 1)[None, :]
            new = self.merged[low]
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), 1)
            ids[line, best] = new
            columns = columns[:, : width - 2]
            rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), 1)
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.ranks(ids[left, best[left] - 1], new[left])
            right = np.flatnonzero(best < width - 2)
            rank[right, best[right]] = self.ranks(new[right], ids[right, best[right] + 1])

    def parts(self, chunk: bytes) -> list[bytes] | None:
        """What the splitting pattern makes of a chunk of plain Latin-1 text; None for other chunks."""
        if chunk.isalpha():
            return [chunk.lower()]
        if chunk.isascii():
            if chunk[-1] in _MARKS and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1:]]
        text = chunk.decode("utf-8", "replace")
        if not _PLAIN.fullmatch(text):
            return None
        lower = text.lower()
        if lower.isalpha():
            return [lower.encode()]
        if lower[-1] in _MARK_CHARS and lower[:-1].isalpha():
            return [lower[:-1].encode(), lower[-1].encode()]
        return [p.encode() for p in self.split.findall(lower)]

    def chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks, as bytes of the type `kind`."""
        kept = self.kept
        if len(kept) > self.KEPT:
            kept.clear()
        words: dict[bytes, int] = {}
        fresh: list[bytes] = []
        numbers: list[int] = []  # of the fresh chunks' words, in a row: many small lists would keep the collector busy
        ends: list[int] = []
        special = self.special_pattern.search
        for chunk in chunks:
            if chunk in kept:
                continue
            found = self.parts(chunk) if self.merging and not special(chunk) else None
            if found is None or len(chunk) > _LONGEST and any(len(p) > _LONGEST for p in found):
                text = chunk.decode("utf-8", "replace")
                kept[chunk] = np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").astype(self.kind).tobytes()
                continue
            for p in found:
                numbers.append(words.setdefault(p, len(words)))
            fresh.append(chunk)
            ends.append(len(numbers))
        ids = self.words(list(words))
        at = 0
        for chunk, end in zip(fresh, ends, strict=True):
            kept[chunk] = ids[numbers[at]] if end - at == 1 else b"".join([ids[k] for k in numbers[at:end]])
            at = end
        return [kept[c] for c in chunks]

    @functools.cached_property
    def kind(self) -> str:
        return "<u2" if self.full.get_vocab_size() <= 65536 else "<u4"

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin, then the end."""
        words = Words(texts, lower=False)
        blobs = self.chunks(words.distinct())
        flat = np.frombuffer(b"".join(blobs), self.kind)
        lens = np.fromiter(map(len, blobs), np.int64, len(blobs)) // np.dtype(self.kind).itemsize
        starts = np.cumsum(lens) - lens
        size = lens[words.inverse]
        before = np.cumsum(size) - size
        ids = flat[np.repeat(starts[words.inverse] - before, size) + np.arange(int(size.sum()))]
        return ids.astype("<u4"), np.append(before, int(size.sum()))[words.doc_first]


@functools.lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)
