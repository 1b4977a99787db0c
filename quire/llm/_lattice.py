"""Subword lattices over the pieces of an existing vocabulary.

A word is a blank followed by its UTF-8 bytes; every piece that matches a range
of them is an edge. Bytes that no piece covers have edges of their own, so that
every text has a segmentation.
"""

from __future__ import annotations

import functools
import math

import numpy as np

_BASE, _MIX, _LEN = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FILTER_BITS = 20
#: Longer words are scored one at a time.
LONGEST = 48
#: Zipf-Mandelbrot offset for log-probabilities from vocabulary ranks.
ZIPF = 2.7


class Pieces:
    """bytes_: each piece, with a blank for a leading word mark; prior: log-probabilities from the vocabulary's own scores, which are ranks."""

    def __init__(self, bytes_: list[bytes], ranks: np.ndarray):
        self.bytes_ = bytes_
        weight = -np.log(ranks + ZIPF)
        self.prior = weight - np.log(np.exp(weight).sum())
        self.longest = max(map(len, bytes_))
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(LONGEST, self.longest) + 1, _BASE)]), dtype=np.uint64)
            keys = np.array([self._key(p) for p in bytes_], np.uint64)
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order
        if np.any(self.keys[1:] == self.keys[:-1]):
            raise ValueError("two pieces have the same key")
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * _MIX) >> np.uint64(64 - _FILTER_BITS)

    @staticmethod
    def _key(piece: bytes) -> np.uint64:
        h = np.uint64(0)
        for b in piece:
            h = h * _BASE + np.uint64(b + 1)
        return h ^ (np.uint64(len(piece)) * _LEN)

    @functools.cached_property
    def ids(self) -> dict[bytes, int]:
        return {p: k for k, p in enumerate(self.bytes_)}

    def edges(self, words: np.ndarray):
        """words: rows of equally many bytes. Yields (end, length, rows, pieces), by end."""
        n, size = words.shape
        with np.errstate(over="ignore"):
            h = np.zeros((size + 1, n), np.uint64)
            for j in range(size):
                h[j + 1] = h[j] * _BASE + (words[:, j].astype(np.uint64) + np.uint64(1))
            for j in range(1, size + 1):
                for k in range(1, min(j, self.longest) + 1):
                    key = (h[j] - h[j - k] * self.power[k]) ^ (np.uint64(k) * _LEN)
                    rows = np.flatnonzero(self.filter[self._slot(key)])
                    if rows.size:
                        at = np.minimum(np.searchsorted(self.keys, key[rows]), len(self.keys) - 1)
                        true = self.keys[at] == key[rows]
                        rows = rows[true]
                        if rows.size:
                            yield j, k, rows, self.order[at[true]]

    def forward(self, words: np.ndarray, logp: np.ndarray, keep: list | None = None) -> np.ndarray:
        """alpha[j, row]: log of the total weight of all segmentations of the first j bytes."""
        alpha = np.full((words.shape[1] + 1, words.shape[0]), -np.inf)
        alpha[0] = 0
        for j, k, rows, pieces in self.edges(words):
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[j - k, rows] + logp[pieces])
            if keep is not None:
                keep.append((j, k, rows, pieces))
        return alpha

    def expected(self, words: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, summed over the words."""
        edges: list = []
        alpha = self.forward(words, logp, edges)
        size = words.shape[1]
        beta = np.full_like(alpha, -np.inf)
        beta[size] = 0
        out = np.zeros(len(logp))
        for j, k, rows, pieces in reversed(edges):
            inner = logp[pieces] + beta[j, rows]
            out += np.bincount(pieces, np.exp(alpha[j - k, rows] + inner - alpha[size, rows]), len(logp))
            beta[j - k, rows] = np.logaddexp(beta[j - k, rows], inner)
        return out

    def one(self, word: bytes, logp: np.ndarray) -> float:
        """The same total for one word of any length."""
        ids, longest = self.ids, self.longest
        alpha = [0.0]
        for j in range(1, len(word) + 1):
            terms = [alpha[j - k] + logp[p] for k in range(1, min(j, longest) + 1) if (p := ids.get(word[j - k : j])) is not None]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha[-1]

    def expected_one(self, word: bytes, logp: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected uses of each piece in one word of any length."""
        ids, longest, n = self.ids, self.longest, len(word)
        ends = [[(j - k, p) for k in range(1, min(j, longest) + 1) if (p := ids.get(word[j - k : j])) is not None] for j in range(n + 1)]
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[i] + logp[p] for i, p in ends[j]])
        for j in range(n, 0, -1):
            for i, p in ends[j]:
                inner = logp[p] + beta[j]
                out[p] += math.exp(alpha[i] + inner - alpha[n])
                beta[i] = np.logaddexp(beta[i], inner)

    def totals(self, words: list[bytes], logp: np.ndarray, chunk: int = 16384) -> np.ndarray:
        """Log total of every word (given without its blank)."""
        out = np.zeros(len(words))
        for rows, mat in matrices(words, chunk):
            if mat is None:
                out[rows] = [self.one(b" " + words[k], logp) for k in rows]
            else:
                out[rows] = self.forward(mat, logp)[-1]
        return out

    def expectations(self, words: list[bytes], logp: np.ndarray, chunk: int = 16384) -> np.ndarray:
        """Expected uses of each piece, over all words."""
        out = np.zeros(len(logp))
        for rows, mat in matrices(words, chunk):
            if mat is not None:
                out += self.expected(mat, logp)
            else:
                for k in rows.tolist():
                    self.expected_one(b" " + words[k], logp, out)
        return out


def matrices(words: list[bytes], chunk: int):
    """(indexes, byte rows with a leading blank) of words of equal length; None in place of the rows for long ones."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lens, kind="stable")
    cuts = np.flatnonzero(np.diff(lens[order])) + 1
    for rows in np.split(order, cuts) if len(words) else []:
        size = int(lens[rows[0]])
        if size >= LONGEST:
            yield rows, None
            continue
        for at in range(0, len(rows), chunk):
            part = rows[at : at + chunk]
            mat = np.frombuffer(b"".join([b" " + words[k] for k in part.tolist()]), np.uint8).reshape(len(part), size + 1)
            yield part, mat


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece vocabulary file whose scores are negative ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    n = model.get_piece_size()
    for k in range(n):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k):
            continue
        text = model.id_to_piece(k)
        body = text[1:] if text[0] == "▁" else text
        if "▁" in body or not body and len(text) > 1:
            continue
        found[((b" " if text[0] == "▁" else b"") + body.encode())] = -model.get_score(k)
    for b in range(256):  # what no piece covers is spelt in bytes
        found.setdefault(bytes([b]), float(n))
    return Pieces(list(found), np.array(list(found.values())))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
