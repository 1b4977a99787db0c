"""Token counts by dynamic programming over a trie of pre-tokens.

Pre-tokens are runs without ASCII white space. Per block of documents the
distinct ones are inserted into a trie, here walked in sorted order, so that
only the current path is held: the best unigram score and its number of pieces
are computed once per trie node, that is once per shared prefix, and the count
at a terminal is stored for its pre-token. A document's count is the sum over
its pre-tokens. Nothing is shuffled, and memory is bounded by a block.

The scores are log-probabilities from the ranks of the vocabulary file; equal
scores go to fewer pieces.

Defined cases: null or blank texts have no words and no tokens. Rows that repeat
an id are counted each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _lattice
from ._store import released, small_batches
from ._words import Words, blocks


class Trie:
    """Forward scores on the path of the last pre-token."""

    def __init__(self, pieces: _lattice.Pieces):
        # Pieces by their reversed bytes: node << 8 | byte -> node.
        self.child: dict[int, int] = {}
        self.score: list[float | None] = [None]
        for piece, logp in zip(pieces.bytes_, pieces.prior.tolist(), strict=True):
            node = 0
            for b in reversed(piece):
                key = node << 8 | b
                if (down := self.child.get(key)) is None:
                    down = self.child[key] = len(self.score)
                    self.score.append(None)
                node = down
            self.score[node] = logp
        self.path, self.best, self.count = b"", [0.0], [0]
        self.nodes = 0

    def insert(self, word: bytes) -> int:
        """The number of pieces of a word; pass words in sorted order to share prefixes."""
        path, best, count = self.path, self.best, self.count
        same, limit = 0, min(len(path), len(word))
        while same < limit and path[same] == word[same]:
            same += 1
        del best[same + 1 :], count[same + 1 :]
        child, score = self.child, self.score
        for j in range(same, len(word)):
            node, k, top, n = 0, j, -1e300, 0
            while k >= 0:
                node = child.get(node << 8 | word[k])
                if node is None:
                    break
                p = score[node]
                if p is not None:
                    s = best[k] + p
                    if s > top or s == top and count[k] + 1 < n:
                        top, n = s, count[k] + 1
                k -= 1
            best.append(top)
            count.append(n)
        self.nodes += len(word) - same
        self.path = word
        return count[-1]


def _counter(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(_lattice.pieces(vocabulary))
        for block in blocks(batches, ["doc_id"]):
            words = Words(block["text"], lower=False)
            forms = words.distinct()
            counts = np.zeros(len(forms), np.int64)
            for k in sorted(range(len(forms)), key=forms.__getitem__):
                counts[k] = trie.insert(b" " + forms[k])
            sums = np.concatenate([[0], np.cumsum(counts[words.inverse])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block["doc_id"], pa.int64()), pa.array(np.diff(words.doc_first)), pa.array(np.diff(sums[words.doc_first]))], names=["doc_id", "n_words", "n_tokens"]
            )

    return run


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, n_words (pre-tokens), n_tokens."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(released(_counter(vocabulary or _lattice.default_path())), "doc_id long, n_words long, n_tokens long")
