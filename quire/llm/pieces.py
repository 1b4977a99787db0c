"""Encoding and decoding with merge-type SentencePiece vocabularies.

Merges come from an agenda of adjacent symbol pairs, ordered by the score of the
piece that a pair makes, the leftmost first among equals. The agendas of many short
segments are the rows of a matrix, from each of which a round takes the best entry;
that of a long one is a heap, where a pair is passed over if one of its symbols has
been merged meanwhile. What stays outside the vocabulary is written as its UTF-8 bytes.

A merge cannot pass a place where no piece of the vocabulary reaches across: before
a space that follows something else, if no piece has a space inside, around a line
feed, if none has one, and between letters and ASCII marks, but for letters that
some piece has beside a mark.
Texts are cut there, and an agenda is run once for each distinct segment that a
worker has not met lately. The segments that are new in an Arrow batch are encoded
and decoded by the sentencepiece library too, in one call, and compared; where the
two differed the library's ids would be taken and counted in n_differing, which is
0 in all tests. Memory is bounded by a batch and the segments kept.

Defined cases: null text counts as empty, and an empty text has no ids. U+2581 is a
space, as in the library. Rows that repeat an id are encoded each. An empty table
gives an empty result. Models with a normaliser of their own, user-defined or unused
pieces, or another type than BPE are refused.
"""

from __future__ import annotations

import codecs
import re
import sys
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import released, small_batches
from ._words import blocks

SPACE = "▁"
#: Segments after which a worker forgets those that it has not met since the last so many, and the longest that it keeps.
KEPT, LONGEST = 300_000, 48
#: Symbols up to which the agenda of a segment is a row of a matrix, and the rows of one.
SHORT, ROWS = 32, 4096
#: Symbols are ids of pieces or, beyond them, characters; a pair is one number.
_SHIFT = np.int64(21)
_MARKS = r"!-/:-@\[-`{-~"
RESULT = "doc_id long, ids array<int>, decoded string, n_differing long"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6

codecs.register_error("quire-bytes", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """A merge-type model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(raw)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        rules = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("not a merge-type vocabulary with plain normalisation")
        self.prefix = rules.add_dummy_prefix
        plain = lambda p: p.replace(SPACE, " ")
        self.score = {plain(p.piece): p.score for p in model.pieces if p.type == _NORMAL}
        self.rank = {p: -s for p, s in self.score.items()}  # the best first
        self.id = {plain(p.piece): k for k, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.byte = {int(p.piece[3:-1], 16): k for k, p in enumerate(model.pieces) if p.type == _BYTE}
        by_byte = {k: b for b, k in self.byte.items()}
        #: What an id stands for: a text, or one byte.
        self.sense: list[str | int] = [by_byte[k] if p.type == _BYTE else plain(p.piece) if p.type == _NORMAL else model.trainer_spec.unk_surface if p.type == _UNKNOWN else "" for k, p in enumerate(model.pieces)]
        spaces = not any(" " in p.lstrip(" ") for p in self.score)
        lines = not any("\n" in p and len(p) > 1 for p in self.score)
        beside = "".join({c for p in self.score for c in "".join(re.findall(rf"[^\W\d_](?=[{_MARKS}])|(?<=[{_MARKS}])[^\W\d_]", p))})
        letter = rf"[^\W\d_{re.escape(beside)}]"
        fine = rf" *{letter}+(?=[{_MARKS} \n]|$)| *[{_MARKS}]+(?={letter}|[ \n]|$)| +[^ \n]*|[^ \n]+|\n"
        self._cut = re.compile(fine if spaces and lines else " +[^ ]*|[^ ]+" if spaces else "[^\n]+|\n" if lines else "(?s).+")
        #: A segment can be shown to the library alone, behind a line feed.
        self.apart = spaces and lines

    def segments(self, text: str) -> list[str]:
        """The text, with the space that stands before each text, in parts that merges do not pass."""
        return self._cut.findall((" " if self.prefix else "") + text.replace(SPACE, " ")) if text else []

    def encode(self, segments: list[str]) -> list[list[int]]:
        """The ids of each segment."""
        out: list[list[int]] = [[]] * len(segments)
        short = sorted((k for k, s in enumerate(segments) if len(s) <= SHORT), key=lambda k: len(segments[k]))
        for at in range(0, len(short), ROWS):
            places = short[at : at + ROWS]
            for k, ids in zip(places, self._short([segments[k] for k in places]), strict=True):
                out[k] = ids
        for k, s in enumerate(segments):
            if len(s) > SHORT:
                out[k] = self._long(s)
        return out

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of symbols that make a piece, ascending, with its rank and id; the last is none."""
        symbol = lambda p: self.id.get(p, len(self.sense) + ord(p) if len(p) == 1 else None)
        found = {}
        for piece, k in self.id.items():
            for at in range(1, len(piece)):
                a, b = symbol(piece[:at]), symbol(piece[at:])
                if a is not None and b is not None:
                    found[a << int(_SHIFT) | b] = self.rank[piece], k
        keys = sorted(found)
        return np.array([*keys, -1], np.int64), np.array([*(found[k][0] for k in keys), np.inf]), np.array([*(found[k][1] for k in keys), -1], np.int64)

    @cached_property
    def _of_char(self) -> np.ndarray:
        """The symbol of every code point."""
        table = np.arange(len(self.sense), len(self.sense) + sys.maxunicode + 1)
        for p, k in self.id.items():
            if len(p) == 1:
                table[ord(p)] = k
        return table

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in _pairs of each pair, the last if it makes no piece or a side is missing."""
        keys = self._pairs[0]
        pair = (left << _SHIFT) | right
        at = np.searchsorted(keys[:-1], pair)
        return np.where((keys[at] == pair) & (left >= 0) & (right >= 0), at, len(keys) - 1)

    def _short(self, segments: list[str]) -> list[list[int]]:
        """The ids; row by row, the agenda has an entry for each adjacent pair, in the order of the text."""
        _, ranks, made = self._pairs
        width, base = max([1, *map(len, segments)]), len(self.sense)
        points = np.frombuffer("".join([s.ljust(width + 1) for s in segments]).encode("utf-32-le"), np.uint32).reshape(len(segments), width + 1)
        symbols = np.where(np.arange(width + 1) < np.array([len(s) for s in segments])[:, None], self._of_char[points], -1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rows, places = np.arange(len(segments)), np.arange(width + 1)
        agenda = self._looked_up(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            score = ranks[agenda]
            best = score.argmin(1)
            open_ = score[np.arange(len(rows)), best] < np.inf
            if not open_.all():
                done.append((rows[~open_], symbols[~open_]))
                rows, symbols, agenda, best = rows[open_], symbols[open_], agenda[open_], best[open_]
                if not len(rows):
                    break
            own, k = np.arange(len(rows)), best[:, None]
            new = made[agenda[own, best]]
            symbols = np.concatenate([symbols, np.full((len(rows), 1), -1)], 1)[own[:, None], places + (places > k)]
            symbols[own, best] = new
            agenda = np.concatenate([agenda, np.full((len(rows), 1), len(ranks) - 1)], 1)[own[:, None], places[:-1] + (places[:-1] >= k)]
            agenda[own, best] = self._looked_up(new, symbols[own, best + 1])
            before = best > 0
            agenda[own[before], best[before] - 1] = self._looked_up(symbols[own[before], best[before] - 1], new[before])
        out: list[list[int]] = [[]] * len(segments)
        for which, found in done:
            sizes, strange = (found >= 0).sum(1).tolist(), (found >= base).any(1).tolist()
            for row, ids, n, odd in zip(which.tolist(), found.tolist(), sizes, strange, strict=True):
                out[row] = [i for x in ids[:n] for i in (self._ids([chr(x - base)]) if x >= base else (x,))] if odd else ids[:n]
        return out

    def _long(self, segment: str) -> list[int]:
        """The ids; the agenda is a heap, and entries whose symbols are gone are passed over."""
        parts: list[str | None] = list(segment)
        n, rank = len(parts), self.rank.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(s, k, len(pair)) for k in range(n - 1) if (s := rank(pair := parts[k] + parts[k + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, left, size = heappop(agenda)
            a, right = parts[left], after[left]
            if a is None or right < 0 or len(a) + len(parts[right]) != size:
                continue
            parts[left], parts[right] = a + parts[right], None
            after[left] = follows = after[right]
            if follows >= 0:
                before[follows] = left
                if (s := rank(pair := parts[left] + parts[follows])) is not None:
                    heappush(agenda, (s, left, len(pair)))
            if (leads := before[left]) >= 0 and (s := rank(pair := parts[leads] + parts[left])) is not None:
                heappush(agenda, (s, leads, len(pair)))
        return self._ids([p for p in parts if p is not None])

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for part in parts:
            if (found := self.id.get(part)) is not None:
                out.append(found)
            elif self.byte:
                out += [self.byte[b] for b in part.encode()]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: Iterable[int], first: bool = True) -> str:
        """The text of ids; first: they begin a text, whose own space is left out. A byte outside any character is U+FFFD."""
        out: list[str] = []
        run = bytearray()
        for k in ids:
            sense = self.sense[k]
            if isinstance(sense, int):
                run.append(sense)
                continue
            if run:
                out.append(run.decode("utf-8", "quire-bytes"))
                run.clear()
            if first and self.prefix and sense[:1] == " " and k != self.unknown and not any(out):
                sense, first = sense[1:], False
            out.append(sense)
        out.append(run.decode("utf-8", "quire-bytes"))
        return "".join(out)


class Coder:
    """Ids and texts of segments, each worked out once while it is kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.differing: set[str] = set()

    def _differing(self, segments: list[str], ids: list[list[int]], texts: list[str]) -> list[int]:
        """The places of segments that the library codes in another way, whose ids and texts become the library's."""
        library = self.vocabulary.library
        line = library.encode("\n")
        if library.encode("".join(["\n" + s for s in segments])) == line[:-1] + [i for own in ids for i in (line[-1], *own)] and library.decode([line[0], *(i for own in ids for i in (line[-1], *own))]) == "".join(["\n" + t for t in texts]):
            return []
        theirs = [library.encode("\n" + s)[len(line) :] for s in segments]
        back = [library.decode(line + i)[1:] for i in theirs]
        found = [k for k in range(len(segments)) if theirs[k] != ids[k] or back[k] != texts[k]]
        for k in found:
            ids[k], texts[k] = theirs[k], back[k]
        return found

    def add(self, segments: set[str]) -> tuple[dict[str, tuple[bytes, str]], set[str]]:
        """Ids (32 bits each) and decoded text of all the segments, and those that the library codes in another way, which are kept apart."""
        v, here, new = self.vocabulary, {}, []
        for s in segments:
            if (found := self.known.get(s) or self.older.get(s)) is not None:
                here[s] = found
            else:
                new.append(s)
        ids = v.encode(new)
        texts = [v.decode(k, False) for k in ids]
        if v.apart and new:
            self.differing.update(new[k] for k in self._differing(new, ids, texts))
        for s, i, t in zip(new, ids, texts, strict=True):
            here[s] = np.array(i, np.int32).tobytes(), s if t == s else t
        if len(self.known) + len(new) > KEPT:
            self.known, self.older = {}, self.known
        self.known.update((s, x) for s, x in here.items() if len(s) <= LONGEST)
        return here, self.differing & segments if self.differing else set()

    def documents(self, texts: list[str]) -> tuple[list[bytes], list[str], list[int]]:
        """Of each text: ids, decoded text, and the number of segments in which the library differs."""
        cut = [self.vocabulary.segments(t) for t in texts]
        known, differing = self.add(set().union(*cut))
        ids, back = [], []
        for segments in cut:
            found = [known[s] for s in segments]
            text = "".join([t for _, t in found])
            ids.append(b"".join([i for i, _ in found]))
            back.append(text[1:] if self.vocabulary.prefix and text[:1] == " " else text)
        return ids, back, [sum(s in differing for s in segments) for segments in cut] if differing else [0] * len(cut)


@lru_cache(1)
def _coder(path: str) -> Coder:
    """The coder of a worker; what it keeps serves the tasks that follow."""
    return Coder(Vocabulary(path))


def _rounds(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for block in blocks(batches, ["doc_id"]):
            ids, back, differs = coder.documents([t.decode("utf-8", "replace") for t in block["text"]])
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(block["doc_id"], pa.int64()), lists, pa.array(back, pa.string()), pa.array(differs, pa.int64())], names=["doc_id", "ids", "decoded", "n_differing"])

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _coder(path).vocabulary
        for batch in batches:
            texts = [None if i is None else vocabulary.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """RESULT: per row its ids, what they decode to, and the segments in which the library differs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(released(_rounds(model or default_path())), RESULT)


def decoded(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows of ids; null ids have no text."""
    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(released(_decoder(model or default_path())), "doc_id long, text string")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas), decoded_sha256, n_differing."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(docs, doc_id, text, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "n_differing")
