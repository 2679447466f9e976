"""SentencePiece encoding and decoding for merge-type vocabularies (operator 13).

A text is normalised as the model says and cut into symbols, one per character. An agenda holds every
adjacent pair of symbols that together is a piece of the vocabulary, ordered by the piece's score, then
from the left. The best pair is taken off and merged, and the merged symbol's new neighbours enter, until
the agenda is empty. Symbols without a piece become byte pieces. Long words have an agenda of their own, a
heap whose entries are passed over when their symbols have changed since; the short words of a batch go
through theirs side by side, as rows of a matrix that lose one symbol in every step.

Merges never meet across a place that no piece spans, so texts are cut at such places first: before white
space that follows a word, if no piece has white space inside; within a word, between two characters that
stand side by side in no piece. Words that were seen keep their ids for the rest of the task.

Every Arrow batch is checked against the sentencepiece library: ``agrees`` says whether the ids of a
text are the library's. Ids decode by the library.

Defined cases: a NULL text is empty and has no tokens. Texts of any length are encoded whole. Models of
another type than merges are refused, as are pieces that the agenda does not know (unused ones). Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracemill.llm.common import map_blocks

SPACE = "▁"
# Words a task keeps from batch to batch, and bytes of text worked on at a time.
CACHE = 400_000
BLOCK = 3_000_000
# Characters of a long word, words merged side by side, and a rank behind all others.
LONG = 48
WORDS = 20_000
NEVER = np.iinfo(np.int32).max


def agenda_merge(text: str, ranks: dict[str, int]) -> list[str]:
    """Symbols of a text after all merges: smallest rank first, ties from the left.

    An entry of the agenda is a rank above a place. It stands as long as the symbol there and its neighbour
    still make a piece of that rank.
    """
    symbols = list(text)
    n = len(symbols)
    known = ranks.get
    agenda = [r << 32 | i for i in range(n - 1) if (r := known(text[i : i + 2])) is not None]
    heapq.heapify(agenda)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while agenda:
        entry = heapq.heappop(agenda)
        left = entry & 0xFFFFFFFF
        right = after[left]
        mine = symbols[left]
        if not mine or right == n:
            continue
        both = mine + symbols[right]
        if known(both) != entry >> 32:
            continue
        symbols[left], symbols[right] = both, ""
        after[left] = behind = after[right]
        if behind < n:
            before[behind] = left
            r = known(both + symbols[behind])
            if r is not None:
                heapq.heappush(agenda, r << 32 | left)
        front = before[left]
        if front >= 0:
            r = known(symbols[front] + both)
            if r is not None:
                heapq.heappush(agenda, r << 32 | front)
    return [s for s in symbols if s]


class PairTable:
    """Rank and merged piece of every pair of pieces that can be merged."""

    def __init__(self, ids: dict[str, int], ranks: dict[str, int], size: int) -> None:
        found = [(ids[p[:k]] * size + ids[p[k:]], r, ids[p]) for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        found.sort()
        self.size = size
        self.keys, self.ranks, self.pieces = (np.array(c, t) for c, t in zip(zip(*found), (np.int64, np.int32, np.int32)))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), self.pieces[at]

    def merge_rows(self, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and final pieces of words with equally many symbols, as their agendas run out."""
        rows = np.arange(len(m))
        rank, piece = self.find(m[:, :-1], m[:, 1:])
        while m.shape[1] > 1:
            j = rank.argmin(axis=1)  # the first of equal ranks is the leftmost pair
            live = rank[np.arange(len(m)), j] < NEVER
            if not live.all():
                yield rows[~live], m[~live]
                rows, m, rank, piece, j = rows[live], m[live], rank[live], piece[live], j[live]
            if not len(m):
                return
            every = np.arange(len(m))
            m[every, j] = piece[every, j]
            left = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, left + (left > j[:, None]), axis=1)
            left = left[:-1]
            kept = left + (left >= j[:, None])
            rank, piece = np.take_along_axis(rank, kept, axis=1), np.take_along_axis(piece, kept, axis=1)
            for at in (j - 1, j):
                near = np.flatnonzero((at >= 0) & (at < m.shape[1] - 1))
                rank[near, at[near]], piece[near, at[near]] = self.find(m[near, at[near]], m[near, at[near] + 1])
        yield rows, m


class PieceCodec:
    """One model; ids of words are kept while it lives."""

    def __init__(self, path: str) -> None:
        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(library.get_piece_size())
        if any(library.is_unused(i) for i in every):
            raise ValueError("unused pieces are not supported")
        special = {i for i in every if library.is_byte(i) or library.is_control(i) or library.is_unknown(i)}
        pieces = {library.id_to_piece(i): i for i in every if i not in special}
        scores = {p: library.get_score(i) for p, i in pieces.items() if len(p) > 1}
        order = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        # Scores of merges are their ranks, those of a unigram model log-probabilities: only merges build
        # every longer piece of two others.
        if any(len(p) > 1 and not any(p[:k] in pieces and p[k:] in pieces for k in range(1, len(p))) for p in pieces):
            raise ValueError("not a vocabulary of merges")
        self.ids = pieces
        self.ranks = {p: order[s] for p, s in scores.items()}
        self.bytes = {int(library.id_to_piece(i)[3:5], 16): i for i in every if library.is_byte(i)}
        self.unknown = library.unk_id()
        self.side_by_side = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.pairs = PairTable(pieces, self.ranks, len(every)) if self.ranks else None
        self.points = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.points[ord(p)] = i
        self.words = self._cutter() or (lambda text: [text] if text else [])
        self.seen: dict[str, list[int]] = {}

    def _cutter(self):
        """Cuts a text where no piece spans: before white space, around characters that are in no longer piece,
        and after a word before characters that no piece has behind a letter. None if pieces span white space."""
        if any(a != SPACE and b == SPACE for a, b in self.side_by_side):
            return None
        used = set("".join(self.ranks)) - {SPACE}
        letters = {c for c in used if c.isalpha()}
        marks = used - letters - {b for a, b in self.side_by_side if a in letters}
        group = lambda chars: "".join(map(re.escape, sorted(chars))) or "\\0"
        body = f"[{group(letters)}]+(?=[{group(marks)}])|[{group(used)}]+"
        return re.compile(f"{SPACE}*(?:{body})|{SPACE}+|[^{SPACE}]").findall

    def symbol_ids(self, symbol: str) -> list[int]:
        known = self.ids.get(symbol)
        if known is not None:
            return [known]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in symbol.encode("utf-8")]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word, each stretch between places that no piece spans for itself."""
        at = [0] + [k + 1 for k in range(len(word) - 1) if word[k : k + 2] not in self.side_by_side] + [len(word)]
        symbols = chain.from_iterable(agenda_merge(word[a:b], self.ranks) for a, b in zip(at, at[1:]))
        return list(chain.from_iterable(map(self.symbol_ids, symbols)))

    def learn(self, words: list[str]) -> None:
        """Takes the ids of distinct words into the cache."""
        sizes = defaultdict(list)
        for w in words:
            sizes[len(w) if 1 < len(w) <= LONG else 0].append(w)
        for w in sizes.pop(0, ()):
            self.seen[w] = self.encode_word(w)
        for size, group in sizes.items():
            for at in range(0, len(group), WORDS):
                part = group[at : at + WORDS]
                m = self.points[np.frombuffer("".join(part).encode("utf-32-le"), "<u4")].reshape(-1, size)
                whole = (m >= 0).all(axis=1) if self.pairs else np.zeros(len(part), bool)
                for i in np.flatnonzero(~whole).tolist():
                    self.seen[part[i]] = self.encode_word(part[i])
                if whole.any():
                    known = np.flatnonzero(whole)
                    for rows, ids in self.pairs.merge_rows(m[known]):
                        self.seen.update(zip(map(part.__getitem__, known[rows].tolist()), ids.tolist()))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, without begin or end."""
        cut = [self.words(self.library.normalize(t)) if t else [] for t in texts]
        fresh = set(chain.from_iterable(cut)).difference(self.seen)
        if len(self.seen) + len(fresh) > CACHE:
            self.seen.clear()
            fresh = set(chain.from_iterable(cut))
        self.learn(list(fresh))
        found = [list(chain.from_iterable(map(self.seen.__getitem__, words))) for words in cut]
        if not self.bytes:  # a run of unknown symbols is one token
            found = [[i for k, i in enumerate(ids) if i != self.unknown or k == 0 or ids[k - 1] != self.unknown] for ids in found]
        return found

    def encode_batch(self, texts: list) -> list[tuple[list[int], bool]]:
        """Ids of each text (None: empty), and whether they are the library's."""
        texts = [t or "" for t in texts]
        theirs = self.library.encode(texts, num_threads=1) if texts else []
        return [(mine, mine == t) for mine, t in zip(self.encode(texts), theirs)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


SCHEMA = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()), T.StructField("agrees", T.BooleanType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("agrees", T.BooleanType()),
    ]
)


def encode(docs: DataFrame, keys: list[str], path: str, text: str = "text") -> DataFrame:
    """``keys, n_tokens, ids, decoded, agrees`` of every row's whole text."""

    def start():
        codec = PieceCodec(path)

        def work(texts):
            found = codec.encode_batch(texts)
            return {
                "n_tokens": [len(i) for i, _ in found],
                "ids": pa.array([i for i, _ in found], pa.list_(pa.int32())),
                "decoded": pa.array([codec.decode(i) for i, _ in found], pa.string()),
                "agrees": pa.array([a for _, a in found], pa.bool_()),
            }

        return work

    return map_blocks(docs, keys, text, SCHEMA, start, BLOCK)


def encode_digests(docs: DataFrame, keys: list[str], path: str, text: str = "text") -> DataFrame:
    """The same, with SHA-256 digests (of the decimal ids joined by commas, of the decoded text)."""

    def start():
        codec = PieceCodec(path)
        digits = [str(i) for i in range(codec.library.get_piece_size())]

        def work(texts):
            found = codec.encode_batch(texts)
            return {
                "n_tokens": [len(i) for i, _ in found],
                "ids_sha256": [hashlib.sha256(",".join(map(digits.__getitem__, i)).encode()).hexdigest() for i, _ in found],
                "decoded_sha256": [hashlib.sha256(codec.decode(i).encode()).hexdigest() for i, _ in found],
                "agrees": [a for _, a in found],
            }

        return work

    return map_blocks(docs, keys, text, DIGESTS, start, BLOCK)
