"""Byte-level BPE encoding and decoding with recursive queries (operator 9).

A text is cut by the tokenizer's pattern; every piece is encoded for itself. Pieces that are a token
are that token; the others are contracted by a DuckDB query inside each task: one row per token of a
word, joined with the merge table, and in every step the leftmost pair of the smallest rank of each
word is contracted, until no pair of the word can be merged. An ordered aggregation writes the ids of
a word, another one decodes them.

Spark deals out the texts; a task encodes each distinct piece of a block once. Texts are first cut
before single spaces that a non-space follows, where the pattern always begins a new match; the pieces
between such cuts repeat often, so that only distinct ones are matched against the pattern.

Defined cases: a NULL text is empty and has no tokens. Lone surrogates cannot occur in a Spark string.
Words of any length are contracted; where a smallest pair occurs several times in a word and no token
that contains the merged one has a smaller rank, all its occurrences are contracted in one step,
which is what one step for each of them, from the left, would give.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracemill.llm.common import map_blocks, release_memory

# Pieces a worker keeps from block to block and from task to task.
CACHE = 700_000
# Bytes of text worked on at a time, words contracted at a time, and bytes of a long word.
BLOCK = 4_000_000
WORDS = 40_000
LONG = 48
# Ids decoded at a time.
IDS = 200_000

# Bytes of each text from its ids, and how many of them are tokens. The connection has one thread, so
# that the aggregate takes the sorted rows as they come; sorting inside it takes twice as long.
_DECODE = """
SELECT doc, string_agg(hex, '') AS hex, count(*) AS n
FROM (SELECT c.doc, v.hex FROM coded c JOIN vocabulary v ON v.id = c.id ORDER BY c.pos) GROUP BY doc
"""

# One contraction per word and step; a word's tokens travel as a list and are unfolded to one row per
# position for the join with the merge table. ``rank`` holds the merged token above the place, so that
# its minimum is the leftmost pair of the smallest rank.
_SHORT = """
WITH RECURSIVE state(word, toks, live) AS (
  SELECT word, toks, true FROM start
  UNION ALL
  SELECT s.word, CASE WHEN b.rank IS NULL THEN s.toks ELSE
           s.toks[:(b.rank & 4294967295) - 1] || [(b.rank >> 32)::INTEGER] || s.toks[(b.rank & 4294967295) + 2:] END,
         b.rank IS NOT NULL
  FROM state s LEFT JOIN (
    SELECT p.word, min((m.merged::BIGINT << 32) | p.i) AS rank
    FROM (SELECT word, i, toks[i]::BIGINT * 65536 + toks[i + 1] AS pair
          FROM (SELECT word, toks, unnest(range(1, len(toks))) AS i FROM state WHERE live)) p
    JOIN merges m ON m.pair = p.pair GROUP BY p.word) b ON b.word = s.word
  WHERE s.live
), words AS (SELECT word, toks FROM state WHERE NOT live)
"""

# Ids of each word, and whether they decode to it.
_RESULT = """
, decoded AS (
  SELECT w.word, string_agg(v.hex, '' ORDER BY w.i) AS hex
  FROM (SELECT word, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tok FROM words) w
  JOIN vocabulary v ON v.id = w.tok GROUP BY w.word)
SELECT w.word, array_to_string(w.toks, ' ') AS ids, coalesce(d.hex = s.hex, false) AS same
FROM words w JOIN start s ON s.word = w.word LEFT JOIN decoded d ON d.word = w.word
"""

# The same for long words: all places of the smallest rank in one step where that is safe.
_LONG = """
WITH RECURSIVE state(word, pos, tok, step, live) AS (
  SELECT word, unnest(range(1, len(toks) + 1)), unnest(toks), 0, true FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN hit THEN merged ELSE tok END, step + 1, live FROM (
    SELECT word, pos, tok, step, merged, best IS NOT NULL AS live,
           hit, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS gone
    FROM (
      SELECT *, best = merged AND (pos = least_pos OR (safe AND (run_pos - run_start) % 2 = 0)) IS TRUE AS hit
      FROM (
        SELECT *, min(CASE WHEN merged = best THEN pos END) OVER (PARTITION BY word) AS least_pos,
               max(CASE WHEN merged IS DISTINCT FROM best THEN run_pos + 1 ELSE 0 END)
                 OVER (PARTITION BY word ORDER BY run_pos ROWS UNBOUNDED PRECEDING) AS run_start
        FROM (
          SELECT *, min(merged) OVER (PARTITION BY word) AS best
          FROM (
            SELECT p.*, m.merged, m.safe
            FROM (
              SELECT word, pos, tok, step, lead(tok) OVER w AS nxt, row_number() OVER w - 1 AS run_pos
              FROM state WHERE live WINDOW w AS (PARTITION BY word ORDER BY pos)) p
            LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt)))))
  WHERE NOT gone
), words AS (SELECT word, list(tok ORDER BY pos) AS toks FROM state WHERE NOT live GROUP BY word)
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """One vocabulary in one DuckDB connection; one per Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        self.seen: dict[str, str] = {}
        self.find = regex.compile(pattern).findall
        self.bytes_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.bytes_ids < 0).any() or max(self.ranks.values()) >= 65536:
            raise ValueError("the vocabulary lacks single bytes or has more than 65,536 tokens")
        left, right, merged = [], [], []
        lowest: dict[bytes, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = token[:i], token[i:]
                lowest[a], lowest[b] = min(rank, lowest.get(a, rank)), min(rank, lowest.get(b, rank))
                if a in self.ranks and b in self.ranks:
                    left.append(self.ranks[a])
                    right.append(self.ranks[b])
                    merged.append(rank)
        by_id = {v: k for k, v in self.ranks.items()}
        safe = [lowest.get(by_id[m], m + 1) > m for m in merged]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "preserve_insertion_order": False})
        self.db.register("given_merges", pa.table({"pair": np.array(left, np.int64) * 65536 + np.array(right, np.int64), "l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32()), "safe": safe}))
        self.db.register("given_vocabulary", pa.table({"id": pa.array(list(by_id), pa.int32()), "hex": [t.hex() for t in by_id.values()]}))
        self.db.execute("CREATE TABLE merges AS FROM given_merges")
        self.db.execute("CREATE TABLE vocabulary AS FROM given_vocabulary")

    def contract(self, words: list[bytes]) -> list[str]:
        """Ids, joined by spaces, of each of the distinct words, none of them empty."""
        found: list = [None] * len(words)
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for picked, query in ((short, _SHORT), (long, _LONG)):
            for at in range(0, len(picked), WORDS):
                part = picked[at : at + WORDS]
                texts = [words[i] for i in part]
                ends = np.cumsum(np.fromiter(map(len, texts), np.int32, len(texts)), dtype=np.int32)
                tok = self.bytes_ids[np.frombuffer(b"".join(texts), np.uint8)]
                toks = pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends]), pa.array(tok))
                self.db.register("start", pa.table({"word": pa.array(part, pa.int32()), "toks": toks, "hex": [t.hex() for t in texts]}))
                got = self.db.sql(query + _RESULT).to_arrow_table()
                self.db.unregister("start")
                if got.num_rows != len(part) or not pa.compute.all(got["same"]).as_py():
                    raise ValueError("a word was lost or its ids do not decode to it")
                for w, ids in zip(got["word"].to_pylist(), got["ids"].to_pylist()):
                    found[w] = ids
        return found

    def decode(self, texts: list[str]) -> list[bytes]:
        """Bytes of each text, given as ids joined by spaces; from the ids and the vocabulary alone."""
        sizes = np.array([t.count(" ") + 1 if t else 0 for t in texts], np.int64)
        ids = np.fromstring(" ".join(filter(None, texts)), np.int32, sep=" ")
        docs = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        found: list[list[bytes]] = [[] for _ in texts]
        for at in range(0, len(ids), IDS):
            doc = docs[at : at + IDS]
            self.db.register("coded", pa.table({"doc": doc, "pos": np.arange(len(doc), dtype=np.int32), "id": ids[at : at + IDS]}))
            got = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("coded")
            if pa.compute.sum(got["n"]).as_py() != len(doc):
                raise ValueError("an id is not in the vocabulary")
            for i, text in zip(got["doc"].to_pylist(), got["hex"].to_pylist()):
                found[i].append(bytes.fromhex(text))
        return [b"".join(f) for f in found]

    def encode_pieces(self, pieces: list[str]) -> list[str]:
        """The same for distinct texts, each cut by the pattern for itself."""
        cut = [[w.encode("utf-8", "replace") for w in self.find(p)] for p in pieces]
        known: dict[bytes, str] = {}
        todo = []
        for w in {w for c in cut for w in c}:
            whole = self.ranks.get(w)
            if whole is None:
                todo.append(w)
            else:
                known[w] = str(whole)
        known.update(zip(todo, self.contract(todo)))
        return [known[c[0]] if len(c) == 1 else " ".join([known[w] for w in c]) for c in cut]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def forget() -> None:
    """Closes the databases of this worker and gives their memory back."""
    codec.cache_clear()
    release_memory()


_RUN = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def cut_text(text: str) -> list[str]:
    """Parts of a text; the first is as it stands, every other one lost the space before it."""
    return text.split(" ") if _RUN.search(text) is None else _CUT.split(text)


class Encoder:
    """Encodes texts block by block, keeping pieces that were seen."""

    def __init__(self, path: str, pattern: str) -> None:
        self.codec = codec(path, pattern)

    def encode(self, texts: list) -> list[tuple[str, bytes]]:
        """Ids joined by spaces, and the bytes that these decode to, of each text."""
        seen = self.codec.seen  # pieces without their leading space
        parts = [cut_text(t or "") for t in texts]
        if len(seen) > CACHE:
            seen.clear()
        rows = [list(map(seen.get, c)) for c in parts]
        fresh = {p for c, r in zip(parts, rows) if None in r for p, i in zip(c[1:], r[1:]) if i is None}
        heads = list({c[0] for c in parts if c[0]})
        # A head stands at the start of a text, without a space before it.
        fresh = list(fresh)
        found = self.codec.encode_pieces([" " + p for p in fresh] + heads)
        seen.update(zip(fresh, found))
        first = dict(zip(heads, found[len(fresh) :]))
        out = []
        for c, r in zip(parts, rows):
            if None in r:
                r = list(map(seen.get, c))
            r[0] = first.get(c[0])
            ids = r if r[0] is not None else r[1:]
            out.append(" ".join(ids))
        return list(zip(out, self.codec.decode(out)))


SCHEMA = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
)
DIGESTS = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
)


def encode(docs: DataFrame, keys: list[str], path: str, pattern: str, text: str = "text") -> DataFrame:
    """``keys, n_tokens, ids, decoded`` of every row's whole text."""

    def start():
        encoder = Encoder(path, pattern)

        def work(texts):
            found = encoder.encode(texts)
            ids = [[int(i) for i in f[0].split()] for f in found]
            return {
                "n_tokens": [len(i) for i in ids],
                "ids": pa.array(ids, pa.list_(pa.int32())),
                "decoded": pa.array([f[1] for f in found], pa.binary()),
            }

        return work

    return map_blocks(docs, keys, text, SCHEMA, start, BLOCK)


def encode_digests(docs: DataFrame, keys: list[str], path: str, pattern: str, text: str = "text", keep: bool = True) -> DataFrame:
    """The same, with SHA-256 digests (of the decimal ids joined by spaces, of the decoded bytes).

    Without ``keep`` a worker forgets the vocabulary and its pieces at the end of each task: slower, but the
    memory is free for what runs next.
    """

    def start():
        encoder = Encoder(path, pattern)

        def work(texts):
            found = encoder.encode(texts)
            return {
                "n_tokens": [f[0].count(" ") + 1 if f[0] else 0 for f in found],
                "ids_sha256": [hashlib.sha256(f[0].encode()).hexdigest() for f in found],
                "decoded_sha256": [hashlib.sha256(f[1]).hexdigest() for f in found],
            }

        return work

    return map_blocks(docs, keys, text, DIGESTS, start, BLOCK, (lambda: None) if keep else forget)
