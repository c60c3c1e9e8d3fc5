"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 6).

Distinct words of a block of texts go into a trie, visited depth first in the order of the sorted
words. Each trie node holds the last token of the encoding of its prefix: the one token that ends
the prefix and stands correctly after the last token of what is left. Prefixes shared by words are
therefore worked out once, and a word's encoding is read back along the last tokens. The operator is
one pass over the texts without any shuffle.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import ship

#: Known words kept by one Python worker before it starts again; bounds memory, never the result.
KNOWN_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def default_vocabulary() -> tuple[str, str]:
    """Path and word pattern of ``byte_bpe_50k``."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


class TrieEncoder:
    """Byte-pair encoding of words by last-token states on a trie of distinct words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.spines: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into ``token``; None for a single byte."""
        word, ranks = self.text[token], self.ranks
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) == 1:
            return None
        while len(parts) > 2:
            best, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best >= token:
                raise ValueError("the vocabulary has a token that its own merges do not make")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Tokens at the left (0) or right (1) end of ``token`` while it was merged, each with the rank that ends it."""
        got = self.spines.get((token, side))
        if got is None:
            got, t, until = [], token, 1 << 60
            while True:
                got.append((self.text[t], until))
                if t not in self.parts:
                    self.parts[t] = self.halves(t)
                pair = self.parts[t]
                if pair is None:
                    break
                until, t = t, pair[side]
            self.spines[token, side] = got
        return got

    def stands_after(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``: merging their bytes in the order of ranks ends in just these two.

        It does unless some end of ``a`` and some start of ``b`` merge with each other while both are
        there, i.e. at a lower rank than the merges that use them up. Equal ranks go from the left.
        """
        ok = self.follows.get((a, b))
        if ok is None:
            get, ok = self.ranks.get, True
            right = self.spine(b, 0)
            for x, x_until in self.spine(a, 1):
                for y, y_until in right:
                    r = get(x + y)
                    if r is not None and r < x_until and r <= y_until:
                        ok = False
                        break
                if not ok:
                    break
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            self.follows[a, b] = ok
        return ok

    def learn(self, words: set[str]) -> None:
        """Encode new distinct words: their trie is visited depth first."""
        ranks, longest, stands = self.ranks, self.longest, self.stands_after
        last: list[int] = [-1]  # last[d]: last token of the encoding of the first d bytes
        size: list[int] = [0]
        before = b""
        for word, text in sorted((w.encode(), w) for w in words):
            d = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                d += 1
            del last[d + 1 :], size[d + 1 :]
            n = len(word)
            while d < n:
                d += 1
                for start in range(max(0, d - longest), d):
                    t = ranks.get(word[start:d])
                    if t is not None and (start == 0 or stands(last[start], t)):
                        last.append(t)
                        size.append(d - start)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte of the text")
            ids = []
            while d:
                ids.append(last[d])
                d -= size[d]
            self.known[text] = tuple(reversed(ids))
            before = word

    def encode(self, texts: list[str | None]) -> tuple[array, array]:
        """Offsets and ids of all texts, in order; null and empty texts have no ids."""
        offsets, ids = array("i", [0]), array("i")
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        split = [self.find(t) if t else () for t in texts]
        self.learn({w for s in split for w in s}.difference(self.known))
        known, put = self.known, ids.extend
        for s in split:
            for w in s:
                put(known[w])
            offsets.append(len(ids))
        return offsets, ids


_encoders: dict[str, TrieEncoder] = {}


def _blocks(batch: pa.RecordBatch, text: int, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of a few million bytes each, so that long texts don't pile up."""
    col = batch.column(text)
    start = size = 0
    for i, n in enumerate(pc.binary_length(col).to_pylist()):
        size += n or 0
        if size >= most_chars:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _map_texts(df: DataFrame, key: str, text: str, out_type: str, build, path: str | None, pattern: str | None, name: str) -> DataFrame:
    ship(df.sparkSession)
    given = default_vocabulary() if path is None or pattern is None else (path, pattern)
    pattern = pattern or given[1]
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(path or given[0]))  # one vocabulary: its size is fixed

    mark = f"{path or given[0]} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoders.get(mark)
        if e is None:
            _encoders.clear()
            e = _encoders[mark] = TrieEncoder(shipped.value, pattern)
        for batch in batches:
            for b in _blocks(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), build(*e.encode(b.column(1).to_pylist()))], names=[key, name])

    key_type = dict(df.select(key).dtypes)[key]
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {key_type}, `{name}` {out_type}")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every text, special tokens' strings being ordinary text.

    Null, empty and - unless the vocabulary says otherwise - no other texts have the empty list.
    Rows are kept as they come: repeated keys give repeated rows, a null key stays. Other columns
    are not read.
    """
    return _map_texts(df, key, text, "array<int>", lambda o, i: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(i, pa.int32())), path, pattern, "ids")


def count(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens): as ``encode``, keeping only the number of ids."""
    return _map_texts(df, key, text, "int", lambda o, i: pa.array([b - a for a, b in zip(o, o[1:])], pa.int32()), path, pattern, "n_tokens")
