"""Token counts at every prefix of a text.

A byte-level BPE tokenizer splits a text into pieces and encodes each by itself, so the
count of a text is a sum over its pieces, and a count inside a piece is found by dynamic
programming over its bytes: the encoding of every prefix ends in the one token that is
compatible with the encoding of what stands before it.  A text's prefix table says for each
byte by how much the count changes with it; its running sum is the count at every prefix,
its end the text's count, and it answers truncation and budget questions without encoding
again.
"""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate, chain, repeat
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the tokenizer cuts a text into pieces, with white space spelled out.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters whose classes are the same in every Unicode table since long ago; a text with others is cut by the library itself.
SETTLED = r"[\t-\r -~\xa0-ɏͰ-ͳΆΈ-ΊΌΎ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞€]*"
#: Pieces that a task remembers; the table is emptied when full, which changes no count.
REMEMBERED = 400_000
#: Code points of a piece beyond which its prefixes are looked up in one pass over it.
LONG = 64


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact counts for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            data = json.load(f)
        self.specials = [t["content"] for t in data["added_tokens"] if t["special"]]
        self._split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self._pieces, self._settled = regex.compile(PIECES), regex.compile(SETTLED)
        self._model = data["model"]
        self._n: dict[str, bytes] = {}
        self._whole: dict[bytes, bool] = {}
        self._follows: dict[tuple[bytes, bytes], bool] = {}
        self._tails: dict[str, int] = {}
        self._pairs: dict[int, bool] = {}

    # -- counts of whole pieces

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; a special string is a piece of its own."""
        parts = self._split.split(text) if self._split else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif self._settled.fullmatch(part):
                out += self._pieces.findall(part)
            else:
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Make the prefix tables of these pieces known."""
        if len(self._n) > REMEMBERED:
            self._n.clear()
        new = [p for p in pieces if p not in self._n]
        short = [p for p in new if len(p) <= LONG and p not in self.specials]
        self._n.update(zip(short, self._within_all([p.encode() for p in short]), strict=True))
        for p in new:
            if p not in self._n:
                counts = self.within(p)
                self._n[p] = array("h", map(sub, counts, [0, *counts[:-1]])).tobytes()

    def changes(self, texts: list[str]) -> list[np.ndarray]:
        """The prefix table of each text: how the count changes with each of its bytes."""
        cut = [self.cut(t) for t in texts]
        self.learn({p for pieces in cut for p in pieces})
        return [np.frombuffer(b"".join(map(self._n.__getitem__, pieces)), np.int16) for pieces in cut]

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """(ends, counts): the code points and the tokens up to the end of each piece, read from the text's prefix table."""
        pieces = self.cut(text)
        running = np.cumsum(self.changes([text])[0], dtype=np.int64)
        at = np.cumsum([len(p.encode()) for p in pieces], dtype=np.int64) - 1
        return list(accumulate(map(len, pieces))), running[at].tolist()

    def totals(self, texts: list[str]) -> list[int]:
        """The count at the last prefix of each text."""
        return [int(c.sum(dtype=np.int64)) for c in self.changes(texts)]

    # -- counts inside a piece

    @cached_property
    def _vocabulary(self) -> dict[bytes, int]:
        back = {v: k for k, v in _byte_letters().items()}
        return {bytes(back[c] for c in t): i for t, i in self._model["vocab"].items() if all(c in back for c in t)}

    @cached_property
    def _merged_from(self) -> dict[bytes, tuple[int, bytes, bytes]]:
        """For each token: its rank and the two tokens that it is merged from."""
        back = {v: k for k, v in _byte_letters().items()}
        out: dict[bytes, tuple[int, bytes, bytes]] = {}
        for rank, pair in enumerate(self._model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = bytes(back[c] for c in a), bytes(back[c] for c in b)
            out.setdefault(left + right, (rank, left, right))
        return out

    @cached_property
    def _sizes(self) -> dict[bytes, list[int]]:
        """The lengths, longest first, that tokens with these last three bytes have, down to one."""
        out: dict[bytes, set[int]] = {}
        for token in self._vocabulary:
            if self._is_whole(token) and len(token) > 2:
                out.setdefault(token[-3:], {1, 2}).add(len(token))
        return {k: sorted(v, reverse=True) for k, v in out.items()}

    def _merge(self, piece: bytes) -> list[bytes]:
        """The tokens of a short byte string, by merging the lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = None
            for i in range(len(parts) - 1):
                m = self._merged_from.get(parts[i] + parts[i + 1])
                if m and m[1] == parts[i] and (best is None or m[0] < best[0]):
                    best = (m[0], i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def within(self, piece: str) -> list[int]:
        """The count at every byte prefix of a piece, from one byte on."""
        if piece in self.specials:
            return [1] * len(piece.encode())
        data = piece.encode()
        sizes, whole, follows = self._sizes, self._whole, self._follows
        last: list[bytes] = [b""]
        counts = [0]
        for end in range(1, len(data) + 1):
            for size in sizes.get(data[max(end - 3, 0) : end], (2, 1)):
                if size > end or (token := data[end - size : end]) not in whole:
                    continue
                before = last[end - size]
                found = follows.get((before, token)) if before else True
                if found or found is None and self._can_follow(before, token):
                    last.append(token)
                    counts.append(counts[end - size] + 1)
                    break
            else:
                raise ValueError(f"no tokens for a prefix of {piece!r}")
        return counts[1:]

    @cached_property
    def _ends(self):
        """(tokens, their sizes, an automaton that finds all that end at a place of a byte string)."""
        import ahocorasick

        tokens = [t for t in self._vocabulary if t in self._whole or self._is_whole(t)]
        automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            automaton.add_word(t.decode("latin-1"), i)
        automaton.make_automaton()
        return tokens, np.array([len(t) for t in tokens], np.int64), automaton

    def _within_all(self, pieces: list[bytes]) -> list[bytes]:
        """The prefix tables of many short pieces: the dynamic programme of ``within``, a place of all pieces at a time."""
        if not pieces:
            return []
        tokens, size_of, automaton = self._ends
        data = b"".join(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(sizes) - sizes
        first = np.repeat(begin, sizes)
        end, token = np.fromiter(chain.from_iterable(automaton.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2).T
        size, place = size_of[token], end - first[end] + 1
        inside = size <= place  # a token that began in the piece before is none
        end, token, size, place = (x[inside] for x in (end, token, size, place))
        order = np.lexsort((-size, end, place))
        end, token, size, place = (x[order] for x in (end, token, size, place))
        number = np.arange(len(end))
        rank = number - np.maximum.accumulate(np.where(np.r_[True, end[1:] != end[:-1]], number, 0))
        last, count = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        bounds = np.searchsorted(place, np.arange(1, sizes.max() + 2))
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            e, t, s, r = end[lo:hi], token[lo:hi], size[lo:hi], rank[lo:hi]
            for k in range(int(r.max()) + 1 if hi > lo else 0):  # the longest token that can stand there
                i = np.flatnonzero((r == k) & (last[e] < 0))
                whole = s[i] == place[lo]
                before = e[i] - s[i]
                ok = whole.copy()
                ok[~whole] = self._can_follow_all(last[before[~whole]], t[i][~whole])
                to = e[i][ok]
                last[to] = t[i][ok]
                count[to] = 1 + np.where(whole[ok], 0, count[before[ok]])
        if (last < 0).any():
            raise ValueError("no tokens for a prefix")
        changes = count - np.where(np.arange(len(data)) == first, 0, np.r_[0, count[:-1]])
        raw = changes.astype(np.int16).tobytes()
        return [raw[2 * a : 2 * (a + n)] for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]

    def _can_follow_all(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        tokens = self._ends[0]
        if len(self._pairs) > 4 * REMEMBERED:
            self._pairs.clear()
        keys = (before * len(tokens) + token).tolist()
        out = np.fromiter(map(self._pairs.get, keys, repeat(2)), np.int8, len(keys))
        for i in np.flatnonzero(out == 2):
            a, b = tokens[before[i]], tokens[token[i]]
            out[i] = self._pairs[keys[i]] = self._merge(a + b) == [a, b]
        return out == 1

    def _is_whole(self, token: bytes) -> bool:
        """Whether merging makes one token of these bytes."""
        if (found := len(self._merge(token)) == 1):
            self._whole[token] = found
        return found

    def _can_follow(self, before: bytes, token: bytes) -> bool:
        if len(self._follows) > REMEMBERED:
            self._follows.clear()
        found = self._follows[before, token] = self._merge(before + token) == [before, token]
        return found

    def prefixes(self, text: str) -> list[int]:
        """The tokens of each prefix by itself, from one code point on."""
        table = ends, counts = self.table(text)
        out: list[int] = []
        for i, end in enumerate(ends):
            start = ends[i - 1] if i else 0
            before = counts[i - 1] if i else 0
            inner = None
            for chars in range(start + 1, end + 1):
                if chars - start <= LONG or text[chars - 1].isspace() or text[start:end] in self.specials:
                    out.append(self.count_at(text, chars, table))
                    continue
                if inner is None:  # a prefix of a long piece is one piece
                    inner = self.within(text[start:end])
                    at = len(text[start : chars - 1].encode())
                at += len(text[chars - 1].encode())
                out.append(before + inner[at - 1])
        return out

    def count_at(self, text: str, chars: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """How many tokens the first ``chars`` code points of a text have by themselves.

        Only the piece that is cut is looked into; all before it comes from the table.
        """
        ends, counts = table or self.table(text)
        i = bisect.bisect_right(ends, chars)
        if 0 < i < len(ends) and ends[i - 1] < chars and text[ends[i - 1] : ends[i]] in self.specials:
            i -= 1  # part of a special string is plain text, which goes on the piece before it
        if chars and text[chars - 1].isspace():  # white space at the end of a text is cut otherwise than before a word
            while i and text[ends[i - 1] - 1].isspace():
                i -= 1
        start, n = (ends[i - 1], counts[i - 1]) if i else (0, 0)
        return n + self._tail(text[start:chars])

    def _tail(self, tail: str) -> int:
        found = self._tails.get(tail)
        if found is None:
            found = sum(self.within(p)[-1] for p in self.cut(tail))
            if len(tail) <= LONG:
                if len(self._tails) > REMEMBERED:
                    self._tails.clear()
                self._tails[tail] = found
        return found

    def budget(self, text: str, n_tokens: int) -> int:
        """How many code points the longest prefix has that is ``n_tokens`` tokens or fewer by itself."""
        table = ends, counts = self.table(text)
        i = bisect.bisect_right(counts, n_tokens)
        best = ends[i - 1] if i else 0
        # the piece that goes beyond the budget; behind white space also the first character of the next
        for chars in range(ends[min(i + 1, len(ends) - 1)], best, -1) if i < len(ends) else ():
            if self.count_at(text, chars, table) <= n_tokens:
                return chars
        return best


@lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    """One counter for all tasks of a worker process."""
    return PrefixCounter(path)


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.

    n_tokens is the end of the text's prefix table.  Counts are those of the library without begin,
    end or added special tokens; special strings inside a text count as the library's default takes
    them.  A null text is empty and has 0 tokens.  ``path`` is a vocabulary file that every executor has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.totals(texts), pa.int64())], schema=_COUNTS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ends, counts, at, changes — code points and tokens up to each piece's end, the tokens of each prefix by itself,
    and the prefix table over bytes (by how much the count changes with each byte of the whole text, as 16-bit numbers).

    ``count_within`` and ``fits_budget`` read ``at``, which has a count for each code point.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                found = [counter.table(t) for t in texts]
                at = [counter.prefixes(t) for t in texts]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in ([f[0] for f in found], [f[1] for f in found], at)]
                changes = pa.array([c.tobytes() for c in counter.changes(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), *lists, changes], names=["doc_id", "ends", "counts", "at", "changes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tables, "doc_id long, ends array<long>, counts array<long>, at array<long>, changes binary")


def count_within(tables: DataFrame, n_chars: int) -> DataFrame:
    """Per row of ``prefix_tables``: the tokens of the first ``n_chars`` code points, or of all if there are fewer."""
    chars = F.least(F.size("at"), F.lit(n_chars))
    return tables.select("doc_id", chars.cast("long").alias("n_chars"), F.coalesce(F.get("at", chars - 1), F.lit(0)).cast("long").alias("n_tokens"))


def fits_budget(tables: DataFrame, n_tokens: int) -> DataFrame:
    """Per row of ``prefix_tables``: the longest prefix, inside a piece or not, within a budget of tokens."""
    fitting = F.filter(F.transform("at", lambda c, i: F.when(c <= n_tokens, i + 1)), lambda i: i.isNotNull())
    chars = F.coalesce(F.array_max(fitting), F.lit(0))
    return tables.select("doc_id", chars.cast("long").alias("n_chars"), F.coalesce(F.get("at", chars - 1), F.lit(0)).cast("long").alias("n_tokens"))
