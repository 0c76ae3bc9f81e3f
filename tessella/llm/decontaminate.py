"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is split into k + 1 pieces.  A passage within k
edits of the item holds at least one piece unchanged, so exact piece hits (found with one
automaton over all pieces) give every candidate place, and Myers' bit-parallel edit
distance verifies it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Normalised characters of items that one automaton holds; more items go in several passes.
SHARD_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    """A-Z lower-cased, runs of ASCII white space made one space, none at the ends."""
    return b" ".join((text or "").encode().lower().split()).decode()


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    budget: int

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): budget + 1 pieces that cover the text."""
        n = self.budget + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern_masks: dict[str, int], m: int, text: str, budget: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the best match of a pattern within ``text``, or None above the budget.

    The end is where the first best match ends (exclusive).  An anchored match begins where the text does.
    """
    full, high, first = (1 << m) - 1, 1 << (m - 1), int(anchored)
    pv, mv, score = full, 0, m
    best, best_end = budget + 1, -1
    get = pattern_masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | first) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, best_end = score, j + 1
    return (best, best_end) if best <= budget else None


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """All items of one shard."""

    def __init__(self, items: list[Item]) -> None:
        self.items, self.masks = items, [masks(i.text) for i in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(items):
            for offset, piece in item.pieces():
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def _matches(self, text: str) -> Iterator[tuple[Item, int, int]]:
        """(item, distance, end) of each item's best passage in a text."""
        if not self.items:
            return
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                item = self.items[n]
                if not item.budget and n in found:
                    continue  # its one piece is the whole item: the first hit is as good as any
                start = last + 1 - size - offset
                span = (max(0, start - item.budget), start + len(item.text) + item.budget)
                if min(span[1], len(text)) - span[0] < len(item.text) - item.budget:
                    continue
                spans = found.setdefault(n, [])
                if spans and spans[-1][0] <= span[0] <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], span[1]))
                else:
                    spans.append(span)
        for n, spans in found.items():
            item, best = self.items[n], None
            for a, b in spans:
                met = myers(self.masks[n], len(item.text), text[a:b], item.budget)
                if met and (best is None or met[0] < best[0]):
                    best = (met[0], a + met[1])
            if best:
                yield item, *best

    def holds(self, text: str) -> bool:
        """Does a normalised text hold a passage of any item?"""
        return bool(text) and next(self._matches(f" {text} "), None) is not None

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item's best passage in a normalised text, without spaces at its ends."""
        out, padded = [], f" {text} "
        for item, distance, end in self._matches(padded) if text else ():
            start = self._start(item, padded, end, distance)
            passage = padded[start:end]
            start, end = start + len(passage) - len(passage.lstrip(" ")), end - len(passage) + len(passage.rstrip(" "))
            out.append((item.item_id, distance, start - 1, end - 1))
        return out

    @staticmethod
    def _start(item: Item, text: str, end: int, distance: int) -> int:
        """Where the passage that ends at ``end`` begins: the match of the reversed item at the beginning of the reversed text."""
        if not distance:
            return end - len(item.text)
        back = text[max(0, end - len(item.text) - item.budget) : end][::-1]
        return end - myers(masks(item.text[::-1]), len(item.text), back, distance, anchored=True)[1]


def load_items(benchmark: DataFrame, error_rate: float = ERROR_RATE, whole_words: bool = False) -> Iterator[list[Item]]:
    """The items in shards of bounded size, one at a time.  The benchmark is the query set and is read whole."""
    if not 0 <= error_rate < 1:
        raise ValueError("error_rate is a share of an item's characters below 1")
    shard: list[Item] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        text = normalise(row.text)
        if not text:
            continue
        if size + len(text) > SHARD_CHARS and shard:
            yield shard
            shard, size = [], 0
        shard.append(Item(row.item_id, f" {text} " if whole_words else text, int(len(text) * error_rate)))
        size += len(text)
    yield shard


_HITS = "doc_id long, item_id long, distance int, start int, end int"
_HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, whole_words: bool = False) -> DataFrame:
    """(doc_id, item_id, distance, start, end): each document that holds a passage within the budget of an item.

    Texts are compared as ``normalise`` gives them, and start and end count its characters.
    The budget is ``error_rate`` edits for each character of the item, rounded down, whatever its
    length; so items of up to 12 characters have to occur as they are.  With ``whole_words`` the spaces
    around an item (or the text's ends) belong to it and count as its characters when edits are counted,
    which keeps short items from being found inside of words.  An item without
    an id or without characters is not searched for; a null or empty text holds nothing.  Rows that repeat a doc_id give a row each; of several
    passages of one item in a text the closest, then the first, is given.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in load_items(benchmark, error_rate, whole_words):
        sent = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                hits = [(i, *h) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for h in matcher.find(normalise(t))]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hits, strict=True), _HITS_ARROW, strict=True)], schema=_HITS_ARROW)

        part = rows.mapInArrow(search, _HITS)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, whole_words: bool = False) -> DataFrame:
    """``docs`` without the rows whose text holds a passage of the benchmark; all columns are kept.

    Rows are judged one by one in the pass that reads them, so nothing is shuffled.
    """
    spark = docs.sparkSession
    at = docs.columns.index("text")
    out = docs
    for items in load_items(benchmark, error_rate, whole_words):
        sent = spark.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.holds(normalise(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
