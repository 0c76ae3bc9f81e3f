"""Substring deduplication with repeated-phrase automata.

A window of words that occurs twice has the same minimizer (the phrase of ``PHRASE``
words with the smallest hash) at the same place in both occurrences.  So:

1. every document gives the hash of its minimizer phrases, each with a digest of the span
   of words whose windows it stands for; phrases that occur once are done with;
2. windows of the phrases that are left are confirmed: a span that occurs twice confirms
   all its windows at once, of the others each window is counted;
3. the phrases of the passages that recur are the dictionary; each shard of documents
   compiles those that it was sent into an Aho-Corasick automaton and streams its documents
   through it.  Only where the automaton finds a phrase are the windows around it held
   against the confirmed ones, and the words that these cover are removed.

Phrases, spans and windows are counted before their rows meet, and frequent ones are salted
when counts go back to the rows, so no task sees all rows of a frequent phrase.  Texts
travel only for passages that recur: one shard gives the text of a passage's phrase, and
the shards in which the passage occurs are sent it, so automata stay as small as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import lookup_skewed, materialize, partitions, release, shuffle_partitions
from tessella.llm.words import Powers, mix, word_bounds, word_hashes

WINDOW, PHRASE = 35, 8
#: Text bytes of a shard of documents, which one task holds at a time.
SHARD_BYTES = 8_000_000
#: Rows that a map task gathers before it adds up equal ones, and that a task gets behind a shuffle, about.
GATHERED = PER_TASK = 1_000_000
#: Tasks of a stage over shards at most; beyond, a task does several shards one after the other.
MAX_TASKS = 50_000

#: The kind of a window, beside those of spans.
_WINDOW = 8

_U = np.uint64
_POWERS = (Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F))
#: Bytes of text that are worked on at once.
PIECE = 1 << 18


def pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts): runs of texts of about ``PIECE`` bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= PIECE or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


class Texts:
    """The words of some texts in a row, and the phrases that stand for their windows."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        self.start, self.stop = word_bounds(raw)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        #: the number of each text's first word, and of all words
        self.bounds = np.searchsorted(self.start, begins)
        self.window = window
        n = len(self.start)
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        windows = np.flatnonzero(np.arange(n) + window <= ends)
        self.n_windows = len(windows)
        if not self.n_windows:
            return
        # sums of words times powers: any run of words has its digest from two of them
        self.sums = []
        for half, powers in enumerate(_POWERS):
            sums = np.zeros(n + 1, _U)
            np.cumsum(word_hashes(raw, self.start, self.stop, half) * powers.upto(n)[0], out=sums[1:])
            self.sums.append(sums)
        phrases = mix((self.sums[0][PHRASE:] - self.sums[0][:-PHRASE]) * _POWERS[0].upto(n)[1][: n - PHRASE + 1])
        # the leftmost smallest phrase of each window, from runs of phrases twice as long each time
        width, size = 1, window - PHRASE + 1
        least, own = phrases, np.arange(len(phrases))
        while width < size:
            step = min(width, size - width)
            behind = least[step:] < least[:-step]
            own = np.where(behind, own[step:], own[:-step])
            least = np.where(behind, least[step:], least[:-step])
            width += step
        own = own[windows]
        # windows in a row with one minimizer are a span: its phrase, first and last window
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)])
        self.first = windows[new]
        self.last = np.concatenate([windows[:-1][new[1:]], windows[-1:]])
        self.at = own[new]
        self.phrase = phrases[self.at]

    def _digests(self, start: np.ndarray, stop: np.ndarray, salt: np.ndarray | int) -> list[np.ndarray]:
        down = [p.upto(len(self.start))[1] for p in _POWERS]
        return [mix((s[stop] - s[start]) * d[start] + np.asarray(salt, _U)) for s, d in zip(self.sums, down, strict=True)]

    def spans(self, chosen: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """For each span a 128-bit digest of its words and of where the phrase lies."""
        first, last = self.first[chosen], self.last[chosen]
        place = ((self.at[chosen] - first).astype(_U) << _U(32)) + (last - first + 1).astype(_U)
        return self._digests(first, last + self.window, place * _U(0x94D049BB133111EB))

    def windows(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and 128-bit digest of each window of the given spans."""
        sizes = self.last[spans] - self.first[spans] + 1
        starts = np.repeat(self.first[spans] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return starts, *self._digests(starts, starts + self.window, 0)

    def phrase_texts(self, chosen: np.ndarray | slice = slice(None)) -> list[bytes]:
        """The text of each span's phrase; words have to be joined by one space."""
        at = self.at[chosen]
        return [self.data[a:b] for a, b in zip(self.start[at].tolist(), self.stop[at + PHRASE - 1].tolist(), strict=True)]


def _added(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows whose columns but the last (a count) are equal made one, their counts added."""
    *keys, n = columns
    if not len(n):
        return columns
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], 0)]
    return [*(k[new] for k in keys), np.add.reduceat(n[order], np.flatnonzero(new))]


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == _U else c.astype(np.int64)) for c in columns], names=names)


def _joined(texts: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts' words, joined by one space."""
    return [b" ".join(t.split()) for t in texts.cast(pa.binary()).to_pylist()]


def _count_spans(window: int):
    names = ["phrase", "d1", "d2", "shard", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            shards = b.column(1).to_numpy()
            for place, some in pieces(_joined(b.column(0))):
                found = Texts(some, window)
                if found.n_windows:
                    of = np.searchsorted(found.bounds, found.first, "right") - 1
                    held.append([found.phrase, *found.spans(), shards[place + of], np.ones(len(of), np.int64)])
                    size += len(of)
            if size > GATHERED:
                yield _batch(_added([np.concatenate(c) for c in zip(*held, strict=True)]), names)
                held, size = [], 0
        if held:
            yield _batch(_added([np.concatenate(c) for c in zip(*held, strict=True)]), names)

    return count


def _recurring_spans(counted: DataFrame) -> DataFrame:
    """(d1, d2, shard, kind, uses): what each shard has to do with each span of the phrases that occur twice or more.

    ``kind`` adds up 1: the span occurs twice or more, so all its windows are confirmed;
    2: its windows are to be counted; 4: the shard gives the text of its phrase.  Spans of
    which others share only some windows have 1 and, in one shard, 2.  ``uses`` is the
    number of the span's rows.
    """
    mixed = (F.min("d1") < F.max("d1")) | (F.min("d2") < F.max("d2"))
    phrases = counted.groupBy("phrase").agg(F.sum("n").alias("phrase_n"), F.count("*").alias("phrase_uses"), mixed.alias("mixed"))
    phrases = materialize(phrases.where("phrase_n > 1").drop("phrase_n"), "repeat-phrases")
    met = lookup_skewed(counted, phrases, ["phrase"], "phrase_uses").where("phrase_uses is not null")
    rows = materialize(met.select("d1", "d2", "shard", "n", "mixed"), "repeat-candidates")
    spans = rows.groupBy("d1", "d2").agg(F.sum("n").alias("span_n"), F.count("*").alias("uses"), F.min("shard").alias("giver"))
    spans = materialize(spans, "repeat-distinct")
    gives = F.col("shard") == F.col("giver")
    kind = F.when(F.col("span_n") > 1, 1).otherwise(0) + F.when(F.col("mixed") & ((F.col("span_n") == 1) | gives), 2).otherwise(0) + F.when(gives, 4).otherwise(0)
    known = lookup_skewed(rows.drop("n"), spans, ["d1", "d2"], "uses").select("d1", "d2", "shard", kind.cast("long").alias("kind"), "uses")
    known = materialize(known, "repeat-spans")
    release(phrases, rows, spans)
    return known


def _recurring(windows: DataFrame) -> DataFrame:
    """(d1, d2, shard, kind) of the windows that occur twice or more."""
    twice = windows.groupBy("d1", "d2").agg(F.sum("n").alias("window_n"), F.count("*").alias("uses"))
    twice = materialize(twice.where("window_n > 1").drop("window_n"), "repeat-twice")
    met = lookup_skewed(windows.drop("n"), twice, ["d1", "d2"], "uses").where("uses is not null")
    met = materialize(met.select("d1", "d2", "shard", F.lit(_WINDOW).alias("kind")), "repeat-windows")
    release(twice)
    return met


class _Known:
    """Digests of a shard with their kinds."""

    def __init__(self, table: pa.Table) -> None:
        d1, d2, kind = (table.column(c).to_numpy() for c in ("d1", "d2", "kind"))
        self.order = np.argsort(d1, kind="stable")
        self.d1, self.d2, self.kind = d1[self.order], d2[self.order], kind[self.order]

    def places(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """A place of each digest in the sorted arrays, -1 where unknown."""
        d1, d2, out = d1.view(np.int64), d2.view(np.int64), np.full(len(d1), -1)
        if not len(self.d1) or not len(d1):
            return out
        at = np.searchsorted(self.d1, d1)
        open_ = np.arange(len(d1))
        while len(open_):  # first halves that are equal by chance stand side by side
            open_ = open_[at[open_] < len(self.d1)]
            open_ = open_[self.d1[at[open_]] == d1[open_]]
            met = self.d2[at[open_]] == d2[open_]
            out[open_[met]] = at[open_[met]]
            open_ = open_[~met]
            at[open_] += 1
        return out

    def kinds(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """The kind of each digest, 0 where unknown."""
        return np.r_[self.kind, 0][self.places(d1, d2)]


_FOUND = "d1 long, d2 long, shard long, n long, text binary"


def _count_windows(window: int):
    """Of a shard: its windows that are to be counted, and the texts of the phrases that it gives (n: the rows to be sent one)."""

    def count(docs: pa.Table, spans: pa.Table) -> pa.Table:
        known, held, texts = _Known(spans), [], {}
        uses = spans.column("uses").to_numpy()[known.order]
        for _, some in pieces(_joined(docs.column("text"))) if spans.num_rows else ():
            found = Texts(some, window)
            if found.n_windows:
                s1, s2 = found.spans()
                places = known.places(s1, s2)
                kinds = np.r_[known.kind, 0][places]
                chosen = np.flatnonzero(kinds & 2)
                _, w1, w2 = found.windows(chosen)
                # a window of a confirmed span occurs elsewhere, too
                twice = np.repeat(kinds[chosen] & 1, (found.last - found.first + 1)[chosen])
                held.append([w1, w2, np.ones(len(w1), np.int64) + twice])
                given = np.flatnonzero(kinds & 4)
                digests = zip(s1.view(np.int64)[given].tolist(), s2.view(np.int64)[given].tolist(), uses[places[given]].tolist(), strict=True)
                texts.update(zip(digests, found.phrase_texts(given), strict=True))
        shard = docs.column("shard")[0].as_py() if docs.num_rows else 0
        d1, d2, n = _added([np.concatenate(c) for c in zip(*held, strict=True)]) if held else (np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))
        t1, t2, sent = (np.array(c, np.int64) for c in zip(*texts, strict=True)) if texts else [np.zeros(0, np.int64)] * 3
        columns = [np.r_[d1.view(np.int64), t1], np.r_[d2.view(np.int64), t2], np.full(len(n) + len(sent), shard), np.r_[n, sent]]
        out = _batch(columns, ["d1", "d2", "shard", "n"])
        return pa.Table.from_batches([out]).append_column("text", pa.array([None] * len(n) + list(texts.values()), pa.binary()))

    return count


class Phrases:
    """The automaton over some phrases, whose words are joined by one space."""

    def __init__(self, phrases: list[bytes]) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase in phrases:
            self.automaton.add_word(f" {phrase.decode()} ", True)
        if phrases:
            self.automaton.make_automaton()

    def places(self, words: bytes) -> np.ndarray:
        """The numbers of the words where a phrase starts in words that are joined by one space."""
        if not len(self.automaton):
            return np.zeros(0, np.int64)
        text = f" {words.decode()} "
        ends = np.fromiter((end for end, _ in self.automaton.iter(text)), np.int64)
        # a phrase ends with the space behind its last word
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
        return np.searchsorted(spaces, ends) - PHRASE


def _covered(found: Texts, places: np.ndarray, known: _Known) -> np.ndarray:
    """How many confirmed windows around the places cover each word."""
    covered = np.zeros(len(found.start) + 1, np.int64)
    if found.n_windows and len(places):
        near = np.zeros(len(found.start) + 1, bool)
        near[places] = True
        hit = np.flatnonzero(near[found.at])  # elsewhere a phrase stands for no window
        kinds = known.kinds(*found.spans(hit))
        whole = hit[kinds & 1 > 0]
        np.add.at(covered, found.first[whole], 1)
        np.add.at(covered, found.last[whole] + found.window, -1)
        starts, w1, w2 = found.windows(hit[(kinds & 3) == 2])
        starts = starts[known.kinds(w1, w2) == _WINDOW]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + found.window, -1)
    return np.cumsum(covered)[:-1]


_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _remove(window: int):
    def remove(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        known, phrases = _Known(confirmed), Phrases(confirmed.column("text").combine_chunks().unique().drop_null().to_pylist())
        n_words, n_removed, kept = [], [], []
        for _, some in pieces(_joined(docs.column("text"))):
            places = phrases.places(b" ".join([t for t in some if t]))
            if not len(places):
                n_words += [t.count(b" ") + 1 if t else 0 for t in some]
                n_removed += [0] * len(some)
                kept += some
                continue
            found = Texts(some, window)
            gone = _covered(found, places, known) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            for i, text in enumerate(some):
                lo, hi = found.bounds[i], found.bounds[i + 1]
                n_words.append(int(hi - lo))
                n_removed.append(int(total[hi] - total[lo]))
                kept.append(b" ".join([w for w, g in zip(text.split(b" "), gone[lo:hi].tolist(), strict=True) if not g]) if n_removed[-1] else text)
        columns = [docs.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are runs of anything but ASCII white space, compared as they are.  A word goes if
    a window of ``window`` words that covers it has a word sequence that also starts
    anywhere else, in the same document or another; windows are judged on the input.  A
    text that is null or has fewer words than a window loses nothing.  Rows that repeat a
    document repeat its windows, so both lose them.  doc_id may be null; other columns are
    left out.  ``window`` has to be at least ``PHRASE`` words.
    """
    if window < PHRASE:
        raise ValueError(f"a window has {PHRASE} words at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(n_bytes // SHARD_BYTES) + 1
    # rows that repeat one id are told apart by their text
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.md5("text")), F.lit(shards)).cast("int"))

    # a task holds a shard at a time; shards are dealt by their numbers, so tasks get equally many
    tasks = min(shards, MAX_TASKS)
    sharded = lambda df: df.withColumn("shard", F.col("shard").cast("int")).repartitionById(tasks, F.col("shard")).groupBy("shard")
    # a word has six bytes with its space, a span's minimizer stands for 14 words on average; windows come from spans that recur
    with shuffle_partitions(docs.sparkSession, partitions(docs.sparkSession, n_bytes / 6 / 14, PER_TASK)):
        counted = materialize(rows.select("text", "shard").mapInArrow(_count_spans(window), "phrase long, d1 long, d2 long, shard long, n long"), "repeat-counts")
        spans = _recurring_spans(counted)
        release(counted)
        found = sharded(rows).cogroup(sharded(spans.where("kind >= 2"))).applyInArrow(_count_windows(window), _FOUND)
        found = materialize(found, "repeat-found")
        windows = _recurring(found.where("text is null").drop("text"))
        texts = found.where("text is not null").select("d1", "d2", F.col("n").alias("sent"), "text")
        confirmed = materialize(lookup_skewed(spans.drop("uses"), texts, ["d1", "d2"], "sent").drop("sent"), "repeat-confirmed")
        release(spans, found)
    confirmed = confirmed.unionByName(windows, allowMissingColumns=True)
    return sharded(rows).cogroup(sharded(confirmed)).applyInArrow(_remove(window), _RESULT)


def removal_digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
