"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has ``CHUNKS`` chunks of ``SYMBOLS`` b-bit MinHash symbols.  Two
signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols have, by the pigeonhole
principle, a chunk that differs in at most ``ERRORS``; so each chunk is filed under every
way of leaving out ``ERRORS`` of its symbols, and all such pairs meet.  Where they meet, a
longer sketch groups what is alike enough to be looked at, and every group's shingle sets
are compared exactly.

Expected mismatches at similarity s are 1 - s of the symbols.  At 0.75 a chunk is within one
error with probability 0.738, so ten chunks all fail with probability 1.5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import lookup_skewed, materialize, partitions, release
from tessella.llm.components import connected_components
from tessella.llm.words import mix, word_bounds, word_hashes

SHINGLE, SIMILARITY_PCT = 5, 75
CHUNKS, SYMBOLS, ERRORS = 10, 4, 1
#: Symbols of 8 bits in the sketch, and the mismatches up to which two are looked at: at
#: similarity 0.75 32 are expected, with a standard deviation of 4.9.
SKETCH, SKETCH_MISMATCHES = 128, 60
#: Documents of a block in the exact comparison of a large group, and of its leaders (on average), whom every
#: block meets first.
BLOCK, LEADERS = 64, 32
#: Keys with sketches that a task holds at once, and shingle sets that it reads one cell after the other.
SKETCHES_PER_TASK, SETS_PER_TASK = 500_000, 20_000
#: Rows of a bucket above which its rows meet block by block, in blocks of so many on average.
LARGE_BUCKET = 1024

_U = np.uint64
_LEFT_OUT = [tuple(i for i in range(SYMBOLS) if i not in out) for out in combinations(range(SYMBOLS), ERRORS)]


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes of a text, A-Z lower-cased.

    With fewer than five words the whole sequence is one shingle; without words there is none.
    """
    raw = np.frombuffer(text.lower(), np.uint8)
    start, stop = word_bounds(raw)
    if not len(start):
        return np.zeros(0, _U)
    h = word_hashes(raw, start, stop)
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, size, _U)
    for i in range(size):
        out = mix(out * _U(3) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 2**32, SKETCH, dtype=np.uint32)[:, None]


_A, _B = _permutations()


def signature(found: np.ndarray) -> np.ndarray:
    """``SKETCH`` MinHash symbols of 16 bits."""
    h = (found >> _U(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        least = np.full(SKETCH, 2**32 - 1, np.uint32)
        for start in range(0, len(h), 2048):
            least = np.minimum(least, (_A * h[None, start : start + 2048] + _B).min(1))
        return ((least * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("chunks", pa.binary()), ("sketch", pa.binary())])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(1).cast(pa.binary()).to_pylist():
            found = shingles(text or b"")
            if len(found):
                sig = signature(found)
                rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), sig[: CHUNKS * SYMBOLS].tobytes(), (sig & 0xFF).astype(np.uint8).tobytes()))
            else:
                rows.append((0, None, None, None))
        columns = [*zip(*rows, strict=True)] or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(_SKETCHED)[1:], strict=True)]], schema=_SKETCHED)


def _rows_of(column: pa.ChunkedArray | pa.Array, size: int, dtype: type) -> np.ndarray:
    """A column of byte strings of one length as an array with a row for each, without copies of single values."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        _, offsets, data = c.buffers()
        if len(c):
            begin = int(np.frombuffer(offsets, np.int32)[c.offset])
            parts.append(np.frombuffer(data, np.uint8)[begin : begin + len(c) * size])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)).view(dtype).reshape(-1, size // np.dtype(dtype).itemsize)


def _bucket_keys(chunks: np.ndarray) -> np.ndarray:
    """For the symbols of some rows, a key for each chunk and way of leaving out symbols: all of it in 64 bits."""
    sym = chunks.reshape(-1, CHUNKS, SYMBOLS).astype(_U)
    out = np.empty((len(sym), CHUNKS, len(_LEFT_OUT)), _U)
    for v, stay in enumerate(_LEFT_OUT):
        key = np.arange(CHUNKS, dtype=_U)[None, :] * _U(len(_LEFT_OUT)) + _U(v)
        for i in stay:
            key = (key << _U(16)) | sym[:, :, i]
        out[:, :, v] = key
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 4096):
            piece = b.slice(start, 4096)
            keys = _bucket_keys(_rows_of(piece.column(1), CHUNKS * SYMBOLS * 2, np.uint16)).reshape(piece.num_rows, -1) if piece.num_rows else np.zeros((0, 1), _U)
            rep = np.repeat(piece.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(rep)], names=["key", "rep"])


def spanning_links(near) -> list[tuple[int, int]]:
    """Links that hold each group of alike rows together; ``near(i, rest)`` tells which of ``rest`` are like i."""
    rest, links = near.rows, []
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            i = stack.pop()
            like = near(i, rest)
            if like.any():
                met = rest[like]
                links += [(i, int(j)) for j in met]
                stack += met.tolist()
                rest = rest[~like]
    return links


class _BySketch:
    def __init__(self, sketches: np.ndarray) -> None:
        self.sketches, self.rows = sketches, np.arange(len(sketches))

    def __call__(self, i: int, rest: np.ndarray) -> np.ndarray:
        return self.like(self.sketches[i], rest)

    def like(self, sketch: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.empty(len(rest), bool)
        for start in range(0, len(rest), 65_536):
            part = rest[start : start + 65_536]
            out[start : start + 65_536] = (self.sketches[part] != sketch).sum(1) <= SKETCH_MISMATCHES
        return out


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the alike rows of each bucket of the partition."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    joined = pa.Table.from_batches(table)
    key, rep = joined.column(0).to_numpy(), joined.column(1).to_numpy()
    sketch = _rows_of(joined.column(2), SKETCH, np.uint8)
    del joined, table
    order = np.lexsort([rep, key])
    key, rep = key[order], rep[order]
    bounds = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
    seen: set[bytes] = set()
    a, b = [], []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        members = rep[lo:hi]
        if hi - lo < 2 or (mark := members.tobytes() if hi - lo < 64 else xxhash.xxh3_128_digest(members.tobytes())) in seen:
            continue
        seen.add(mark)  # many buckets hold the same rows
        for i, j in spanning_links(_BySketch(sketch[order[lo:hi]])):
            a.append(members[i])
            b.append(members[j])
    yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])


def _alike_outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows that ask, one to each other part that has a row alike in their cell."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    joined = pa.Table.from_batches(table)
    cell, rep, label = (joined.column(i).to_numpy() for i in range(3))
    asks = joined.column(3).to_numpy()
    sketch = _rows_of(joined.column(4), SKETCH, np.uint8)
    del joined, table
    order = np.argsort(cell, kind="stable")
    bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0]), len(cell)]
    a, b = [], []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        at = order[lo:hi]
        members = at[~asks[at]]
        near, labels, everyone = _BySketch(sketch[members]), label[members], np.arange(len(members))
        for i in at[asks[at]]:
            met = np.unique(labels[near.like(sketch[i], everyone)])
            met = met[met != label[i]]
            a += [rep[i]] * len(met)
            b += met.tolist()
    yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: set[tuple[int, bytes]] = set()  # rows that repeat a document, which lie side by side behind the join
    for b in batches:
        for start in range(0, b.num_rows, 256):
            piece = b.slice(start, 256)
            found, stay = [], []
            for rep, text in zip(piece.column(2).to_pylist(), piece.column(3).cast(pa.binary()).to_pylist(), strict=True):
                here = shingles(text or b"").tobytes()
                mark = (rep, xxhash.xxh3_128_digest(here))
                stay.append(mark not in met)
                if stay[-1]:
                    found.append(here)
                    met.add(mark)
            if len(met) > 100_000:
                met.clear()
            rows = piece.filter(pa.array(stay, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(found, pa.binary())], names=["group_id", "members", "rep", "found"])


def exact_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that hold together what the exact similarity of the sets links."""
    n = np.array([len(s) for s in sets], np.int64)
    tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, doc = tokens[order], doc[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    number, doc = np.unique(number[shared], return_inverse=True)[1] if shared.any() else number[:0], doc[shared]
    common = np.zeros((len(sets), len(sets)), np.int64)
    n_tokens = int(number[-1]) + 1 if len(number) else 0
    width = max(1, min(n_tokens, 4_000_000 // len(sets)))
    edges = np.searchsorted(number, np.arange(0, n_tokens + width, width))
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        if hi > lo:
            x = np.zeros((len(sets), width), np.float32)
            x[doc[lo:hi], number[lo:hi] - k * width] = 1
            common += (x @ x.T).astype(np.int64)  # whole numbers far below 2**24, so exact
    linked = 100 * common >= SIMILARITY_PCT * (n[:, None] + n[None, :] - common)

    class Linked:
        rows = np.arange(len(sets))

        def __call__(self, i: int, rest: np.ndarray) -> np.ndarray:
            return linked[i, rest]

    return spanning_links(Linked())


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links within each (group, cell); rows come sorted by them."""
    key, reps, sets, met, out = None, [], [], set(), []

    def close() -> None:
        if len(reps) > 1:
            out.extend((reps[i], reps[j]) for i, j in exact_links(sets))

    for batch in batches:
        for group, cell, rep, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (group, cell) != key:
                close()
                key, reps, sets, met = (group, cell), [], [], set()
            if (mark := (rep, xxhash.xxh3_128_digest(found))) in met:
                continue  # a row that is repeated
            met.add(mark)
            reps.append(rep)
            sets.append(np.frombuffer(found, _U))
    close()
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct shingles of five words (A-Z lower-cased; words are runs
    of anything but ASCII white space), or the whole sequence if it has fewer.  Documents
    are linked when 100 * intersection >= 75 * union.  component_id is the smallest doc_id
    that can be reached, and the document that has it is kept.  A text without words (null,
    empty, blank) has an empty set and is linked with nothing.  Rows that repeat a doc_id
    are one document: what either is linked with, both are.  A row with a null doc_id is
    linked with nothing, has no component and isn't kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = materialize(rows.mapInArrow(_sketches, "doc_id long, n_shingles long, digest binary, chunks binary, sketch binary"), "near-sketches")
    named = sketched.where("doc_id is not null and digest is not null")
    # rows with equal sets are one from here on
    groups = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("uses"), F.first("chunks").alias("chunks"), F.first("sketch").alias("sketch")), "near-sets")

    shared = _shared(groups.select("rep", "chunks").mapInArrow(_keys, "key long, rep long"), "near-buckets")
    alike = connected_components(_alike_links(shared, groups))

    # groups of alike sets: exact links
    sizes = alike.groupBy("component").agg(F.count("*").alias("members"))
    member = materialize(lookup_skewed(alike, sizes, ["component"], "members"), "near-members")
    texts = rows.join(member.withColumnRenamed("node", "doc_id"), "doc_id").select("component", "members", "doc_id", "text")
    found = materialize(texts.mapInArrow(_sets, "group_id long, members long, rep long, found binary"), "near-shingles")
    confirmed = _with_leaders(found)
    if found.where(F.col("members") > BLOCK).limit(1).count():
        confirmed = materialize(confirmed, "near-links")
        confirmed = confirmed.unionByName(_rest_of_large_groups(found, connected_components(confirmed)))
    # an id with several sets holds them together
    several = named.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high")).where("low <> high").select("doc_id")
    same = named.join(several, "doc_id").select("doc_id", "digest").join(groups.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = connected_components(confirmed.unionByName(same))

    reach = groups.select("digest", "rep", "uses").join(links.withColumnRenamed("node", "rep"), "rep", "left")
    reach = materialize(reach.select("digest", F.coalesce("component", "rep").alias("reached"), "uses"), "near-reach")
    release(groups, shared, member, found)
    out = lookup_skewed(sketched.select("doc_id", "n_shingles", "digest"), reach, ["digest"], "uses")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("reached", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _alike_links(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Links that hold together what the sketches link within each bucket, however large."""
    large = shared.where(F.col("size") > LARGE_BUCKET)
    sketches = groups.select("rep", "sketch")

    def cells(dealt: DataFrame, rows: int) -> DataFrame:
        return dealt.join(sketches, "rep").repartition(partitions(shared.sparkSession, rows, SKETCHES_PER_TASK), F.col("key"))

    n_large = large.count()
    dealt = shared.where(F.col("size") <= LARGE_BUCKET).select("key", "rep")
    if n_large:
        # each block of a large bucket together with the bucket's leaders
        blocks = F.ceil(F.col("size") / LARGE_BUCKET)
        leads = F.pmod(F.xxhash64(F.lit(1), F.col("rep")), F.ceil(F.col("size") / LEADERS)) == 0
        at = F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), blocks))))
        dealt = dealt.unionByName(large.withColumn("i", at).select(F.xxhash64("key", "i").alias("key"), "rep"))
    links = cells(dealt, shared.count() + n_large).select("key", "rep", "sketch").mapInArrow(_alike, "a long, b long")
    if not n_large:
        return links
    links = materialize(links, "near-alike")
    # each row outside its bucket's largest part with all of the bucket, as in _rest_of_large_groups
    parts = connected_components(links).select(F.col("node").alias("rep"), "component")
    labelled = materialize(large.join(parts, "rep", "left").select("key", "size", "rep", F.coalesce("component", "rep").alias("label")), "near-bucket-parts")
    sizes = labelled.groupBy("key", "size", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.first("size").alias("uses"), (F.sum("n") - F.max("n")).alias("outside"))
    main = materialize(main, "near-bucket-main")
    blocks, outer = F.ceil(F.col("size") / LARGE_BUCKET), F.ceil(F.col("outside") / LARGE_BUCKET)
    n_open = main.where("outside > 0").agg(F.sum(F.col("outside") * F.ceil(F.col("uses") / LARGE_BUCKET) + F.col("uses") * outer)).first()[0]
    if not n_open:
        return links
    rows = lookup_skewed(labelled, main, ["key"], "uses").where("outside > 0")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    queries = rows.where(F.col("label") != F.col("main")).withColumn("i", F.pmod(F.xxhash64("rep"), outer)).withColumn("j", every(blocks)).withColumn("asks", F.lit(True))
    members = rows.withColumn("j", F.pmod(F.xxhash64("rep"), blocks)).withColumn("i", every(outer)).withColumn("asks", F.lit(False))
    met = queries.unionByName(members).select(F.xxhash64("key", "i", "j").alias("key"), "rep", "label", "asks")
    return links.unionByName(cells(met, n_open).select("key", "rep", "label", "asks", "sketch").mapInArrow(_alike_outside, "a long, b long"))


def _compared(dealt: DataFrame, rows: int) -> DataFrame:
    """Links within each cell of rows with rep and found: (group_id, cell), which are numbered from 0 in each group.

    The cells of a group go to tasks in turn, so no task gets many of one large group.
    """
    tasks = partitions(dealt.sparkSession, rows, SETS_PER_TASK)
    task = F.pmod(F.xxhash64("group_id") + F.col("cell"), F.lit(tasks)).cast("int")
    met = dealt.select("group_id", "cell", "rep", "found").withColumn("task", task).repartitionById(tasks, F.col("task"))
    return met.sortWithinPartitions("group_id", "cell", "rep").select("group_id", "cell", "rep", "found").mapInArrow(_confirmed, "a long, b long")


def _with_leaders(found: DataFrame) -> DataFrame:
    """Links within small groups, and within each block of a large group together with the group's leaders."""
    blocks = F.ceil(F.col("members") / BLOCK)
    leads = (F.col("members") > BLOCK) & (F.pmod(F.xxhash64(F.lit(1), F.col("rep")), F.ceil(F.col("members") / LEADERS)) == 0)
    own = F.pmod(F.xxhash64("rep"), blocks)
    at = F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(own)))
    return _compared(found.withColumn("cell", at), found.count())


def _rest_of_large_groups(found: DataFrame, parts: DataFrame) -> DataFrame:
    """The links of large groups that their leaders don't account for.

    Most members of a large group hang together already.  Each member outside its group's
    largest part is compared with every other member, block by block.
    """
    large = found.where(F.col("members") > BLOCK).select("group_id", "members", "rep").distinct()
    labelled = large.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("group_id", "members", "rep", F.coalesce("component", "rep").alias("label"))
    labelled = materialize(labelled, "near-parts")
    sizes = labelled.groupBy("group_id", "members", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group_id").agg(F.max_by("label", "n").alias("main"), F.first("members").alias("uses"), (F.sum("n") - F.max("n")).alias("outside"))
    open_ = lookup_skewed(labelled, main, ["group_id"], "uses").where("outside > 0").select("rep", (F.col("label") != F.col("main")).alias("out"), "outside")
    rows = found.join(open_, "rep")
    blocks, outer = F.ceil(F.col("members") / BLOCK), F.ceil(F.col("outside") / BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    queries = rows.where("out").withColumn("i", F.pmod(F.xxhash64("rep"), outer)).withColumn("j", every(blocks))
    members = rows.withColumn("j", F.pmod(F.xxhash64("rep"), blocks)).withColumn("i", every(outer))
    cells = queries.unionByName(members, allowMissingColumns=True).withColumn("cell", F.col("i") * blocks + F.col("j"))
    return _compared(cells, rows.agg(F.sum(outer)).first()[0] or 0)


def _shared(keys: DataFrame, name: str) -> DataFrame:
    """The rows whose key another row has, and how many have it; keys of any size are counted before they meet."""
    counted = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    counted = materialize(counted, f"{name}-sizes")
    shared = materialize(lookup_skewed(keys, counted, ["key"], "size").where("size is not null"), name)
    release(counted)
    return shared


def dedup_near(docs: DataFrame, one_row: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``near_groups`` keeps; rows without a doc_id stay, too.

    Rows that repeat a kept doc_id all stay; with ``one_row`` only that with the smallest text does (null
    first; of equal texts the smallest row, as far as its columns can be ordered).  What goes and what is repeated
    is told by ids alone, so texts meet the ids that go, not those that stay, and are shuffled once at most unless
    very many ids are repeated; rows of one id are reduced before they are shuffled.
    """
    groups = near_groups(docs)
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("uses"))
    marked = materialize(ids.where("not kept or uses > 1"), "near-marked")
    release(groups)
    gone = materialize(marked.where("not kept").select(F.col("doc_id").alias("_gone_id")), "near-gone")
    stay = docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
    if not one_row:
        release(marked)
        return stay
    repeated = materialize(marked.where("kept").select(F.col("doc_id").alias("_again_id")), "near-repeated")
    release(marked)
    if not repeated.limit(1).count():
        return stay
    same = docs["doc_id"] == repeated["_again_id"]
    order = F.struct("text", *[c.name for c in docs.schema.fields if "map<" not in c.dataType.simpleString() and "variant" not in c.dataType.simpleString()])
    smallest = docs.join(repeated, same, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), order).alias("_row"))
    return stay.join(repeated, same, "left_anti").unionByName(smallest.select("_row.*"))
