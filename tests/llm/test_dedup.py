"""Deduplication operators against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import components, exact_dedup, line_dedup, near_dedup, substring_dedup
from tessella.llm.common import lookup_skewed, materialize
from tessella.llm.components import connected_components

SCHEMA = "doc_id long, text string"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "One Two"), (5, "one two"), (6, "one\x0btwo"), (None, "one two"), (None, None), (7, "x y z w v u"), (7, "x y z w v u"), (8, "wort " * 5000), (9, "Àé ÀÉ"), (10, "àé àé")]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# -- exact


def exact_brute(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").encode().lower()].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf_rows", [2, 7, 2048])
def test_exact_groups(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(exact_dedup, "LEAF_ROWS", leaf_rows)
    rng = random.Random(leaf_rows)
    docs = EDGES + [(100 + i, rng.choice(["a", "A", "b", "c d", "hot", "hot", "HOT"]) + str(rng.choice(["", "", i]))) for i in range(400)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    assert rows(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == exact_brute(docs)


def test_exact_groups_without_rows(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


# -- lines


def line_brute(docs, least=10):
    strip = " \t\n\x0b\x0c\r"
    key = lambda s: s.strip(strip).encode().lower().decode()
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(key(line), set())
            first = min((x for x in ids if x is not None), default=None)
            drop = first is not None and (i is None or first < i)
            if not drop:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_lines(spark, batches):
    rng = random.Random(batches)
    pool = ["a common line of words", "A Common Line of Words", "  padded common line\t", "padded common line", "short", "ünïcödé line of text", "ÜNÏCÖDÉ line of text", ""]
    docs = [(i, "\n".join(rng.choice([*pool, f"own line number {i}"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs += [(None, "a common line of words\nno id here at all"), (None, None), (70, None), (71, "\n"), (72, "again again again\n" * 50), (73, "again again again"), (5, docs[5][1])]
    df = spark.createDataFrame(docs, SCHEMA)
    assert rows(line_dedup.dedup_lines(df, batches=batches), "doc_id", "n_lines", "n_dropped", "text") == line_brute(docs)


@pytest.mark.parametrize("batches", [3, 12])
def test_each_line_is_read_with_its_batch_alone(spark, monkeypatch, batches):
    written, reads = {}, []

    def lines_written(df, name, by=None):
        out = materialize(df, name, by)
        if by:
            written["rows"] = out.count()
            monkeypatch.setattr(line_dedup, "lookup_skewed", lambda batch, *rest: reads.append(batch) or lookup_skewed(batch, *rest))
            written["files"] = {}
            for number, file in out.select(by, F.input_file_name()).distinct().collect():
                written["files"].setdefault(number, []).append(file)
        elif name == "line-dropped":  # before the lines are deleted
            read = reads[-1]
            assert "PartitionFilters: [isnotnull(_batch" in read._jdf.queryExecution().executedPlan().toString()
            files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
            assert files == set(written["files"].get(len(reads) - 1, []))
            written["read"] = written.get("read", 0) + read.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", lines_written)
    docs = [(i, f"a line of its own {i}\na line of all documents\na line of ten {i // 10}") for i in range(80)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, SCHEMA), batches=batches)
    assert rows(out, "doc_id", "n_lines", "n_dropped", "text") == line_brute(docs)
    assert (len(reads), written["read"]) == (batches, written["rows"])


def test_lines_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one line of text", 7, 8, 9), (2, "one line of text\nx", 7, 8, 9)], SCHEMA + ", n_lines long, _id long, _dropped long")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_id", "_dropped", "n_lines", "n_dropped"]
    assert rows(out, *out.columns) == [(1, "one line of text", 8, 9, 1, 0), (2, "x", 8, 9, 2, 1)]


def test_lines_without_rows(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("words", [1, line_dedup.WORDS])
def test_only_texts_that_may_lose_lines_are_shuffled(spark, monkeypatch, words):
    """With a word of marks that all documents share other texts may be among them, too."""
    split, parts = line_dedup._split_by_marks, []
    monkeypatch.setattr(line_dedup, "WORDS", words)
    monkeypatch.setattr(line_dedup, "_split_by_marks", lambda *args: parts.append(split(*args)) or parts[-1])
    docs = [(i, f"a line of its own {i}" + "\na line of ten of them" * (i % 8 == 0)) for i in range(80)] + [(None, "a line of its own 3"), (None, None), (90, None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, SCHEMA))
    assert rows(out, "doc_id", "n_lines", "n_dropped", "text") == line_brute(docs)
    ((losers, others),) = parts
    n = losers.count()
    assert n + others.count() == len(docs)
    assert n == 10 if words > 1 else 10 <= n < len(docs)


def test_line_runs_are_compacted(spark):
    runs = line_dedup.LineRuns()
    for k in range(5):
        runs.add(line_dedup._sorted_run(spark.createDataFrame([(k, k, k)], "h1 long, h2 long, first_id long"), "run"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.seen().count() == 5


def test_runs_are_merged_as_they_lie(spark):
    """Only the batch is shuffled and sorted; runs are read bucket by bucket, in order."""
    runs, found = line_dedup.LineRuns(), spark.range(200).selectExpr("id % 50 h1", "id h2").groupBy("h1", "h2").count()
    for k in range(3):
        runs.add(line_dedup._sorted_run(spark.range(k * 40, k * 40 + 40).selectExpr("id % 50 h1", "id h2", "id first_id"), "run"))
    with line_dedup._runs_in_order(spark):
        met = runs.first_ids(found)
        plan = met._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.h2, r.first_id) for r in met.collect())
    assert (plan.count("SortMergeJoin"), plan.count("Exchange"), plan.count("Sort [")) == (2, 1, 1)
    assert got == [(i, i if i < 120 else None) for i in range(200)]


# -- near


def near_brute(docs):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return sorted(((i, len(s), None if i is None else root(i), i is not None and root(i) == i) for i, s in sets), key=str)


def near_docs(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.randint(3, 120))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(w) // 14))):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w = w[: rng.randint(0, len(w))] + passage
        docs.append((1000 + rng.randrange(10**6), " ".join(w).title() if rng.random() < 0.3 else "  ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_groups(spark, seed):
    docs = near_docs(seed) + EDGES + [(20, "a b c"), (21, "A  b c"), (22, "a b c d e f g h"), (23, "a b c d e f g x")]
    out = near_dedup.near_groups(spark.createDataFrame(docs, SCHEMA))
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == near_brute(docs)


def test_near_groups_of_several_blocks_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    monkeypatch.setattr(near_dedup, "LARGE_BUCKET", 5)
    docs = near_docs(9, 200)
    out = near_dedup.near_groups(spark.createDataFrame(docs, SCHEMA))
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == near_brute(docs)


def test_near_pairs_of_a_large_bucket_that_share_no_other_chunk(spark, monkeypatch):
    """Pairs of a bucket of 60 rows meet, though each two have the symbols of one chunk only in common."""
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "LARGE_BUCKET", 5)
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    docs = [(i, " ".join([*(f"w{i // 3}x{k}" for k in range(60)), f"own{i}"])) for i in range(60)]
    of = near_dedup._sketches
    chunk = near_dedup.SYMBOLS * 2

    def sketched(batches):
        for b in of(batches):
            rng = [np.random.default_rng(i) for i in b.column(0).to_pylist()]
            made = [b"\1" * chunk + r.bytes((near_dedup.CHUNKS - 1) * chunk) for r in rng]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary()), b.column(4)], schema=b.schema)

    monkeypatch.setattr(near_dedup, "_sketches", sketched)
    out = near_dedup.near_groups(spark.createDataFrame(docs, SCHEMA))
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == near_brute(docs)


def test_near_groups_join_the_texts_of_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    out = near_dedup.near_groups(spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], SCHEMA))
    assert {r.component_id for r in out.collect()} == {1}


def test_near_groups_without_rows(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dedup_near_keeps_one_of_each_group(spark):
    docs = near_docs(4, 80) + [(None, "x y z")]
    kept = near_dedup.dedup_near(spark.createDataFrame([(i, t, 1) for i, t in docs], SCHEMA + ", _kept_id int"))
    want = [(i, t) for (i, t), (j, _, _, k) in zip(sorted(docs, key=str), near_brute(docs), strict=True) if k or i is None]
    assert rows(kept, "doc_id") == sorted(((i,) for i, _ in want), key=str)
    assert kept.columns == ["doc_id", "text", "_kept_id"]


@pytest.fixture
def no_broadcasts(spark):
    """As with tables of any size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dedup_near_shuffles_texts_once(spark, no_broadcasts):
    docs = near_docs(6, 40)
    out = near_dedup.dedup_near(spark.createDataFrame(docs, SCHEMA), one_row=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc_id") == 1
    assert rows(out, "doc_id", "text") == sorted(((i, t) for (i, t), (_, _, _, k) in zip(sorted(docs, key=str), near_brute(docs), strict=True) if k), key=str)


def test_recall_at_the_least_similarity():
    """Of pairs at similarity 0.75 exactly, which the signatures may miss, 99.9 % meet in a bucket and pass the sketch."""
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(1000):
        both, own = rng.integers(0, 2**64, 300, dtype=np.uint64), rng.integers(0, 2**64, 100, dtype=np.uint64)
        a, b = (near_dedup.signature(np.unique(np.r_[both, part])) for part in (own[:50], own[50:]))
        keys = near_dedup._bucket_keys(np.stack([a, b])[:, : near_dedup.CHUNKS * near_dedup.SYMBOLS])
        met += bool((keys[0] == keys[1]).any()) and int(((a ^ b) & 0xFF != 0).sum()) <= near_dedup.SKETCH_MISMATCHES
    assert met >= 999


def test_pigeonhole_guarantee():
    """Every pair of signatures within the guaranteed distance shares a bucket."""
    rng = np.random.default_rng(1)
    size, most = near_dedup.CHUNKS * near_dedup.SYMBOLS, near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for _ in range(300):
        a = rng.integers(0, 65536, size).astype(np.uint16)
        b = a.copy()
        at = rng.choice(size, most, replace=False)
        b[at] ^= rng.integers(1, 65536, most).astype(np.uint16)
        keys = near_dedup._bucket_keys(np.concatenate([a, b])).reshape(2, -1)
        assert set(keys[0].tolist()) & set(keys[1].tolist())


# -- substrings


def repeat_brute(docs, window):
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "shard_bytes"), [(8, 300), (10, 10**6), (13, 1000), (35, 1000)])
def test_repeats(spark, monkeypatch, window, shard_bytes):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard_bytes)
    rng = random.Random(window)
    base = [[rng.choice("abcdefghijklm") for _ in range(rng.randint(0, 80))] for _ in range(15)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(base)
            a = rng.randint(0, max(0, len(b) - 1))
            w += b[a : a + rng.randint(0, 60)]
            if rng.random() < 0.4:
                w += [rng.choice(["x", "é y", "z"]) for _ in range(rng.randint(0, 5))]
        docs.append((i, " ".join(w)))
    docs += [(60, None), (61, ""), (62, "a " * 100), (None, docs[3][1]), (3, docs[3][1])]
    out = substring_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA), window)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept") == repeat_brute(docs, window)


def test_places_come_from_the_automaton():
    """What the automaton of a shard doesn't find stays, though its windows are confirmed."""
    window = 10
    passage = [f"w{i}" for i in range(30)]
    texts = [" ".join(["x", "y", *passage]), " ".join([*passage, "z"])]
    found = substring_dedup.Texts([t.encode() for t in texts], window)
    d1, d2 = (d.view(np.int64) for d in found.spans())
    phrases = found.phrase_texts()
    assert {p.decode() for p in phrases} < {" ".join(passage[i : i + substring_dedup.PHRASE]) for i in range(30)} | {" ".join(["x", "y", *passage][i : i + substring_dedup.PHRASE]) for i in range(2)}
    docs = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": texts})
    sent = lambda texts: pa.table({"d1": d1, "d2": d2, "kind": np.ones(len(d1), np.int64), "text": pa.array(texts, pa.binary())})
    remove = substring_dedup._remove(window)
    assert remove(docs, sent(phrases)).column("n_removed").to_pylist() == [32, 31]
    assert remove(docs, sent([b"a b c d e f g h"] * len(phrases))).column("n_removed").to_pylist() == [0, 0]
    # one phrase alone locates the windows that it stands for, and no others
    least = [p if p == phrases[0] else None for p in phrases]
    some = remove(docs, sent(least)).column("n_removed").to_pylist()
    assert 0 < some[0] < 32


def test_words_that_collide_in_powers_of_two_are_told_apart(spark):
    """Thue-Morse words have equal digests in any polynomial modulo a power of two."""
    flip = str.maketrans("ab", "ba")
    a = "a"
    while len(a) < 2048:
        a += a.translate(flip)
    b = a.translate(flip)
    rest = " ".join(f"w{i}" for i in range(60))
    docs = [(1, f"{rest[:100]} {a} {rest[100:]}"), (2, f"{rest[:100]} {b} {rest[100:]}")]
    df = spark.createDataFrame(docs, SCHEMA)
    assert rows(substring_dedup.remove_repeats(df, 35), "doc_id", "n_words", "n_removed", "kept") == repeat_brute(docs, 35)
    assert rows(near_dedup.near_groups(df), "doc_id", "n_shingles", "component_id", "kept") == near_brute(docs)


def test_a_passage_of_every_document_is_dealt_over_tasks(spark, monkeypatch):
    """A passage whose surroundings always differ: its spans are all distinct, its inner windows recur, its phrases are everywhere."""
    passage, few = [f"p{i}" for i in range(40)], [f"q{i}" for i in range(12)]
    docs = [(i, " ".join([f"a{i}", *(f"{i}b{k}" for k in range(30)), *passage, *(f"{i}c{k}" for k in range(30)), *few, *(f"{i}d{k}" for k in range(30))])) for i in range(600)]
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 4000)
    sizes = {}

    def written(df, name):
        out = materialize(df, name)
        sizes[name] = sorted(r[1] for r in out.groupBy(F.input_file_name()).count().collect()) or [0]
        return out

    monkeypatch.setattr(substring_dedup, "materialize", written)
    out = substring_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA).repartition(8), 35)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept") == repeat_brute(docs, 35)
    assert out.where("n_removed <> 40").count() == 0
    for name in ("repeat-candidates", "repeat-spans", "repeat-windows"):
        assert sizes[name][-1] < sum(sizes[name]) / 2, (name, sizes[name])
    assert sum(sizes["repeat-distinct"]) >= 600


def test_repeats_of_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(4)
    long = " ".join(f"{rng.randrange(10**6)}" for _ in range(60_000))
    assert len(long) > substring_dedup.PIECE
    docs = [(1, long), (2, "short " + " ".join(long.split()[30_000:30_050])), (3, "x" * 300_000), (4, None)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'x' n_words", "1 shard", "2 phrase", "3 n_removed", "'k' kept", "'d' d1")
    assert rows(substring_dedup.remove_repeats(df, 35), "doc_id", "n_words", "n_removed", "kept") == repeat_brute(docs, 35)


def test_repeats_without_rows(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


# -- helpers


def test_lookup_skewed(spark):
    left = spark.createDataFrame([(k, i) for i in range(3000) for k in [None if i % 9 == 0 else 1 if i % 3 else i]], "k long, v long")
    right = left.groupBy("k").count().selectExpr("k", "count uses", "k * 2 double_k").where("k is null or k <> 6")
    got = lookup_skewed(left, right, ["k"], "uses", share=10)
    assert got.columns == ["k", "v", "uses", "double_k"]
    assert got.count() == 3000
    assert got.where("k = 1 and (uses is null or double_k <> 2)").count() == 0
    assert got.where("k is null and uses is null").count() == 0
    assert got.where("k = 6 and uses is not null").count() == 0


def test_a_rising_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    chain = [(i, i + 1) for i in range(2000)]
    got = connected_components(spark.createDataFrame(chain, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(2001)}
    assert len(written) <= 20


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
