"""Filtering, mixing, archiving and counting operators against brute force, and their edge cases."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, mixing, quality, url_filter, warc
from tessella.llm.token_counts import PrefixCounter, count_tokens, fits_budget, prefix_tables

SCHEMA = "doc_id long, text string, source string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# -- mixing


def targets_brute(sizes, weights=(3, 1, 2), pct=150, cap=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left, weight = pct * total / 100 - sum(cap * sizes[s] for s in capped), sum(w[s] for s in order if s not in capped)
        share = {s: cap * sizes[s] if s in capped else w[s] * left / weight for s in order}
        over = {s for s in order if s not in capped and share[s] >= cap * sizes[s]}
        if not over or over | capped == set(order):
            return share
        capped |= over


def mixed_docs(seed):
    rng = random.Random(seed)
    docs = [(i, "w " * rng.randint(0, 30), rng.choice(["b", "a", "hot", "hot", "hot", "hot", "é", None, "Z"])) for i in range(3000)]
    return docs + [(None, "one two", "a"), (5000, None, "tiny"), (5001, "\tx\x0by\x1fz ", "tiny")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_plan(spark, seed):
    docs = mixed_docs(seed)
    got = mixing.plan_mix(spark.createDataFrame(docs, SCHEMA)).toPandas()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = targets_brute(sizes)
    assert len(got) == len(docs)
    taken = {}
    for r in got.itertuples():
        source = None if r.source != r.source or r.source is None else r.source
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    assert all(taken[s] == pytest.approx(want[s], rel=0.15) for s in want if sizes[s] > 1000)
    again = mixing.plan_mix(spark.createDataFrame(docs, SCHEMA).repartition(7)).toPandas()
    assert got.taken.sum() == again.taken.sum()


def test_mix_emits_what_the_plan_takes(spark):
    docs = spark.createDataFrame(mixed_docs(3), SCHEMA).withColumn("rate", F.lit(1))
    plan, out = mixing.plan_mix(docs), mixing.mix_sources(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == plan.agg(F.sum("taken")).first()[0]


def test_targets_of_a_very_large_corpus(spark):
    sizes = {f"{i:05d}": 10**9 + i for i in range(10_000)} | {"00007": 4 * 10**12}
    sized = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    want = targets_brute(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_documents_without_ids_draw_apart(spark, monkeypatch):
    docs = [(None, f"{i} " + "w " * 9, "none") for i in range(2000)] + [(i, "w " * 10, "a") for i in range(2000)] + [(None, "again and again", "b")] * 3
    df = spark.createDataFrame(docs, SCHEMA)
    plan = mixing.plan_mix(df)
    taken = {r.source: r.taken for r in plan.groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    target = {r.source: r.target for r in plan.select("source", "target").distinct().collect()}
    assert taken["none"] == pytest.approx(target["none"], rel=0.1)
    assert plan.where("source = 'b'").select("taken").distinct().count() == 1  # rows that repeat are taken alike
    want = rows(plan, "doc_id", "size", "source_size", "target", "taken")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)  # the look-up gives the same
    assert rows(mixing.plan_mix(df), "doc_id", "size", "source_size", "target", "taken") == want
    assert mixing.mix_sources(df).agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r[-1] for r in want)


def test_mix_without_words_or_rows(spark):
    assert rows(mixing.plan_mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixing.plan_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


# -- decontamination


def best_match(pattern, text):
    column, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, c in enumerate(text, 1):
        before, column[0] = column[0], 0
        for i, p in enumerate(pattern, 1):
            before, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, before + (p != c))
        best = min(best, (column[-1], j))
    return best


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        p, t, k = "".join(rng.choices("abc", k=rng.randint(1, 70))), "".join(rng.choices("abc", k=rng.randint(0, 90))), rng.randint(0, 30)
        want = best_match(p, t)
        assert decontaminate.myers(decontaminate.masks(p), len(p), t, k) == (want if want[0] <= k and t else None if want[0] > k or not t else want)


def test_leaks(spark):
    rng = random.Random(2)
    item = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    items = [(1, item(30)), (2, item(12)), (3, "too short"), (4, None), (None, item(20)), (5, "")]
    docs, want = [(900, None), (901, ""), (902, item(200))], set()
    for i in range(60):
        which, text = rng.choice(items[:2])
        passage = list(text)
        edits = rng.randint(0, 16)
        for _ in range(edits):
            at, how = rng.randrange(len(passage)), rng.random()
            passage[at : at + (how < 0.66)] = rng.choice("xyz") if how < 0.33 or how > 0.66 else ""
        body = f"{item(rng.randint(0, 9))} {''.join(passage).upper() if i % 2 else ''.join(passage)}\n\t {item(rng.randint(0, 9))}"
        docs.append((i, body))
    for d, t in docs:
        for n, text in items[:2]:
            distance = best_match(text, decontaminate.normalise(t))[0]
            if distance <= int(len(text) * decontaminate.ERROR_RATE):
                want.add((d, n, distance))
    docs += [(0, docs[3][1])]
    df, bench = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(df, bench)
    assert {tuple(r) for r in got.select("doc_id", "item_id", "distance").collect()} == want
    for r in got.collect():
        text = decontaminate.normalise(dict(docs)[r.doc_id])[r.start : r.end]
        assert best_match(dict(items)[r.item_id], text)[0] == r.distance
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id") == sorted([(d,) for d, _ in docs if d not in {w[0] for w in want}], key=str)


@pytest.mark.parametrize("whole_words", [False, True])
def test_items_of_every_length(spark, whole_words):
    """Items of 1 to 30 characters in texts that hold them with up to three edits, against a plain search."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcd", k=n))
    items = [(n, " ".join(word(rng.randint(1, 6)) for _ in range(9))[:n].strip() or "a") for n in range(1, 31)]
    texts = []
    for i in range(150):
        passage = list(items[i % 30][1])
        for _ in range(rng.randint(0, 3)):
            passage[rng.randrange(len(passage) or 1) : (rng.random() < 0.5) * len(passage)] = rng.choice("abx")
        glue = rng.choice(["", " "])
        texts.append((i, f"{word(5)} {word(7)}{glue}{''.join(passage)}{glue}{word(4)}"))
    df = spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in texts:
        for n, item in items:
            pattern, text = (f" {item} ", f" {t} ") if whole_words else (item, t)
            distance = best_match(pattern, text)[0]
            if distance <= int(len(item) * decontaminate.ERROR_RATE):
                want.add((d, n, distance))
    got = decontaminate.find_leaks(df, bench, whole_words=whole_words)
    assert {tuple(r) for r in got.select("doc_id", "item_id", "distance").collect()} == want
    assert {int(len(dict(items)[n]) * decontaminate.ERROR_RATE) for _, n, _ in want} >= {0, 1}
    assert rows(decontaminate.drop_contaminated(df, bench, whole_words=whole_words), "doc_id") == sorted([(d,) for d in {d for d, _ in texts} - {w[0] for w in want} | {900, 901}], key=str)


def test_short_items_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, " x = 7 "), (3, " "), (4, "é")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "in paris\tx  =\n7"), (2, "parish, comparis x = 71"), (3, "PARIS"), (4, "a é b paris paris"), (5, None)], "doc_id long, text string")
    got = rows(decontaminate.find_leaks(docs, bench, whole_words=True), "doc_id", "item_id", "distance", "start", "end")
    assert got == [(1, 1, 0, 3, 8), (1, 2, 0, 9, 14), (3, 1, 0, 0, 5), (4, 1, 0, 6, 11), (4, 4, 0, 2, 3)]
    assert rows(decontaminate.drop_contaminated(docs, bench, whole_words=True), "doc_id") == [(2,), (5,)]
    assert rows(decontaminate.find_leaks(docs, bench), "doc_id", "item_id", "start", "end")[2:4] == [(2, 1, 0, 5), (2, 2, 17, 22)]
    with pytest.raises(ValueError, match="error_rate"):
        decontaminate.find_leaks(docs, bench, error_rate=1.0)


def test_start_of_a_long_passage():
    rng = random.Random(4)
    for _ in range(100):
        p = "".join(rng.choices("ab", k=rng.randint(1, 40)))
        t = "".join(rng.choices("ab", k=rng.randint(1, 60)))
        prefixes = [best_anchored(p, t[:j]) for j in range(1, len(t) + 1)]
        least = min(prefixes)
        want = (least, prefixes.index(least) + 1) if least < len(p) else None
        got = decontaminate.myers(decontaminate.masks(p), len(p), t, len(p) - 1, anchored=True)
        assert got == want


def best_anchored(p, t):
    column = list(range(len(p) + 1))
    for j, c in enumerate(t, 1):
        before, column[0] = column[0], j
        for i, q in enumerate(p, 1):
            before, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, before + (q != c))
    return column[-1]


def test_leaks_in_very_long_texts(spark):
    rng = random.Random(8)
    item = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(20))
    long = " ".join("".join(rng.choices("ijklmnop", k=5)) for _ in range(60_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, long), (3, "x" * 400_000)], "doc_id long, text string").selectExpr("*", "7 item_id", "'d' distance", "0 start", "0 end")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string").selectExpr("*", "'x' doc_id")
    assert rows(decontaminate.find_leaks(docs, bench), "doc_id", "item_id", "distance", "start") == [(1, 1, 0, len(long) + 1)]


def test_leaks_in_shards_and_without_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 30)
    bench = spark.createDataFrame([(i, f"item number {i} with some text in it") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before item number {i} with some text in it after") for i in range(5)], "doc_id long, text string")
    assert [len(items) for items in decontaminate.load_items(bench)] == [1] * 5
    # the others are one edit away
    assert decontaminate.find_leaks(docs, bench).where("distance = 0").count() == 5
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 5


# -- quality


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.score_quality(docs, labels)
    assert got.count() == docs.count()
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    judged = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (judged.predicted == judged.quality).mean() >= 0.95


def test_quality_edges(spark):
    junk = [(i, "!! ## " * (i + 3), "x") for i in range(20)]
    good = [(100 + i, "Plain words of a text, and more. " * (i + 1), "x") for i in range(20)]
    odd = [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, "word " * 20000, "x"), (None, "Plain words of a text.", "x"), (100, good[0][1], "x")]
    docs = spark.createDataFrame(junk + good + odd, SCHEMA).withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(i, 0) for i, *_ in junk] + [(i, 1) for i, *_ in good] + [(5, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels)
    assert got.columns == ["doc_id", "text", "source", "score", "held_out", "predicted"]
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[i].predicted == 0 for i, *_ in junk) and all(by[i].predicted == 1 for i, *_ in good)
    assert by[900].score == by[901].score == by[902].score and 0 <= by[900].score <= 1
    assert got.count() == 46
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_vote_is_the_weighted_mean_of_all_nearest():
    rng = np.random.default_rng(3)
    known, y, v = quality._unit(rng.standard_normal((200, 6))), (rng.random(200) < 0.5).astype(np.float32), quality._unit(rng.standard_normal((30, 6)))
    for got, x in zip(quality.vote(v, known, y), v, strict=True):
        near = sorted(((float(x @ k), float(label)) for k, label in zip(known, y, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(s, 0) ** 4 for s, _ in near]
        assert got == pytest.approx(sum(w * label for w, (_, label) in zip(weights, near, strict=True)) / sum(weights), abs=1e-4)


def test_votes_of_ties_go_by_the_order_of_the_labelled():
    known = quality._unit(np.tile(np.array([[1.0, 2.0, 3.0]]), (2000, 1)).astype(np.float32))
    known[::7] *= -1
    y = (np.arange(2000) % 3 == 0).astype(np.float32)
    first = [i for i in range(2000) if i % 7][: quality.NEIGHBOURS]
    got = quality.vote(known[1:4], known, y)
    assert got == pytest.approx([y[first].mean()] * 3, abs=1e-4)


def test_scores_against_brute_force(spark):
    """With fewer labelled rows than dimensions the projection keeps every product, so plain vectors give the scores."""
    rng = random.Random(6)
    words = ["Plain", "words", "of", "text,", "and", "12", "##", "!!", "x9", "É", "Éa"]
    docs = [(i, " ".join(rng.choice(words[: 3 + i % 8]) for _ in range(rng.randint(1, 40)))) for i in range(80)] + [(200, None), (3, "another text of number three")]
    labels = [(i, int(i % 8 < 4)) for i in range(0, 80, 2)]

    def vector(text):
        out = Counter()
        w = (text or "").split()
        number = lambda x: zlib.crc32(quality.shape(x).encode()) % quality.SHAPES
        for x in w:
            out["shape", number(x)] += 1
            out["term", zlib.crc32(x.encode().lower()) % quality.TERMS] += 1
        for a, b in zip(w, w[1:], strict=False):
            out["pair", 0 if a == b else (number(a) * 31 + number(b) * 7 + 1) % (quality.PAIRS - 1) + 1] += 1
        out = {k: math.log1p(n) for k, n in out.items()}
        size = {part: math.sqrt(sum(v * v for k, v in out.items() if (k[0] == "term") == part)) for part in (True, False)}
        return {k: v / size[k[0] == "term"] * (quality.TERM_WEIGHT if k[0] == "term" else 1 - quality.TERM_WEIGHT) ** 0.5 for k, v in out.items()}

    learnt = [(i, y, vector(min(t for j, t in docs if j == i))) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(learnt) <= quality.DIMENSIONS
    got = quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = {(r.doc_id, r.text): r.score for r in got.collect()}
    assert len(scores) == len(docs)
    for i, text in docs:
        v = vector(text)
        near = sorted(((-round(sum(x * known.get(k, 0) for k, x in v.items()) * quality.STEPS), j, y) for j, y, known in learnt))[: quality.NEIGHBOURS]
        weights = [(max(-s, 0) / quality.STEPS) ** 4 for s, _, _ in near]
        want = sum(w * y for w, (_, _, y) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) else np.mean([y for _, y, _ in learnt])
        assert scores[i, text] == pytest.approx(want, abs=2e-3)


# -- urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "org", "/a*z/"), ("block", "org", "")]


def test_urls(spark):
    urls = [
        "http://example.com/en/x", "https://WWW.Example.com/en/x?y=/", "http://example.com", "http://a.b.net/es/", "http://a.net/ES/", "http://notexample.com/en/", "http://com/", "http://x.com?y/en/",
        "no scheme", None, "", "://", "http://x.org/abcz/1", "http://x.org/ab", "http://a\nb.net/es/\n", "ftp://é.example.com/en/ü", "http://example.com/english", "http://u:p@example.com:80/en/",
    ]
    rules = [url_filter.UrlRule(*r) for r in RULES]

    def judge(url):
        host, path = url_filter.split_url(url)
        fits = []
        for verdict, h, p in RULES:
            head, _, tail = p.partition("*")
            in_path = path.startswith(head) and (not tail or tail in path[len(head) :])
            if (host == h or host.endswith("." + h)) and in_path:
                fits.append((len(h + p), h + p, verdict))
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], "x"), (0, urls[0], "x")], "page_id long, url string, host string")
    got = url_filter.judge_urls(df, rules)
    want = [(i, *judge(u)) for i, u in enumerate(urls)] + [(None, *judge(urls[0])), (0, *judge(urls[0]))]
    assert rows(got, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=str)
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, [], "block").collect()} == {"block"}


def test_rules_are_filed_under_their_rarest_token():
    index = url_filter.RuleIndex([url_filter.UrlRule("block", "example.com", "/en/")], {"example": 50, "com": 90, "en": 7})
    assert list(index.filed) == ["en"]
    assert index.match("example.com", "/en/1").verdict == "block" and index.match("example.com", "/fr/") is None


# -- WARC


def test_archive(spark, tmp_path):
    big = "é" * 50_000
    pages = [(1, "http://a/", "one"), (2, "http://b/\r\nX: y", "one"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", "two"), (6, "u", "two"), (None, "u", "two"), (None, "u", "alone"), (7, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(df, path)
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        best = max((j for j, _, h in pages if (h or "") == (html or "") and j is not None), default=None)
        want.append((i, len(body), warc.payload_sha1(body), "response" if i == best else "revisit", None if i == best else best))
    assert rows(warc.read_pages(spark, path), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in pages})
    made = [warc.record_head(i, u, n, d, r, k == "revisit", "2000-01-01T00:00:00Z") + (b"" if k == "revisit" else (h or "").encode()) + warc.TAIL for (i, u, h), (_, n, d, k, r) in zip(pages, want, strict=True)]
    assert sorted(bytes(r.record) for r in warc.read_records(spark, path).collect()) == sorted(made)
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in made))
    (tmp_path / "files/b.warc").write_bytes(b"".join(made))
    back = warc.read_warc_files(spark, f"file://{tmp_path}/files")
    assert back.count() == 2 * len(pages) and back.where("record_type = 'revisit'").count() == 2 * sum(k == "revisit" for *_, k, _ in want)


def test_archive_of_small_payloads_and_none(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "one"), (2, "u", "one"), (3, "u", "longer one"), (4, "u", "longer one")], "page_id long, url string, html string")
    warc.write_archive(df, f"file://{tmp_path}/a", min_bytes=5)
    assert rows(warc.read_pages(spark, f"file://{tmp_path}/a"), "page_id", "record_type") == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    warc.write_archive(df.limit(0), f"file://{tmp_path}/b")
    assert warc.read_pages(spark, f"file://{tmp_path}/b").count() == 0


def test_a_changed_payload_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "one")], "page_id long, url string, html string")
    warc.write_archive(df, f"file://{tmp_path}/a")
    spark.read.parquet(f"file://{tmp_path}/a/payloads").withColumn("payload", F.encode(F.lit("two"), "utf-8")).write.parquet(f"file://{tmp_path}/c/payloads")
    spark.read.parquet(f"file://{tmp_path}/a/headers").write.parquet(f"file://{tmp_path}/c/headers")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_pages(spark, f"file://{tmp_path}/c").collect()


# -- tokens


@pytest.fixture(scope="module")
def counter():
    public = pytest.importorskip("public_tokenizers")
    return PrefixCounter(public.path("byte_bpe_50k.json"))


TEXTS = ["", " ", "hello world", "a<|endoftext|>b  <|endoftext|>", "Ünï  \n\n x", "日本語テキスト text", "x\x1cy \x1c z\x85", "don't 123abc x''s", "é" * 300, "​　a   b", "a" * 3000, "🙂🙃 ퟿", "ſ İ ı ǅ ʰ ͅ"]


def test_counts_are_the_library_s(counter, spark):
    encode = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab cd'sÀ9ſ̀\n\t .,<|>é日 ") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    assert counter.totals(texts) == [encode(t) for t in texts]
    import public_tokenizers

    df = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(texts)), (None, "x y", 1), (0, None, 1)], "doc_id long, text string, n_tokens int")
    want = [(i, len(t.encode()), encode(t), encode(t) > 20) for i, t in enumerate(texts)] + [(None, 3, 2, False), (0, 0, 0, False)]
    assert rows(count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), 20), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert count_tokens(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_prefixes(counter, spark):
    encode = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    for piece in ["hello", " strawberries", "éàü", "12345678", " unbelievable", "日本", "!!??", "zzzzzzqqq"]:
        got, data = counter.within(piece), piece.encode()
        for n in range(1, len(data) + 1):
            part = data[:n].decode("utf-8", "ignore")
            if len(part.encode()) == n:
                assert got[n - 1] == encode(part), (piece, n)
    rng = random.Random(6)
    texts = [t for t in TEXTS if t and len(t) < 100] + ["".join(rng.choice("abc  'slv1!\n ") for _ in range(rng.randint(1, 25))) for _ in range(80)]
    for text in texts:
        ends, counts = counter.table(text)
        own = [encode(text[:n]) for n in range(len(text) + 1)]
        assert ends[-1] == len(text) and counts[-1] == own[-1]
        if "<|" not in text:  # a special string is whole or ordinary text
            assert [counter.count_at(text, n) for n in range(len(text) + 1)] == own
            for n in (0, 1, 2, 5, 10**6):
                assert counter.budget(text, n) == max(i for i, c in enumerate(own) if c <= n)
    import public_tokenizers

    df = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    tables = prefix_tables(df, public_tokenizers.path("byte_bpe_50k.json"))
    assert rows(tables, "doc_id", "ends", "counts") == [(1, [3, 7, 13], [1, 2, 3]), (2, [], [])]
    assert rows(fits_budget(tables, 2), "doc_id", "n_chars", "n_tokens") == [(1, 7, 2), (2, 0, 0)]


def test_budgets_inside_long_pieces(counter, spark, monkeypatch):
    import public_tokenizers

    from tessella.llm import token_counts

    monkeypatch.setattr(token_counts, "LONG", 5)
    encode = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    texts = ["日本語テキスト" * 8, "a" * 90, "x" + "qzjw" * 20 + "  \n  end", "don't <|endoftext|>!!!???;;; 1234567890", ""]
    own = [[encode(t[:n]) for n in range(len(t) + 1)] for t in texts]
    assert [[0, *counter.prefixes(t)] for t in texts] == own
    tables = prefix_tables(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    for n in (0, 3, 7, 1000):
        best = [max(k for k, c in enumerate(o) if c <= n) for o in own]
        assert rows(fits_budget(tables, n), "doc_id", "n_chars", "n_tokens") == [(i, k, own[i][k]) for i, k in enumerate(best)]
        short = [min(n, len(t)) for t in texts]
        assert rows(token_counts.count_within(tables, n), "doc_id", "n_chars", "n_tokens") == [(i, k, own[i][k]) for i, k in enumerate(short)]


def test_totals_come_from_the_prefix_counts(counter, monkeypatch):
    """No piece is encoded by the library, and one that is known isn't worked on again."""
    fresh = PrefixCounter(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    of, seen = fresh._within_all, []
    monkeypatch.setattr(fresh, "_within_all", lambda pieces: seen.extend(pieces) or of(pieces))
    cut = [p for p, _ in fresh.tokenizer.pre_tokenizer.pre_tokenize_str("one two one")]
    assert len(cut) == 3
    monkeypatch.setattr(fresh, "tokenizer", None)
    assert fresh.totals(["one two one"]) == [3] and sorted(seen) == [b" one", b" two", b"one"]
    assert fresh.totals(["one two one two"]) == [4] and len(seen) == 3


def test_the_prefix_table_is_the_library_s_count_of_every_prefix_of_its_pieces(counter):
    rng = random.Random(9)
    texts = [*TEXTS, "".join(rng.choice("ab cd'sÀ9ſ̀\n\t .,<|>é日 ") for _ in range(200_000))]
    for text, changes in zip(texts, counter.changes(texts), strict=True):
        running = np.cumsum(changes, dtype=np.int64)
        assert len(running) == len(text.encode())
        assert (running[-1] if len(running) else 0) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)
        before, at = 0, 0
        for piece in counter.cut(text)[:300]:
            size = len(piece.encode())
            assert (running[at : at + size] - before).tolist() == counter.within(piece)
            at += size
            before = running[at - 1]


def test_digests_of_known_bytes():
    assert warc.payload_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha1(b"").hexdigest() == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
