"""Text extraction, centroid clusters and Merkle manifests against brute force, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import centroids, html_text, merkle

# -- text of pages


def test_article_without_what_stands_around_it():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site, name.</h1></header>
      <div class="cookie-notice"><p>We use cookies, really. Accept them, please.</p></div><nav><a href=1>Home</a></nav>
      <main><article><header><h1>Ti&amp;tle</h1><p class=byline>By X</p></header><p>One <a href=x>link</a>\n two.</p>
      <ul><li>Milk<li>Eggs</ul><h2>Sub</h2><p>More&nbsp;text, here. <span class="ad">Buy now!</span><script>if (a < b) "</p>"</script></p>
      <div class="comments"><p>First comment, long. Very long, indeed.</p></div></article></main>
      <section id="comments"><p>Bob: great, text. Long comment, again.</p></section><form><p>Sign up, now.</p></form>
      <aside><p>Side text, so long.</p></aside><footer>&copy; me</footer></body></html>"""
    assert html_text.page_texts([page]) == ["Ti&tle\n\nOne link two.\n\nMilk\n\nEggs\n\nSub\n\nMore text, here."]


@pytest.mark.parametrize("attribute", ["class='mainmenu'", "id=cookieBar", "class='left usercomments'", "class='SideBar-2'", "role=alert", "class='site-notice'", "hidden", "style='display: none'", "class='advertorial'", "id=newsletter_box"])
@pytest.mark.parametrize("inside", [True, False])
def test_other_text_by_its_names(attribute, inside):
    beside = f"<div {attribute}><p>Other text, of some length. And more of it, too.</p></div>"
    text = "<p class='commentary has-sidebar'>The article, of course. It is long enough, too.</p>"
    page = f"<article>{text}{beside}</article>" if inside else f"<div>{text}</div>{beside}"
    assert html_text.page_texts([page]) == ["The article, of course. It is long enough, too."]


def test_ratios_find_an_article_that_is_not_marked():
    text = "Long paragraph, with text. And more, of it. Indeed it goes on, and on, for quite some time."
    menu = "".join(f"<div class=x><a href={i}>Item {i}</a></div>" for i in range(9))
    page = f"<div class=y>{menu}</div><div class=z><p>{text}<p>Short.<p>{text}</div><div class=end><a href=1>One</a> <a href=2>Two</a></div>"
    assert html_text.page_texts([page, page]) == [f"{text}\n\nShort.\n\n{text}"] * 2


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("plain text only.", "plain text only."),
        ("<p>unclosed <b>bold", "unclosed bold"),
        ("<article><p>a<!-- <p>no</p> -->b</p></article", "ab"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\n\nb\n\nc"),
        ("<article>x &lt;b&gt; &am &amp y<br>z</article>", "x <b> &am & y z"),
        ("<article><p>a</p>b<p>c</article>", "a\n\nb\n\nc"),
        ('<article><p title="a > b">c</p></article>', "c"),
        ("<nav>a</nav><script>b", ""),
        ("a < b, 3 <4", "a < b, 3 <4"),
    ],
)
def test_small_pages(page, text):
    assert html_text.page_texts([page]) == [text]


@pytest.mark.parametrize("piece", ["<div>", "<p><b>", '<a href="', "<!--", "<", "<li>", "</x>", "<span>a", "<table><td>"])
def test_broken_pages_take_no_square_time(piece):
    html_text.page_texts([piece * 30_000])


def test_extract_rows(spark):
    long = "<article>" + "<p>Word, word.</p>" * 50_000 + "</article>"
    rows = [(1, "u", "<p>Hé, llo.</p>", "x"), (1, "u", "<p>Hé, llo.</p>", "x"), (None, None, None, "y"), (2, "v", long, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_text(df).collect()
    want = [(0, "", 0), (1, "u", 8), (1, "u", 8), (2, "v", 50_000 * (11 + 2) - 2)]
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == want
    assert html_text.extract_text(df.limit(0)).count() == 0


# -- centroids


def clusters_brute(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    v = np.array([p for _, p in kept], np.int64)
    name = lambda i: hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest()
    c = v[sorted(range(len(kept)), key=lambda i: (name(kept[i][0]), kept[i][1]))[:k]].copy()
    far = lambda: ((v[:, None] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        at = far().argmin(1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = [int(s) // int((at == j).sum()) for s in v[at == j].sum(0)]
    d = far()
    at, d = d.argmin(1), d.min(1)
    return sorted([(i, int(at[r]), int(d[r]), int(d[at == at[r]].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[at[r]])).encode()).hexdigest()) for r, (i, _) in enumerate(kept)], key=str)


def vectors(seed, n=700):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(rng.integers(0, 5), 0.4, 64)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(300)] + [(5, rows[6][1]), (None, rows[7][1]), (None, rows[8][1])]
    return rows + [(2000, None), (2001, [1.0] * 63), (2002, [None] + [1.0] * 63), (2003, [math.nan] + [1.0] * 63), (2004, [math.inf] + [1.0] * 63), (2005, []), (2006, [-0.001] * 64)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(spark, seed):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("own"))
    got = sorted([tuple(r) for r in centroids.cluster(df.repartition(5)).collect()], key=str)
    assert got == clusters_brute(rows)


def test_few_or_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted([tuple(r) for r in centroids.cluster(df).collect()], key=str) == clusters_brute(rows)
    none = centroids.cluster(df.where("false"))
    assert none.count() == 0 and none.columns == centroids.cluster(df).columns
    with pytest.raises(Exception, match="a component is"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], df.schema))


@pytest.mark.parametrize("size", [1, 3, 300, 2**20, 2**26])
def test_screening_is_exact(size):
    rng = np.random.default_rng(size)
    points = rng.integers(-size, size + 1, (1500, 64))
    centres = np.r_[points[:20], points[:20], points[20:40] + rng.integers(-1, 2, (20, 64))]
    chosen, far = centroids.nearest(points, centres)
    want = ((points[:, None] - centres[None]) ** 2).sum(2)
    assert (chosen == want.argmin(1)).all() and (far == want.min(1)).all()


# -- manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def said(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def manifest_brute(rows, change):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([said(r) for r in by[s]]) for s in order if by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, said(r))) is None}
    top, out = levels([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            node = said((*r[:4], change(r[4])))
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], said(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def documents(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        rows += [(rng.randrange(10**6), s, rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "a\nb", "é\n\n" * 3, "x" * rng.randint(1, 50)])) for _ in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [{"one": 1}, {"one": 2, None: 4}, {"hot": 2300, "é": 729, "z": 730, "Z": 28, None: 3, "": 1, "a": 9, "b": 10}, {f"s{i}": 1 + i % 3 for i in range(800)}])
def test_manifest(spark, sizes):
    rows = documents(len(sizes), sizes)
    rows += [rows[0]] * 2 + [(None, *rows[0][1:]), (None, *rows[0][1:4], "other\n")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, schema).withColumn("page", F.lit(1)).withColumn("leaf", F.lit("own"))
    got = merkle.prove_documents(df.repartition(3), F.replace("text", F.lit("\n"), F.lit("")))
    assert sorted([tuple(r) for r in got.collect()], key=str) == manifest_brute(rows, lambda t: t and t.replace("\n", ""))


def test_manifest_over_several_regroupings(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    monkeypatch.setattr(merkle, "PAGE", 9)
    rows = documents(3, {"hot": 800, "a": 81, "b": 82, "c": 1, None: 9})
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted([tuple(r) for r in merkle.prove_documents(df).collect()], key=str) == manifest_brute(rows, lambda t: t)
    assert merkle.prove_documents(df).where("NOT verified").count() == 0


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.prove_documents(df).collect() == []
