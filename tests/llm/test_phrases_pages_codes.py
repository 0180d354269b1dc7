"""Operators 11 to 13 against brute force on small tables with awkward rows."""

import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import extract, phrases, vector_codes
from millrace.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
CLASHING = ["n", "k", "lang_hash", "phrase", "a", "l", "r", "score", "rank", "part", "at", "v", "upper", "lower", "code", "error", "slot", "words", "total", "of", "size", "text2", "n_chars2"]


def clashing(df):
    return df.select("*", *(F.lit("x" if k % 2 else None).cast("string").alias(c) for k, c in enumerate(CLASHING) if c not in df.columns))


def brute_phrases(rows, least, percent, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, 5):
                for k in range(len(w) - d + 1):
                    f[lang][tuple(w[k : k + d])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * c >= percent * a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, c in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_rows():
    rnd = random.Random(11)
    vocab = ["a", "a\x01", "b", "Ab", "ü", "中", "a\x00b", "the", "The", "\xa0x"]
    rows = [(k, rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(vocab) + rnd.choice([" ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(rnd.randint(0, 60)))) for k in range(120)]
    return [*rows, (None, "en", "a b a b a b"), (1, "en", None), (2, "xx", ""), (3, "yy", " \t\n.,"), (4, "zz", "one two"), (4, "zz", "one two"), (5, None, "a b " * 3000)]


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 7)])
def test_op11(spark, monkeypatch, least, top):
    monkeypatch.setattr(phrases, "SHARD", 500)
    rows = phrase_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5))
    got = sorted(tuple(r) for r in phrases.collocations(df, least, 80, top).collect())
    assert got == brute_phrases([r[1:] for r in rows], least, 80, top) and len(got) > 20


def test_op11_counts_beyond_64_bits(spark):
    """The score of counts that leave no room for the factor in a long."""
    rows = spark.createDataFrame([("en", "a b", 3 * 10**17, [4 * 10**17], [5 * 10**17])], "lang string, phrase string, a long, l array<long>, r array<long>")
    assert phrases.scored(rows).first().score == 2000000 * 3 // 9


def test_op11_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


def test_op11_full_filter(spark, monkeypatch):
    """A filter that lets everything pass changes no result."""
    monkeypatch.setattr(phrases, "frequent_filter", lambda p: np.full(phrases.FILTER_BITS // 64, 2**64 - 1, np.uint64))
    rows = phrase_rows()
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 3).collect())
    assert got == brute_phrases([r[1:] for r in rows], 3, 80, 2000)


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class="cookie-notice">We use cookies to make this site work better for all.</div>
<div id="wrap"><div class="post"><h2>A   title</h2><p>First paragraph with enough text to be the article, and <a href=1>a link</a> in it.<p>Second &amp; last,<br>with a break.</div>
<div class="sidebar"><ul><li><a>One</a><li><a>Two</a></ul></div></div><div id=comments><p>I like this article, said a reader with a long comment that goes on and on and on and on and on.</p></div><footer>foot</footer></body></html>"""
TEXT = "A title\n\nFirst paragraph with enough text to be the article, and a link in it.\n\nSecond & last, with a break."


def test_op12_pages():
    assert extract.main_text(PAGE) == TEXT
    article = PAGE.replace('<div class="post">', "<article>").replace("</div>\n<div class", "<aside>Not this</aside><form>Nor <input> this</form></article>\n<div class", 1)
    assert extract.main_text(article) == TEXT
    lone = '<body><div>Some words about this site that stand on every page of it.</div><article class="post comments-open"><p>The article, which is open for comments.</p></article>'
    assert extract.main_text(lone) == "The article, which is open for comments."
    assert extract.main_text(lone.replace("post comments-open", "post") + "<article class=comment><p>Well said, and more words.</p></article>") == "The article, which is open for comments."
    cut = PAGE[: PAGE.index("with a break") + 6]
    assert extract.main_text(cut) == TEXT[: TEXT.index("with a break") + 6]
    parts = "".join(f"<div><p>Part {k} has a text that is as long as that of others.</p><p>And a second paragraph.</p></div>" for k in range(4))
    links = "".join(f"<li><a href={k}>Link {k}</a>" for k in range(9))
    assert extract.main_text(f"<body><ul>{links}</ul><div>{parts}</div><p><a>more</a>").count("Part") == 4
    assert "Link" not in extract.main_text(f"<body><ul>{links}</ul><div>{parts}</div>")


@pytest.mark.parametrize("source, want", [("", ""), (None, ""), ("plain  text", "plain text"), ("<p", ""), ("<p>a", "a"), ("a < b &lt; c", "a < b < c"), ("<script>var x = '</p>';</script>", ""), ("<!-- <p>x</p>", ""), ("&nbsp;", ""), ("<b><p>one</b> two</p>", "one two"), ("<ul><li>a<li>b</ul>", "a\n\nb"), ("<nav>only a menu</nav>", "")])
def test_op12_fragments(source, want):
    assert extract.main_text(source) == want


@pytest.mark.parametrize("source", ["<" * 200_000, "<div>" * 60_000 + "x", "<a href='" * 20_000, "</p>" * 100_000, "<li>x" * 30_000, "<!--" * 50_000, "<b>" * 30_000 + "</i>" * 30_000])
def test_op12_huge(source):
    extract.main_text(source)


def test_op12_given_pages(spark):
    """The given pages: their article's blocks, cut out by patterns that fit these pages alone."""
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r.page_id: r for r in extract.extract_pages(clashing(pages)).collect()}
    for r in pages.collect():
        blocks = re.split(r"<p>|</p>|</?h1>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks]
        want = "\n\n".join(filter(None, blocks))
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_op12_awkward_table(spark):
    rows = [(1, None, PAGE), (1, None, PAGE), (None, "u", None), (2, "v", "")]
    got = extract.extract_pages(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert Counter(tuple(r) for r in got) == Counter([(1, None, TEXT, len(TEXT))] * 2 + [(None, "u", "", 0), (2, "v", "", 0)])
    assert extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_codes(rows):
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(r[1]) for r in rows) // 8)
    x = np.array([np.floor(4096 * np.array([*r[1], *[0.0] * (8 * width - len(r[1]))])) for r in rows]).astype(np.int64).reshape(len(rows), 8, width)
    book = x[:16].transpose(1, 0, 2).copy()
    for k in range(7):
        d2 = ((x[:, :, None] - book[None]) ** 2).sum(-1)
        at, error = d2.argmin(2), d2.min(2).sum(1)
        if k < 6:
            for p in range(8):
                for j in set(at[:, p]):
                    book[p, j] = x[at[:, p] == j, p].sum(0) // (at[:, p] == j).sum()
    sha, label = hashlib.sha256(",".join(map(str, book.ravel())).encode()).hexdigest(), Counter()
    for r, e in zip(rows, error):
        label[r[2]] += int(e)
    return Counter((r[0], bytes(a.astype(np.uint8)).hex(), int(e), label[r[2]], sha) for r, a, e in zip(rows, at, error))


@pytest.mark.parametrize("size, n, spread", [(16, 300, 1), (64, 200, 0.05), (8, 400, 0.001), (5, 60, 2), (24, 9, 1), (1, 3, 9)])
def test_op13(spark, size, n, spread):
    """Few values make many ties; short, broken, repeated and unnumbered vectors."""
    rnd = random.Random(size)
    rows = [(k, [round(rnd.gauss(0, spread), 3) for _ in range(size)], rnd.choice([None, 1, 2])) for k in rnd.sample(range(1000), n)]
    rows += [rows[0], (rows[1][0], rows[2][1], 1), (None, rows[3 % n][1], None), (-5, None, 1), (-4, [None] * size, 1), (-3, [float("nan")] * size, 1), (-2, [1e30 * 1e300] * size, 2), (5000, rows[0][1][: size // 2], 3)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4))
    assert Counter(tuple(r) for r in vector_codes.vector_codes(df).collect()) == brute_codes(rows)


def test_op13_no_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [None], 1)]):
        assert vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).count() == 0
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [3e37] * 8, 1)], "vec_id long, embedding array<float>, label int"))
    assert vector_codes.vector_codes(spark.createDataFrame([(1, [], 1)], "vec_id long, embedding array<float>, label int")).first().error == 0


def test_op13_prunes():
    """Most distances of a later round are not computed, and the result is that of computing all."""
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(c, 30, (200, 4)) for c in range(0, 16000, 1000)]).astype(np.int64)
    book = x[::200].copy()
    scale = vector_codes.Scale(4, np.dtype(np.int32), 1.0)
    at, own, upper, lower = vector_codes.assign_all(x, book, scale)
    new = np.stack([x[at == j].sum(0) // (at == j).sum() for j in range(16)])
    asked, plain = [], vector_codes._squared
    vector_codes._squared = lambda a, b: (asked.append(len(a)), plain(a, b))[1]
    try:
        got, _, _ = vector_codes.reassign(x, new, book, at.copy(), upper, lower, scale)
    finally:
        vector_codes._squared = plain
    assert (got == ((x[:, None] - new) ** 2).sum(-1).argmin(1)).all() and sum(asked) < 0.2 * len(x) * 16


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, DIR).select(*want.columns).collect()
    assert Counter(tuple(r) for r in got) == Counter(want.fetchall())
