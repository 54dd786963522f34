"""The site style tree against a plain reading of the driver's pages."""

import html as htmllib
import re
import time

import pytest
from pyspark.sql import functions as F

from tracklake.llm import html_extract, queries

SF = "/root/testdata/sf0.01"


def plain(page: str | None) -> str:
    """What stands between <article> and </article>, a line a block."""
    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    text = re.sub(r"<script.*?</script>|<!--.*?-->", "", found[1] if found else "", flags=re.S)
    text = re.sub(r"</?(p|h1|div|ul|li)[^>]*>", "\0", re.sub(r"<br\s*/?>", " ", text))
    lines = (" ".join(htmllib.unescape(t).split()) for t in re.sub(r"<[^>]+>", "", text).split("\0"))
    return "\n".join(t for t in lines if t)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def want(pages):
    return {r.page_id: plain(r.html) for r in pages.collect()}


def test_query_gives_every_article(spark, want):
    got = queries.op3_html_extract(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("limit", [None, 1])
def test_tree_alone_finds_the_articles(pages, want, limit):
    """With all that pages declare taken out, importance alone tells articles from the rest."""
    bare = F.col("html")
    for tag, name in (("nav", "a"), ("article", "c"), ("footer", "d")):
        bare = F.regexp_replace(F.regexp_replace(bare, f"<{tag}>", f'<div class="x{name}">'), f"</{tag}>", "</div>")
    bare = F.regexp_replace(bare, 'class="ad"', 'class="xb"')
    got = html_extract.extract(pages.withColumn("html", bare), limit).collect()
    assert {r.page_id: r.text for r in got} == want


def test_importance_decides_on_declared_pages(pages):
    """An article that the tree holds for boilerplate goes, one that it holds for content stays."""
    for r in pages.limit(50).collect():
        root = lambda: html_extract.parse(r.html)  # noqa: B023, E731
        paths = {html_extract._signed(x.path): x.tag for x, _ in html_extract.read(root()).containers}
        low = {p: float(t != "article") for p, t in paths.items()}
        assert html_extract.main_text(root(), {}) and not html_extract.main_text(root(), low)


def test_large_hosts_are_dealt_out(spark, pages):
    """Every page of one host; both ways to bring branches to pages agree."""
    one = pages.withColumn("url", F.lit("http://one.example/x"))
    whole = {r.page_id: r.text for r in html_extract.extract(one).collect()}
    assert whole == {r.page_id: r.text for r in html_extract.extract(one, 0).collect()}
    assert html_extract.extract(one.limit(0), 0).count() == 0


def test_mirrored_articles_stay(spark):
    """A host whose articles are copies of one another, among others."""
    page = "<body><nav><ul><li>menu {0}</ul></nav><article><p>{1}</p></article></body>"
    rows = [(k, "http://mirror/x", page.format(k, "one text")) for k in range(20)]
    rows += [(100 + k, f"http://h{k}/x", page.format(k, f"own text {k}")) for k in range(200)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "one text" if k < 100 else f"own text {k - 100}" for k, _, _ in rows}


def test_joined_boilerplate_is_parted(spark):
    page = "<body><div class=a><p>text {0} of a page</p></div><div class=b>© site · line {1}</div></body>"
    rows = [(k, "http://s/x", page.format(k, k % 3)) for k in range(60)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"text {k} of a page" for k in range(60)}


def test_deep_and_long_pages_take_linear_time():
    for page in ("<body>" + "<div>x" * 50_000, "<body><b><div>" + "<i>x" * 50_000 + "</b></i>" * 50_000, "<body><article>" + "<p>word &amp; " * 200_000):
        began = time.time()
        blocks = html_extract.main_text(html_extract.parse(page), {})
        assert time.time() - began < 20 and sum(map(len, blocks)) >= 50_000


def test_nulls_and_ties(spark):
    rows = [(None, None, None), (1, "http://a/1", "<p>x"), (1, "http://a/1", "<p>x"), (2, "", "")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, "x"), (1, "x"), (2, "")]


def test_references_without_a_semicolon(spark):
    """Titles are cut anywhere: operator, SQL and the standard's rules agree on what is left of a reference."""
    import duckdb
    import pandas as pd

    cut = ["a &amp", "a &amp;amp", "a &am", "a &lt", "a &gt;&quot", "&copy 1", "x&nbsp", "&middot&amp;lt;", "&#39;s &"]
    html = pd.DataFrame({"page_id": range(len(cut)), "url": "http://a/1", "html": [f"<body><article><h1>{t}</h1><p>text</p></article></body>" for t in cut]})
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(html)).collect()}
    db = duckdb.connect()
    db.register("pages", html)
    assert got == dict(db.execute(f"SELECT page_id, text FROM ({queries.OP3})").fetchall())
    assert got == {k: "\n".join([" ".join(htmllib.unescape(t).split()), "text"]) for k, t in enumerate(cut)}
