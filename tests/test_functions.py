"""Values that follow from the rules, written out."""

import pytest
from pyspark.sql import functions as F

from tarnkite.functions import features as ft
from tarnkite.functions import text as tx
from tarnkite.functions import urls as u


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("html", "n"),
    [
        ("<p>hello world</p>", 10), ("<p>ab<b>cd</b>ef</p>", 6), ('<p>abc<a href="x">link</a>de</p>', 3), ("<div>abc<br>def</div>", 6), ('<p>abc<img src="x">de</p><p>f</p>', 6),
        ("</p></p>text", 0), ("<p>a</p></div></div>zz", 1), ("<!-- ad 0 --><p>abcd</p>efgh", 4), ("<p>aa<span>bb</span>cccc</p>", 4), ("plain", 0), ("", 0),
    ],
)
def test_longest_text(spark, html, n):
    assert one(spark, html, tx.longest_text) == n


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>Hi</p>", "Hi"), ("x<script a>1\n2</script>y", "xy"), ('<article>one <a href="/x">two</a> three', " three"), ("a&amp;b&middot;c", "ab&middot;c"),
        ("A\n\n \nB", "A\nB"), ("<b\nc>t", "<b\nc>t"), ("", ""), (None, None),
    ],
)
def test_page_text(spark, html, text):
    assert one(spark, html, tx.page_text) == text


@pytest.mark.parametrize(("t", "v"), [(0, -1), (-1, -1), (0.1, -0.9866142981514303), (0.5, -0.6366826426338932), (1, 0), (2, 0.636682642633893), (10, 0.9866142981514305)])
def test_squashed(spark, t, v):
    assert spark.range(1).select(tx.squashed(F.lit(float(t)))).first()[0] == pytest.approx(v, abs=1e-12)


def test_ranked_words(spark):
    assert one(spark, "Lease that lease Rent rent lease with of zoo", tx.ranked_words) == ["lease", "rent"]
    assert one(spark, None, tx.ranked_words) == []


def test_clean_drops_what_is_not_ascii(spark):
    assert one(spark, "aé\x7fb\tç", tx.ascii_clean) == "ab\t"


@pytest.mark.parametrize("path", ["", "/", "/a", "/a.html", "/a.php5", "/a.pdf/", "/a.htl", "/a;b.jpg"])
def test_safe(spark, path):
    assert one(spark, f"http://h.com{path}", u.is_safe)


@pytest.mark.parametrize("path", ["/a.jpg", "/a.tar.gz", "/v1.2/doc", "/dir.x/page", "/a.HTML", "/x.html.bak"])
def test_unsafe(spark, path):
    assert not one(spark, f"http://h.com{path}", u.is_safe)


R1, R2 = "http://h.com/a/b/c.html", "http://h.com/"


@pytest.mark.parametrize(
    ("link", "ref", "base", "url"),
    [
        ("http://x.org/a", R1, None, "http://x.org/a"), ("/go?u=http://x.org", R1, None, "/go?u=http://x.org"), ("www.foo.com", R1, None, "//www.foo.com"),
        ("www.foo.com/a.html", R1, None, "http://h.com/a/b/www.foo.com/a.html"), ("a.b.html", R2, None, "http://h.com/a.b.html"), ("foo.com/bar", R1, None, "//foo.com/bar"),
        ("mailto:a@b.com", R1, None, None), ("/root.html", R1, None, "http://h.com/root.html"), ("/root.html", R1, "http://base.org/x/", "http://base.org/x/root.html"),
        ("./near.html", R1, "http://base.org/x/", "http://h.com/a/b/near.html"), ("../up.html", R1, None, "http://h.com/a/up.html"), ("../up.html", R2, None, "http://up.html"),
        ("../../up2.html", R1, None, "http://h.com/a/../up2.html"), ("page.html#s", R1, None, "http://h.com/a/b/page.html#s"), ("about", R1, None, None), ("#top", R1, None, None),
        ("../up.html", "http://h.com", None, None), ("a.html", "no-slashes", None, None),
    ],
)
def test_resolve(spark, link, ref, base, url):
    df = spark.createDataFrame([(link, ref, base)], "link string, ref string, base string")
    assert df.select(u.resolve("link", "ref", "base")).first()[0] == url


def test_a_page_is_searched_for_its_base_once(spark):
    """And not for each of its links: the search is below the step that makes a row of each link, which leaves html behind."""
    web = spark.range(3).select(F.col("id").alias("page_id"), F.lit(R1).alias("url"), F.concat(F.lit('<base href="http://b.org/"><a href="/x">it goes</a>'), "id").alias("html"))
    steps = u.page_links(web)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    (made,) = [k for k, step in enumerate(steps) if "Generate" in step]
    assert {k > made for k, step in enumerate(steps) if "<base" in step} == {True}
    assert [r.url for r in u.page_links(web).collect()] == ["http://b.org/x"] * 3


def test_links_take_the_last_href_and_words_of_inner_tags(spark):
    html = '<a data-href="/no.html" href="/yes.html#part"><b>Bold</b> words</a> <a href=\'/single\'>x</a> <a href="about">y</a>'
    rows = u.page_links(spark.createDataFrame([(1, R1, html), (2, R1, None)], "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.pos, r.url, r.link_tokens) for r in rows] == [(1, 0, "http://h.com/yes.html", ["bold", "words"])]


def test_normal_url_is_idempotent_on_single_slashes(spark):
    assert one(spark, "http://h.com/a/", lambda x: u.normal_url(u.normal_url(x))) == one(spark, "http://h.com/a/", u.normal_url) == "http://h.com/a"


def test_features_without_parents_and_with_parents_of_nothing(spark):
    df = spark.createDataFrame([(1, "<title>Lease</title><p>lease text</p>", None), (2, "<p>x</p>", (0.0, 0.0, [], ["go"])), (3, "", (5.0, 1.0, ["t"], []))], f"page_id long, html string, parent {ft.STATS}")
    got = {r.page_id: r for r in ft.page_features(df).collect()}
    assert (got[1].rel_text, got[1].rel_links, got[1].title_words, got[1].parent_link_words) == (0.0, 0.0, ["lease"], [])
    assert (got[2].rel_text, got[2].parent_link_words, got[2].top_words) == (0.0, ["go"], [])
    assert (got[3].rel_text, got[3].parent_title_words) == (-1.0, ["t"])


def test_vector_of_zeros_is_empty(spark):
    df = spark.createDataFrame([(0.0, []), (3.0, ["a", "a"])], "n double, w array<string>").select(ft.sparse_vector([F.col("n")], [F.col("w")]).alias("x")).collect()
    assert df[0].x == {}
    assert df[1].x["0"] == pytest.approx(3 / 10**0.5)
    assert df[1].x["1:a"] == pytest.approx(1 / 10**0.5)
