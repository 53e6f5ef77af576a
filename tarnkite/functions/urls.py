"""URLs: parts, filters, links in pages and what they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Text, as_column, ranked_words

# Which paths are pages, which are documents, which URLs are never taken.
SAFE_PATH = r"(\.((x|p|r|s)?htm?l?|php\d?|aspx?|cfml?|pdf|docx?|rtf|txt)|^/?[^\.]*)/?(;|\?|#|$)"
DOCUMENT_PATH = r"\.(pdf|docx?|rtf|txt)/?$"
BLOCKED = r"(law|print|www)\.onecle\.com"
# How pages write links, and the forms of links that decide what they mean.
BASE_TAG = r'(?d)<base[^>]+href="(.*?)"'
ANCHOR = r"(?d)<a(?:\s[^>]+)?>.*?</a>"
TARGET = r'(?d)<a [^>]*href="([^"]+)"[^>]*>(.*?)</a>'
DOTTED_HOST, HOST_AND_PATH, NEAR_PAGE = r"^\w+\.\w+\.\w+", r"^\w+\.\w+/", r"^[^\./]+\.[^\./]+(;|\?|#|$)"
#: Scheme, authority and path of any string (RFC 3986, appendix B); never fails.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)"


def scheme(url: Text) -> Column:
    return F.regexp_extract(as_column(url), PARTS, 1)


def host(url: Text) -> Column:
    return F.regexp_extract(as_column(url), PARTS, 2)


def path(url: Text) -> Column:
    return F.regexp_extract(as_column(url), PARTS, 3)


def normal_url(url: Text) -> Column:
    """Without one trailing slash."""
    return F.regexp_replace(as_column(url), "/$", "")


def is_blocked(url: Text, pattern: str = BLOCKED) -> Column:
    return as_column(url).rlike(pattern)


def is_safe(url: Text) -> Column:
    return path(url).rlike(SAFE_PATH)


def is_document(url: Text) -> Column:
    return path(url).rlike(DOCUMENT_PATH)


def document_marker(url: Text) -> Column:
    """[ext] in place of a document's content; null for pages."""
    return F.when(is_document(url), F.concat(F.lit("["), F.regexp_extract(path(url), DOCUMENT_PATH, 1), F.lit("]")))


def fetch_address(url: Text, address: Text) -> Column:
    """The URL with its host replaced by the address that it is fetched from."""
    url = as_column(url)
    rest = F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?(.*)$", 1)
    return F.concat(scheme(url), F.lit("://"), as_column(address), rest)


def base_href(html: Text) -> Column:
    """Where a page's base tag points, or null."""
    return F.nullif(F.regexp_extract(as_column(html), BASE_TAG, 1), F.lit(""))


def resolve(link: Text, ref: Text, base: Text) -> Column:
    """What a link on page ref means, by the first rule that fits; null if none does.

    Only links that begin with a slash go by base. ../ on a page without a path
    gives null.
    """
    link, ref, base = as_column(link), as_column(ref), as_column(base)
    site = F.concat(scheme(ref), F.lit("://"), host(ref))
    root = F.when(base.isNotNull(), F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"))).otherwise(F.concat(site, F.lit("/")))
    bare = path(ref) == ""
    near = F.when(bare, F.concat(site, F.lit("/"))).otherwise(F.concat(site, F.regexp_replace(path(ref), "[^/]+$", "")))
    above = F.when(~bare, F.regexp_replace(near, "[^/]+/$", ""))
    after = lambda n: F.substring(link, n + 1, 1 << 30)
    return (
        F.when(~ref.contains("//"), None)
        .when(link.contains("//"), link)
        .when(link.rlike(DOTTED_HOST), F.when(link.rlike(SAFE_PATH), F.concat(near, link)).otherwise(F.concat(F.lit("//"), link)))
        .when(link.rlike(HOST_AND_PATH), F.concat(F.lit("//"), link))
        .when(link.startswith("mailto:"), None)
        .when(link.startswith("/"), F.concat(root, after(1)))
        .when(link.startswith("./"), F.concat(near, after(2)))
        .when(link.startswith("../"), F.concat(above, after(3)))
        .when(link.rlike(NEAR_PAGE), F.concat(near, link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, parent_url, url, link_tokens: the links of each page (page_id, url, html) that resolve.

    pos is the anchor's number on the page; fragments are dropped; words of tags
    inside the anchor count as its words.
    """
    # The base in a step of its own, so that html is searched for it once a page and does not go on to each of its links.
    read = pages.select("page_id", F.col("url").alias("parent_url"), "html", base_href("html").alias("base"))
    anchors = F.regexp_extract_all("html", F.lit(ANCHOR), 0)
    rows = read.select("page_id", "parent_url", "base", F.posexplode(anchors).alias("pos", "anchor"))
    rows = rows.withColumn("link", F.regexp_extract("anchor", TARGET, 1)).where("link <> ''")
    found = resolve("link", "parent_url", "base")
    rows = rows.select("page_id", "pos", "parent_url", F.regexp_replace(found, "(?d)#.*$", "").alias("url"), ranked_words(F.regexp_extract("anchor", TARGET, 2)).alias("link_tokens"))
    return rows.where("url is not null")


def node_of(key: Text, nodes: int) -> Column:
    """Which of `nodes` workers a key belongs to: the first 32 bits of its MD5."""
    return (F.conv(F.substring(F.md5(as_column(key).cast("binary")), 1, 8), 16, 10).cast("long") % nodes).cast("long")


def routed(rows: DataFrame, nodes: int) -> DataFrame:
    """rows, those with node n in partition n and in no other: hashes of nodes would put two into one partition."""
    return rows.repartitionById(nodes, F.col("node").cast("int"))
