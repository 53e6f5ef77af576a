"""Pieces of DuckDB SQL that the queries' oracles are put together from."""

from __future__ import annotations

import re

from ..functions import text as tx
from ..functions import urls as u

STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"
TEXT = "(" + ", ".join(f"'{w}'" for w in tx.TEXT_TAGS) + ")"
SKIP = "(" + ", ".join(f"'{w}'" for w in tx.SKIP_TAGS) + ")"
#: page_id, url and cleaned html.
PAGES = f"p AS (SELECT page_id, url, regexp_replace(html, '{tx.NOT_ASCII}', '', 'g') AS html FROM pages)"


def plain(pattern: str) -> str:
    """A pattern of ours for RE2: without Java's flags, and with Java's white space written out."""
    return re.sub(r"^\(\?[ds]+\)", "", pattern).replace(r"\s*", r"[ \t\n\x0B\f\r]*")


def text(x: str) -> str:
    for pattern, instead in tx.TEXT_STEPS:
        names = re.match(r"\(\?ds\)<\(([^)]*)\)", pattern)
        # RE2 has no back references: an alternative for each name.
        known = "|".join(plain(pattern).replace(f"({names[1]})", n).replace(r"\1", n) for n in names[1].split("|")) if names else plain(pattern)
        x = f"regexp_replace({x}, '{known}', {'chr(10)' if instead else repr(instead)}, '{'gs' if names else 'g'}')"
    return x


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z]+')"


def title(x: str) -> str:
    return f"regexp_extract({x}, '{plain(tx.TITLE)}', 1)"


def links(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{plain(tx.LINK_START)}'))"


def squashed(t: str) -> str:
    return f"CASE WHEN ({t}) > 0 THEN 2.0 / (1.0 + exp(-5.0 * log10({t}))) - 1.0 ELSE -1.0 END"


def longest(x: str) -> str:
    tag = f"regexp_extract(part, '{tx.TAG_NAME}', 1)"
    state = "{'kind': 0, 'tag': '', 'n': 0, 'stack': %s, 'run': %s, 'best': %s, 'over': %s}"
    items = (
        f"list_transform(regexp_extract_all({x}, '{tx.MARKUP}'), lambda part: "
        r"{'kind': CASE WHEN starts_with(part, '</') THEN 1 WHEN starts_with(part, '<') THEN 2 ELSE 3 END, "
        rf"'tag': {tag}, 'n': length(regexp_replace(part, '[ \t\n\x0B\f\r]', '', 'g'))::INT, "
        r"'stack': []::BOOLEAN[], 'run': 0, 'best': 0, 'over': false})"
    )
    first = state % ("[false]::BOOLEAN[]", "0", "0", "false")
    top = "coalesce(a.stack[len(a.stack)], false)"
    step = (
        f"CASE WHEN a.over OR (len(a.stack) = 0 AND b.kind <> 2) THEN {state % ('a.stack', 'a.run', 'a.best', 'true')} "
        f"WHEN b.kind = 1 THEN {state % ('a.stack[1:len(a.stack) - 1]', 'a.run', 'a.best', 'false')} "
        f"WHEN b.kind = 2 AND b.tag <> '' AND b.tag NOT IN {SKIP} THEN {state % (f'list_append(a.stack, b.tag IN {TEXT})', f'CASE WHEN b.tag IN {TEXT} THEN a.run ELSE 0 END', 'a.best', 'false')} "
        f"WHEN b.kind = 3 AND {top} THEN {state % ('a.stack', 'a.run + b.n', 'greatest(a.best, a.run + b.n)', 'false')} "
        f"ELSE {state % ('a.stack', 'a.run', 'a.best', 'false')} END"
    )
    return f"list_reduce(list_prepend({first}, {items}), lambda a, b: {step}).best::BIGINT"


def scheme(x: str) -> str:
    return f"regexp_extract({x}, '{u.PARTS}', 1)"


def host(x: str) -> str:
    return f"regexp_extract({x}, '{u.PARTS}', 2)"


def path(x: str) -> str:
    return f"regexp_extract({x}, '{u.PARTS}', 3)"


def normal(x: str) -> str:
    return f"regexp_replace({x}, '/$', '')"


def safe(x: str) -> str:
    return f"regexp_matches({path(x)}, '{u.SAFE_PATH}')"


def resolved(link: str, ref: str, base: str) -> str:
    site = f"{scheme(ref)} || '://' || {host(ref)}"
    bare = f"{path(ref)} = ''"
    near = f"CASE WHEN {bare} THEN {site} || '/' ELSE {site} || regexp_replace({path(ref)}, '[^/]+$', '') END"
    above = f"CASE WHEN {bare} THEN NULL ELSE regexp_replace({near}, '[^/]+/$', '') END"
    root = f"CASE WHEN {base} IS NULL THEN {site} || '/' ELSE regexp_replace({base}, '/$', '') || '/' END"
    return (
        f"CASE WHEN NOT contains({ref}, '//') THEN NULL WHEN contains({link}, '//') THEN {link} "
        f"WHEN regexp_matches({link}, '{u.DOTTED_HOST}') THEN CASE WHEN regexp_matches({link}, '{u.SAFE_PATH}') THEN ({near}) || {link} ELSE '//' || {link} END "
        f"WHEN regexp_matches({link}, '{u.HOST_AND_PATH}') THEN '//' || {link} WHEN starts_with({link}, 'mailto:') THEN NULL "
        f"WHEN starts_with({link}, '/') THEN ({root}) || substr({link}, 2) WHEN starts_with({link}, './') THEN ({near}) || substr({link}, 3) "
        f"WHEN starts_with({link}, '../') THEN ({above}) || substr({link}, 4) "
        f"WHEN regexp_matches({link}, '{u.NEAR_PAGE}') THEN ({near}) || {link} ELSE NULL END"
    )


def ranked(name: str, source: str, key: str, column: str, most: str = "") -> str:
    """CTEs that end in `name`: key, words (frequent first, then by name; keys without any are absent)."""
    return (
        f"{name}_n AS (SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest({tokens(column)}) AS token FROM {source}) "
        f"WHERE length(token) > 3 AND token NOT IN {STOP} GROUP BY ALL), "
        f"{name} AS (SELECT {key}, list(token ORDER BY n DESC, token) AS words FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, token) AS r FROM {name}_n) {most} GROUP BY {key})"
    )


#: CTEs that end in `links`: page_id, pos, parent_url, url, link_tokens.
LINKS = f"""{PAGES}, anchors AS (
  SELECT page_id, url AS parent_url, nullif(regexp_extract(html, '{plain(u.BASE_TAG)}', 1), '') AS base,
         unnest(a) AS anchor, unnest(range(len(a))) AS pos
  FROM (SELECT *, regexp_extract_all(html, '{plain(u.ANCHOR)}') AS a FROM p)),
targets AS (
  SELECT *, regexp_extract(anchor, '{plain(u.TARGET)}', 1) AS link, regexp_extract(anchor, '{plain(u.TARGET)}', 2) AS inner_html FROM anchors),
found AS (SELECT *, {resolved('link', 'parent_url', 'base')} AS whole FROM targets WHERE link <> ''),
{ranked('inner_words', 'found', 'page_id, pos', 'inner_html')},
links AS (
  SELECT f.page_id, f.pos, f.parent_url, regexp_replace(whole, '#.*$', '') AS url, coalesce(words, []) AS link_tokens
  FROM found f LEFT JOIN inner_words w ON w.page_id = f.page_id AND w.pos = f.pos WHERE whole IS NOT NULL)"""


def draw(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT)"


def node(x: str, nodes: int) -> str:
    return f"{draw(x)} % {nodes}"


def replay(vectors: str, labels: str, cap: float = 1.0, gate: float = 0.5) -> str:
    """CTEs that end in `steps` (id, t, tc, score, loss, updated, step) and `weights` (key, weight): a replay of vectors
    (id, key, value) and labels (id, tc) in order of id. Weights are sums of steps times vectors, so scores are sums of steps
    times dot products of vectors."""
    return f"""turns AS MATERIALIZED (SELECT id, tc, row_number() OVER (ORDER BY id) AS t FROM {labels}),
entries AS MATERIALIZED (SELECT t, key, value FROM {vectors} JOIN turns USING (id)),
products AS (SELECT a.t AS t, b.t AS i, sum(a.value * b.value) AS dot FROM entries a JOIN entries b ON a.key = b.key AND b.t <= a.t GROUP BY ALL),
dots AS MATERIALIZED (SELECT x.t, list(coalesce(dot, 0.0) ORDER BY y.t) AS dots FROM turns x JOIN turns y ON y.t <= x.t LEFT JOIN products p ON p.t = x.t AND p.i = y.t GROUP BY 1),
fold AS (
  SELECT 0::BIGINT AS t, []::DOUBLE[] AS steps, 0.0::DOUBLE AS score, 0.0::DOUBLE AS loss, false AS updated
  UNION ALL
  SELECT t, list_append(steps, CASE WHEN abs(score) <= {gate} AND size > 0 THEN least({cap}, greatest(0.0, 1.0 - tc * score) / size) * tc ELSE 0.0 END), score,
         greatest(0.0, 1.0 - tc * score), abs(score) <= {gate} AND size > 0
  FROM (SELECT r.t, f.steps, r.tc, d.dots[r.t] AS size, CASE WHEN f.t = 0 THEN 0.0 ELSE list_dot_product(f.steps, d.dots[1:f.t]) END AS score
        FROM fold f JOIN turns r ON r.t = f.t + 1 JOIN dots d ON d.t = r.t)),
steps AS MATERIALIZED (SELECT id, t, tc, score, loss, updated, steps[t] AS step FROM fold JOIN turns USING (t)),
weights AS (SELECT key, sum(step * value) AS weight FROM entries JOIN steps USING (t) GROUP BY 1)"""
