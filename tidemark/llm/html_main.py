"""Main text of web pages by consensus host paths.

Pass one scores the containers of each page by the text their blocks hold, less three times
the text of links, and names each container by its generalised path: tags and classes from
the root, digits made equal. The scores are votes; Spark adds them up per host and path and
keeps each host's best path, raised to the lowest container around it that holds nearly all of the host's text. Pass two extracts each page again, now from the containers on its
host's path; a page without such a container falls back on its own best one.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import chunks, cut

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(script|style|noscript|template|svg|iframe|textarea|select|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-z][a-z0-9:-]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>"""
    r"""|<(/?)([a-z][a-z0-9:-]*)([^>]*)>"""
    r"""|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CONTAINERS = frozenset("html body main article section div td blockquote figure center".split())
BLOCKS = CONTAINERS | frozenset("address aside dd details dialog dl dt fieldset figcaption footer form h1 h2 h3 h4 h5 h6 header hgroup hr li menu nav ol p pre summary table tbody tfoot th thead tr ul head".split())
JUNK_TAGS = frozenset("nav footer aside form head button dialog menu label fieldset".split())
#: Words that name what isn't article text, outside article and main elements; the second set also holds inside them.
JUNK_OUTSIDE = frozenset("gdpr popup popups modal aside footer footers masthead topbar discussion related recommended recommendations widget widgets search toolbar complementary contentinfo alert alerts header".split())
JUNK = frozenset(
    "ad ads advert adverts advertisement advertising banner banners promo promos promotion sponsor sponsored sponsors cookie cookies consent notice notices newsletter subscribe subscription signup sidebar sidebars menu menus "
    "nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies share sharing social pagination pager login".split()
)
#: Words that only say where or what kind of box it is: `ad-box` is an advert, `social-history` a topic.
BOX = frozenset("bar block body bottom box btn button buttons card col column container content footer form global header icon icons inline inner item items left link links list main outer page panel primary right row secondary section site slot sticky sub tab tabs text title top unit widget wrap wrapper zone".split())
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
#: Hosts whose paths may be broadcast (about 100 bytes each); more are joined over salted hosts.
MOST_BROADCAST, SALTS = 100_000, 64
#: Hundredths of a host's text outside junk and links that the winning container must hold, or else it is raised.
NEARLY_ALL = 99


def _attributes(source: str) -> tuple[str, str, bool]:
    """(class, class id and role together, hidden)."""
    kind, marks, hidden = "", [], False
    for m in _ATTRIBUTE.finditer(source):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            marks.append(value)
            if name == "class":
                kind = value
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        else:
            hidden = hidden or name == "hidden" or value.lower() == "true"
    return kind, " ".join(marks), hidden


def is_junk(marks: str, inside: bool) -> bool:
    """Whether one of the class, id and role tokens says junk: a junk word, and otherwise only words for boxes.

    Inside article and main elements fewer words do, as `related` or `search` may be the topic there.
    """
    for token in marks.lower().split():
        words = _WORDS.findall(token)
        if any(w in JUNK or not inside and w in JUNK_OUTSIDE for w in words) and all(w in JUNK or w in BOX or not inside and w in JUNK_OUTSIDE for w in words):
            return True
    return False


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, paths of the containers around it, characters in links) of each block outside junk."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    # open elements: tag, paths so far, whether inside junk, whether inside article or main
    stack: list[tuple[str, tuple[str, ...], bool, bool]] = [("", ("",), False, False)]
    held: list[str] = []
    linked = [0]
    links = 0

    def close() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((text, stack[-1][1], linked[0]))
        linked[0] = 0

    def said(source: str) -> None:
        if source and not stack[-1][2]:
            text = unescape(source) if "&" in source else source
            held.append(text)
            if links:
                linked[0] += len(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        ends, tag, source = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if tag == "br":
            held.append(" ")
            continue
        if block:
            close()
        if tag == "a":
            links = 0 if ends else 1
            continue
        if ends:
            if block or tag in JUNK_TAGS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag in VOID or source.endswith("/") and not block or not (block or tag in JUNK_TAGS):
            continue
        if stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li":
            stack.pop()  # its end tag was left out
        _, paths, junk, main = stack[-1]
        if source.strip():
            kind, marks, hidden = _attributes(source)
        else:
            kind, marks, hidden = "", "", False
        if not junk:
            junk = hidden or tag in JUNK_TAGS or not main and tag == "header"
            junk = junk or tag not in ("body", "html") and bool(marks) and is_junk(marks, main) and not (tag in ("main", "article") and not re.search(r"comment|repl", marks, re.I))
        if tag in CONTAINERS and not main:
            name = ".".join([tag, *sorted(_DIGITS.sub("#", kind).split())])
            paths = (*paths, f"{paths[-1]}>{name}")
        stack.append((tag, paths, junk, main or tag in ("article", "main")))
    if at < len(page):
        said(page[at:])
    close()
    return out


def container_scores(found: list[tuple[str, tuple[str, ...], int]]) -> dict[str, int]:
    """Points of each container path: a block's own container gets all, the next two half each.

    Points count twice for article and main elements, whose very name says what they hold.
    """
    score: dict[str, int] = {}
    for text, paths, linked in found:
        points = max(0, len(text) - 3 * linked)
        for path in (*reversed(paths[-3:]),):
            score[path] = score.get(path, 0) + points * (1 + is_article(path))
            points //= 2
    return score


def best_path(score: dict[str, int], held: dict[str, int] | None = None) -> str:
    """The path with most points, raised to the lowest one around it that holds NEARLY_ALL of the text.

    held: text by path, links left out. Article and main elements, whose name says that they hold it all, aren't raised.
    """
    if not score:
        return ""
    best = max(score, key=lambda p: (score[p], p))
    if held and not is_article(best):
        whole = held.get("", 0)
        path = best
        while path and 100 * held.get(path, 0) < NEARLY_ALL * whole:
            path = path.rpartition(">")[0]
            if is_article(path):
                return path
        best = path or best
    return best


def is_article(path: str) -> bool:
    return path.rpartition(">")[2].partition(".")[0] in ("article", "main")


def held_text(found: list[tuple[str, tuple[str, ...], int]]) -> dict[str, int]:
    """Characters outside links that each path's containers hold, "" being the page."""
    held: dict[str, int] = {}
    for text, paths, linked in found:
        n = max(0, len(text) - linked)
        for path in paths:
            held[path] = held.get(path, 0) + n
    return held


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host, raised as best_path says; pages has columns host and text.

    The paths around the winner are few (its depth), so what is joined and compared is a few rows a host.
    """

    def run(batches):
        for part in chunks(batches, "text"):
            votes: dict[tuple[str, str], int] = {}
            held: dict[tuple[str, str], int] = {}
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = blocks(page or "")
                for path, points in container_scores(found).items():
                    votes[host, path] = votes.get((host, path), 0) + points
                for path, n in held_text(found).items():
                    held[host, path] = held.get((host, path), 0) + n
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), pa.array([p for _, p in held], pa.string()), pa.array([votes.get(k) for k in held], pa.int64()), pa.array(list(held.values()), pa.int64())], ["host", "path", "votes", "held"])

    told = pages.select("host", "text").mapInArrow(run, "host string, path string, votes long, held long")
    total = cut(told.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("held").alias("held")))
    best = total.where("votes is not null").groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best")).select("host", F.col("best.path").alias("best"))
    # the winner and the paths around it
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("best", ">"))), lambda n: F.array_join(F.slice(F.split("best", ">"), F.lit(1), n), ">"))
    around = best.select("host", "best", F.explode(steps).alias("path")).join(total, ["host", "path"])
    article = F.regexp_extract("path", r"([^>.]*)[^>]*$", 1).isin("article", "main")
    whole = F.max(F.when(F.col("path") == "", F.col("held")))
    told = around.groupBy("host", "best").agg(whole.alias("whole"), F.collect_list(F.struct(F.length("path").alias("n"), "path", "held", article.alias("article"))).alias("up"))
    good = F.filter("up", lambda u: (u.path != "") & (u.article | (100 * u.held >= NEARLY_ALL * F.col("whole"))))
    lowest = F.element_at(F.sort_array(good), -1).path
    own = F.regexp_extract("best", r"([^>.]*)[^>]*$", 1).isin("article", "main")
    return told.select("host", F.when(own | (F.size(good) == 0), F.col("best")).otherwise(lowest).alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: the id and url columns, text, n_chars (code points).

    Null and empty pages have an empty text, an empty table gives no rows, columns with other names
    may clash with nothing as they are left out. Pages without a url vote together. Blocks have
    their references decoded, white space made one space and trimmed, and are joined by one
    space in page order. Other columns are left out; repeated rows repeat (and vote again).
    Hosts' paths join back by host: broadcast up to MOST_BROADCAST hosts, so that pages aren't
    shuffled; beyond that over (host, salt), so that no host's pages meet in one task.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("text"))
    chosen = cut(host_paths(rows))
    kinds = {"id": pages.schema[id_col].dataType.simpleString(), "url": pages.schema[url_col].dataType.simpleString()}

    def run(batches):
        for part in chunks(batches, "text"):
            texts = []
            for page, path in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                found = blocks(page or "")
                if not any(path in paths for _, paths, _ in found):
                    path = best_path(container_scores(found), held_text(found))
                texts.append(" ".join(text for text, paths, _ in found if path in paths))
            n = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(n)], [id_col, url_col, "text", "n_chars"])

    if chosen.count() <= MOST_BROADCAST:
        joined = rows.join(F.broadcast(chosen), "host", "left")
    else:
        salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("id", "url", "text", "path")
    return joined.mapInArrow(run, f"`{id_col}` {kinds['id']}, `{url_col}` {kinds['url']}, text string, n_chars long")
