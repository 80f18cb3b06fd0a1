"""HTML extraction by consensus host paths.

Every page's containers are scored by the text they hold outside links and
boilerplate.  A container's path is that of its ancestors' tags and classes,
with digits and ids taken out, so that pages made from one template agree.
Each page votes with its best container; Spark sums the votes per host and
path.  Then every page is extracted anew: from the containers on the
best-voted path of its host that the page has, or, where it has none of them,
from its own best container.

Inside the container, boilerplate descendants (menus, headers and footers of
the page, sidebars, adverts, notices, forms, comments, scripts, styles) are
left out, wherever the path leads.  An element that only its names call
boilerplate is read all the same if it holds most of the unlinked text in
articles, or, on a page without any, most of all unlinked text; comments never
are, and adverts only for an article in them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatecast.llm.store import keep

PATHS = 8   # best-voted paths of a host that are tried in turn; a page with none of them uses its own best

# Names of HTML elements and words in class names, by role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "blockquote"}
SKIPPED = {"nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "head"}
NESTING = CONTAINERS | SKIPPED | {"header", "ul", "ol", "li", "dl", "table", "tbody", "thead", "tfoot", "tr", "th", "figure", "fieldset", "details", "center"}
BLOCKS = NESTING | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "dt", "dd", "figcaption", "caption", "summary", "address", "hgroup", "legend", "option", "title"}
BOILERPLATE = ("ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent",
               "disclaimer", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup",
               "promo", "related", "replies", "responses", "share", "sharing", "sidebar", "sidebars", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets")
_BOILER = frozenset(BOILERPLATE)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# a whole class, id or role; or one with such an affix, as in ad-top, share-buttons or site-footer
_AFFIXED = re.compile("|".join([r"(?:ads?|advert|banner|breadcrumbs?|comments?|cookies?|consent|newsletter|pagination|popup|promo|share|sharing|sponsor|subscribe|widget)[-_].*",
                                r"(?:site|global|top|bottom)[-_](?:header|footer|nav|navigation|menu|banner)|(?:main|primary|secondary|left|right)[-_](?:nav|navigation|menu|sidebar)|page[-_]footer",
                                r"(?:nav|footer|sidebar|menu|related|social)[-_](?:bar|box|list|links?|menu|area|widgets?|posts|articles|icons|buttons|share|media|left|right|top|bottom)",
                                r"(?:users?|readers?|visitors?|guests?)[-_](?:comment|feedback|discussion|repl(?:y|ies)|responses?|reviews?|opinions?|voices)",
                                r"(?:feedback|discussion|replies|responses)[-_](?:area|box|form|list|section|thread|threads)",
                                r".*[-_](?:ads?|advert|advertisement|breadcrumbs?|comments?|disclaimer|newsletter|pagination|popup|promo|widget)"]))
_REPLIES = re.compile(r"comments?|replies|responses|disqus|feedback|discussion")  # may well hold most of a page's text
_ADVERT = re.compile(r"\b(?:ads?|advert\w*|sponsor\w*|promo)\b")  # as may these, of a short page
_DIGITS = re.compile(r"[-_]?\d+$")
_SAYS_ARTICLE = re.compile(r"(?:has|no|with|without)[-_].*")
_BLANK = re.compile(r"\s+")


def _boiler_name(name: str) -> bool:
    if _SAYS_ARTICLE.fullmatch(name):
        return False
    return name in _BOILER or _DIGITS.sub("", name) in _BOILER or _AFFIXED.fullmatch(name) is not None


def _names(attrs: str) -> tuple[str, bool, bool]:
    """First class without digits, whether class, id or role says boilerplate, and whether the element is hidden."""
    first, boiler, hidden = "", False, False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.strip() == "true"
        elif key in ("class", "id", "role"):
            if key == "class" and value.split() and not first:
                first = re.sub(r"[\d_-]+", "", value.split()[0])
            boiler |= any(map(_boiler_name, value.split())) or (key == "role" and value in ("contentinfo", "complementary", "search"))
    return first, boiler, hidden


def read_blocks(page: str, freed: frozenset = frozenset()) -> tuple[list, list]:
    """The page's containers and its text blocks in order.

    Containers are (path, parent, skipped).  Blocks are (container, text, is
    inside a link only, is boilerplate).  Broken nesting is read leniently: an
    end tag closes up to its start, unknown ones are ignored, and what is open
    at the end ends there.  ``freed`` has the numbers of the elements whose
    names do not count; if it is empty they are found, and the page read again.
    """
    nodes, blocks = [("", -1, False)], []
    stack = [("", 0, False, False, False, ())]  # tag, container, skipped, skipped whatever the names, in an article, elements named boilerplate
    named: list = []                            # of each such element: text, text in its articles, is in an article, may be freed by (0) none, (1) its articles, (2) either
    page_text = article_text = 0
    parts: list[str] = []
    linked = plain = 0
    in_link = False
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal linked, plain, page_text, article_text
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                _, box, skipped, hard, in_article, inside = stack[-1]
                blocks.append((box, text, linked, skipped))
                if not hard:
                    free = max(len(text) - linked, 0)
                    page_text += free
                    article_text += free * in_article
                    for k in inside:
                        named[k][0] += free
                        named[k][1] += free * (in_article and not named[k][2])
            parts.clear()
        linked = plain = 0

    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            at = end
        if at > pos:
            parts.append(page[pos:at])
            if in_link:
                linked += at - pos
        if at == end:
            break
        m = _TOKEN.match(page, at)
        if m is None:
            parts.append("<")
            pos = at + 1
            continue
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            if tag == "title":
                flush()
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
                pos = close.end() if close else end
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        in_link = False
        if tag not in NESTING:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if attrs.rstrip().endswith("/"):
            continue
        first, boiler, hidden = _names(attrs)
        _, box, skipped, hard, in_article, inside = stack[-1]
        top = tag in ("html", "body", "main", "article")
        hard = hard or tag in SKIPPED or (hidden and not top) or (tag == "header" and not in_article)
        skip = skipped or hard
        if boiler and not top:
            skip = skip or len(named) not in freed
            inside = (*inside, len(named))
            named.append([0, 0, in_article, 0 if _REPLIES.search(attrs.lower()) else 1 if _ADVERT.search(attrs.lower()) else 2])
        if tag in CONTAINERS and not skip:
            nodes.append((f"{nodes[box][0]}/{tag}" + (f".{first}" if first else ""), box, skip))
            box = len(nodes) - 1
        stack.append((tag, box, skip, hard, in_article or tag in ("article", "main"), inside))
    flush()
    if not freed:
        found = frozenset(k for k, (text, own, _, may) in enumerate(named) if 2 * own > article_text and may or 2 * text > page_text and may > 1 and not article_text)
        if found:
            return read_blocks(page, found)
    return nodes, blocks


def best_path(nodes: list, blocks: list) -> tuple[str, int]:
    """The path of the container with the most text of its own and near it; ties go to the first."""
    score = [0.0] * len(nodes)
    for box, text, linked, skipped in blocks:
        if skipped:
            continue
        gain = max(len(text) - 2 * linked, 0) + 20 * text.count(",")
        # a block counts fully for its container and half for each one further up
        share = 1.0
        while box >= 0 and share > 0.1:
            name = nodes[box][0].rpartition("/")[2]
            score[box] += gain * share * (1.5 if name.startswith(("article", "main")) else 1.0)
            share /= 2
            box = nodes[box][1]
    best = max(range(len(nodes)), key=lambda i: (score[i], -i))
    return (nodes[best][0], int(score[best])) if score[best] > 0 else ("", 0)


def text_at(nodes: list, blocks: list, path: str) -> str:
    """The text of all containers on the path, boilerplate left out."""
    inside = [False] * len(nodes)
    for i, (own, parent, _) in enumerate(nodes):
        inside[i] = own == path or (parent >= 0 and inside[parent])
    return " ".join(text for box, text, _, skipped in blocks if inside[box] and not skipped)


def extract(page: str, paths: list[str]) -> str:
    nodes, blocks = read_blocks(page)
    have = {n[0] for n in nodes}
    path = next((p for p in paths if p in have), None)
    if path is None:
        path = best_path(nodes, blocks)[0]
    return text_at(nodes, blocks, path)


def host_paths(pages: DataFrame) -> DataFrame:
    """Rows ``(host, paths)``: the best-voted container paths of each host, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                page = page.as_py()
                if page:
                    path, score = best_path(*read_blocks(page))
                    if score:
                        votes[host, path] = votes.get((host, path), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()),
                                              pa.array(list(votes.values()), pa.int64())], names=["host", "path", "votes"])

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, votes bigint")
    total = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    top = total.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PATHS)
    return top.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages(page_id, url, html)``: page_id, url, text, n_chars.

    Text is the decoded blocks in page order, white space inside a block made
    one space, joined by one space.  Null or empty html gives an empty text.
    The host is what the url holds between ``//`` and the next ``/``, ``?`` or
    ``#``, lower-cased; pages without a host form one.  Repeated rows each give
    a row; other columns are left aside; an empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"//([^/?#]*)", 1))
    named = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    paths = keep(host_paths(named), "paths")
    hosts = paths.count()
    joined = named.join(F.broadcast(paths) if hosts <= BROADCAST_HOSTS else paths, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [extract(page.as_py() or "", way or []) for page, way in zip(part.column("html"), part.column("paths").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "paths").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


BROADCAST_HOSTS = 50_000  # of at most PATHS short strings each: some 20 MB
