"""Main text of web pages by composite text density.

Every element of the page's tree gets its characters, tags, link characters and link tags; its density is
characters per tag, weighed down by the share of links. The element whose children's densities have the
largest sum is the core of the article; the least density on the way from the body to it is the threshold
that tells which paragraphs beside that way belong to the article too. Containers beside it, which may be sidebars
or further articles, have to be at least half as dense as the core itself.
"""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import table, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; none of it is text of the article.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold the article; and words of class, id and role that say the same of a container, with less trust.
PRUNED = frozenset("nav footer aside form button select head svg canvas object audio video dialog menu".split()) | RAW
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments respond reply replies disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login social share sharing related recommended widget pagination pager search skip complementary contentinfo toolbar".split()
)
ROOTS = frozenset(["article", "main"])
#: Share of the core's density that a container beside the way must reach.
BESIDE = 0.5
#: What a boilerplate name leaves of a container's density; paragraphs and the like are not weighed.
NAME_WEIGHT = 0.1
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption table li dd dt em strong b i span a code".split())
#: Start tags that end an open element: tag -> (what it ends, what it does not reach beyond).
_LISTS, _CELLS = frozenset(["ul", "ol", "menu", "dl"]), frozenset(["table"])
ENDS = {
    "li": (frozenset(["li"]), _LISTS), "dt": (frozenset(["dt", "dd"]), _LISTS), "dd": (frozenset(["dt", "dd"]), _LISTS),
    "td": (frozenset(["td", "th"]), _CELLS), "th": (frozenset(["td", "th"]), _CELLS), "tr": (frozenset(["tr"]), _CELLS),
    "option": (frozenset(["option"]), frozenset(["select"])), "tbody": (frozenset(["thead", "tbody", "tfoot"]), _CELLS), "tfoot": (frozenset(["thead", "tbody"]), _CELLS),
}
_P_SCOPE = frozenset(["td", "th", "table", "caption", "button", "object", "html", "body"])
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"""[>"']""")
_BARRIERS = ("article", "main", "body", "table", "td")
_HINT = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


class Page:
    """The tree of one page as lists: tag, parent, pruned and named flag of each element, and its texts in page order.

    One pass over the source: every scan for the end of a tag either uses up what it read or is known to be in
    vain before it begins, and open elements are found by their tag, never by a walk over the stack.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.pruned, self.named, self._rooted = ["#"], [-1], [False], [False], [False]
        self.texts: list[tuple[int, str]] = []  # (element, text); a block boundary is a space
        self.body = 0
        self._stack, self._open_at = [0], {}
        self._read(source)
        for i in range(1, len(self.tags)):
            self.pruned[i] |= self.pruned[self.parents[i]]

    def _add(self, tag: str, attributes: str) -> int:
        top = self._stack[-1]
        inside = self._rooted[top]
        self.tags.append(tag)
        self.parents.append(top)
        self._rooted.append(inside or tag in ROOTS)
        self.pruned.append(tag in PRUNED or tag == "header" and not inside or bool(attributes and tag not in ("html", "body") and _HIDDEN.search(attributes)))
        self.named.append(bool(attributes) and tag not in PLAIN and tag not in ("html", "body", *ROOTS) and self._boilerplate(attributes, inside))
        return len(self.tags) - 1

    @staticmethod
    def _boilerplate(attributes: str, inside: bool) -> bool:
        words = {w.lower() for m in _HINT.finditer(attributes) for w in _WORDS.findall(m[2] or m[3] or m[4] or "")}
        return bool(words & NAMES - (frozenset(["header", "alert"]) if inside else frozenset()))

    def _read(self, source: str):
        at, n, last = 0, len(source), {c: source.rfind(c) for c in ">\"'"}
        while at < n:
            start = source.find("<", at)
            if start < 0 or start > last[">"] and not source.startswith("<!--", start):
                self._text(source[at:])
                return
            end, tag, closing, attributes = self._markup(source, start, last)
            if end is None:  # a "<" that starts nothing
                self._text(source[at : start + 1])
                at = start + 1
                continue
            if start > at:
                self._text(source[at:start])
            at = end
            if tag is None:
                continue
            if tag in BLOCK:
                self.texts.append((self._stack[-1], " "))
            if closing:
                self._end((tag,), _BARRIERS if tag not in BLOCK else ())
            elif tag in RAW:
                self._add(tag, attributes)
                over = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                at = source.find(">", over.end()) + 1 if over and over.end() <= last[">"] else n
            else:
                self._start(tag, attributes)

    @staticmethod
    def _markup(source: str, start: int, last: dict):
        """(end, tag, closing, attributes) of the markup at ``start``: no tag for comments, no end for a plain "<"."""
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            return (end + 3 if end >= 0 else len(source)), None, False, ""
        if source[start + 1 : start + 2] in ("!", "?"):
            return source.find(">", start) + 1, None, False, ""
        closing = source.startswith("/", start + 1)
        name = _NAME.match(source, start + 1 + closing)
        if not name:
            return None, None, False, ""
        at = name.end()
        while True:
            m = _QUOTE_OR_END.search(source, at)
            if m is None or m[0] != ">" and m.start() >= last[m[0]]:
                end = source.find(">", name.end()) + 1  # a quote that nothing closes is a letter like any other
                break
            if m[0] == ">":
                end = m.end()
                break
            at = source.find(m[0], m.end()) + 1
        return end or None, name[0].lower(), closing, source[name.end() : end - 1]

    def _start(self, tag: str, attributes: str):
        if tag in BLOCK and tag != "br":
            self._end(("p",), _P_SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("html", "body") and self._open_at.get(tag):
            return
        node = self._add(tag, attributes)
        if tag == "body":
            self.body = node
        if tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK - VOID:
            self._open_at.setdefault(tag, []).append(len(self._stack))
            self._stack.append(node)

    def _end(self, tags, scope):
        """Closes the innermost open element of ``tags``, unless one of ``scope`` is open inside it."""
        depth = lambda names: max((self._open_at[t][-1] for t in names if self._open_at.get(t)), default=0)
        found = depth(tags)
        if found and found > depth(scope):
            for node in reversed(self._stack[found:]):
                self._open_at[self.tags[node]].pop()
            del self._stack[found:]

    def _text(self, raw: str):
        self.texts.append((self._stack[-1], _html.unescape(raw) if "&" in raw else raw))


def densities(page: Page):
    """(density, sum of the children's densities, characters, characters in links) of every element.

    Pruned elements count for nothing; a container with a boilerplate name has a tenth of its density, and what
    stands below it counts a tenth as well.
    """
    n = len(page.tags)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parents[i]] or page.tags[i] == "a"
    for node, text in page.texts:
        if not page.pruned[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if in_link[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):
        if not page.pruned[i]:
            up = page.parents[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tags[i] == "a")
    body = page.body
    share = link_chars[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
        if c and not page.pruned[i]:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            ratio = c / max(1, lc) * t / max(1, lt)
            # The base is e without links and grows with them; ratios below 1 stay small, not negative.
            density[i] = c / t * (math.log(max(ratio, 1.0) + 1e-9) / math.log(max(base, 1.0) + 1.0)) * (NAME_WEIGHT if page.named[i] else 1.0)
        if i:
            total[page.parents[i]] += density[i]
    for node, text in page.texts:
        if text.strip() and not page.pruned[node]:
            total[node] += len(text.strip())  # text that stands beside the children, as a child of its own
    weight = [1.0] * n
    for i in range(1, n):
        weight[i] = weight[page.parents[i]] * (NAME_WEIGHT if page.named[i] else 1.0)
    return density, [t * w for t, w in zip(total, weight, strict=True)], chars, link_chars


def main_text(source: str) -> str:
    """The article of a page, blocks joined by one space; empty if the page has no text outside boilerplate."""
    page = Page(source)
    density, total, chars, link_chars = densities(page)
    n = len(page.tags)
    below = [False] * n
    below[page.body] = True
    for i in range(page.body + 1, n):
        below[i] = below[page.parents[i]]
    inside = [i for i in range(n) if below[i] and not page.pruned[i] and total[i] > 0]
    if not inside:
        return ""
    best = max(inside, key=lambda i: (total[i], -i))
    path = [best]
    while path[-1] not in (page.body, 0):
        path.append(page.parents[path[-1]])
    threshold = min((density[i] for i in path if density[i] > 0), default=0.0)
    # The outermost article or main on the way is looked at whole; beside the way, further ones join it by the
    # boundary's threshold, and where there is none, all neighbours by theirs.
    roots, way = [i for i in path if page.tags[i] in ROOTS], set(path)
    core = roots[-1] if roots else best
    boundary = max(threshold, BESIDE * density[core])
    chosen = [False] * n
    for i in range(n):
        up = page.parents[i]
        if page.pruned[i] or not below[i]:
            continue
        dense = density[i] >= threshold
        if i == core:
            chosen[i] = True
        elif up >= 0 and chosen[up]:
            # Below the core, links and what its name calls boilerplate must be as dense as the threshold.
            chosen[i] = i in way or dense or not (page.named[i] or page.tags[i] != "a" and 2 * link_chars[i] > chars[i])
        else:
            beside = up in way and i not in way and (page.tags[i] in ROOTS or not roots)
            chosen[i] = beside and density[i] >= (threshold if page.tags[i] in PLAIN else boundary)
    return " ".join("".join(text if chosen[node] else " " for node, text in page.texts).split())


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``.

    Null and empty pages, and pages of boilerplate alone, have the empty text. Each row is read whole where it
    stands: repeated rows alike, null ids and urls as they are, no rows from an empty table. Only the three
    named columns are read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_composite_text_density(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
