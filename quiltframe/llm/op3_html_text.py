"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm.common import rows, table

#: Elements whose content is no text of the page, up to their end tag.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg math iframe object textarea select title".split()}
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
STOP = re.compile(r"[<>\"']")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text.
OUTSIDE = frozenset("nav footer aside form menu button dialog search label fieldset legend input audio video canvas map".split())
#: Those of them that some pages put around everything.
AROUND = frozenset("form dialog fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the same kind up to the container named.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Words in class, id or role that mark what is no article text.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adunit sponsor sponsored promo promotion promoted banner sidebar sidebars aside menu menus nav navbar navigation topnav breadcrumb breadcrumbs "
    "footer footnav colophon cookie cookies cookiebar consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations teaser teasers outbrain taboola "
    "comment comments commentlist disqus respond reply replies discussion widget widgets toolbar pagination pager skip search searchbox contentinfo complementary".split()
)
HEADER_HINTS = frozenset("header masthead topbar banner".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
WORD = re.compile(r"[A-Za-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, whether an end tag, tag, attributes) one after another; the tag is "" for comments and at the end.

    Linear in the page: what is looked for and not there is looked for once.
    """
    at = text = 0
    last = {c: page.rfind(c) for c in "\"'>"}
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", at)
            end = page.find("-->", at + 4) if comment else page.find(">", at)
            yield page[text:at], False, "", ""
            text = at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        m = NAME.match(page, at)
        if not m:
            if after == "/" and at < last[">"] and page[at + 2 : at + 3] != " ":
                yield page[text:at], False, "", ""  # a bogus end tag
                text = at = page.find(">", at) + 1
            else:
                at += 1
            continue
        end, closed = m.end(), False
        while end <= last[">"]:
            stop = STOP.search(page, end)
            c = stop.group()
            end = stop.end()
            if c == "<":
                break
            if c == ">":
                closed = True
                break
            if end <= last[c]:
                end = page.find(c, end) + 1
        if not closed:
            if at > last[">"] and page.find("<", at + 1) < 0:
                yield page[text:at], False, "", ""  # cut off within a tag
                return
            at += 1
            continue
        tag = m.group(2).lower()
        yield page[text:at], bool(m.group(1)), tag, page[m.end() : end - 1]
        text = at = end
        if tag in RAW and not m.group(1):
            close = RAW[tag].search(page, end)
            text = at = close.end() if close else len(page)
    yield page[text:], False, "", ""


def _marked(tag: str, attributes: str, hints: bool, around: bool) -> str:
    """"out" for what is left out, "gone" for what can't be seen, "head" for headers, "main" for an article, else "".

    Article and main, by tag or role, win over classes, of which only whole names count, - and _ left out. hints: whether classes count at all; around: whether forms and the like do.
    """
    kind = "out" if tag in OUTSIDE and (around or tag not in AROUND) else "head" if tag == "header" else "main" if tag in ("article", "main") else ""
    if kind == "out" or not attributes or attributes.isspace() or tag in ("html", "body"):
        return kind
    found = [(name.lower(), a or b or c) for name, a, b, c in ATTRIBUTE.findall(attributes)]
    for name, value in found:
        if name == "role" and {w.lower() for w in WORD.findall(value)} & {"main", "article"}:
            kind = "main"
    for name, value in found:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            return "out"
        if name in ("class", "id", "role") and kind != "main" and hints:
            words = {w.lower().replace("-", "").replace("_", "") for w in value.split()}
            if words & HEADER_HINTS and "banner" not in words:
                kind = kind or "head"
            elif words & HINTS:
                return "out"
    return kind


class Stack:
    """Open elements: tag, mark, left out, within an article, whether an article in it is not the page's."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str, bool, bool, bool]] = []
        self.at: dict[str, list[int]] = {}

    def push(self, *element) -> None:
        self.at.setdefault(element[0], []).append(len(self.open))
        self.open.append(element)

    def last(self, tag: str) -> int:
        return (self.at.get(tag) or [-1])[-1]

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            self.at[self.open.pop()[0]].pop()


def lines(page: str, hints: bool = True, around: bool = True) -> tuple[list[tuple[str, int, bool, bool, bool]], bool]:
    """The blocks of a page without markup: text, characters in links, left out, within an article, heading; and whether it marks an article, if empty. Linear in the page."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    stack = Stack()
    parts: list[str] = []
    linked = link = 0
    heading = article = False

    def flush() -> None:
        nonlocal linked, heading
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            left_out, inside = stack.open[-1][2:4] if stack.open else (False, False)
            out.append((text, linked, left_out, inside, heading))
        parts.clear()
        linked, heading = 0, False

    def close(tag: str, until: tuple[str, ...] = ()) -> None:
        k = stack.last(tag)
        if k >= 0 and all(stack.last(t) < k for t in until):
            flush()
            stack.cut(k)

    for piece, ending, tag, attributes in tokens(page):
        if piece:
            parts.append(piece)
            if link:
                linked += len(piece)
        if not tag:
            continue
        if ending:
            if tag == "a":
                link = max(0, link - 1)
            if tag in BLOCK or tag in OUTSIDE:
                if tag in HEADINGS:
                    heading = True
                flush()
            close(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            link += 1
        mark = _marked(tag, attributes, hints, around)
        if tag in BLOCK or mark:
            flush()
            link = link if tag not in BLOCK else 0
            if tag in BLOCK:
                close("p", ("div", "article", "section", "td", "body", "main", "aside", "li"))
            if tag in SIBLINGS:
                close(tag, SIBLINGS[tag])
        if tag in VOID or tag in RAW or (tag not in BLOCK and not mark):
            continue
        _, _, left_out, inside, foreign = stack.open[-1] if stack.open else ("", "", False, False, False)
        foreign = foreign or tag == "aside" or (mark == "out" and inside)
        if mark == "main":
            if not foreign:
                left_out, inside, article = False, True, True  # an article in an advert or menu: that was never closed
        elif mark == "out":
            left_out = True
        elif mark == "head":
            left_out = not inside or left_out
            mark = "head" if inside else "out"
        if any(s[1] == "head" for s in stack.open[-3:]) and tag not in HEADINGS:
            left_out = True  # of an article's own header only the headings stay
        stack.push(tag, mark, left_out, inside, foreign)
    flush()
    return out, article


def sums(size: list[int], window: int) -> list[int]:
    """The sum of each line's size and those of the lines that follow within the window."""
    total = [0]
    for x in size:
        total.append(total[-1] + x)
    n = len(size)
    return [total[min(i + window, n)] - total[i] for i in range(n)]


def surges(size: list[int], headings: list[bool], window: int, surge: int) -> list[int]:
    """The lines between surge and dive points: from where a sum exceeds surge up to where the sum is nothing.

    The heading just before a first surge belongs to it, if headings say so.
    """
    keep, on = [], False
    for i, s in enumerate(sums(size, window)):
        if not on and s > surge and size[i]:
            on = True
            if not keep and i and headings[i - 1]:
                keep.append(i - 1)
        elif on and not s:
            on = False
        if on and size[i]:
            keep.append(i)
    return keep


def main_text(page: str, window: int = 3, surge: int = 80) -> str:
    """The main text of a page, its blocks joined by blank lines.

    Block lengths are summed over windows of so many lines. The text starts
    where a sum surges above the threshold and ends where the sum dives to
    nothing. What markup names as menu, advert, comment and so on counts as
    empty lines, as do lines made of links. A marked article is one hump of
    the distribution with sharp edges: its every line counts, unless the lines
    outside surge too and hold more than twice its text; then it is a teaser
    and the distribution decides over the whole page. A page without surge is
    all text. Where nothing is left, the page is read again without the marks
    that pages put around everything: forms, then classes, then both; if it
    marks an article, only forms within that may come back.
    """
    for hints, around in ((True, True), (True, False), (False, True), (False, False)):
        found, marked = lines(page, hints, around)
        article = [0 if left_out or not inside else len(text) for text, _, left_out, inside, _ in found]
        other = [0 if left_out or 2 * linked > len(text) else len(text) for text, linked, left_out, _, _ in found]
        outside = [0 if inside else x for x, (_, _, _, inside, _) in zip(other, found, strict=True)]
        headings = [head and not left_out and not x for (_, _, left_out, _, head), x in zip(found, other, strict=True)]
        if not (hints and around) and marked:
            return "\n\n".join(text for x, (text, *_) in zip(article, found, strict=True) if x)
        if sum(article) and not (sum(outside) > 2 * sum(article) and max(sums(outside, window)) > surge):
            keep = surges(article, [False] * len(found), window, 0)
        else:
            keep = surges(other, headings, window, surge) or surges(other, headings, window, 0)
        if keep or not found:
            break
    return "\n\n".join(found[i][0] for i in keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", window: int = 3, surge: int = 80) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    Null, empty or text-free html gives an empty text with 0 characters; broken
    or cut markup is read as far as it goes; very long pages take time in
    proportion, however deep their elements nest. Other columns are ignored; repeated
    and null keys stay as they are; an empty table gives no rows. One pass in
    Arrow batches, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, urls, texts in rows(batches, "page_id", "url", "html"):
            got = [main_text(t, window, surge) if t else "" for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(urls, pa.string()), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
