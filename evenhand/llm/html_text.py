"""Main text of web pages by composite text density.

A page becomes a tree of its block elements; inline tags count as tags of the block they stand in. Every node has C characters, T
tags, and of these LC characters and LT tags in links. Its link-adjusted density is

    C / T * log(C / LC * T / LT, base ln(C / (C - LC) * LC + LCb / Cb * C + e))

with b the body; a node's density sum is that of its children and of text of its own. The node with the largest sum is the core of
the article, and the least density on the path from it to the body is the threshold: all subtrees
that reach it hold content, each from its node with the largest sum on. Where content stands in an element that is marked as an
article, or as the main part, that element's whole text is taken, so that short paragraphs stay.

Parts that are no article by their element, role or hiding (menus, page headers, footers, sidebars, forms, scripts, styles) count nothing. They end where other elements do: at their end tag, at that of an element around
them, or where HTML lets the end tag be left out (head, p, li, dt, dd, option, cells, rows).

Words of a class or an id are evidence only, weighed when the tree is known. Outside the article (an article element, a main element
without one, else the core of what nobody suspects) an element with such a word counts nothing, unless it holds most of the articles, or without articles of the page's text.
Inside, headings stay and sections go only if links make up half of them; other elements go if links do, if the word is one of adverts and
the like and the text is short, or if they hold readers' comments that are the smaller part.

Defined cases: null, empty or text-free html gives an empty text; unclosed and stray tags are mended as browsers do for
paragraphs, items and cells; an unclosed script takes the rest of the page; input columns are kept.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.llm.catalog import register
from evenhand.llm.common import read, slices
from evenhand.llm.rows import replace_columns, schema_with

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
# Elements that are no text of an article.
DROPPED = frozenset("head title script style noscript template nav footer aside form button select textarea input option iframe svg math canvas object audio video dialog menu noframes noembed map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert status form menu menubar toolbar".split())
# Words of a class or an id that mark such elements.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended "
    "recommendations comment comments reply replies respond disqus discussion widget toolbar pagination pager search skip hidden".split()
)
FOREIGN = frozenset(("svg", "math"))
# Of these, the words that a short part of an article is taken at, and those of readers' comments.
PLAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar sidebars menu menus navbar breadcrumb breadcrumbs cookie cookies consent gdpr popup modal newsletter "
    "subscribe subscription signup signin login disqus pagination pager toolbar".split()
)
COMMENT_WORDS = frozenset("comment comments respond replies disqus".split())
# Of these, the words of whole threads.
THREAD_WORDS = frozenset("comments respond replies disqus".split())
# Elements of a form whose own text is running text.
FORM_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote td div article section main em strong b i a span code pre".split())
SHORT = 200
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT = frozenset("html body main".split())
ARTICLE = frozenset("article main".split())
# Elements whose start closes an open paragraph.
CLOSING_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# In the list of texts: a block begins or ends.
BREAK = (-1, "")
SCOPE = frozenset("html body table td th button object caption template".split())
# What a new item does not close beyond.
ITEM_FENCE = (CLOSING_P - {"address", "div", "p"}) | SCOPE | {"select", "datalist", "noscript", "dialog"}
CELLS = frozenset(("td", "th"))
ROWS = frozenset("tr td th caption colgroup".split())
TABLE = frozenset(("table", "template"))
# The open elements that a new one closes, and where the search for them ends.
CLOSES = {
    "li": ({"li"}, ITEM_FENCE), "dt": ({"dt", "dd"}, ITEM_FENCE), "dd": ({"dt", "dd"}, ITEM_FENCE),
    "tr": (ROWS, TABLE), "td": (CELLS, TABLE | {"tr"}), "th": (CELLS, TABLE | {"tr"}), **{x: (ROWS | {"thead", "tbody", "tfoot"}, TABLE) for x in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, SCOPE | {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, SCOPE | {"select"}),
    "a": ({"a"}, SCOPE), "button": ({"button"}, SCOPE - {"button"}), "rt": ({"rt", "rp"}, SCOPE | {"ruby"}), "rp": ({"rt", "rp"}, SCOPE | {"ruby"}),
}
# Elements that may stand in a head; any other, or text, ends one that is left open.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())


def _is_dropped(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attributes.strip() or name in KEPT:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in DROPPED_ROLES:
            return True
    return False


def _evidence(name: str, attributes: str) -> frozenset[str]:
    """The words of class and id that speak against an element."""
    if not attributes.strip() or name in KEPT or name in VOID:
        return frozenset()
    return DROPPED_WORDS.intersection(w for key, value in ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id") for w in re.split(r"[^a-z0-9]+", value.lower()))


class Page:
    """The block elements of a page in page order, and their text. Lists are indexed by node; children follow their parent."""

    def __init__(self, source: str, forms: bool = False):
        """forms: a form is a block like others, not dropped."""
        self._forms, self.form_chars = forms, 0
        self._opened: Counter[str] = Counter()  # open elements by name
        self.parent, self.name, self.tags, self.link_tags = [-1], ["#page"], [0], [0]
        self.chars, self.link_chars = [0], [0]
        self.pieces: list[tuple[int, str]] = []  # (node, text) in page order
        self.evidence: dict[int, frozenset[str]] = {}
        self._stack, self._link, self._skip, self._in_article, self._inline = [0], 0, 0, 0, 0
        self._read(source)
        self.gone = self._settle() if self.evidence else [False] * len(self.name)

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">")
        while at < len(source):
            # Without a further end of a tag there is none; looking for it from every start would take the square of what is left.
            found = TOKEN.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
            if found is None:
                self._text(source[at:])
                return
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._close(name)
                continue
            attributes = found[3] if found[2] else found[6]
            closed = attributes.endswith("/") and name not in INLINE and name in VOID
            self._open(name, attributes, closed)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._close(name)

    def _text(self, text: str) -> None:
        if self._skip and self.name[self._stack[-1]] == "head" and text.strip():
            self._pop(len(self._stack) - 1)
        if self._skip:
            self._count_in_form(text)
            return
        node = self._stack[-1]
        n = len("".join(text.split()))
        if n:
            self.chars[node] += n
            if self._link:
                self.link_chars[node] += n
        self.pieces.append((node, text))

    def _count_in_form(self, text: str) -> None:
        """Running text of a dropped form: what stands in blocks of it, not in its labels, controls and other dropped parts."""
        skipped = [self.name[x] for x in self._stack[-self._skip :]] if self._opened["form"] else ["none"]
        if skipped[0] == "form" and skipped[-1] in FORM_TEXT and not any(x in DROPPED and x != "form" for x in skipped):
            self.form_chars += len("".join(text.split()))

    def _open(self, name: str, attributes: str, closed: bool) -> None:
        if self._skip:
            self._leave_head(name)
            if self._skip and name in KEPT and name != "main":
                return
        if name in CLOSING_P:
            self._close_p()
        if name in CLOSES:
            self._close_before(*CLOSES[name])
        plain = self._forms and name == "form"
        if self._skip or (not plain and _is_dropped(name, attributes, self._in_article > 0)):
            # Dropped elements are open elements like others, so that the same tags end them, but they count nothing.
            if not self._skip and name not in INLINE:
                self.pieces.append(BREAK)
            if name not in VOID and not (name in FOREIGN and attributes.endswith("/")):
                self._push(name, 0)
                self._skip += 1
            return
        node = self._stack[-1]
        evidence = _evidence(name, attributes)
        if name in INLINE and name not in VOID and (evidence or self._inline):
            # Such inline elements are nodes, since they may go, and so are those in them, to tell their end tags.
            self._push(name, 1)
            self._inline += 1
            if evidence:
                self.evidence[self._stack[-1]] = evidence
            if name == "a":
                self.link_tags[self._stack[-1]] = 1
                self._link = len(self._stack)
            return
        if name in INLINE or name in VOID:
            self.tags[node] += 1
            if name == "a":
                self.link_tags[node] += 1
                self._link = len(self._stack)
            elif name == "hr":
                self.pieces.append(BREAK)
            elif name in ("br", "img"):
                self.pieces.append((node, " "))
            return
        self.pieces.append(BREAK)
        self._push(name, 1)
        if evidence:
            self.evidence[self._stack[-1]] = evidence
        if closed:
            self._opened[self.name[self._stack.pop()]] -= 1
        else:
            self._in_article += name in ARTICLE

    def _push(self, name: str, tags: int) -> None:
        self.parent.append(self._stack[-1])
        self.name.append(name)
        for counts in (self.link_tags, self.chars, self.link_chars):
            counts.append(0)
        self.tags.append(tags)
        self._stack.append(len(self.name) - 1)
        self._opened[name] += 1

    def _close(self, name: str) -> None:
        first = len(self._stack) - self._skip
        if not self._opened[name] and not (self._skip and self._opened["template"]):
            first = len(self._stack)  # none is open: nothing to look for
        for depth in range(len(self._stack) - 1, first - 1, -1):
            above = self.name[self._stack[depth]]
            if above == name:
                self._pop(depth)
                return
            if above == "template":
                return
        if name in INLINE or name in VOID:
            for depth in range(first - 1, 0, -1) if self._inline and name not in VOID else ():
                if self.name[self._stack[depth]] == name:
                    self._pop(depth)
                    return
            if name == "a":
                self._link = 0
            elif name == "br" and not self._skip:
                self.pieces.append((self._stack[-1], " "))
            return
        for depth in range(first - 1, 0, -1) if self._opened[name] else ():
            if self.name[self._stack[depth]] == name:
                self._pop(depth)
                return

    def _leave_head(self, name: str) -> None:
        """End a head that is left open where the body begins, with its tag or with something that no head has."""
        for depth in range(len(self._stack) - 1, len(self._stack) - 1 - self._skip, -1):
            if self.name[self._stack[depth]] == "head":
                if name == "body" or (depth == len(self._stack) - 1 and name not in IN_HEAD):
                    self._pop(depth)
                return
            if name != "body":
                return

    def _close_before(self, ends: frozenset[str], fence: frozenset[str]) -> None:
        """Close the outermost of these elements on this side of the fence."""
        found, left = 0, sum(self._opened[x] for x in ends)
        for depth in range(len(self._stack) - 1, 0, -1) if left else ():
            above = self.name[self._stack[depth]]
            if above in ends:
                found, left = depth, left - 1
                if not left:
                    break
            elif above in fence:
                break
        if found:
            self._pop(found)

    def _close_p(self) -> None:
        if not self._opened["p"]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            above = self.name[self._stack[depth]]
            if above == "p":
                self._pop(depth)
                return
            if above in SCOPE:
                return

    def _pop(self, depth: int) -> None:
        counted = len(self._stack) - self._skip
        for node in self._stack[depth:counted]:
            self._in_article -= self.name[node] in ARTICLE
            self._inline -= self.name[node] in INLINE
        inline = all(self.name[node] in INLINE for node in self._stack[depth:])
        self._opened.subtract(self.name[node] for node in self._stack[depth:])
        self._skip = max(0, min(self._skip, depth - counted))
        del self._stack[depth:]
        if not self._skip and not inline:
            self.pieces.append(BREAK)
        if self._link > depth:
            self._link = 0

    def _settle(self) -> list[bool]:
        """For every node, whether it goes for the words of its class or id, or of one around it; what goes counts nothing."""
        n = len(self.name)
        chars, links = self.chars[:], self.link_chars[:]
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            links[self.parent[i]] += links[i]
        threads = self._threads()
        in_thread = [False] * n
        for i in range(1, n):
            in_thread[i] = i in threads or in_thread[self.parent[i]]
        # A main element with an article in it is no article itself, nor is a reader's comment.
        has_article = [x == "article" and not t for x, t in zip(self.name, in_thread)]
        for i in range(n - 1, 0, -1):
            has_article[self.parent[i]] = has_article[self.parent[i]] or has_article[i]
        holder = [-1] * n
        for i in range(1, n):
            own = (self.name[i] == "article" or (self.name[i] == "main" and not has_article[i])) and not in_thread[i]
            holder[i] = holder[self.parent[i]] if holder[self.parent[i]] >= 0 else i if own else -1

        def goes(i: int, within: int) -> bool:
            words, name = self.evidence[i], self.name[i]
            if name in HEADINGS:
                return False
            if links[i] * 2 >= chars[i] > 0:
                return True
            if name == "section" or name in ARTICLE:
                return False
            return (chars[i] < SHORT and not PLAIN_WORDS.isdisjoint(words)) or (chars[i] * 2 < chars[within] and not COMMENT_WORDS.isdisjoint(words))

        def spread(own: set[int]) -> list[bool]:
            gone = [False] * n
            for i in range(1, n):
                gone[i] = gone[self.parent[i]] or i in own
            return gone

        inside = {i for i in self.evidence if holder[i] >= 0}
        own = {i for i in inside if goes(i, holder[i])}
        # Most of the articles' text, or without articles of the page's own text, speaks for an element around it.
        text = [chars[i] if holder[i] == i else 0 for i in range(n)]
        for i in range(n - 1, 0, -1):
            text[self.parent[i]] += text[i]
        articles = text[0] > 0
        if not articles:
            text = [c - k for c, k in zip(chars, links)]
        outside = {i for i in self.evidence if i not in inside and text[i] * 3 < text[0] * 2}
        own |= outside
        if outside and not articles:
            kept = self._without(spread(own))
            _, sums, body = self.densities()
            core = max(range(body, n), key=lambda i: (sums[i], -i))
            self.tags, self.link_tags, self.chars, self.link_chars = kept
            in_core = [False] * n
            for i in range(core, n):
                in_core[i] = i == core or in_core[self.parent[i]]
            # Where the body itself is the core, only its headings and paragraphs are surely text of it.
            texts = HEADINGS | {"p"}
            own -= {i for i in outside if in_core[i] and (core != body or self.name[i] in texts) and not goes(i, core)}
        gone = spread(own | threads)
        self._without(gone)
        return gone

    def _threads(self) -> set[int]:
        """Elements that hold readers' comments, by name and place: after text of the article that they are in, or after some text of the page."""
        marked = {i for i, words in self.evidence.items() if self.name[i] not in HEADINGS and (not THREAD_WORDS.isdisjoint(words) or (self.name[i] == "article" and "comment" in words))}
        if not marked:
            return marked
        n = len(self.name)
        around, before = [0] * n, [0] * (n + 1)
        for i in range(1, n):
            up = self.parent[i]
            around[i] = up if self.name[up] in ARTICLE and up not in marked else around[up]
        for i in range(n):
            before[i + 1] = before[i] + (0 if i in marked else self.chars[i] - self.link_chars[i])
        return {i for i in marked if before[i] - before[around[i]] >= (1 if around[i] else SHORT // 2)}

    def _without(self, gone: list[bool]) -> tuple[list[int], ...]:
        """Set the counts of these nodes to 0; those before are returned."""
        counts = (self.tags, self.link_tags, self.chars, self.link_chars)
        self.tags, self.link_tags, self.chars, self.link_chars = ([0 if g else x for x, g in zip(c, gone)] for c in counts)
        return counts

    def densities(self) -> tuple[list[float], list[float], int]:
        """Density and density sum of every node, and the body."""
        n = len(self.parent)
        own = [(c, 1, lc, 1) for c, lc in zip(self.chars, self.link_chars)]
        chars, links, tags, link_tags = self.chars[:], self.link_chars[:], self.tags[:], self.link_tags[:]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i]
            link_tags[up] += link_tags[i]
        body = next((i for i in range(n) if self.name[i] == "body"), 0)
        if not chars[body]:
            body = 0
        share = links[body] / chars[body] if chars[body] else 0.0

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            # A tenth above 1, so that text that is all link still has a density.
            return c / max(t, 1) * max(math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.1)), 0.0) / max(base, 1e-9)

        # A node's own tag does not separate its text.
        found = [density(chars[i], tags[i] - 1 if i else tags[i], links[i], link_tags[i]) for i in range(n)]
        sums = [density(*own[i]) for i in range(n)]
        for i in range(n - 1, 0, -1):
            sums[self.parent[i]] += found[i]
        return found, sums, body

    def content(self) -> list[bool]:
        """For every node, whether it stands in the main text."""
        n = len(self.parent)
        found, sums, body = self.densities()
        inside = [False] * n
        inside[body] = True
        for i in range(body + 1, n):
            inside[i] = inside[self.parent[i]]
        core = max((i for i in range(n) if inside[i]), key=lambda i: (sums[i], -i))
        path = [core]
        while path[-1] != body:
            path.append(self.parent[path[-1]])
        marked = [False] * n
        threshold = min(found[i] for i in path)
        # The node with the largest sum below each node, itself included.
        best = list(range(n))
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if sums[best[i]] > sums[best[up]] or (sums[best[i]] == sums[best[up]] and best[up] != up):
                best[up] = best[i]
        for i in range(n):
            if inside[i] and found[i] >= threshold and found[i] > 0:
                marked[best[i]] = True
        # An article that holds something marked is marked.
        holds = marked[:]
        for i in range(n - 1, 0, -1):
            if holds[i]:
                holds[self.parent[i]] = True
                marked[i] = marked[i] or self.name[i] in ARTICLE
        for i in range(1, n):
            marked[i] = marked[i] or marked[self.parent[i]]
        return marked

    def text(self) -> str:
        if not any(self.chars):
            return ""
        marked = self.content()
        # Inline elements continue the line of the block that they stand in.
        line = list(range(len(self.name)))
        for i in range(1, len(line)):
            if self.name[i] in INLINE:
                line[i] = line[self.parent[i]]
        blocks, last = [], -1
        for node, text in self.pieces:
            if node < 0:
                last = -1
            elif not marked[node] or self.gone[node]:
                continue
            elif line[node] == last:
                blocks[-1].append(text)
            else:
                blocks.append([text])
                last = line[node]
        # A reference ends where its text does: what an element parts is none.
        lines = (" ".join("".join(map(entities.unescape, b)).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def main_text(source: str | None) -> str:
    """The article of one page. A form with more running text than the rest of the page is not left out, as the page stands in it."""
    if not source:
        return ""
    page = Page(source)
    if page.form_chars > max(SHORT, sum(page.chars)):
        page = Page(source, forms=True)
    return page.text()


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows without the html, with ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            texts = [main_text(h) for h in batch.column(html_col).to_pylist()]
            yield replace_columns(batch.drop_columns([html_col]), {"text": pa.array(texts, pa.string())})

    return pages.mapInArrow(run, schema_with(pages.drop(html_col).schema, "text string"))


@register("op2_text_density")
def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
