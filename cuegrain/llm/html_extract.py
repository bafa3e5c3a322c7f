"""Operator 4: main text of HTML pages by consensus host paths.

Every page's containers are scored by the text that stands in their paragraphs; the best of each page
votes, with its score, for its path of tags and classes, digits aside; each host's winning path is then
used to extract all its pages again. A page that has no container on that path keeps its own best.

A class or id marks an element only if all of its words are unwanted ones or fillers; that lowers its score, and what is
marked is left out of the article unless the winning path leads through it. Names with other words in them, such as
side-effects, mark nothing. An article of readers' comments is marked as well, and is never lifted to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrain.llm.common import broadcast_below, cut
from cuegrain.llm.url_filter import host_of

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html li dd dt td th tr tbody thead tfoot".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements and roles that hold no article text.
DROPPED = frozenset("script style noscript template svg canvas iframe object button select textarea label nav aside footer head title menu dialog noembed noframes audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that speak against a container, and words that say nothing of their own beside them. A name with any other
#: word in it, such as side-effects or form-of-government, is taken to say what its text is about.
UNWANTED = frozenset("ad ads advert adverts advertisement advertising banner promo promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget header masthead topbar footer bottom cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist reply replies respond disqus discussion feedback share sharing social related recommended recommendations pagination pager toolbar hidden".split())
FILLERS = frozenset("area bar block body bottom box btn button buttons column container content desktop first fixed floating global group inner item items last left links list main mobile module outer page panel post posts primary reader readers rail right row secondary section site slot sticky story the thread top unit user users widget wrap wrapper zone".split())
#: Words that mark a paragraph, heading or cell by itself; the others say where it stands.
UNWANTED_TEXT = UNWANTED - frozenset("bottom footer header hidden nav search side form menu".split())
#: Words for what readers write: they mark an article, too, which other words don't.
READERS = frozenset("comment comments commentlist reply replies respond disqus discussion feedback".split())
#: What a container under such a word counts for.
MARKED_WORTH = 0.25
#: What may hold an article; "page" is the page itself, around all of its elements.
CONTAINERS = frozenset("article main section div td body blockquote page".split())
#: What text of an article stands in.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dd dt td th figcaption".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>?", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marked(tag: str, names: str) -> bool:
    """Whether a class or id speaks against the element: all its words are unwanted or fillers, and one is unwanted. For a paragraph and the like it has one word."""
    words = READERS if tag in ("article", "main") else UNWANTED_TEXT if tag in TEXTUAL else UNWANTED
    for name in names.split():
        parts = [p for x in re.split(r"[-_]+", _HUMP.sub("-", name)) if (p := x.lower().rstrip("0123456789"))]
        if any(p in words for p in parts) and (len(parts) == 1 if tag in TEXTUAL else all(p in UNWANTED or p in FILLERS for p in parts)):
            return True
    return False


def _read_attributes(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The element's step in a path, whether it is marked, and whether it is hidden or of a role without article text."""
    classes, mark, gone = "", "", False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = unescape(a or b or c)
        if name == "class":
            classes = value
        elif name == "role":
            gone |= value.strip().lower() in ROLES
        elif name == "style":
            gone |= bool(_UNSEEN.search(value))
        elif name != "id":
            gone |= name == "hidden" or value.lower() == "true"
        elif _marked(tag, value):
            mark = "#" + re.sub(r"\d+", "#", value.lower())
    words = sorted({re.sub(r"\d+", "#", x.lower()) for x in classes.split()})
    return ".".join([tag, *words]) + mark, bool(mark) or _marked(tag, classes), gone


class Page:
    """Blocks of a page's text, and the tree of its paths: each path is a parent and a step, so deep pages take little room.

    Unclosed and stray tags are taken as browsers do: a block ends an open paragraph, an end tag closes
    what is open inside it, and one that matches nothing is ignored. Inline elements, but links and what
    is dropped, leave no trace, so unclosed ones do not nest. Time and memory grow with the page's length.
    """

    def __init__(self, html: str | None):
        self.parent, self.step, self.tag, self.soft, self.wraps = [-1], ["page"], ["page"], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # path, text, characters in links
        self._read(html or "")

    def _read(self, html: str) -> None:
        known: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, bool, bool]] = []  # tag, path, dropped, in a link
        tops: list[int] = []  # places of blocks in the stack
        count: dict[str, int] = {}  # open elements by tag
        pieces: list[str] = []
        linked = at = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = _SPACE.sub(" ", "".join(pieces)).strip()
                if text:
                    path = stack[-1][1] if stack else 0
                    self.blocks.append((path, text, min(linked, len(text))))
                    if self.tag[path] == "h1":
                        self._wrap(self.parent[path])
                pieces.clear()
            linked = 0

        def add(text: str) -> None:
            nonlocal linked
            if text and not (stack and stack[-1][2]):
                text = unescape(text)
                pieces.append(text)
                if stack and stack[-1][3]:
                    linked += len(text.strip())

        def close(k: int) -> None:
            if tops and tops[-1] >= k:
                flush()
            while len(stack) > k:
                count[stack.pop()[0]] -= 1
            while tops and tops[-1] >= k:
                tops.pop()

        while (m := _TOKEN.search(html, at)) is not None:
            add(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if count.get(tag):
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    close(k)
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    add(" ")
                continue
            block = tag in BLOCK
            if block:
                if tag in ("html", "body") and count.get(tag):
                    continue
                flush()
                ends = {"p"} if tag in CLOSES_P else CLOSES.get(tag, ())
                while tops and stack[tops[-1]][0] in ends:
                    close(tops[-1])
            elif tag == "a" and count.get("a") and (not tops or tops[-1] < len(stack) - 1):
                k = next((i for i in range(len(stack) - 1, tops[-1] if tops else -1, -1) if stack[i][0] == "a"), None)
                if k is not None:  # a link ends the one before it in the same block
                    close(k)
            attributes = m[3] or ""
            step, mark, gone = _read_attributes(tag, attributes) if not attributes.isspace() and attributes else (tag, False, False)
            if not (block or gone or tag == "a" or tag in DROPPED):
                continue
            if attributes.rstrip().endswith("/") and not block:
                continue
            path = stack[-1][1] if stack else 0
            # a page's header is dropped; one inside an article introduces it
            dropped = bool(stack and stack[-1][2]) or gone or tag in DROPPED or (tag == "header" and not (count.get("article") or count.get("main")))
            if block and not dropped:
                above, path = path, known.get((path, step), -1)
                if path < 0:
                    path = known[above, step] = len(self.parent)
                    for column, value in zip((self.parent, self.step, self.tag, self.soft, self.wraps), (above, step, tag, (mark and tag not in ("html", "body")) or tag == "form", False)):
                        column.append(value)
                if tag in ("article", "main") and not mark:
                    self._wrap(above)
            if block:
                tops.append(len(stack))
            stack.append((tag, path, dropped, tag == "a" or bool(stack and stack[-1][3])))
            count[tag] = count.get(tag, 0) + 1
            if tag in RAW:  # text up to the end tag, whatever it looks like
                end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(html, at)
                stop = end.start() if end else len(html)
                add(html[at:stop])
                at = stop
        add(html[at:])
        flush()
        # what holds an article, a main or a page title is a wrapper, whatever its name
        self.soft = [s and not w for s, w in zip(self.soft, self.wraps)]
        self.blocks = [b for b, form in zip(self.blocks, self._under(lambda p: self.soft[p] and self.tag[p] == "form", [b[0] for b in self.blocks])) if not form]

    def _wrap(self, path: int) -> None:
        while path >= 0 and not self.wraps[path]:
            self.wraps[path] = True
            path = self.parent[path]

    def _under(self, is_top, paths: list[int]) -> list[bool]:
        """For each of paths whether it, or a path above it, is a top."""
        found = [is_top(0)]
        for p in range(1, len(self.parent)):
            found.append(found[self.parent[p]] or is_top(p))
        return [found[p] for p in paths]

    def keys(self) -> list[int]:
        """A 64-bit key of each path, the same on every page that has it."""
        out = [0]
        for p in range(1, len(self.parent)):
            out.append(xxhash.xxh3_64_intdigest(self.step[p].encode("utf-8", "surrogatepass"), out[self.parent[p]]))
        return [k - (1 << 64) if k >> 63 else k for k in out]

    def name(self, path: int) -> str:
        steps = []
        while path >= 0:
            steps.append(self.step[path])
            path = self.parent[path]
        return "/".join(reversed(steps))

    def best(self) -> tuple[int | None, float]:
        """The page's best container and its score; the one that begins first, if equal.

        A block's unlinked text counts for the containers around it, halved at each further out, and
        less below a marked element.
        """
        near = [0]  # of each path the innermost container, itself included
        for p in range(1, len(self.parent)):
            near.append(p if self.tag[p] in CONTAINERS else near[self.parent[p]])
        scores: dict[int, float] = {}
        marked = self._under(self.soft.__getitem__, [b[0] for b in self.blocks])
        for (path, text, linked), low in zip(self.blocks, marked):
            worth, at = max(0, len(text) - 2 * linked) * (MARKED_WORTH if low else 1.0), near[path]
            while worth >= 2.0**-30:  # what is less decides nothing: other scores are sums of whole characters, halved as often
                scores[at] = scores.get(at, 0.0) + worth
                if at == 0:
                    break
                worth, at = worth / 2, near[self.parent[at]]
        if not scores:
            return None, 0.0
        path = min(scores, key=lambda p: (-scores[p], p))
        return path, scores[path]

    def text(self, path: int) -> str:
        """All blocks of the article that the container is a part of, in page order, without what is marked beside it."""
        chain = [path]
        while chain[-1] > 0:
            chain.append(self.parent[chain[-1]])
        on = set(chain)
        marked = self._under(lambda p: self.soft[p] and p not in on, [b[0] for b in self.blocks])
        blocks = [b for b, left_out in zip(self.blocks, marked) if not left_out]
        top = self._lift(chain, blocks)
        inside = self._under(lambda p: p == top, [b[0] for b in blocks])
        return "\n\n".join(b[1] for b, within in zip(blocks, inside) if within)

    def _lift(self, chain: list[int], blocks: list[tuple[int, str, int]]) -> int:
        """The outermost article of the chain, else its outermost main.

        Without these, it is the outermost container up to which no step adds more linked than unlinked
        text. The body, or the page, counts only if all that it adds stands in headings, paragraphs and the
        like outside other divs and sections: a div next to the article's on the page is no part of it.
        """
        for tag in ("article", "main"):
            found = [p for p in chain if self.tag[p] == tag and not self.soft[p]]
            if found:
                return found[-1]
        every, own = [0] * len(self.parent), [0] * len(self.parent)
        for path, text, linked in blocks:
            every[path] += len(text)
            own[path] += len(text) if 2 * linked < len(text) else 0
        for p in range(len(self.parent) - 1, 0, -1):  # a path comes after those above it
            every[self.parent[p]] += every[p]
            own[self.parent[p]] += own[p]
        best = chain[0]
        for p in chain[1:]:
            if self.tag[p] not in CONTAINERS:
                continue
            if 2 * (own[p] - own[best]) < every[p] - every[best]:
                break
            if self.tag[p] in ("body", "page"):
                paths = [b[0] for b in blocks if 2 * b[2] < len(b[1])]
                inside = self._under(lambda q, top=best: q == top, paths)
                boxed = self._under(lambda q: self.tag[q] in ("div", "section"), paths)
                textual = self._under(lambda q: self.tag[q] in TEXTUAL, paths)
                if any((box or not good) and not within for within, box, good in zip(inside, boxed, textual)):
                    break
            best = p
        return best


def host_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the key of the path with the highest sum of scores on each host."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, html in zip(*(c.to_pylist() for c in batch.columns)):
                page = Page(html)
                best, score = page.best()
                if best is not None:
                    hosts.append(host), paths.append(page.keys()[best]), scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(vote, "host string, path long, score double")
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("score"), 3).alias("score"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("score", "path")).alias("path"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) per page.

    A null or empty page, and one without text outside what is dropped, has an empty text. Pages
    without a host in their url vote together as the empty host; votes that tie fall to the larger key.
    Very long and deeply nested pages are read whole, in time and memory that grow with their length.
    Repeated rows are pages each; other columns are not read. An empty table gives an empty result.
    """
    winners = cut(host_votes(pages, url_col, html_col), "host-paths").select(F.col("host").alias("its"), "path")

    @F.arrow_udf("string")
    def extract(html: pa.Array, path: pa.Array) -> pa.Array:
        out = []
        for text, winner in zip(html, path):
            page = Page(text.as_py())
            keys, winner = page.keys(), winner.as_py()
            found = keys.index(winner) if winner in keys else page.best()[0]
            got = page.text(found) if found is not None else ""
            if not got and found is not None and (best := page.best()[0]) is not None:  # nothing stands there on this page
                got = page.text(best)
            out.append(got)
        return pa.array(out, pa.string())

    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    both = read.join(broadcast_below(winners), F.col("host") == F.col("its"), "left")
    return both.select("id", "url", extract("html", "path").alias("text"))
