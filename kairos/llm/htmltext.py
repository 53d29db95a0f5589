"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .mincut import min_cut

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Never rendered as text of the page.
UNSEEN = frozenset("head template svg math object canvas audio video select datalist".split()) | RAW
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th
    thead tr ul""".split())
ENDS_P = BLOCK - frozenset("body caption html legend noscript tbody td tfoot th thead tr".split())
#: A start tag ends an open element of these, up to the nearest fence.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
        "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
FENCE = frozenset("table td th caption template svg math object button".split())

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form",
         "main": "main", "article": "article", "dialog": "dialog", "alertdialog": "dialog", "alert": "dialog"}
AWAY = frozenset("nav footer aside menu dialog noscript".split())
#: Parts of class and id names that mark boilerplate, and content.
AWAY_NAMES = frozenset("""nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead topbar banner footer colophon
    copyright sidebar aside widget widgets rail related recommended recommendations trending cookie cookies consent gdpr notice notices popup modal
    overlay toast paywall newsletter subscribe subscription ad ads advert adverts advertisement advertisements adsense sponsor sponsored
    promo promotion form search login signup comment comments disqus replies reply respond share sharing social""".split())
CONTENT_NAMES = frozenset("article content entry hentry main post prose story text".split())
NOT_OWN = ("has", "with", "no", "without", "hide")  # "has-sidebar" is no sidebar

#: Weights of the hints, in nats of log odds; the learned part is bounded by TEXT.
AWAY_COST, CONTAINER, NAMED, TITLE = 9.0, 4.0, 2.0, 2.0
TEXT, ONE = 3.0, 1.5
#: Cost of different labels for neighbours, halved by each further step in the tree.
SMOOTH, KIN = 1.0, 0.5
#: Weak labels: blocks with such hints train the text part.
SURE_CONTENT, SURE_AWAY = 3.0, -4.0

#: Counts of (content, boilerplate) blocks the classifier starts from.
PRIOR = {
    "links": {"none": (90, 40), "some": (8, 15), "most": (2, 45)},
    "words": {"1": (3, 35), "2-4": (7, 35), "5-9": (15, 15), "10-19": (20, 8), "20+": (55, 7)},
    "end": {"sentence": (85, 25), "open": (15, 75)},
    "tag": {"p": (70, 15), "heading": (12, 5), "item": (8, 50), "cell": (5, 10), "other": (5, 20)},
}


@dataclass
class Block:
    text: str
    element: int
    hint: float
    features: tuple


class Page:
    """The blocks of one page: runs of text between block-level tags, with
    the elements above them. Open tags are ended as browsers do."""

    def __init__(self, source: str):
        self.parent, self.depth, self.tag, self.hard, self.soft, self.good = [-1], [0], ["#"], [False], [False], [0.0]
        self.blocks: list[Block] = []
        self.stack = [0]
        self.unseen = 0  # open elements that are not rendered
        self.links = 0
        self.run: list[str] = []
        self.linked = 0  # letters of the run inside links
        self._read(source)
        self._flush()
        self._hints()

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = TOKEN.search(source, at)
            stop = m.start() if m else len(source)
            if stop > at and not self.unseen:
                piece = html.unescape(source[at:stop])
                self.run.append(piece)
                if self.links:
                    self.linked += len("".join(piece.split()))
            if not m:
                return
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                self._end(tag)
            elif m.group().endswith(">"):
                self._start(tag, m["attrs"])
                if tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                    at = close.start() if close else len(source)

    def _flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            e = next(i for i in reversed(self.stack) if self.tag[i] in BLOCK or not i)
            self.blocks.append(Block(text, e, 0.0, features(text, self.linked, self.tag[e])))
        self.run, self.linked = [], 0

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self.run.append(" ")
        if tag in VOID:
            return
        if tag in ("html", "body") and tag in (self.tag[i] for i in self.stack):
            return
        if tag in ENDS_P:
            self._pop({"p"}, FENCE)
        if tag == "body":
            self._pop({"head"}, frozenset())
        if tag in ENDS:
            self._pop(*ENDS[tag])
        if tag == "a":
            self._pop({"a"}, BLOCK)
        found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTR.findall(attrs)} if attrs.strip() else {}
        kind = ROLES.get(found.get("role", "").strip().lower(), tag)
        top = tag in ("html", "body")
        names = [] if top else [[p.lower() for p in PART.findall(n)] for n in (found.get("class", "") + " " + found.get("id", "")).split()]
        names = [n for n in names if n and n[0] not in NOT_OWN]
        away = any(p in AWAY_NAMES for n in names for p in n)
        gone = "hidden" in found or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) is not None
        self.parent.append(self.stack[-1])
        self.depth.append(self.depth[self.stack[-1]] + 1)
        self.tag.append(kind if kind in ("article", "main", "header") else tag)
        self.hard.append(kind in AWAY or gone)
        self.soft.append(kind == "form" or tag == "button" or away)
        self.good.append(CONTAINER if kind in ("article", "main") else NAMED if not away and any(p in CONTENT_NAMES for n in names for p in n) else 0.0)
        self.stack.append(len(self.tag) - 1)
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def _leave(self) -> None:
        tag = self.tag[self.stack.pop()]
        self.unseen -= tag in UNSEEN
        self.links -= tag == "a"

    def _pop(self, tags, fence) -> None:
        """End the nearest open element of ``tags`` above the fence."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[k]]
            if tag in tags:
                while len(self.stack) > k:
                    self._leave()
                return
            if tag in fence:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag in ("html", "body") or tag in VOID:
            return
        if tag in BLOCK or tag in FENCE or tag in UNSEEN:
            self._pop({tag}, frozenset({"table"}) if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else FENCE - {tag})
        else:
            self._pop({tag}, BLOCK | FENCE)

    def _hints(self) -> None:
        """Log odds of content from the elements around each block.

        The wrappers of the first article or main element outside menus and
        the like are no boilerplate themselves, whatever they are called.
        """
        n = len(self.tag)
        away, container, named, header, free = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, set()
        hard = [False] * n
        for i in range(1, n):
            hard[i] = hard[self.parent[i]] or self.hard[i]
            if not free and self.tag[i] in ("article", "main") and not hard[i]:
                j = self.parent[i]
                while j > 0:
                    free.add(j)
                    j = self.parent[j]
                free.add(0)
        for i in range(1, n):
            p = self.parent[i]
            container[i] = max(container[p], self.good[i] if self.good[i] == CONTAINER else 0.0)
            named[i] = max(named[p], self.good[i] if self.good[i] == NAMED else 0.0)
            soft = self.soft[i] and i not in free
            inner = self.tag[i] == "header" and container[p] > 0
            outer = self.tag[i] == "header" and not inner
            away[i] = AWAY_COST if away[p] or self.hard[i] or outer or (soft and not inner) else 0.0
            header[i] = AWAY_COST if inner else header[p]
        for b in self.blocks:
            e = b.element
            title = TITLE if self.tag[e] in ("h1", "h2", "h3", "h4", "h5", "h6") else 0.0
            # Of an article's own header the headings stay.
            b.hint = (container[e] or named[e]) - away[e] + (title if container[e] or self.tag[e] == "h1" else 0.0) - (0.0 if title else header[e])

    def edges(self) -> list[tuple[int, int, float]]:
        """Smoothness: neighbours in page order, and neighbours in one parent."""
        out, last = [], {}
        for i, b in enumerate(self.blocks):
            if i:
                out.append((i - 1, i, SMOOTH * 0.5 ** max(0, self._steps(self.blocks[i - 1].element, b.element) - 2)))
            up = self.parent[b.element]
            if up in last:
                out.append((last[up], i, KIN))
            last[up] = i
        return out

    def _steps(self, a: int, b: int) -> int:
        """Steps between two elements of the tree (two for siblings)."""
        n = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
            n += 1
        return n


def features(text: str, linked: int, tag: str) -> tuple:
    """One value for each feature of PRIOR."""
    n = text.count(" ") + 1
    share = linked / max(1, len(text) - n + 1)
    return ("none" if share < 0.05 else "some" if share < 0.6 else "most",
            "1" if n == 1 else "2-4" if n < 5 else "5-9" if n < 10 else "10-19" if n < 20 else "20+",
            "sentence" if text.rstrip("\"'”’»)")[-1:] in tuple(".!?…:;。！？") else "open",
            "p" if tag in ("p", "blockquote", "pre") else "heading" if re.fullmatch(r"h[1-6]|legend|summary", tag) else
            "item" if tag in ("li", "dt", "dd") else "cell" if tag in ("td", "th", "caption") else "other")


def weights(counts: dict) -> dict:
    """Log odds of each feature value from the counted blocks and the prior,
    each within ONE: counts are {(feature, value): (content, boilerplate)}."""
    out = {}
    for f, values in PRIOR.items():
        both = {v: [p + c for p, c in zip(prior, counts.get((f, v), (0, 0)))] for v, prior in values.items()}
        sums = [sum(x[k] for x in both.values()) for k in (0, 1)]
        for v, (a, b) in both.items():
            out[f, v] = max(-ONE, min(ONE, math.log(a / sums[0]) - math.log(b / sums[1])))
    return out


def content(page: Page, learned: dict) -> list[bool]:
    """Which blocks are content: terminal capacities from the classifier,
    edges from the page, separated by the minimum cut."""
    gain = []
    for b in page.blocks:
        text = sum(learned[f, v] for f, v in zip(PRIOR, b.features))
        gain.append(round(1000 * (b.hint + max(-TEXT, min(TEXT, text)))))
    return min_cut(gain, [(i, j, round(1000 * w)) for i, j, w in page.edges()])


def main_text(source: str | None, learned: dict) -> str:
    page = Page(source or "")
    return "\n".join(b.text for b, keep in zip(page.blocks, content(page, learned)) if keep)


def fit(pages: DataFrame, html_col: str = "html") -> dict:
    """Weights of the text features, from all blocks of all pages whose
    surroundings leave no doubt. At most one row for each feature value
    (fixed in PRIOR) and label reaches the driver."""
    names = list(PRIOR)

    def count(batches):
        seen: dict = {}
        for batch in batches:
            for source in batch.column(0).to_pylist():
                for b in Page(source or "").blocks:
                    if b.hint >= SURE_CONTENT or b.hint <= SURE_AWAY:
                        for f, v in zip(names, b.features):
                            k = (f, v, b.hint > 0)
                            seen[k] = seen.get(k, 0) + 1
        if seen:
            f, v, good = zip(*seen)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(v), pa.array(good), pa.array(list(seen.values()), pa.int64())], ["f", "v", "good", "n"])

    rows = pages.select(F.col(html_col).cast("string")).mapInArrow(count, "f string, v string, good boolean, n long")
    counts: dict = {}
    for r in rows.groupBy("f", "v", "good").agg(F.sum("n").alias("n")).collect():
        counts.setdefault((r.f, r.v), [0, 0])[0 if r.good else 1] = r.n
    return weights(counts)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): main text of every page's whole html.

    Null html counts as empty and gives an empty text; null ids and urls stay;
    rows that repeat give equal rows; truncated and unbalanced markup is read
    as far as it goes; an empty table gives an empty result; other columns
    are not read.
    """
    prepare(pages.sparkSession)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    learned = fit(pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(x, learned) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
