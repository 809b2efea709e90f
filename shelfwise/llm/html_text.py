"""Operator 7, HTML extraction: boosted trees over DOM nodes, decoded hierarchically.

A page becomes a tree of block elements and, below them, blocks (runs of inline text).  Every node
gets features: text and tag density of its subtree, links, punctuation, tag, tokens of class, id and
role here and above, depth, place among its siblings.  Boosted trees give the odds that a node holds
main text.  Decoding finds the likeliest labelling in which a dropped node has no kept descendant, so
ancestors and descendants never contradict each other; the kept blocks, in page order, are the text.

The trees are fitted on a bounded sample of pages (``SAMPLE_PAGES``, drawn by hash, of those below
``SAMPLE_BYTES``) that mark their article, each page as it is and in rewritten templates with the
same main text: other tags, other class names, sidebars, notices, forms, comments.

Null and empty pages have empty text.  Character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by one space; scripts, styles, form controls, drawings
(svg) and comments of the markup never are text, formulas (math) are.  Only raw text elements are skipped
to their end tag; a drawing or formula honours ``/>`` and ends with its parent or before an element that
cannot be in one, and so does a head whose end tag is left out.  Repeated rows are treated alike; an empty table gives an
empty result.  Where no page of the sample marks an article, the rewritten templates are fitted on the
sample's own longest blocks.  Only id, url and html are read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.boosting import BoostedTrees
from shelfwise.llm.common import drawn, slices, text_or_empty

SAMPLE_PAGES = 200
SAMPLE_BYTES = 60_000
SEED = 7

TAG_RX = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
NOSCRIPT_END = re.compile(r"</noscript\b", re.I)
ATTR_RX = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "xmp", "noframes", "noembed")}
NEVER = frozenset("head script style noscript template button select option textarea object embed canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                     "main menu nav ol p pre section table ul".split())
#: What may be in a head; what ends a drawing or formula; where markup inside of one is html again; what is hidden there.
IN_HEAD = frozenset("head html base basefont bgsound link meta title script style noscript noframes template".split())
BREAKS = CLOSES_P | frozenset("b big body br center code dd dt em embed head i img li listing meta nobr ruby s small span strike strong sub sup "
                              "tbody td tfoot th thead tr tt u var".split())
FOREIGN = frozenset(("svg", "math"))
POINTS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
UNSEEN = NEVER | frozenset(("svg", "annotation", "annotation-xml"))
#: A last slash that belongs to an unquoted value closes nothing.
VALUE_SLASH_RX = re.compile(r"=\s*[^\s\"']*/\Z")
#: Tag groups, one feature each.
GROUPS = {t: g for g, ts in enumerate(("p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd menu", "table thead tbody tr td th", "div section",
                                       "article main", "nav", "header", "footer", "aside", "form fieldset label input", "figure figcaption",
                                       "body html")) for t in ts.split()}
N_GROUPS = 14
BLOCK = N_GROUPS - 1       # a run of text has a group of its own
#: Tokens of class, id and role that speak against and for main text (fixed lists).
AGAINST = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
                    "copyright disclaimer dialog discussion disqus foot footer form gdpr head header legal links login masthead menu meta modal "
                    "nav navbar navigation newsletter notice notification outbrain pager pagination popup promo promoted promotion rail recommended "
                    "register related replies reply respond search share sharing sidebar signup site skip social sponsor sponsored sponsors "
                    "subscribe subscription tabs tags taboola tool toolbar top widget widgets".split())
FOR = frozenset("article articlebody body content entry main maincontent page post posts story text".split())
TOKEN_RX = re.compile(r"[A-Za-z][a-z]*")


class Page:
    """Nodes of one page in page order; ``blocks`` are (node, text)."""

    __slots__ = ("parent", "group", "depth", "against", "fore", "text", "own", "linked", "marks", "tags")

    def __init__(self, source: str):
        self.parent, self.group, self.depth, self.against, self.fore = [-1], [N_GROUPS - 2], [0], [0], [0]
        self.text: list[str | None] = [None]
        self.own, self.linked, self.marks, self.tags = [0], [0], [0], [0]
        self._parse(source)

    def _node(self, parent: int, group: int, against: int = 0, fore: int = 0) -> int:
        self.parent.append(parent)
        self.group.append(group)
        self.depth.append(self.depth[parent] + 1)
        self.against.append(against)
        self.fore.append(fore)
        self.text.append(None)
        self.own.append(0)
        self.linked.append(0)
        self.marks.append(0)
        self.tags.append(0)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        #: Open elements: name, node (inline ones share their block's), inline, hidden, link, drawing or formula.
        stack: list[tuple[str, int, bool, bool, bool, bool]] = [("", 0, False, False, False, False)]
        run: list[str] = []
        link_chars = 0
        links = hidden = foreign = 0
        opened: Counter = Counter()        # open elements by name, so that no search is for nothing
        turns: list[int] = []              # places of the open drawings, formulas and points of return to html
        heads: list[int] = []              # and of the open heads, templates and noscripts
        ends = -1                          # where the next end of a noscript was found to be

        def push(e: tuple[str, int, bool, bool, bool, bool]) -> None:
            opened[e[0]] += 1
            if e[5] or e[0] in POINTS:
                turns.append(len(stack))
            if e[0] in ("head", "template", "noscript"):
                heads.append(len(stack))
            stack.append(e)

        def flush() -> None:
            nonlocal link_chars
            if run:
                text = " ".join("".join(run).split())
                if text:
                    at = self._node(stack[-1][1], BLOCK)
                    self.text[at] = text
                    self.own[at] = len(text)
                    self.linked[at] = min(link_chars, len(text))
                    self.marks[at] = sum(map(text.count, ".!?,;:"))
                run.clear()
            link_chars = 0

        def close(name: str) -> None:
            nonlocal links, hidden, foreign
            if not opened[name]:
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    break
            else:
                return
            if not all(e[2] for e in stack[k:]):
                flush()
            for e in stack[k:]:
                hidden -= e[3]
                links -= e[4]
                foreign -= e[5]
                opened[e[0]] -= 1
            for places in (turns, heads):
                while places and places[-1] >= k:
                    places.pop()
            del stack[k:]

        at = 0
        while True:
            m = TAG_RX.search(source, at)
            piece = source[at:m.start()] if m else source[at:]
            if hidden and stack[-1][0] == "head" and piece.strip(" \t\n\r\f"):
                close("head")
            if piece and not hidden:
                plain = html.unescape(piece)
                run.append(plain)
                if links:
                    link_chars += len(plain.strip())
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                close(name)
                continue
            attrs = m[3] if m[2] else m[6]
            if hidden and name not in IN_HEAD:
                above = stack[heads[-1]][0] if heads else ""
                if above == "noscript" and ends < at:
                    found = NOSCRIPT_END.search(source, at)
                    ends = found.start() if found else len(source) + 1
                if above == "head" or (above == "noscript" and ends > len(source)):
                    close("head")          # that was left open
            inner = ""
            while foreign:                 # the innermost drawing or formula, or the html inside of it
                inner = stack[turns[-1]][0]
                if inner not in FOREIGN or name not in BREAKS:
                    break
                close(inner)
                inner = ""
            if name in FOREIGN or inner in FOREIGN:
                if name == "svg":
                    run.append(" ")
                if not attrs.rstrip().endswith("/") or VALUE_SLASH_RX.search(attrs):
                    push((name, stack[-1][1], True, name in UNSEEN, False, name in FOREIGN))
                    hidden += name in UNSEEN
                    foreign += name in FOREIGN
                continue
            if name in RAW:                # its content is no markup
                end = RAW[name].search(source, at)
                at = end.end() if end else len(source)
                if name not in ("title",):
                    flush()
                continue
            if name in CLOSES_P and not foreign and opened["p"]:
                close("p")
            elif name in ("li", "tr", "td", "th", "dt", "dd", "option"):
                same = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(name, (name,))
                edge = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}.get(name, ("table",))
                for t, *_ in reversed(stack) if any(opened[t] for t in same) else ():
                    if t in edge:
                        break
                    if t in same:
                        close(t)
                        break
            if name == "body":             # ends a head that was left open
                close("head")
            node = stack[-1][1]
            if name in VOID:
                if name in ("br", "hr"):
                    flush()
                self.tags[node] += 1
                continue
            if name in INLINE:
                self.tags[node] += 1
            else:
                flush()
                tokens = [t.lower() for a in ATTR_RX.findall(attrs) for v in a[1:] for t in TOKEN_RX.findall(v)] if attrs else []
                node = self._node(node, GROUPS.get(name, 4), sum(t in AGAINST for t in tokens), sum(t in FOR for t in tokens))
                self.tags[node] = 1
            if not attrs.endswith("/") or name in INLINE:
                push((name, node, name in INLINE, name in NEVER, name == "a", False))
                links += name == "a"
                hidden += name in NEVER
        flush()

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent = self.parent
        own, linked, marks, tags = (list(x) for x in (self.own, self.linked, self.marks, self.tags))
        blocks = [int(t is not None) for t in self.text]
        kids = [0] * n
        index = [0] * n
        for i in range(1, n):
            index[i] = kids[parent[i]]
            kids[parent[i]] += 1
        longest = list(own)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            own[p] += own[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            tags[p] += tags[i]
            blocks[p] += blocks[i]
            longest[p] = max(longest[p], longest[i])
        above_against, above_for, kinds_above = [0] * n, [0] * n, [0] * n
        before = [0] * n
        seen = 0
        for i in range(n):
            if i:
                p = parent[i]
                above_against[i] = above_against[p] + self.against[p]
                above_for[i] = above_for[p] + self.fore[p] + (self.group[p] == 5)
                kinds_above[i] = kinds_above[p] | (1 << self.group[p])
            before[i] = seen
            seen += self.own[i]
        a = np.array([parent, self.group, self.depth, self.against, self.fore, own, linked, marks, tags, blocks, kids, index, longest,
                      above_against, above_for, kinds_above, before], dtype=np.float64)
        par = np.maximum(a[0].astype(int), 0)
        chars, total = a[5], max(seen, 1)
        up = a[15].astype(np.int64)
        cols = [a[2], np.log1p(chars), chars / total, a[6] / np.maximum(chars, 1), a[7] / np.maximum(chars, 1), chars / (a[8] + 1), a[9],
                chars / np.maximum(a[9], 1), a[10], a[11], a[11] / np.maximum(a[10][par], 1), np.log1p(a[12]), a[3], a[4], a[13], a[14],
                a[16] / total, (a[16] + chars) / total, np.log1p(chars[par]), chars / np.maximum(chars[par], 1), a[6][par] / np.maximum(chars[par], 1),
                a[3][par], a[4][par], a[1][par], (up >> 6) & 1, (up >> 7) & 1, (up >> 8) & 1, (up >> 9) & 1, (up >> 10) & 1, (up >> 5) & 1]
        cols += [a[1] == g for g in range(N_GROUPS)]
        return np.stack(cols, axis=1).astype(np.float64)

    def decode(self, odds: np.ndarray) -> str:
        """The text of the kept blocks under the likeliest labelling without contradictions."""
        n = len(self.parent)
        score = odds.tolist()
        keep = list(score)                 # best gain of keeping a node over dropping all below it
        for i in range(n - 1, 0, -1):
            if keep[i] > 0:
                keep[self.parent[i]] += keep[i]
        kept = [True] * n
        out = []
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and keep[i] > 0
            if kept[i] and self.text[i] is not None:
                out.append(self.text[i])
        return " ".join(out)

    def label(self, good: set[str]) -> np.ndarray:
        """1 for blocks whose text is main text and for what holds them."""
        n = len(self.parent)
        y = [float(t is not None and t in good) for t in self.text]
        for i in range(n - 1, 0, -1):
            y[self.parent[i]] = max(y[self.parent[i]], y[i])
        return np.array(y)


def marked_blocks(page: Page) -> tuple[list[str], list[str]]:
    """Blocks inside and outside of the page's article, as its own tags mark it."""
    inside = [False] * len(page.parent)
    good, other = [], []
    for i in range(1, len(page.parent)):
        g = page.group[i]
        inside[i] = (inside[page.parent[i]] or g == 5) and g not in (6, 8, 9, 10) and not page.against[i]
        if page.text[i] is not None:
            (good if inside[i] else other).append(page.text[i])
    return good, other


def rewritten(good: list[str], other: list[str], foreign: list[str], rng: random.Random, plain: bool) -> str:
    """A page with the same main text in another template; ``plain`` leaves class names out or makes
    them up, so that structure has to tell."""
    esc = html.escape
    noise = lambda: f' class="c{rng.randrange(10 ** 6):x}"' if rng.random() < 0.5 else ""

    def name(*words: str) -> str:
        if plain:
            return noise()
        word = rng.choice(words)
        return rng.choice([f' class="{word}"', f' id="{word}"', f' class="site-{word} {word}-inner"', f" class='{word}'"])

    words = " ".join(other + foreign).split() or ["x"]

    def some(k: int) -> str:
        a = rng.randrange(len(words))
        return esc(" ".join((words[a:] + words)[:k]))

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{some(rng.randint(1, 4))}</a></{tag}>' for i in range(k))

    def box(tag: str, attrs: str, inner: str) -> str:
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def comment() -> str:
        said = "".join(box(rng.choice(["p", "div"]), noise(), some(rng.randint(4, 60))) for _ in range(rng.randint(1, 2)))
        return box(rng.choice(["div", "li", "article", "section"]), name("comment", "reply"), box("div", noise(), some(2)) + said)

    semantic = not plain or rng.random() < 0.5
    tag = lambda t: t if semantic and rng.random() < 0.5 else "div"
    top = [box(tag("header"), name("header", "masthead", "banner"), box("div", noise(), some(3)) + some(rng.randint(2, 12))),
           box(tag("nav"), name("menu", "nav", "navbar"), box("ul", "", links(rng.randint(3, 12)))),
           box("div", name("cookie-notice", "notice", "notification"), box("p", "", some(rng.randint(8, 30))) + "<button>ok</button>"),
           box("div", name("ad", "advert", "sponsored", "promo"), some(rng.randint(4, 25))),
           box("div", name("breadcrumbs"), links(3, "span"))]
    side = box(tag("aside"), name("sidebar", "widget", "related"), box("h3", "", some(2)) + box("ul", "", links(rng.randint(3, 8))) + box("p", "", some(rng.randint(3, 20))))
    end = [box(tag("section"), name("comments", "discussion", "replies"), box("h3", "", some(2)) + "".join(comment() for _ in range(rng.randint(1, 5)))),
           box("form", name("newsletter", "subscribe", "search"), f"<label>{some(3)}</label><input><button>{some(1)}</button>" + box("p", "", some(rng.randint(3, 15)))),
           box("div", name("share", "social", "related"), links(rng.randint(2, 6), rng.choice(["span", "li", "p"]))),
           box(tag("footer"), name("footer", "copyright"), rng.choice(["&copy; ", ""]) + some(rng.randint(3, 25)) + box("p", "", some(rng.randint(2, 20))))]
    para = rng.choice(["p", "p", "p", "div", "section"])
    body = []
    for k, text in enumerate(good):
        if k == 0 and len(text) < 120:
            body.append(box(rng.choice(["h1", "h1", "h2"]), noise(), esc(text)))
        else:
            body.append(box(rng.choice(["h2", "h3"]) if len(text) < 60 and rng.random() < 0.6 else para, noise(), esc(text)))
        if rng.random() < 0.08:
            body.append(box(rng.choice(["div", "aside"]), name("ad", "advert", "promo", "related"), some(rng.randint(4, 25)) if rng.random() < 0.5 else links(2, "p")))
    main = box(rng.choice(["article", "main", "div", "div"]) if semantic else "div", name("content", "article", "post", "entry", "main", "story"), "".join(body))
    if rng.random() < 0.4:
        main = box("div", noise(), main)
    wrap = [main, side] if rng.random() < 0.7 else [side, main]
    pick = lambda parts: "".join(x for x in parts if rng.random() < 0.6)
    if rng.random() < 0.2:
        middle = "<table><tr>" + "".join(box("td", noise(), x) for x in wrap) + "</tr></table>"
    else:
        middle = "".join(wrap) if rng.random() < 0.7 else main
    return f"<html><head><title>{some(4)}</title><style>p{{}}</style></head><body>{pick(top)}{middle}{pick(end)}<script>var a='<p>x</p>'</script></body></html>"


def varied(good: list[str], rng: random.Random) -> list[str]:
    """The same main text with a heading of another length, subheadings and short paragraphs."""
    out = []
    for k, text in enumerate(good):
        words = text.split()
        if k == 0 and len(text) < 120:
            words = words[:rng.randint(1, 10)]
        elif rng.random() < 0.15 and len(words) > 12:
            out.append(" ".join(words[:rng.randint(1, 6)]))
            words = words[rng.randint(6, 9):]
        elif rng.random() < 0.1:
            words = words[:rng.randint(2, 15)]
        out.append(" ".join(words))
    return out


def fit(pages: list[str], seed: int = SEED) -> BoostedTrees | None:
    """Boosted trees on the sample's pages and their rewritten forms; None without any page text."""
    rng = random.Random(seed)
    parsed = [Page(p) for p in pages]
    split = [marked_blocks(p) for p in parsed]
    if not any(sum(map(len, good)) >= 100 for good, _ in split):
        split = [([t for t in p.text if t and len(t) >= 80], [t for t in p.text if t and len(t) < 80]) for p in parsed]
    x, y = [], []
    for k, (page, (good, other)) in enumerate(zip(parsed, split)):
        if not good:
            continue
        foreign = split[rng.randrange(len(split))][0][:3]
        forms = [(page, good)]
        for plain in (False, False, True):
            own = varied(good, rng)
            forms.append((Page(rewritten(own, other, foreign, rng, plain)), own))
        if len(good) > 6:                  # a short article too
            own = varied(good[:rng.randint(1, 4)], rng)
            forms.append((Page(rewritten(own, other, foreign, rng, rng.random() < 0.3)), own))
        own = good[:rng.randint(1, 3)]     # and a page that is nothing but its text
        bare = html.escape(own[0]) if rng.random() < 0.5 else "".join(f"<p>{html.escape(t)}" for t in own)
        forms.append((Page(bare), own))
        for form, own in forms:
            x.append(form.features())
            y.append(form.label(set(own) - set(other)))
    if not x:
        return None
    return BoostedTrees().fit(np.concatenate(x), np.concatenate(y))


def sample_pages(pages: DataFrame, id_col: str, html_col: str, limit: int = SAMPLE_PAGES, most: int = SAMPLE_BYTES, seed: int = SEED) -> list[str]:
    """At most ``limit`` pages of at most ``most`` bytes, drawn by hash of id and html."""
    fit_for = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    fit_for = fit_for.where(F.octet_length("html").between(1, most))
    return [r["html"] for r in drawn(fit_for, F.xxhash64(F.lit(seed), F.col("id"), F.col("html")), limit)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seed: int = SEED) -> DataFrame:
    """id, url, text, n_chars of every page."""
    model = fit(sample_pages(pages, id_col, html_col, seed=seed), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 2 << 20):
                found = [Page(s) for s in part.column("html").to_pylist()]
                sizes = [len(p.parent) for p in found]
                x = np.concatenate([p.features() for p in found])
                odds = model.log_odds(x) if model else np.ones(len(x))
                texts = [p.decode(o) for p, o in zip(found, np.split(odds, np.cumsum(sizes)[:-1]))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = narrow.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
