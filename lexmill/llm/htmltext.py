"""Main text of HTML pages: content marginals of DOM nodes by sum-product over the tree, trained from labelled pages."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ship, table
from lexmill.llm.htmlpages import labelled_pages

#: Elements whose text is never shown as text.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "audio", "video", "annotation", "annotation-xml"}
#: What may stand in a head: anything else closes one that is still open, as does text.
HEADED = {"head", "html", "base", "link", "meta", "title", "style", "script", "noscript", "template"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "acronym"}
#: Formulas are read as the text of their leaves.
INLINE |= {"math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "menclose", "merror"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What an opening tag closes when it is open above, up to the nearest of its bounds.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TAIL = re.compile(r"<[a-zA-Z/!?][^<>]*$")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
ROOT, TEXT = "#root", "#text"


class Tree(HTMLParser):
    """Block elements and runs of text, parents before children. Inline elements melt into their block.

    labelled: data-content is the label of an element and what it holds, as in the pages that a model is trained from. On any other
    page the attribute is the page's own and means nothing."""

    def __init__(self, labelled: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.labelled = labelled
        self.tags, self.names, self.parents, self.texts = [ROOT], [()], [-1], [""]
        self.labels: list[int] = [0]
        self.linked = [0]
        self.open: list[tuple[str, int, bool]] = [(ROOT, 0, False)]  # tag, block, and whether it hides what it holds
        self.count: Counter = Counter()  # of the open tags, so that no search goes through them all in vain
        self.hidden, self.links, self.run, self.run_linked = 0, 0, [], 0

    def read(self, html: str) -> Tree:
        self.feed(_TAIL.sub("", html))
        self.close()
        self.flush()
        return self

    def node(self, tag: str, names: tuple, text: str, label: int, linked: int = 0) -> int:
        for column, x in ((self.tags, tag), (self.names, names), (self.parents, self.open[-1][1]), (self.texts, text), (self.labels, label), (self.linked, linked)):
            column.append(x)
        return len(self.tags) - 1

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.node(TEXT, (), text, self.labels[self.open[-1][1]], self.run_linked)
            self.run, self.run_linked = [], 0

    def pop(self, at: int) -> None:
        self.flush()
        for tag, _, hides in self.open[at:]:
            self.count[tag] -= 1
            self.hidden -= hides
            self.links -= tag == "a"
        del self.open[at:]

    def close_head(self) -> None:
        """End a head that is open, with what is open in it, but for templates."""
        at = next((k for k, (tag, *_) in enumerate(self.open) if tag == "head"), 0) if self.count["head"] else 0
        if at and all(tag != "template" for tag, *_ in self.open[at:]):
            self.pop(at)

    def handle_starttag(self, tag, attrs):
        if tag == "body" or self.open[-1][0] == "head" and tag not in HEADED:
            self.close_head()
        if tag == "br":
            self.run.append(" ")
        if tag in VOID or tag in ("html", "body"):
            return
        hides = tag in HIDDEN or any(name == "hidden" for name, _ in attrs)
        if tag in INLINE:
            self.links += tag == "a"
            self.count[tag] += 1
            self.hidden += hides
            self.open.append((tag, self.open[-1][1], hides))
            return
        if tag == "object" and not self.hidden and not dict(attrs).get("data"):
            return  # nothing to load: its content is shown
        closes, bounds = _CLOSES.get(tag, (("p",) if tag not in HIDDEN else (), ("button", "td", "th", "table")))
        for k in range(len(self.open) - 1 if any(self.count[x] for x in closes) else 0, 0, -1):
            if self.open[k][0] in closes:
                self.pop(k)
                break
            if self.open[k][0] in bounds:
                break
        self.flush()
        if hides:
            self.hidden += 1
            self.count[tag] += 1
            self.open.append((tag, self.open[-1][1], True))
            return
        own = dict(attrs)
        names = tuple({w.lower() for key in ("class", "id", "role", "aria-label", "itemprop") for w in _NAME.findall(own.get(key) or "")})
        label = int(own["data-content"]) if self.labelled and "data-content" in own else self.labels[self.open[-1][1]]
        self.count[tag] += 1
        self.open.append((tag, self.node(tag, names, "", label), False))

    def handle_endtag(self, tag):
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag in INLINE:  # what it wraps goes on
                    self.links -= tag == "a"
                    self.count[tag] -= 1
                    self.hidden -= self.open[k][2]
                    del self.open[k]
                else:
                    self.pop(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return

    def handle_data(self, data):
        if self.open[-1][0] == "head" and data.strip():
            self.close_head()
        if not self.hidden:
            self.run.append(data)
            self.run_linked += len(data) if self.links else 0


def features(tree: Tree, i: int) -> list[str]:
    """What is seen of a node besides its tag: its names, or a text's length, links and marks."""
    if tree.tags[i] == TEXT:
        text = tree.texts[i]
        n = len(text)
        length = "0" if n < 25 else "1" if n < 80 else "2" if n < 250 else "3"
        links = tree.linked[i] / max(n, 1)
        return [f"length {length}", f"links {0 if links < 0.2 else 1 if links < 0.7 else 2}", f"ends {text[-1] in '.!?;:…»”'}"]
    return [f"name {w}" for w in tree.names[i]]


#: Where no text reaches a half but the best one this, what comes close to the best is taken.
DOUBT = 0.2
#: States of a node: no content, content, and neither itself but with content below.
OTHER, CONTENT, WRAPPER = STATES = (0, 1, 2)


def states(tree: Tree) -> list[int]:
    """The states of a labelled page's nodes."""
    out = list(tree.labels)
    out[0] = WRAPPER
    for i in range(len(out) - 1, 0, -1):
        if out[i] != OTHER and out[tree.parents[i]] == OTHER:
            out[tree.parents[i]] = WRAPPER
    return out


class Model:
    """Potentials: likelihoods of features by state, and of a child's state by its tag and its parent's state."""

    def __init__(self, pages: list[str], smooth: float = 0.5):
        seen, total = [Counter() for _ in STATES], [Counter() for _ in STATES]
        pair: Counter = Counter()
        for page in pages:
            tree = Tree(labelled=True).read(page)
            of = states(tree)
            for i in range(1, len(of)):
                for f in features(tree, i):
                    seen[of[i]][f] += 1
                    total[of[i]][f.split()[0]] += 1
                pair[tree.tags[i], of[tree.parents[i]], of[i]] += 1
        known = set().union(*seen)
        kinds = Counter(f.split()[0] for f in known)
        self.unary = {}
        for f in known:
            k = f.split()[0]
            own = [(seen[y][f] + smooth) / (total[y][k] + smooth * (kinds[k] + 1)) for y in STATES]
            self.unary[f] = tuple(x / sum(own) for x in own)
        for y in (OTHER, CONTENT):  # a wrapper's own text: as likely content as not
            pair[TEXT, WRAPPER, y] += 50
        rows = [[sum(n for (tag, q, z), n in pair.items() if tag != TEXT and (q, z) == (p, y)) + smooth for y in STATES] for p in STATES]
        self.any = [[x / sum(r) for x in r] for r in rows]
        self.pair = {}
        for tag in {t for t, _, _ in pair}:  # few sightings of a tag leave it near what holds for any element
            rows = [[pair[tag, p, y] + 2 * self.any[p][y] * (tag != TEXT) + 1e-3 for y in STATES] for p in STATES]
            self.pair[tag] = [[x / sum(r) for x in r] for r in rows]

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of each node; the root is a wrapper. Messages go up from the leaves, then down from the root."""
        n, tags, parents, unary = len(tree.tags), tree.tags, tree.parents, self.unary
        belief = [[1.0, 1.0, 1.0] for _ in range(n)]  # unary terms and the messages of the children, scaled
        up = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            b = belief[i]
            for f in features(tree, i):
                u = unary.get(f)
                if u is not None:
                    b[0] *= u[0]
                    b[1] *= u[1]
                    b[2] *= u[2]
            _scale(b)
            x, y, z = b
            up[i] = m = tuple([r[0] * x + r[1] * y + r[2] * z for r in self.pair.get(tags[i], self.any)])
            p = belief[parents[i]]
            p[0] *= m[0]
            p[1] *= m[1]
            p[2] *= m[2]
            _scale(p)
        out = [0.0] * n
        down = [(0.0, 0.0, 1.0)] * n
        for i in range(1, n):
            p, m, t = parents[i], up[i], self.pair.get(tags[i], self.any)
            q, d = belief[p], down[p]
            # the parent's belief without what this child told it
            a, b, c = d[0] * q[0] / m[0], d[1] * q[1] / m[1], d[2] * q[2] / m[2]
            s = a + b + c or 1.0
            own = tuple([(a * t[0][y] + b * t[1][y] + c * t[2][y]) / s for y in STATES])
            down[i] = own
            x, y, z = own[0] * belief[i][0], own[1] * belief[i][1], own[2] * belief[i][2]
            out[i] = y / (x + y + z or 1.0)
        return out

    def text(self, html: str) -> str:
        tree = Tree().read(html)
        if set(tree.tags[1:]) <= {TEXT}:
            return " ".join(tree.texts[1:])  # no element at all: plain text
        p = self.marginals(tree)
        most = max((x for tag, x in zip(tree.tags, p, strict=True) if tag == TEXT), default=0.0)
        cut = 0.5 if most > 0.5 or most < DOUBT else 0.8 * most  # a page in doubt keeps its likeliest texts
        return " ".join(t for t, tag, x in zip(tree.texts, tree.tags, p, strict=True) if tag == TEXT and x > cut)


def _scale(b: list[float]) -> None:
    """Keep a belief's entries over a floor, so that no later quotient is empty."""
    s = b[0] + b[1] + b[2]
    b[0], b[1], b[2] = max(b[0] / s, 1e-60), max(b[1] / s, 1e-60), max(b[2] / s, 1e-60)


@functools.lru_cache(maxsize=1)
def model() -> Model:
    return Model(labelled_pages())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text), one row for each row of pages: the text of the nodes whose marginal is over a half
    (or, where none is, close to the page's best, if that is over DOUBT).

    Character references are decoded, white space in a block becomes one space, and blocks are joined by one space
    in page order. Null, empty and textless pages give an empty text; broken markup is read as browsers would,
    roughly; pages of any length are read whole, one at a time. Repeated rows stay and null ids pass through; other
    columns are not read. The labelled pages are part of the package and the model is fitted in each task."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for pdf in batches:
            pdf["text"] = [m.text(h) if isinstance(h, str) and h else "" for h in pdf["html"]]
            yield pdf.drop(columns=["html"])

    inner = pages.select(F.col(id_col).alias("id"), *keep, F.col(html_col).alias("html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields if f.name != "html")
    return inner.mapInPandas(run, f"{kinds}, text string").withColumnRenamed("id", id_col)


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
