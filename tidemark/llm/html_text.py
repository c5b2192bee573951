"""Operator 8: main text of HTML pages by gradient-boosted trees over DOM-node features."""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf

from .common import bounded, read


#: Fixed values of HTML: elements without content, with raw content, that start a block, and that end an open p.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg select option".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SIGNS = {
    "bad": set("ad ads advert advertisement banner sponsor sponsored promo nav navbar menu breadcrumb breadcrumbs header masthead footer sidebar aside related share social cookie cookies notice popup modal subscribe newsletter comment comments reply replies widget toolbar pagination pager login search form consent legal copyright tags disclaimer alert overlay".split()),
    "good": set("article content main story entry post body text page articlebody".split()),
}
TAGS = "article aside body button div footer form header h1 h2 h3 li main nav ol p section span table ul".split()
CONTROLS = {"button", "label", "input", "output"}
OUTER = {"nav", "footer", "aside", "form"}
ABOVE = frozenset(SIGNS["bad"] | OUTER | {"article", "main"})
SPACES = re.compile(r"\s+")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    parent: "Node | None" = None
    kids: list = field(default_factory=list)
    depth: int = 0


class Dom(HTMLParser):
    """A lenient tree: p, li and table cells end where the next one starts; unknown end tags are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.open: Counter = Counter()

    def close(self):
        super().close()
        return self.root

    def parse_marked_section(self, i, report=1):
        """<![...> of any kind ends at the next >, as browsers have it; without one the rest is passed over."""
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_to("p", stop={"table", "td", "th", "button"})
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.end_to(tag, stop={"ul", "ol", "dl", "table", "select"} | ({"tr"} if tag in ("td", "th") else set()))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, depth=self.at.depth + 1)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def end_to(self, tag, stop=frozenset()):
        if not self.open[tag]:
            return
        n, closed = self.at, []
        while n.parent and n.tag != tag:
            if n.tag in stop:
                return
            closed.append(n.tag)
            n = n.parent
        if n.parent:
            self.open.subtract([*closed, tag])
            self.at = n.parent

    def handle_endtag(self, tag):
        self.end_to(tag)

    def handle_data(self, data):
        if self.at.tag not in RAW:
            self.at.kids.append(data)


def parse(html: str) -> Node:
    dom = Dom()
    dom.feed(html or "")
    return dom.close()


def attribute_tokens(n: Node) -> set[str]:
    return set(re.split(r"[^a-z]+", " ".join(n.attrs.get(k, "") for k in ("class", "id", "role", "itemprop")).lower())) - {""}


def described(root: Node) -> tuple[list[Node], np.ndarray]:
    """The block nodes in page order and their features, from totals of each subtree (two passes, no recursion)."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
    sums = {}
    for n in reversed(order):
        own = "".join(k for k in n.kids if isinstance(k, str))
        t = np.array([len(own), own.count(" "), sum(own.count(c) for c in ".,;!?"), len(own) if n.tag == "a" else 0, n.tag == "a", n.tag == "p", 1, n.tag in ("input", "button", "form")], float)
        for k in n.kids:
            if isinstance(k, Node):
                s = sums[id(k)]
                t += s
                if n.tag == "a":
                    t[3] += s[0] - s[3]
        sums[id(n)] = t
    whole = max(1.0, sums[id(root)][0])
    nodes, rows = [], []
    # signs of the nodes above, and how many children of each tag a node has: carried down, each looked at once
    above, kinds = {id(root): frozenset()}, {}
    for n in order:
        kinds[id(n)] = Counter(k.tag for k in n.kids if isinstance(k, Node))
        signs = attribute_tokens(n)
        own = (signs | {n.tag}) & ABOVE
        over = above[id(n.parent)] if n.parent else frozenset()
        above[id(n)] = over if own <= over else over | own
        if not scored(n, signs):
            continue
        t, up = sums[id(n)], sums[id(n.parent)] if n.parent else sums[id(n)]
        same = kinds[id(n.parent)][n.tag] if n.parent else 1
        nodes.append(n)
        rows.append(
            [np.log1p(t[0]), t[0] / whole, t[0] / max(1, up[0]), t[3] / max(1, t[0]), t[2] / max(1, t[1] + 1), t[0] / t[6], t[5] / t[6], t[4] / t[6], t[7], n.depth, np.log1p(same), len(signs & SIGNS["bad"]), len(signs & SIGNS["good"]), len(over & (SIGNS["bad"] | OUTER)), len(over & {"article", "main"}), n.tag not in BLOCK, *[n.tag == x for x in TAGS]]
        )
    return nodes, np.array(rows, float).reshape(len(rows), 16 + len(TAGS))


def scored(n: Node, signs: set[str]) -> bool:
    """Every block, and within lines what is a control or carries a sign of being none of the text."""
    return n.tag in BLOCK and n.tag != "html" or n.tag in CONTROLS or bool(signs & SIGNS["bad"])


class Boosted:
    """Gradient-boosted trees of logistic loss on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[list] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        z = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree: list = []
            self.grow(tree, x, y - p, p * (1 - p), np.arange(len(y)), 0)
            self.trees.append(tree)
            z += self.rate * self.apply(tree, x)
        return self

    def grow(self, tree: list, x, g, h, who, depth) -> int:
        me = len(tree)
        total_g, total_h = g[who].sum(), h[who].sum()
        tree.append(total_g / (total_h + 1.0))
        best = (1e-6, None, None)
        if depth < self.depth and len(who) >= 8:
            for f, edges in enumerate(self.edges):
                c = x[who, f]
                for e in edges:
                    left = c <= e
                    gl, hl = g[who][left].sum(), h[who][left].sum()
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    if 0 < left.sum() < len(who) and gain > best[0]:
                        best = (gain, f, e)
        if best[1] is not None:
            left = x[who, best[1]] <= best[2]
            a = self.grow(tree, x, g, h, who[left], depth + 1)
            b = self.grow(tree, x, g, h, who[~left], depth + 1)
            tree[me] = (best[1], best[2], a, b)
        return me

    def apply(self, tree: list, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x)), [(0, np.arange(len(x)))]
        while todo:
            n, who = todo.pop()
            if not isinstance(tree[n], tuple):
                out[who] = tree[n]
            elif len(who):
                f, e, a, b = tree[n]
                left = x[who, f] <= e
                todo += [(a, who[left]), (b, who[~left])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum(self.apply(t, x) for t in self.trees) if len(x) else np.zeros(0)


def lesson(rng: random.Random) -> str:
    """A labelled page, made by rule: main blocks carry data-main=1, all others 0."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(1, 10)))
    say = lambda n: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    b = lambda tag, inner, main, attr="": f'<{tag} data-main="{main}"{attr}>{inner}</{tag}>'
    items = lambda n, main: "".join(b("li", f'<a href="/x">{word()}</a>' if not main else say(rng.randint(3, 20)), main) for _ in range(n))
    sign = lambda: rng.choice([f' class="{rng.choice(sorted(SIGNS["bad"]))}"', f' id="{rng.choice(sorted(SIGNS["bad"]))}"', f' class="box {rng.choice(sorted(SIGNS["bad"]))}"'])
    extra = [
        lambda: b("nav", b("ul", items(rng.randint(2, 9), 0), 0), 0),
        lambda: b("div", b("ul", items(rng.randint(2, 9), 0), 0), 0, sign()),
        lambda: b("div", say(rng.randint(3, 40)), 0, sign()),
        lambda: b("aside", b("h3", say(2), 0) + b("p", say(rng.randint(2, 40)), 0), 0),
        lambda: b("header", b("h1", say(rng.randint(1, 5)), 0) if rng.random() < 0.2 else say(3), 0),
        lambda: b("form", say(4) + "<input><button>go</button>", 0),
        lambda: b("section", "".join(b("div", b("p", say(rng.randint(3, 40)), 0), 0, ' class="comment"') for _ in range(rng.randint(1, 4))), 0, ' class="comments"'),
        lambda: b("span", say(rng.randint(1, 12)), 0, sign()),
        lambda: b("button", say(rng.randint(1, 3)), 0) + (b("label", say(2), 0) if rng.random() < 0.5 else ""),
        lambda: b("footer", "&copy; " + say(rng.randint(2, 40)), 0),
    ]
    parts = []
    tiny = rng.random() < 0.3
    if tiny:
        # a few words in all
        parts = [b("p", say(rng.randint(1, 5)), 1) for _ in range(rng.randint(0, 3))]
    for _ in range(0 if tiny else rng.randint(0, rng.choice([2, 30, 30]))):
        parts.append(rng.choice([lambda: b("p", say(rng.choice([1, 1, 3, 20, 60, 150])), 1)] * 5 + [lambda: b("h2", say(rng.randint(1, 6)), 1), lambda: b("ul", items(3, 1), 1), lambda: b("blockquote", b("p", say(20), 1), 1), lambda: b("table", b("tr", b("td", say(3), 1), 1), 1), lambda: b("div", b("p", say(30), 1), 1), lambda: rng.choice(extra[1:3])()])())
    tag, attr = rng.choice([("article", "")] * 3 + [("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="post entry"'), ("section", ' class="article-body"')])
    for _ in range(rng.choice([0, 0, 1, 2])):
        # controls and adverts within lines of the text, or between its blocks
        odd = rng.choice([b("span", say(rng.randint(1, 8)), 0, sign()), b("button", say(rng.randint(1, 3)), 0), b("label", say(2), 0), b("a", say(2), 0, sign())])
        parts.insert(rng.randint(0, len(parts)), rng.choice([odd, b("p", say(rng.choice([5, 30])) + " " + odd + " " + say(9), 1)]))
    body = b(tag, b("h1", say(rng.choice([1, 2, 4, 8, 12])), 1) + "".join(parts), 1, attr)
    before, after = [rng.choice(extra[:6])() for _ in range(rng.randint(0, 3))], [rng.choice(extra)() for _ in range(rng.randint(0, 3))]
    inner = "".join(before) + body + "".join(after)
    # pages differ in what stands around the whole
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        inner = b("div", inner, 1)
    whole = f'<body data-main="1">{inner}</body>'
    return whole if rng.random() < 0.3 else f"<html><head><title>{say(3)}</title></head>{whole}</html>"


@lru_cache(1)
def model(pages: int = 250, seed: int = 8) -> Boosted:
    """Fitted on pages made by rule, since the tables hold no labels; the same on every worker."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes, x = described(parse(lesson(rng)))
        xs.append(x)
        ys += [n.attrs.get("data-main") == "1" for n in nodes]
    return Boosted(rounds=20, depth=5, rate=0.5, bins=8).fit(np.vstack(xs), np.array(ys, float))


def main_text(html: str | None, trees: Boosted | None = None) -> str:
    """Blocks of the main text joined by a line end; null, empty or textless pages give an empty string.

    Hierarchical decoding: from the root down, a block is kept only if every block above it is kept.
    """
    root = parse(html or "")
    nodes, x = described(root)
    keep = {id(n): s > 0 for n, s in zip(nodes, (trees or model()).score(x))}
    for n in nodes:
        if n.tag == "body":
            keep[id(n)] = True
    blocks, line = [], []

    def end():
        if text := SPACES.sub(" ", "".join(line)).strip():
            blocks.append(text)
        line.clear()

    stack: list = [root]
    while stack:
        n = stack.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            line.append(n)
        elif n.tag not in RAW and n.tag != "head" and keep.get(id(n), True):
            if n.tag == "br":
                line.append(" ")
            if n.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(n.kids)
    end()
    return "\n".join(blocks)


def extract(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """Adds the main text of each page."""
    bounded(pages.sparkSession)
    trees = model()

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x, trees) for x in column.to_pylist()], pa.string())

    return pages.withColumn(to, run(pages[html]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
