"""Main text of web pages by a tree-structured graphical model.

Every node of a page's element tree has one of three states: M, a frame that
holds the article and other things; C, the article; B, anything else. A node's
features (element, words of class and id, amount of text, share of linked text
in its block, sentence marks, form parts) give its own potential, and a parent
and a child are joined by a potential too. Sum-product messages go up the tree once and
down once and give each node's exact marginals; a piece of text is kept if its
most likely state is C.

The potentials are counts over labelled pages. The given table has no labels,
so the pages are written by ``labelled_page``: a seeded writer of layouts in
common use, which marks each element with its state. Nearly half of its
classes and ids are none or say nothing, and one article in five has no element
of its own, so that the model doesn't live by names. Training takes
``TRAIN_PAGES`` of them, on the driver, whatever the size of the input, and the
model that goes to the tasks has a few hundred numbers.

Defined results: a null or empty page, or one without an article, gives the
empty text; cut-off pages are read as far as they go; a piece of text whose
likeliest states tie is left out; a page of any length is read whole, in memory
for its tree; repeated rows give equal rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from millrace.llm.arrow import map_batches
from millrace.llm.dom import INLINE, Tree, parse

STATES = "MCB"
TRAIN_PAGES = 1000
SEED = 3
#: Words of class, id and role that say what an element is.
WORDS = {
    "body": "article content main post entry story text body copy prose maincontent articlebody",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs crumbs tabs pagination pager toc skip links",
    "head": "header masthead banner logo brand topbar top hero",
    "foot": "footer foot copyright legal bottom colophon contentinfo",
    "side": "sidebar side aside rail widget complementary related recommended teaser more popular trending",
    "ad": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion outbrain taboola",
    "note": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe subscription paywall warning message",
    "talk": "comment comments reply replies respond response responses disqus discussion thread guestbook feedback reviews",
    "form": "form login signup search register",
    "share": "share sharing social follow meta byline tags tag author date",
}
GROUP = {w: g for g, ws in WORDS.items() for w in ws.split()}
TAGS = frozenset("html head body div section article main nav header footer aside form ul ol li p h1 h2 h3 h4 h5 h6 a b i em strong span table tr td th blockquote pre figure figcaption dl dt dd details summary fieldset legend center font button br hr img label input title script style".split())
FRAMES = frozenset("header footer aside nav section div form article main".split())
#: Weights of evidence: features of a node repeat each other, words of class and id less than the rest.
WEIGHT = defaultdict(lambda: 0.7, {"word": 1.5})
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[.!?;,]")
FORM = frozenset("form input button label select textarea option".split())


def features(tree: Tree) -> list[list]:
    """Each node's features."""
    n = len(tree.tag)
    size, linked, marks, form = [0] * n, [0] * n, [0] * n, [False] * n
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[tree.parent[i]] or tree.tag[i] == "a"
        if tree.tag[i] is None:
            size[i] = len(tree.text[i].strip())
            linked[i] = size[i] if inside[i] else 0
            marks[i] = len(MARKS.findall(tree.text[i]))
        elif tree.tag[i] in FORM:
            form[i] = True
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        form[p] = form[p] or form[i]
    out, block = [], list(range(n))
    for i in range(n):
        if i and (tree.tag[i] is None or tree.tag[i] in INLINE):
            block[i] = block[tree.parent[i]]
        b = block[i]  # a link in a sentence is judged by its block
        share = -1 if not size[b] else min(4, linked[b] * 5 // size[b])
        dense = 0 if not size[i] else min(3, marks[i] * 40 // size[i])
        own = [("link", share)]
        if tree.tag[i] is None or tree.tag[i] in INLINE:
            own.append(("in", tree.tag[b] if tree.tag[b] in TAGS else "other"))
        if tree.tag[i] is not None:  # a piece of text goes by its element, whose amounts it has
            own += [("size", min(12, size[i].bit_length())), ("marks", dense)]
            own += [("tag", tree.tag[i] if tree.tag[i] in TAGS else "other"), ("form", form[i] and size[i] < 400)]
            if tree.tag[i] in FRAMES:
                out_tag = tree.tag[tree.parent[i]]
                own.append(("under", tree.tag[i], out_tag if out_tag in FRAMES or out_tag == "body" else "other"))
            if tree.names[i]:
                groups = {GROUP[t] for t in map(str.lower, TOKEN.findall(tree.names[i])) if t in GROUP}
                own += [("word", g) for g in groups or {"unknown"}]
        out.append(own)
    return out


class Model:
    """Log-potentials of features by state, and parent-child potentials for elements and for text."""

    def __init__(self, node: dict, edge: dict):
        self.node, self.edge = node, edge

    @classmethod
    def train(cls, pages: list[str], smooth: float = 0.5) -> Model:
        seen: dict = defaultdict(lambda: [smooth] * 3)
        states, pairs = [smooth] * 3, {False: [[smooth] * 3 for _ in range(3)], True: [[smooth] * 3 for _ in range(3)]}
        for page in pages:
            tree = parse(page)
            label = [0] * len(tree.tag)
            for i, own in enumerate(features(tree)):
                p = tree.parent[i]
                if tree.tag[i] is None:
                    label[i] = 1 if label[p] == 1 else 2
                elif i:
                    label[i] = STATES.index(tree.label[i]) if tree.label[i] else label[p]
                if tree.tag[i] is None and not tree.text[i].strip():
                    continue
                states[label[i]] += 1
                for f in own:
                    seen[f][label[i]] += 1
                if i:
                    pairs[tree.tag[i] is None][label[p]][label[i]] += 1
        node = {f: [WEIGHT[f[0]] * math.log(c / s) for c, s in zip(counts, states)] for f, counts in seen.items()}
        edge = {k: [[x / sum(row) for x in row] for row in table] for k, table in pairs.items()}
        return cls(node, edge)

    def marginals(self, tree: Tree) -> list[list[float]]:
        """Of each node, by messages up and then down."""
        n = len(tree.tag)
        belief, up = [], [None] * n
        for own in features(tree):
            logs = [0.0, 0.0, 0.0]
            for f in own:
                found = self.node.get(f)
                if found:
                    for s in range(3):
                        logs[s] += found[s]
            most = max(logs)
            belief.append([math.exp(max(-60.0, x - most)) for x in logs])
        for i in range(n - 1, 0, -1):
            a, b, c = belief[i]
            table = self.edge[tree.tag[i] is None]
            up[i] = message = [r[0] * a + r[1] * b + r[2] * c for r in table]
            p = belief[tree.parent[i]]
            x, y, z = p[0] * message[0], p[1] * message[1], p[2] * message[2]
            total = x + y + z or 1.0
            p[0], p[1], p[2] = x / total, y / total, z / total
        belief[0] = [1.0, 0.0, 0.0]
        for i in range(1, n):
            p, m, own = belief[tree.parent[i]], up[i], belief[i]
            out = [p[0] / m[0], p[1] / m[1], p[2] / m[2]]
            table = self.edge[tree.tag[i] is None]
            x, y, z = (own[s] * (table[0][s] * out[0] + table[1][s] * out[1] + table[2][s] * out[2]) for s in range(3))
            total = x + y + z or 1.0
            belief[i] = [x / total, y / total, z / total]
        return belief

    def main_text(self, page: str | None) -> str:
        """Text of the article: white space in a block to one space, blocks joined by one space."""
        if not page:
            return ""
        tree = parse(page)
        marginal = self.marginals(tree)
        out, last = [], 0
        for i in range(1, len(tree.tag)):
            if tree.tag[i] is None:
                if marginal[i][1] > max(marginal[i][0], marginal[i][2]):
                    out.append(tree.text[i])
                    if _apart(tree, last, i):
                        out[-1] = " " + out[-1]
                    last = i
            elif tree.tag[i] == "br":
                out.append(" ")
        return " ".join("".join(out).split())


def _apart(tree: Tree, a: int, b: int) -> bool:
    """Whether two pieces of text stand in different blocks."""
    up = []
    for i in (a, b):
        i = tree.parent[i] if i else 0
        while i and tree.tag[i] in INLINE:
            i = tree.parent[i]
        up.append(i)
    return up[0] != up[1] or any(tree.tag[k] is not None and tree.tag[k] not in INLINE for k in range(a + 1, b))


# --- labelled pages ---------------------------------------------------------


def labelled_page(r: random.Random) -> str:
    """A page in a common layout; data-y gives the state of each element that differs from its parent."""
    letters = "etaoinshrdlu"

    def word() -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(2, 9)))

    def sentence(lo: int = 4, hi: int = 22) -> str:
        words = [word() + ("," if r.random() < 0.1 else "") for _ in range(r.randint(lo, hi))]
        return (" ".join(words) + r.choice("....?!")).capitalize()

    def prose(lo: int = 1, hi: int = 7) -> str:
        out = " ".join(sentence() for _ in range(r.randint(lo, hi)))
        return out if r.random() < 0.8 else f"{out} <a href='/{word()}'>{word()} {word()}</a> {sentence()}" if r.random() < 0.6 else f"<b>{sentence()}</b> {out}"

    def named(words: str, extra: str = "") -> str:
        """A class or id: of the known words, of no known word, or none."""
        x = r.random()
        if x < 0.2:
            return extra
        if x < 0.45:
            w = r.choice([word(), f"{word()}-{word()}", f"{word()} {word()}", f"col-{r.randint(1, 12)}", "wrap", "outer", "inner", "block"])
        else:
            w = r.choice(words.split())
            w = r.choice([w, w, f"{w}-{r.choice(['box', 'area', 'wrapper', 'list', 'container', 'inner', word()])}", f"{word()}-{w}", f"site-{w}", f"{w} {word()}"])
        return f" {r.choice(['class', 'class', 'id'])}=\"{w}\"{extra}"

    def sometimes() -> str:
        return f" class='{r.choice([word(), 'lead', 'intro', 'title', 'first', word()])}'" if r.random() < 0.12 else ""

    def links(lo: int = 2, hi: int = 9) -> str:
        items = [f"<li><a href='/{word()}'>{' '.join(word() for _ in range(r.randint(1, 4)))}</a></li>" for _ in range(r.randint(lo, hi))]
        return f"<ul>{''.join(items)}</ul>" if r.random() < 0.7 else " ".join(x[4:-5] for x in items)

    B = ' data-y="B"'

    def block(tag_words: str, group: str, body: str) -> str:
        tag = r.choice(tag_words.split())
        own = named(WORDS[group], B) if tag in ("div", "section", "p", "span", "ul") or r.random() < 0.5 else B
        return f"<{tag}{own}>{body}</{tag}>"

    def junk(kind: str | None = None) -> str:
        kind = kind or r.choice("nav side ad ad note share form talk related".split())
        if kind == "nav":
            return block("nav nav div ul", "nav", links())
        if kind == "head":
            return block("header header div", "head", f"<a href='/'>{word()}</a> " * (r.random() < 0.5) + f"<h1>{word()} {word()}</h1>" * (r.random() < 0.6) + f"<p>{sentence(2, 8)}</p>" * (r.random() < 0.7) + links(0, 5) * (r.random() < 0.5))
        if kind == "foot":
            return block("footer footer div", "foot", f"&copy; {word()}.example {sentence(2, 9)}" + links(0, 6) * (r.random() < 0.5))
        if kind == "side":
            return block("aside aside div", "side", f"<h3>{word()}</h3>" + (links() if r.random() < 0.6 else f"<p>{prose(1, 2)}</p>"))
        if kind == "ad":
            return block("div div aside section p", "ad", r.choice([sentence(2, 12), f"<a href='/x'>{sentence(2, 9)}</a>", f"<p>{prose(1, 2)}</p>", f"<img src='x'>{sentence(2, 6)}"]))
        if kind == "note":
            return block("div div section aside p", "note", r.choice([prose(1, 2), f"<p>{prose(1, 2)}</p><button>{word()}</button>"]))
        if kind == "share":
            return block("div div ul p span", "share", r.choice([links(1, 4), sentence(1, 4)]))
        if kind == "form":
            return f"<form{named(WORDS['form'], B) if r.random() < 0.6 else B}><label>{sentence(1, 5)}</label><input name='q'>{f'<p>{sentence(2, 9)}</p>' * (r.random() < 0.4)}<button>{word()}</button></form>"
        if kind == "talk":
            inner = "div article li p section".split()
            one = lambda: (lambda t: f"<{t}{named('comment reply')}><b>{word()}</b> <p>{prose(1, 3)}</p></{t}>")(r.choice(inner))
            return block("section div ol div", "talk", f"<h3>{word()}</h3>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 5))))
        return block("section div aside", "side", f"<h2>{word()} {word()}</h2>" + "".join(f"<div><a href='/{word()}'>{sentence(2, 8)}</a> <p>{sentence()}</p></div>" for _ in range(r.randint(1, 4))))

    def part() -> str:
        x = r.random()
        if x < 0.36:
            return f"<p{sometimes()}>{prose()}</p>"
        if x < 0.41:
            return f"<p>{sentence()} <a href='/{word()}'>{word()} {word()}</a>, {sentence()}<sup><a href='#{word()}'>{r.randint(1, 9)}</a></sup></p>"
        if x < 0.48:
            tag = r.choice(["b", "b", "strong", "em", "i", "span", "font"])
            return f"<p><{tag}>{prose()}{r.choice([f'</{tag}></p>', '<br>'])}"
        if x < 0.57:
            return f"<p>{' '.join(word() for _ in range(r.choice([1, 1, 2, 5, 30])))}</p>"
        if x < 0.70:
            return f"<p>{sentence(1, 1) if x < 0.64 else sentence(1, 4)}</p>"
        if x < 0.76:
            h = r.choice(["h2", "h2", "h3"])
            return f"<{h}{sometimes()}>{sentence(1, 6)}</{h}>"
        if x < 0.83:
            tag = r.choice(["ul", "ul", "ol"])
            return f"<{tag}{sometimes()}>" + "".join(f"<li>{sentence(1, 14)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if x < 0.86:
            return f"<blockquote><p>{prose(1, 2)}</p></blockquote>"
        if x < 0.89:
            return "<table>" + "".join(f"<tr><td>{word()}</td><td>{sentence(1, 6)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if x < 0.91:
            return f"<figure><img src='x'><figcaption>{sentence(2, 9)}</figcaption></figure>"
        if x < 0.93:
            return f"<pre>{sentence()}</pre>"
        if x < 0.95:
            return f"<details><summary>{sentence(1, 6)}</summary><p>{prose(1, 3)}</p></details>"
        if x < 0.96:
            return f"<fieldset><legend>{word()}</legend><p>{prose(1, 2)}</p></fieldset>"
        if x < 0.97:
            return "<dl>" + "".join(f"<dt>{word()}</dt><dd>{sentence()}</dd>" for _ in range(r.randint(1, 4))) + "</dl>"
        return f"<div{sometimes()}>{prose()}</div>"

    title = f"<h1{sometimes()}>{sentence(1, 10)}</h1>" if r.random() < 0.85 else f"<h2{sometimes()}>{sentence(1, 8)}</h2>"
    parts = [part() for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9, 14, 25]))]
    if r.random() < 0.9:
        parts.insert(0, f"<header>{title}</header>" if r.random() < 0.05 else title)
    for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
        parts.insert(r.randint(0, len(parts)), junk(r.choice("ad ad ad note share form related side talk talk".split())))
    tag = r.choice("article article article main div div div section td bare bare".split())
    own = named(WORDS["body"]) if tag in ("div", "section", "td") and r.random() < 0.9 or r.random() < 0.3 else ""
    if tag == "bare":  # the article's blocks stand in a frame by themselves
        article = "".join(re.sub(r"^<([a-z0-9]+)", r'<\1 data-y="C"', p) if 'data-y="B"' not in p[: p.index(">")] else p for p in parts)
    else:
        article = f'<{tag} data-y="C"{own}>{"".join(parts)}</{tag}>'
    if tag not in ("bare", "td") and r.random() < 0.15:
        article = f'<div data-y="C"{named("content page main wrap")}>{article}</div>'
    before = [] if tag == "bare" and r.random() < 0.3 else [junk(k) for k in ("head", "nav", "ad", "note", "side", "form", "share") if r.random() < (0.6 if k in ("head", "nav") else 0.25)]
    after = [] if not before and tag == "bare" and r.random() < 0.6 else [junk(k) for k in ("talk", "related", "side", "ad", "note", "share", "form", "foot") if r.random() < (0.85 if k == "foot" else 0.25)]
    middle = f"{''.join(before)}{article}{''.join(after)}"
    if r.random() < 0.4:
        k = r.randint(0, len(before))
        j = r.randint(0, len(after))
        frame = r.choice("div div main section".split())
        own = named("page wrap wrapper container layout site main content columns") if r.random() < 0.8 else ""
        middle = f'{"".join(before[:k])}<{frame} data-y="M"{own}>{"".join(before[k:])}{article}{"".join(after[:j])}</{frame}>{"".join(after[j:])}'
    if tag == "td":
        middle = f"<table><tr>{middle}</tr></table>"
    head = f'<head data-y="B"><title>{sentence(2, 9)}</title><style>p{{}}</style></head>'
    return f'<!DOCTYPE html><html data-y="M">{head}<body data-y="M">{middle}</body></html>'


_trained: dict[tuple[int, int], Model] = {}


def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Model:
    """The model of ``pages`` labelled pages, made once in each process."""
    if (pages, seed) not in _trained:
        r = random.Random(seed)
        _trained[pages, seed] = Model.train([labelled_page(r) for _ in range(pages)])
    return _trained[pages, seed]


def extract_pages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batch):
        texts = [model.main_text(h) for h in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    slim = pages.selectExpr(f"cast(`{id_col}` as long) page_id", f"cast(`{url_col}` as string) url", f"`{html_col}` html")
    return map_batches(slim, run, "page_id long, url string, text string, n_chars long")


def op3_html(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), trained())
