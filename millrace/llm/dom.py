"""A page's element tree as flat lists, by the usual repair rules of HTML."""

from __future__ import annotations

import html
import re

#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements with rules of their own, in which '/>' ends an element, and those in them that hold HTML again.
FOREIGN = frozenset(["svg", "math"])
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
SCOPE = {
    "p": frozenset("button table td th caption".split()), "li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
    "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "tbody": frozenset(["table"]), "option": frozenset(),
}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

MARKUP = re.compile(r"""<(?:!--(?:(?!-->).)*(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(?:/?>|\Z))""", re.S)
NAME = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Tree:
    """parent, tag (None: text), names (class, id and role), text, label; a parent comes before its children."""

    def __init__(self):
        self.parent, self.tag, self.names, self.text, self.label = [-1], ["#root"], [""], [""], [""]

    def add(self, parent: int, tag: str | None, names: str = "", text: str = "", label: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.label.append(label)
        return len(self.tag) - 1


def _close(stack: list[tuple[int, str]], tags, scope) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][1] in tags:
            del stack[k:]
            return
        if stack[k][1] in scope:
            return


def _foreign(stack: list[tuple[int, str]]) -> int:
    """Place of the svg or math element whose rules hold, 0 if those of HTML do."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][1] in FOREIGN:
            return k
        if stack[k][1] in HOLDS_HTML:
            return 0
    return 0


def parse(page: str) -> Tree:
    """The tree of a page; markup, comments and raw elements leave no text."""
    tree, stack, at, met = Tree(), [(0, "#root")], 0, False
    find = MARKUP.search
    while True:
        m = find(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            tree.add(stack[-1][0], None, "", html.unescape(piece) if "&" in piece else piece)
        if m is None:
            return tree
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][1] not in INLINE:
                    break
            continue
        foreign = met and _foreign(stack)
        if foreign and tag in CLOSES_P:  # a block ends an svg or math that was left open
            del stack[foreign:]
            foreign = 0
        if tag in CLOSES_P:
            _close(stack, CLOSES["p"], SCOPE["p"])
        if tag in CLOSES and tag != "p":
            _close(stack, CLOSES[tag], SCOPE[tag])
        names, label = "", ""
        if m[3]:
            for key, a, b, c in NAME.findall(m[3]):
                if key == "data-y":
                    label = a
                else:
                    names += f" {a or b or c}"
        # A formula's symbols are words of the text around them.
        node = stack[-1][0] if tag in MATH else tree.add(stack[-1][0], tag, names, "", label)
        met = met or tag in FOREIGN
        if (foreign or tag in FOREIGN) and page.endswith("/>", 0, at):
            continue
        if tag in RAW and not (foreign and tag == "title"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            stack.append((node, tag))
