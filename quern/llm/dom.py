"""Pages as trees of block elements: what of HTML's rules decides about blocks of text, their white space and their nesting."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

#: Fixed values of HTML: elements without content; elements whose content is no text; elements inside a line of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style textarea title noscript iframe noembed noframes template select button svg math object canvas video audio datalist".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Fixed values of HTML: an element that ends where one of these begins, up to the nearest of its bounds.
ENDS_AT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Elements deeper than this count as part of the element at this depth, with their texts.
DEPTH = 100

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]{0,4096}"|=\s*'[^']{0,4096}'|[^>])*+)>?|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in SKIPPED}


@lru_cache(maxsize=20_000)
def label_of(tag: str, attributes: str) -> str:
    """The tag with its classes, id and role, without those that hold digits; `!` before it if it isn't shown."""
    words, shown = set(), True
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            shown = False
        elif name in ("class", "id", "role"):
            words.update(w for w in value.lower().split() if not re.search(r"\d|[.!]", w))
    return ("" if shown else "!") + ".".join([tag, *sorted(words)])


class Node:
    __slots__ = ("tag", "label", "kids", "blocks")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.kids, self.blocks = tag, label, [], []


def parse(html: str) -> tuple[Node, list[tuple[str, int]]]:
    """The tree of a page's block elements, and its blocks of text in page order, each with how many of its characters are links. Nodes hold numbers of blocks."""
    root = Node("", "")
    stack, blocks, buffer, links, in_link = [root], [], [], 0, False

    def flush():
        nonlocal links, in_link
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                stack[-1].blocks.append(len(blocks))
                blocks.append((text, min(links, len(text))))
            buffer.clear()
        links, in_link = 0, False

    def close(k: int):
        if k < len(stack):
            flush()
            del stack[k:]

    def skip(tag: str, at: int) -> int:
        end = _CLOSING[tag].search(html, at)
        return end.start() if end else len(html)

    at = 0
    while at < len(html):
        token = _TOKEN.match(html, at)
        at, tag = token.end(), token[2]
        if tag is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                text = unescape(text) if "&" in text else text
                buffer.append(text)
                links += len(text) if in_link else 0
            continue
        tag = tag.lower()
        if token[1]:
            if tag == "a":
                in_link = False
            elif tag == "br":
                buffer.append(" ")
            elif tag not in INLINE:
                flush()
                close(next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), len(stack)))
            continue
        if tag in SKIPPED:
            at = skip(tag, at)
        elif tag in INLINE:
            if tag == "a":
                in_link = True
            elif label_of(tag, token[3])[0] == "!" and not token[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)  # an element that isn't shown
                at = end.start() if end else at
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                buffer.append(" ")
        else:
            flush()
            ends = ENDS_AT.get(tag)
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k].tag
                if open_tag == "p" or (ends and open_tag in ends):
                    close(k)
                    if open_tag != "p" or not ends:
                        break
                elif open_tag in BOUNDS.get(tag, ()) or not ends:
                    break
            if len(stack) <= DEPTH:
                node = Node(tag, label_of(tag, token[3]))
                stack[-1].kids.append(node)
                stack.append(node)
    flush()
    return root, blocks
