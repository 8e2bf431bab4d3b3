"""Operator 13: main texts of pages by wrapper induction.

Pages of a host share a template. Each page becomes a tree of slots: its block elements, with repeated siblings in one slot. Trees of
a host's pages are aligned by simple tree matching and merged, first within tasks, then in rounds of few templates at a time, so a host of
any size never meets in one task. A template knows of each slot in how many pages it has text, and whether that is the same in all of them. Then each page is
aligned with its host's template: constant slots are template, varying slots are content, unless an element's kind (navigation, forms, adverts, comments)
says that they aren't: menus and adverts vary from page to page, too.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.dom import Node, parse
from quern.llm.storage import Workspace

#: A slot is constant if at least so many pages have it and all with the same text.
LEAST_PAGES = 8
#: Slots of a template; beyond, those of the fewest pages are left to be judged by the page alone. Kids of one slot.
MOST_SLOTS, MOST_KIDS = 2000, 200
#: Slots that a task holds before it hands its templates on; templates that one task merges, about.
HELD_SLOTS, FAN = 50_000, 64
#: Bytes of all templates up to which they are broadcast; beyond, only those of hosts with more than one page in HOT.
BROADCAST_BYTES, HOT = 32 << 20, 100

#: Elements that repeat in flowing text: all of one label share a slot, wherever they stand among their siblings.
FLOW = set("p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption caption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NOT_TEXT = set("head nav footer aside form menu dialog fieldset".split())
#: Of these, what never holds the main text, whatever is in it; a form may stand around the whole page.
NEVER_MAIN = NOT_TEXT - {"form", "fieldset"}
#: First or last words of a class, id or role that is not the main text.
SIDE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside complementary widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond reply replies disqus discussion "
    "footer footers contentinfo copyright search pagination pager form toolbar skip".split()
)
#: The same, but part of the text inside an article.
TOP = set("header headers masthead topbar banner".split())
QUALIFIERS = {"has", "no", "with", "is", "without"}


class Slot:
    """`same`: 0 without text, -1 if texts differ between pages, else a checksum of the text that all have."""

    __slots__ = ("label", "pages", "texts", "same", "chars", "links", "kids", "blocks")

    def __init__(self, label, pages=1, texts=0, same=0, chars=0, links=0, kids=()):
        self.label, self.pages, self.texts, self.same, self.chars, self.links, self.kids, self.blocks = label, pages, texts, same, chars, links, list(kids), []

    def __iter__(self):
        yield self
        for kid in self.kids:
            yield from kid


def _groups(nodes: list[Node]) -> dict:
    groups: dict = {}
    for node in nodes:
        seen: dict[str, int] = {}
        before = None
        for kid in node.kids:
            if kid.tag in FLOW:
                key = (0, kid.label)
            else:
                shape = (kid.label, tuple(sorted({k.label for k in kid.kids})))
                if shape != before:
                    seen[kid.label] = seen.get(kid.label, 0) + 1
                before, key = shape, (seen[kid.label], kid.label)
            groups.setdefault(key, []).append(kid)
    for coarser in (lambda k: (0, k[1]), lambda k: (0, k[1].split(".")[0]), lambda k: (0, "*")):
        if len(groups) > MOST_KIDS:
            merged: dict = {}
            for key, kids in groups.items():
                merged.setdefault(coarser(key), []).extend(kids)
            groups = merged
    return groups


def fold(nodes: list[Node], blocks: list[tuple[str, int]], label: str = "") -> Slot:
    """The slot that `nodes` of one page share, with the slots below it."""
    slot = Slot(label)
    slot.blocks = [k for node in nodes for k in node.blocks]
    if slot.blocks:
        slot.texts, slot.chars, slot.links = 1, sum(len(blocks[k][0]) for k in slot.blocks), sum(blocks[k][1] for k in slot.blocks)
        slot.same = zlib.crc32("\n".join(blocks[k][0] for k in slot.blocks).encode("utf-8", "replace")) + 1
    slot.kids = [fold(kids, blocks, key[1]) for key, kids in _groups(nodes).items()]
    return slot


def _weight(a: Slot, b: Slot) -> int:
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    return 1 + _matching(a.kids, b.kids)[0]


def _matching(a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of siblings: the heaviest pairing that keeps their order."""
    names = [s.label for s in a]
    if names == [s.label for s in b] and len(set(names)) == len(names):  # each can only match its like
        return sum(map(_weight, a, b)), [(k, k) for k in range(len(a))]
    rows, weights = [[0] * (len(b) + 1)], []
    for x in a:
        w, row, up = [_weight(x, y) for y in b], [0], rows[-1]
        for j, v in enumerate(w):
            row.append(max(row[j], up[j + 1], up[j] + v))
        rows.append(row)
        weights.append(w)
    found, i, j = [], len(a), len(b)
    while i and j:
        if weights[i - 1][j - 1] and rows[i][j] == rows[i - 1][j - 1] + weights[i - 1][j - 1]:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return rows[-1][-1], found[::-1]


def merge(a: Slot, b: Slot) -> Slot:
    """The template of the pages of both; slots that only one has stand where it has them."""
    same = a.same or b.same if not (a.same and b.same) else a.same if a.same == b.same else -1
    pairs = _matching(a.kids, b.kids)[1] if a.kids and b.kids else []
    kids, i, j = [], 0, 0
    for x, y in [*pairs, (len(a.kids), len(b.kids))]:
        kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            kids.append(merge(a.kids[x], b.kids[y]))
        i, j = x + 1, y + 1
    return Slot(a.label, a.pages + b.pages, a.texts + b.texts, same, a.chars + b.chars, a.links + b.links, kids)


def bounded(template: Slot) -> Slot:
    """At most MOST_SLOTS slots, those of the most pages."""
    counts = sorted((s.pages for s in template), reverse=True)
    if len(counts) <= MOST_SLOTS:
        return template
    least = counts[MOST_SLOTS] + 1

    def cut(s: Slot) -> Slot:
        s.kids = [cut(k) for k in s.kids if k.pages >= least]
        return s

    return cut(template)


def written(s: Slot) -> list:
    return [s.label, s.pages, s.texts, s.same, s.chars, s.links, [written(k) for k in s.kids]]


def _read(row: list) -> Slot:
    return Slot(*row[:6], [_read(k) for k in row[6]])


@lru_cache(maxsize=256)
def read_template(text: str) -> Slot:
    return _read(json.loads(text))


@lru_cache(maxsize=20_000)
def kind(label: str) -> str:
    """hidden, side (never the main text), top (not outside an article), main (holds the main text) or an empty string."""
    if label[:1] == "!":
        return "hidden"
    tag, *words = label.split(".")
    if tag in ("", "html", "body"):
        return ""
    parts = [p for w in words if (p := [x for x in w.replace("_", "-").split("-") if x]) and p[0] not in QUALIFIERS]
    ends = {e for p in parts for e in (p[0], p[-1])}
    if tag in NOT_TEXT or ends & SIDE:
        return "side"
    if tag in ("article", "main") or "main" in words and tag not in FLOW:
        return "main"
    return "top" if tag == "header" or ends & TOP else ""


def kept(page: Slot, template: Slot | None) -> set[int]:
    """The blocks of a page that are its main text."""
    total = sum(s.chars for s in page)
    holds_main: dict[int, bool] = {}
    share: dict[int, int] = {}

    def look(s: Slot) -> bool:
        below = [look(k) for k in s.kids]
        share[id(s)] = s.chars + sum(share[id(k)] for k in s.kids)
        holds_main[id(s)] = (any(below) or kind(s.label) == "main") and s.label.split(".")[0] not in NEVER_MAIN
        return holds_main[id(s)]

    has_main = look(page)
    varies = template is not None and _varies(template)
    out: set[int] = set()

    def walk(s: Slot, t: Slot | None, inside: bool):
        what = kind(s.label)
        if what == "hidden":
            return
        whole_page = holds_main[id(s)] or (s.label.split(".")[0] == "form" and 2 * share[id(s)] > total)
        if what == "side" and not whole_page or what == "top" and not inside and not holds_main[id(s)]:
            return
        inside = inside or what == "main"
        constant = varies and t is not None and t.texts >= LEAST_PAGES and t.same > 0 and not (inside and s.label.split(".")[0] in HEADINGS)
        chars, links = (t.chars, t.links) if t is not None else (s.chars, s.links)
        if inside or not has_main and not 5 * links > 3 * chars:
            if not constant:
                out.update(s.blocks)
        pairs = dict((j, i) for i, j in _matching(t.kids, s.kids)[1]) if t is not None and t.kids and s.kids else {}
        for j, kid in enumerate(s.kids):
            walk(kid, t.kids[pairs[j]] if j in pairs else None, inside)

    walk(page, template, False)
    return out


def _varies(template: Slot) -> bool:
    """Whether any slot of text differs between pages; if none does, the pages are copies of each other and tell nothing."""
    if kind(template.label) in ("hidden", "side", "top") and not any(kind(s.label) == "main" for s in template):
        return False
    return template.same == -1 or any(map(_varies, template.kids))


def main_text(html: str, template: str | None = None) -> str:
    root, blocks = parse(html)
    chosen = kept(fold([root], blocks), read_template(template) if template else None)
    return "\n\n".join(text for k, (text, _) in enumerate(blocks) if k in chosen)


def _page_templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Slot] = {}
    slots = 0

    def out():
        texts = [json.dumps(written(t), separators=(",", ":"), ensure_ascii=False) for t in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(texts, pa.string()), pa.array([t.pages for t in held.values()], pa.int64())], names=["host", "template", "pages"])

    for batch in batches:
        for host, html in zip(batch.column("host"), batch.column("html"), strict=True):
            root, blocks = parse(html.as_py())
            page, host = fold([root], blocks), host.as_py()
            before = held.get(host)
            now = held[host] = bounded(merge(before, page) if before else page)
            slots += sum(1 for _ in now) - (sum(1 for _ in before) if before else 0)
            if slots > HELD_SLOTS:
                yield out()
                held.clear()
                slots = 0
    if held:
        yield out()


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    template = None
    for text in sorted(rows["template"]):
        one = _read(json.loads(text))
        template = one if template is None else bounded(merge(template, one))
    return pd.DataFrame({"host": [key[0]], "template": [json.dumps(written(template), separators=(",", ":"), ensure_ascii=False)], "pages": [template.pages]})


TEMPLATES = "host string, template string, pages long"


def induce(pages: DataFrame, work: Workspace) -> DataFrame:
    """host, template, pages for each host of `pages` (host, html). Templates of one host are merged FAN at a time until one is left."""
    partial = pages.where("host IS NOT NULL").select("host", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_page_templates, TEMPLATES)
    while True:
        now = work.table(partial.withColumn("at", F.monotonically_increasing_id()), "templates")
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now.drop("at")
        pieces = -(-most // FAN)
        partial = now.withColumn("piece", F.pmod(F.xxhash64("at"), F.lit(pieces))).groupBy("host", "piece").applyInPandas(_merged, TEMPLATES)


def _texts(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, template in columns:
        yield pa.array([main_text(h.as_py(), t.as_py()) for h, t in zip(html, template, strict=True)], pa.string())


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages` (page_id, url, html).

    Null or empty html has the empty text. A page whose url names no host is judged without a template, as is one of a host with fewer than
    LEAST_PAGES pages, in effect. Markup that is cut off or never closed, entities without their semicolon and stray `<` are read as browsers read them. Text is never
    shortened. Rows repeated under one id are pages of their own; other columns are not read. An empty table gives none.
    """
    work = Workspace(spark, "wrappers")
    rows = pages.select("page_id", "url", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), "html")
    templates = work.table(induce(rows.select("host", "html"), work).withColumnRenamed("host", "of_host"), "hosts")
    held, total = templates.agg(F.sum(F.length("template")), F.sum("pages")).first()
    same = F.col("host") == F.col("of_host")
    if (held or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(templates), same, "left")
    else:
        hot = F.col("pages") > total // HOT  # at most HOT hosts of at most MOST_SLOTS slots
        common, rare = F.broadcast(templates.where(hot)), templates.where(~hot)
        known = F.col("host").isNotNull()
        rest = rows.where(known).join(common, same, "left_anti").join(rare, same, "left")
        joined = rows.where(known).join(common, same).unionByName(rest).unionByName(rows.where(~known).withColumns({c: F.lit(None).cast(t) for c, t in templates.dtypes}))
    text = F.arrow_udf(_texts, "string").asNondeterministic()(F.coalesce("html", F.lit("")), F.col("template"))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: What the method must find in these tables, whose main texts all stand in one article of headings and paragraphs.
OP13_SQL = r"""
WITH parts AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(h1|p)>') AS parts FROM pages),
plain AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<br>', ' ', 'g').regexp_replace('</?[a-z][^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp$', '&'),
    '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM parts)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10)))::BIGINT AS n_chars FROM plain
"""
