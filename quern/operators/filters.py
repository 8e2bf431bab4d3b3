"""Filters as data: trees of conditions on rows and on what rows contain, put in a canonical order and compiled to one plan.

Conditions on a row's children (a product's ingredients) are named in a registry. All of a tree's conditions on children become flags of one aggregate over the
child table, however many there are and however they are nested or negated, so that table is read once; the tree itself is then one predicate.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Text:
    """`column` contains `value`, whatever the case."""

    column: str
    value: str


@dataclass(frozen=True)
class Within:
    """`column` is one of `values`."""

    column: str
    values: tuple


@dataclass(frozen=True)
class Has:
    """Some child meets the registry's condition `term`."""

    term: str


@dataclass(frozen=True)
class Clear:
    """Certainly no child meets `term`: there are children, all are assessed, and none does. Rows that nothing is known about don't pass."""

    term: str


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


def normal(tree):
    """The same tree without nested ands and ors of one kind, repeated parts and double negations, its parts in one order: trees that say the same in another order become equal."""
    if isinstance(tree, Not):
        part = normal(tree.part)
        return part.part if isinstance(part, Not) else Not(part)
    if isinstance(tree, (All, AnyOf)):
        kind, parts = type(tree), []
        for p in map(normal, tree.parts):
            parts += p.parts if isinstance(p, kind) else [p]
        parts = sorted(set(parts), key=repr)
        return parts[0] if len(parts) == 1 else kind(tuple(parts))
    return Within(tree.column, tuple(sorted(set(tree.values)))) if isinstance(tree, Within) else tree


def terms_of(tree) -> set[str]:
    if isinstance(tree, (Has, Clear)):
        return {tree.term}
    parts = tree.parts if isinstance(tree, (All, AnyOf)) else [tree.part] if isinstance(tree, Not) else []
    return set().union(*map(terms_of, parts))


def _predicate(tree) -> Column:
    if isinstance(tree, Text):
        return F.coalesce(F.lower(tree.column).contains(tree.value.lower()), F.lit(False))
    if isinstance(tree, Within):
        return F.coalesce(F.col(tree.column).isin(*tree.values), F.lit(False)) if tree.values else F.lit(False)
    if isinstance(tree, Has):
        return F.coalesce(F.col("_flags")[tree.term], F.lit(False))
    if isinstance(tree, Clear):
        return F.coalesce(F.col("_flags")["_assessed"] & ~F.col("_flags")[tree.term], F.lit(False))
    if isinstance(tree, Not):
        return ~_predicate(tree.part)
    if not tree.parts:
        return F.lit(isinstance(tree, All))
    return reduce((lambda a, b: a & b) if isinstance(tree, All) else (lambda a, b: a | b), map(_predicate, tree.parts))


def matching(rows: DataFrame, key: str, tree, registry: Mapping[str, str], children: DataFrame, child_key: str, assessed: Column | None = None) -> DataFrame:
    """The rows that `tree` lets pass. `registry` has a condition on `children`, in SQL, for each term; `assessed` says of a child whether it was looked at at all (all were, if it isn't given)."""
    tree = normal(tree)
    terms = sorted(terms_of(tree))
    unknown = set(terms) - set(registry)
    if unknown:
        raise ValueError(f"filters not in the registry: {sorted(unknown)}")
    if not terms:
        return rows.where(_predicate(tree))
    flags = [F.coalesce(F.bool_or(F.expr(registry[t])), F.lit(False)).alias(t) for t in terms]
    known = F.bool_and(F.coalesce(assessed if assessed is not None else F.lit(True), F.lit(False))).alias("_assessed")
    per_row = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_of")).agg(*flags, known)
    flagged = per_row.select("_of", F.struct(*terms, "_assessed").alias("_flags"))
    return rows.join(flagged, F.col(key) == F.col("_of"), "left").where(_predicate(tree)).drop("_of", "_flags")


#: Lengths of free text in a filter, and how many filters one request may have.
LEAST, MOST, FILTERS = 2, 60, 20


def parse(query: str, registry: Mapping[str, str]) -> list[tuple[str, str]]:
    """(`without` or `with` or `text`, value) of a URL's query: known terms and texts of a sensible length, each once, terms in the registry's order before texts in theirs."""
    found = []
    for name, value in parse_qsl(query, keep_blank_values=False):
        value = " ".join(value.split()).lower()
        if name in ("without", "with"):
            found += [(name, v) for v in (x.strip() for x in value.split(",")) if v in registry]
        elif name == "text" and LEAST <= len(value) <= MOST:
            found.append((name, value))
    order = list(registry)
    once = list(dict.fromkeys(found))
    return sorted(once, key=lambda f: (f[0] == "text", order.index(f[1]) if f[1] in registry and f[0] != "text" else 0, f[1], f[0]))[:FILTERS]


def to_query(filters: list[tuple[str, str]]) -> str:
    return urlencode(filters)


def toggled(filters: list[tuple[str, str]], one: tuple[str, str], registry: Mapping[str, str]) -> list[tuple[str, str]]:
    left = [f for f in filters if f != one]
    return parse(to_query(left if len(left) < len(filters) else [*filters, one]), registry)


def tree_of(filters: list[tuple[str, str]], column: str):
    """The tree of parsed filters: terms that must not be there, terms that must, texts that `column` must have."""
    return All(tuple(Not(Has(v)) if k == "without" else Has(v) if k == "with" else Text(column, v) for k, v in filters))


def check_digit_holds(digits: str) -> bool:
    total = sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def dispatched(query: str, barcode: str, name: str, brand: str, noise: tuple[str, ...] = ("and", "the", "of", "with", "for")):
    """The tree that a search for `query` means: one barcode if it is one; else every word in the name or the brand; else the text as it stands."""
    digits = "".join(c for c in query if c.isdigit())
    if len(digits) in (8, 12, 13) and all(c.isdigit() or c in " -" for c in query) and check_digit_holds(digits):
        return Within(barcode, (digits.zfill(13) if len(digits) == 12 else digits,))
    words = list(dict.fromkeys(w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if len(w) >= 2))
    telling = [w for w in words if w not in noise][:6] or words[:6]
    if telling:
        return All(tuple(AnyOf((Text(name, w), Text(brand, w))) for w in telling))
    return Text(name, query.strip()) if query.strip() else AnyOf(())
