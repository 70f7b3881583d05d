"""A registry of sources as a table: which rows a listing has, which fields a row or an article has, what follows a page.

A rule is a row (source, kind, field, nth, selector, take):

* ``row``: selectors of a listing's rows; ``field``: a field inside a row; ``page``: a field of the whole page;
  ``next``: the link to the following page. Of the rules of one field the one with the smallest ``nth`` that
  gives a valid value counts, and which it was is told.
* ``take``: ``text`` (the first text directly in the first element), ``texts`` (all text in all elements,
  joined), ``@name`` (an attribute), ``ld`` (the key ``selector`` of the page's JSON-LD node), ``const`` (the selector
  itself). A field whose
  name ends with ``_at`` is a date: a value that is none is passed over, one that is comes as
  ``yyyy-MM-dd HH:mm:ss`` in UTC.
* ``required``: a row without this field is none. A rule of the source ``*`` holds for every source that has none of
  its kind and field.
* ``include``, ``exclude``: patterns of a row's address (an exclusion wins, no inclusion accepts all);
  ``rewrite``: a pattern of a picture's address, ``take`` its replacement. These are joined as columns and run
  in the JVM.

Selectors: tags, ``.class``, ``#id``, ``[name]``, ``[name='value']``, ``:nth-child(n)``, ``:first-child``, ``:last-child``,
``:not(:first-child)``, blanks, ``>``, ``+`` and commas. Rules are compiled once a task; a page is parsed once
(``sources.tree``) for all its rules. A source without rules gives no rows and no fields; broken pages never fail.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree
from .html import absolute

RULES_DDL = "source string, kind string, field string, nth int, selector string, take string"
#: A registry is read by the driver: a table of more rules than this is refused.
MOST_RULES = 100_000
_FOUND = pa.struct([("row", pa.int32()), ("values", pa.map_(pa.string(), pa.string())), ("steps", pa.map_(pa.string(), pa.int32()))])

_TEST = re.compile(r"""\.([\w-]+)|\#([\w-]+)|\[([\w:-]+)(?:\s*=\s*["']?([^\]"']*)["']?)?\]|:nth-child\((\d+)\)|:(first-child|last-child|not\(:first-child\))|([\w-]+|\*)""")
_PIECE = re.compile(r"""\s*([>+])\s*|\s+(?=[^\s>+])|((?:\[[^\]]*\]|\([^)]*\)|[^\s>+\[(])+)""")


@lru_cache(maxsize=4096)
def compiled(group: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives, each a list of (combinator, tests) from the last element to the first."""
    out = []
    for one in re.split(r",(?![^\[(]*[\])])", group):
        chain, sign = [], " "
        for piece in _PIECE.finditer(one.strip()):
            if piece[2] is None:
                sign = piece[1] or " "
            else:
                chain.append((sign, [t.groups() for t in _TEST.finditer(piece[2])]))
                sign = " "
        out.append(chain[::-1])
    return out


@lru_cache(maxsize=4096)
def keyed(group: str) -> list[tuple[tuple | None, list]]:
    """The alternatives with the rarest thing that their last element must have: an id, a class, an attribute or a tag; None where any may match."""
    out = []
    for chain in compiled(group):
        wanted = [(k, v) for name, ident, attr, _, _, _, tag in chain[0][1] for k, v in enumerate((ident, name, attr, tag.lower() if tag and tag != "*" else None)) if v]
        out.append((min(wanted, key=lambda w: w[0]) if wanted else None, chain))
    return out


class Page:
    """Elements of a page with what selectors ask for."""

    def __init__(self, html: str | None):
        self.raw = (html or "").encode()
        self.nodes = tree.parse(self.raw) if html else []
        self.children: dict[int, list[int]] = {}
        for n in self.nodes:
            self.children.setdefault(n[1], []).append(n[0])
        self.place = {c: k for own in self.children.values() for k, c in enumerate(own)}
        self.attrs = [dict(n[11]) for n in self.nodes]
        self.opens = [n[4] for n in self.nodes]
        self.having: dict[tuple, list[int]] = {}
        for n, attrs in zip(self.nodes, self.attrs, strict=True):
            self.having.setdefault((3, n[3]), []).append(n[0])
            for name, value in attrs.items():
                self.having.setdefault((2, name), []).append(n[0])
                for key in {(1, c) for c in value.split()} if name == "class" else ((0, value),) if name == "id" else ():
                    self.having.setdefault(key, []).append(n[0])

    def _test(self, at: int, tests: list[tuple]) -> bool:
        attrs, place, last = self.attrs[at], self.place[at], len(self.children[self.nodes[at][1]]) - 1
        for name, ident, attr, value, nth, child, tag in tests:
            if name and name not in attrs.get("class", "").split() or ident and attrs.get("id") != ident or attr and (attr not in attrs or value is not None and attrs[attr] != value):
                return False
            if nth and place + 1 != int(nth) or child == "first-child" and place or child == "last-child" and place != last or child and child.startswith("not") and not place:
                return False
            if tag and tag != "*" and self.nodes[at][3] != tag.lower():
                return False
        return True

    def _chain(self, at: int, chain: list, k: int = 0) -> bool:
        if not self._test(at, chain[k][1]):
            return False
        if k + 1 == len(chain):
            return True
        sign, above = chain[k][0], self.nodes[at][1]
        if sign == "+":
            return self.place[at] > 0 and self._chain(self.children[above][self.place[at] - 1], chain, k + 1)
        while above >= 0:
            if self._chain(above, chain, k + 1):
                return True
            if sign == ">":
                return False
            above = self.nodes[above][1]
        return False

    def select(self, group: str, scope: int | None = None) -> list[int]:
        """Elements in document order, inside ``scope`` (itself included).

        What lies in an element follows it at once, so a scope is a range of numbers; only those elements in it are
        tested that have what the selector's last element must have.
        """
        begin, end = (scope, bisect_left(self.opens, self.nodes[scope][7])) if scope is not None else (0, len(self.nodes))
        made: list[int] = []
        alternatives = keyed(group)
        for key, chain in alternatives:
            if key is None:
                among = range(begin, end)
            else:
                among = self.having.get(key, ())
                if among and (begin or end < len(self.nodes)):
                    among = among[bisect_left(among, begin) : bisect_left(among, end)]
            made += [n for n in among if self._chain(n, chain)]
        return made if len(alternatives) == 1 else sorted(set(made))

    def texts(self, at: int, deep: bool) -> Iterator[str]:
        """Text directly in an element, or all in it."""
        if deep and self.nodes[at][3] in ("script", "style"):
            return
        where = self.nodes[at][5]
        for child in [*self.children.get(at, []), None]:
            stop = self.nodes[child][4] if child is not None else self.nodes[at][6]
            for piece in re.split(rb"<!--.*?-->|</[^>]*>", self.raw[where:stop], flags=re.DOTALL):
                if piece:
                    yield tree.unescaped(piece.decode("utf-8", "replace"))
            if child is not None:
                if deep:
                    yield from self.texts(child, True)
                where = self.nodes[child][7]

    @cached_property
    def ld(self) -> dict:
        """The first JSON-LD node: lists are unwrapped; of a graph, the first node with a date of publication."""
        for at in self.select("script[type='application/ld+json']"):
            try:
                data = json.loads("".join(self.texts(at, False)))
            except ValueError:
                continue
            for entry in data if isinstance(data, list) else [data]:
                if not isinstance(entry, dict):
                    continue
                if isinstance(entry.get("@graph"), list):
                    dated = [n for n in entry["@graph"] if isinstance(n, dict) and n.get("datePublished")]
                    if dated:
                        return dated[0]
                    continue
                return entry
        return {}

    def take(self, selector: str, take: str, scope: int | None) -> str:
        if take == "const":
            return selector
        if take == "ld":
            value = self.ld.get(selector)
            return value.strip() if isinstance(value, str) else ""
        found = self.select(selector, scope)
        if take.startswith("@"):
            return next((self.attrs[n][take[1:]].strip() for n in found if take[1:] in self.attrs[n]), "")
        if take == "texts":
            return " ".join(" ".join(t for n in found for t in self.texts(n, True)).split())
        return next((t.strip() for n in found for t in self.texts(n, False)), "")


_FORMATS = ("%A, %d %B %Y %H:%M", "%d %B %Y", "%B %d, %Y", "%d/%m/%Y", "%d-%b-%Y", "%d %b %Y", "%Y/%m/%d")


@lru_cache(maxsize=65_536)
def date(text: str) -> str:
    """``yyyy-MM-dd HH:mm:ss`` in UTC of a date in ISO, mail or one of the written forms; empty where it is none."""
    made = None
    try:
        made = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        try:
            made = parsedate_to_datetime(text)
        except (TypeError, ValueError):
            for form in _FORMATS:
                try:
                    made = datetime.strptime(text, form)
                    break
                except ValueError:
                    continue
    if made is None:
        return ""
    try:
        return (made.astimezone(UTC) if made.tzinfo else made).strftime("%Y-%m-%d %H:%M:%S")
    except (OverflowError, ValueError):
        return ""


class Rules:
    """The rules of one source, by kind and field, in order."""

    def __init__(self, rows: list[tuple], common: list[tuple]):
        own = {(r[0], r[1]) for r in rows}
        rows = [*rows, *(r for r in common if (r[0], r[1]) not in own)]
        self.by: dict[str, dict[str, list[tuple[int, str, str]]]] = {}
        for kind, field, nth, selector, take in sorted(rows, key=lambda r: (r[0], r[1] or "", r[2] or 0)):
            self.by.setdefault(kind, {}).setdefault(field or "", []).append((nth or 0, selector, take or "text"))

    def fields(self, page: Page, kind: str, scope: int | None) -> tuple[list, list]:
        values, steps = [], []
        for field, rules in self.by.get(kind, {}).items():
            for nth, selector, take in rules:
                value = page.take(selector, take, scope)
                value = date(value) if value and field.endswith("_at") else value
                if value:
                    values.append((field, value))
                    steps.append((field, nth))
                    break
        return values, steps

    def found(self, html: str | None) -> list[tuple[int, list, list]]:
        """(0, fields of the page and the next page's link), then (number, fields) of each row of the listing that has any."""
        page = Page(html)
        values, steps = self.fields(page, "page", None)
        for _, selector, _ in self.by.get("next", {}).get("", []):
            link = page.take(selector, "@href", None)
            if link:
                values.append(("next", link))
                break
        out = [(0, values, steps)]
        for _, selector, _ in self.by.get("row", {}).get("", []):
            rows = page.select(selector)
            for k, at in enumerate(rows):
                own = self.fields(page, "field", at)
                if own[0] and {f for f, _ in own[0]} >= set(self.by.get("required", {})):
                    out.append((k + 1, *own))
            break
        return out


def read(pages: DataFrame, registry: DataFrame, source: str = "source", html: str = "html") -> DataFrame:
    """The columns of ``pages`` but the markup, and a row for the page (number 0) and for each row of its listing: row, values, steps."""
    rows = registry.filter(F.col("kind").isin("row", "required", "field", "page", "next")).select("source", "kind", "field", "nth", "selector", "take").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a registry of more than {MOST_RULES} rules")
    told: dict[str, list[tuple]] = {}
    for r in rows:
        told.setdefault(r["source"], []).append(tuple(r)[1:])
    where = (pages.columns.index(source), pages.columns.index(html))
    kept = [i for i, c in enumerate(pages.columns) if c != html]
    names = [pages.columns[i] for i in kept]
    found = F.lit(None).cast("array<struct<row: int, values: map<string, string>, steps: map<string, int>>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = told.get("*", [])
        rules, none = {s: Rules(r, common) for s, r in told.items()}, Rules([], common)
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            made = [rules.get(s.as_py(), none).found(h.as_py()) for s, h in zip(batch.column(where[0]), batch.column(where[1]), strict=True)]
            flat = [r for rows in made for r in rows]
            offsets = [0]
            for rows in made:
                offsets.append(offsets[-1] + len(rows))
            structs = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], f.type) for k, f in enumerate(_FOUND)], fields=list(_FOUND))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)], names=[*names, "__found"])

    schema = pages.select(*(F.col(f"`{n}`") for n in names), found.alias("__found")).schema
    return pages.mapInArrow(run, schema).select(*(F.col(f"`{n}`") for n in names), F.inline("__found"))


def _patterns(registry: DataFrame) -> DataFrame:
    """(source, include, exclude, rewrite, put): one row a source; of several patterns of a kind the first counts."""
    first = lambda kind, c: F.min_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.coalesce("nth", F.lit(0))))
    return registry.groupBy("source").agg(first("include", "selector").alias("__include"), first("exclude", "selector").alias("__exclude"), first("rewrite", "selector").alias("__rewrite"), first("rewrite", "take").alias("__put"))


def listing(found: DataFrame, registry: DataFrame, url: str = "url", source: str = "source", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of listings from ``read``: the columns before ``row``, row, url (absolute, once a page), values. Rows without an address or with one that the registry refuses go."""
    own = [c for c in found.columns if c not in ("row", "values", "steps")]
    rows = found.filter("row > 0 and values['href'] is not null").withColumn("link", absolute(F.col(url), F.col("values")["href"]))
    rows = rows.join(F.broadcast(_patterns(registry)), source, "left")
    accepted = (F.col("__exclude").isNull() | ~F.rlike("link", F.col("__exclude"))) & (F.col("__include").isNull() | F.rlike("link", F.col("__include")))
    by = [*(keys or own), "link"]
    first = rows.filter(F.coalesce(accepted, F.lit(False))).groupBy(*by).agg(F.min_by(F.struct(*(c for c in [*own, "row", "values"] if c not in by)), "row").alias("__r"))
    return first.select(*by, "__r.*").select(*own, "row", "link", "values")


def rewritten(rows: DataFrame, registry: DataFrame, address: str, source: str = "source") -> DataFrame:
    """``rows`` with the picture's address rewritten by its source's rule (a thumbnail becomes the full picture)."""
    made = rows.join(F.broadcast(_patterns(registry).select(source, "__rewrite", "__put")), source, "left")
    new = F.when(F.col("__rewrite").isNull(), F.col(address)).otherwise(F.regexp_replace(F.col(address), F.col("__rewrite"), F.col("__put")))
    return made.withColumn(address, new).drop("__rewrite", "__put")
