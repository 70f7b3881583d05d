"""Expressions over HTML text: listings, structured data, and what goes before a body is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

NODE = "type string, headline string, datePublished string, dateModified string, author string"
_FIELDS = ("`@type` string", "headline string", "datePublished string", "dateModified string", "author string")


def listing_rows(html: Column | str, row: str, fields: dict[str, str]) -> Column:
    """The rows of a listing page as structs: ``row`` finds each row's markup, a field's pattern its value (first group, tags stripped; empty is null)."""
    value = lambda r, p: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(r, p, 1), "<[^>]+>", " "), r"\s+", " ")), F.lit(""))
    return F.transform(F.regexp_extract_all(col(html), F.lit(row), F.lit(1)), lambda r: F.struct(*(value(r, p).alias(n) for n, p in fields.items())))


def json_ld(html: Column | str) -> Column:
    """The page's JSON-LD node: lists and @graph are unwrapped, the first node with a date of publication wins, else the first of all."""
    node = f"struct<{', '.join(x.replace(' ', ': ') for x in _FIELDS)}>"
    scripts = F.regexp_extract_all(col(html), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))

    def nodes(text: Column) -> Column:
        many = F.from_json(text, f"array<{node}>")
        one = F.from_json(text, f"struct<`@graph`: array<{node}>, {node[7:-1]}>")
        own = F.array(F.struct(*(one[x.split(" ")[0].strip("`")].alias(x.split(" ")[0].strip("`")) for x in _FIELDS)))
        return F.when(F.ltrim(text).startswith("["), many).otherwise(F.coalesce(one["@graph"], own))

    every = F.filter(F.flatten(F.transform(scripts, lambda s: F.coalesce(nodes(s), F.array().cast(f"array<{node}>")))), lambda n: n.isNotNull())
    return F.coalesce(F.get(F.filter(every, lambda n: n["datePublished"].isNotNull()), F.lit(0)), F.get(every, F.lit(0)))
