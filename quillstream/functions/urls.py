"""URL expressions: page numbers, canonical forms, redirects, referrals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Hosts of assistants that send readers.
ASSISTANTS = ["chatgpt.com", "chat.openai.com", "openai.com", "perplexity.ai", "gemini.google.com", "bard.google.com", "copilot.microsoft.com", "edgeservices.bing.com", "claude.ai", "you.com", "poe.com", "meta.ai", "chat.mistral.ai", "phind.com"]


def page_count(n: Column, size: int = 12) -> Column:
    return F.ceil(n / size).cast("long")


def page_param(text: Column | str) -> Column:
    """The page of a query parameter: what is no number, or under 1, is page 1."""
    n = F.try_to_number(F.when(F.trim(col(text)).rlike(r"^\d{1,9}$"), F.trim(col(text))), F.lit("999999999")).cast("long")
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(1))).cast("long")


def page_segment(text: Column | str) -> Column:
    """The page of a path segment: digits only and at least 2, else null."""
    n = F.when(col(text).rlike(r"^[0-9]{1,9}$"), col(text)).cast("long")
    return F.when(n >= 2, n)


def param(url: Column, name: str) -> Column:
    """A parameter of the query, null where it is absent."""
    found = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(url.rlike(rf"[?&]{name}="), found)


def path(url: Column) -> Column:
    """The path, without a slash at its end; the root is '/'."""
    p = F.regexp_replace(F.regexp_replace(url, r"^\w+://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(F.regexp_replace(p, "/+$", "") == "", "/").otherwise(F.regexp_replace(p, "/+$", ""))


def paged(base: Column, page: Column, word: str = "page") -> Column:
    """Page 1 is the bare path, others are segments behind it."""
    stem = F.when(base == "/", "").otherwise(F.regexp_replace(base, "/+$", ""))
    return F.when(page <= 1, base).otherwise(F.concat(stem, F.lit(f"/{word}/"), page.cast("string")))


def canonical(url: Column, allowed: list[str], page: str = "page") -> Column:
    """Path form of the page and, behind it, the allowed parameters that are there, in fixed order."""
    own = [F.when(F.coalesce(param(url, p), F.lit("")) != "", F.concat(F.lit(f"{p}="), param(url, p))) for p in allowed]
    query = F.concat_ws("&", *own)
    target = paged(path(url), page_param(param(url, page)), page)
    return F.when(query == "", target).otherwise(F.concat(target, F.lit("?"), query))


def without_param(url: Column, name: str) -> Column:
    """Path and query without a parameter; the others keep their places."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    rest = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != name)), "&")
    return F.when(rest == "", path(url)).otherwise(F.concat(path(url), F.lit("?"), rest))


def redirect(url: Column, listing: str, filters: list[tuple], gone: list[str], page: str = "page", prefixes: list[str] | None = None) -> Column:
    """(status, target): 410 for what is gone; the first known filter of its listing moves into the path; a page parameter moves into the path; else null.

    ``filters``: (parameter, known values, target prefix), in order of precedence; known values None take any
    slug. Further elements of a filter: whether the page goes along into the path, in one hop (else it is
    dropped, the target being another set of rows), and its listing where that is another one. A page
    parameter moves only on the root and under ``prefixes`` (None: everywhere). Left over on an address that
    is paged already, it alone goes and other parameters stay.
    """
    p = path(url)
    moves = []
    for name, values, to, *more in filters:
        with_page, own = (*more, False, listing)[:2] if len(more) != 1 else (more[0], listing)
        value = param(url, name)
        known = value.isin(values) if values is not None else value.rlike("^[a-z0-9-]+$")
        target = F.concat(F.lit(f"{to}/"), value)
        moves.append(F.when((p == own) & known, paged(target, page_param(param(url, page)), page) if with_page else target))
    within = F.lit(True) if prefixes is None else reduce(lambda a, b: a | b, ((p == x.rstrip("/")) & F.lit(not x.endswith("/")) | p.startswith(x.rstrip("/") + "/") for x in prefixes), p == "/")
    by_page = F.when(param(url, page).isNotNull() & within, F.when(p.rlike(rf"/{page}/\d+$"), without_param(url, page)).otherwise(paged(p, page_param(param(url, page)), page)))
    target = F.coalesce(*moves, by_page)
    return F.when(p.isin(gone), F.struct(F.lit(410).alias("status"), F.lit(None).cast("string").alias("target"))).when(target.isNotNull(), F.struct(F.lit(308).alias("status"), target.alias("target")))


def assistant(url: Column, referrer: Column, hosts: list[str] = ASSISTANTS) -> Column:
    """The assistant a visit came from: a source tag that is or holds its host, else a referrer whose host is or ends with it."""
    tag, host = F.lower(param(url, "utm_source")), F.lower(F.regexp_extract(referrer, r"^\w+://([^/?#:]+)", 1))
    first = lambda hits: reduce(lambda w, h: w.when(h[0], h[1]), hits[1:], F.when(hits[0][0], hits[0][1]))
    by_tag = first([(F.contains(tag, F.lit(h)), F.lit(h)) for h in hosts])
    return F.coalesce(by_tag, first([((host == h) | host.endswith(f".{h}"), F.lit(h)) for h in hosts]))
