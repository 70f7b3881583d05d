"""The registry that ships: sources of news and of notices as rows of rules (``sources.rules``), and the fields that any article may have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .rules import RULES_DDL


def _listing(source: str, row: str, following: str, fields: dict[str, list[tuple[str, str]]], required: tuple[str, ...] = ()) -> list[tuple]:
    out = [(source, "row", None, 0, row, None), *((source, "required", f, 0, None, None) for f in required)]
    out += [(source, "next", None, k, s, None) for k, s in enumerate([following] if following else [])]
    return out + [(source, "field", f, k, s, take) for f, rules in fields.items() for k, (s, take) in enumerate(rules)]


def _page(source: str, fields: dict[str, list[tuple[str, str]]]) -> list[tuple]:
    return [(source, "page", f, k, s, take) for f, rules in fields.items() for k, (s, take) in enumerate(rules)]


def _index(source: str, include: str, exclude: str | None = None, rewrite: tuple[str, str] | None = None, dates: tuple[str, ...] = (), alts: tuple[str, ...] = ()) -> list[tuple]:
    out = _listing(source, "a[href]", "", {"href": [("a", "@href")], "title": [("a", "texts")]})
    out += [(source, "include", None, 0, include, None)] + ([(source, "exclude", None, 0, exclude, None)] if exclude else []) + ([(source, "rewrite", None, 0, *rewrite)] if rewrite else [])
    out += _page(source, {"published_at": [*ARTICLE["published_at"], *((s, "texts") for s in dates)]}) if dates else []
    return out + (_page(source, {"alt": [(s, "@alt") for s in alts] + [("meta[property='og:image:alt']", "@content")]}) if alts else [])


# Where an article's fields are looked for, in order.
ARTICLE = {
    "title": [("meta[property='og:title']", "@content"), ("headline", "ld"), ("name", "ld"), ("h1", "texts")],
    "published_at": [("meta[property='article:published_time']", "@content"), ("datePublished", "ld"), ("uploadDate", "ld"), ("time[datetime]", "@datetime")],
    "author": [(".author-name a, .byline-name", "text"), ("[rel='author']", "text"), ("meta[name='author']", "@content")],
    "image": [("meta[property='og:image']", "@content"), ("figure img", "@src")],
    "alt": [("figure img", "@alt"), ("meta[property='og:image:alt']", "@content")],
    "credit": [("figcaption, .image-credit", "text")],
}

# Renditions of pictures and the largest one, which differs by site; dates in the text of one publishing system.
_TO_GENERIC, _TO_XL = (r"_(XS|S|M|L|XL)\.jpg$", "_Generic.jpg"), (r"_(XS|S|M|L|Generic)\.jpg$", "_XL.jpg")
_TEXT_DATES = (".itemDateCreated", ".itemDate")

# Addresses of articles on index pages.
NEWS = [
    *_index("the_conversation", r"theconversation\.com/[\w-]+-\d+$"),
    *_index("cnbc_africa", r"cnbcafrica\.com/20\d{2}/[a-z0-9-]+/?$"),
    *_index("aa_africa", r"aa\.com\.tr/en/africa/[\w-]+/\d+$"),
    *_index("business_insider", r"africa\.businessinsider\.com/local/[a-z-]+/[a-z0-9-]+/[a-z0-9]+$"),
    *_index("ecofin", r"ecofinagency\.com/[a-z-]+/\d+-\d+-[a-z0-9-]+$", rewrite=_TO_GENERIC, dates=_TEXT_DATES, alts=("figure img", ".itemImage img")),
    *_index("business_in_cameroon", r"businessincameroon\.com/[a-z-]+/\d+-\d+-[a-z0-9-]+$", rewrite=_TO_XL, dates=_TEXT_DATES, alts=("figure img", ".itemImage img")),
    *_index("new_times_rwanda", r"newtimes\.co\.rw/article/\d+/[\w/-]+$"),
    *_index("africa_report", r"theafricareport\.com/\d+/[\w-]+/?$", alts=(".article-featured-image img", "figure img")),
]

_HREF = {"href": [("a", "@href")], "title": [("a", "texts")]}
# Listings of notices.
NOTICES = [
    *_listing("world_bank", "table.procurement-table tbody tr, div.procurement-notice, li.notice-item", "a.next, a[rel='next'], li.next a", _HREF | {"deadline_at": [(".closing-date, td:nth-child(4), .deadline", "text")], "published_at": [(".published-date, td:nth-child(3), .pub-date", "text")]}),
    *_page("world_bank", {"title": [("h1.notice-title, h1", "text"), ("meta[property='og:title']", "@content")], "description": [("div.notice-description, div.project-description, div.content-body", "texts")], "reference": [(".notice-number, .contract-id, .procurement-id", "text")], "institution": [("World Bank", "const")],
                          "country": [(".country-name, .borrower-country, td.country", "text")], "published_at": [("time", "@datetime"), (".publication-date, .date", "text")], "deadline_at": [(".closing-date, .deadline, .submission-date", "text")]}),
    *_listing("undp", "table.table tbody tr, div.procurement-item, tr.notice-row", "a[rel='next'], li.next a, a.next-page", _HREF | {"deadline_at": [("td.deadline, td:nth-child(4), .closing", "text")], "published_at": [("td.published, td:nth-child(3), .pub-date", "text")]}),
    *_page("undp", {"title": [("h1.notice-title, h1.title, h1", "text"), ("meta[property='og:title']", "@content")], "description": [("div.notice-body, div.description, div.content", "texts")], "reference": [(".reference, .notice-ref, .contract-id", "text")], "institution": [(".organization, .agency, .department", "text"), ("UNDP", "const")],
                    "country": [(".country, .location, td.country", "text")], "published_at": [("time", "@datetime"), (".publication-date, .posted-date", "text")], "deadline_at": [(".deadline, .closing-date, .submission-deadline", "text")]}),
    *_listing("ungm", "table.tableNotices tbody tr, div.notice-row, tr.contract-notice", "a[rel='next'], a.next, li.next a", _HREF | {"deadline_at": [("td.deadline, td.deadlineDate, td:nth-child(5)", "text")], "published_at": [("td.published, td.publicationDate, td:nth-child(4)", "text")]}),
    *_page("ungm", {"title": [("h1.notice-title, h2.title, h1", "text"), ("meta[property='og:title']", "@content"), (".noticeTitle", "text")], "description": [("div.notice-description, div.noticeDescription, div.description", "texts")], "reference": [(".referenceNo, .notice-reference, .contract-number", "text")],
                    "institution": [(".procuringEntity, .agency, .un-organization, .organization", "text"), ("United Nations", "const")], "country": [(".country, .deliveryLocation, .location", "text")], "published_at": [("time", "@datetime"), (".publicationDate, .published-date", "text")]}),
    *_listing("african_union", "table.views-table tbody tr", "li.pager__item--next a, a[rel='next']", {"href": [("td.views-field-title a", "@href")], "title": [("td.views-field-title a", "texts")], "deadline_at": [("td.views-field-field-date span.date-display-single", "text")], "reference": [("td.views-field-field-text-bidnumber", "text")], "bid_type": [("td.views-field-field-tags-documents a", "text")]}),
    *_page("african_union", {"title": [("h1.page-header, h1.node__title, h1", "text"), ("meta[property='og:title']", "@content")], "description": [("div.field--name-body, div.node__content, div.content", "texts")], "reference": [(".field--name-field-reference, .reference-number", "text")], "institution": [("African Union Commission", "const")], "country": [("Africa", "const")]}),
    *_listing("burkina", "div.job", "a[rel='next'], ul.pagination li.active + li a", {"href": [("a.job-title", "@href")], "title": [("a.job-title", "text")], "deadline_at": [("small.expire-date", "texts")], "institution": [("small.societe", "text")], "country": [("small.offre-localisation", "text"), ("Burkina Faso", "const")]}),
    *_page("burkina", {"title": [("h1, h2.job-title", "text"), ("meta[property='og:title']", "@content")], "description": [("div.job-description, div.content, article", "texts")]}),
    *_listing("ghana", "table#T01 tr:not(:first-child)", "div.Pagination a:last-child", {"href": [("td:nth-child(2) a", "@href")], "title": [("td:nth-child(2) a", "text")], "institution": [("td:nth-child(3)", "text")], "deadline_at": [("td:nth-child(5)", "texts")], "status": [("td:nth-child(7)", "texts")], "document": [("td:nth-child(8) a", "@href")], "published_at": [("td:nth-child(9)", "texts")]}, required=("title",)),
    *_page("ghana", {"title": [("h1, h2.tender-title", "text"), ("meta[property='og:title']", "@content")], "description": [("div.tender-description, td.notice-content, div.content", "texts")], "reference": [(".reference, .notice-ref, td.ref", "text")]}),
]

#: The rules of source ``*`` hold for every source that has none of its own for a field.
RULES = [*_page("*", ARTICLE), *NEWS, *NOTICES]


def shipped(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULES_DDL)
