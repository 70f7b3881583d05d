"""Dates, money, hashes, arrays and JSON as Column expressions. ``now`` is always a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Formats tried in this order; conversion rates to US dollars.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy", "dd-MMM-yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "dd-MM-yyyy", "MMMM d, yyyy")
RATES = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "CHF": 1.12}


def parse_date(c: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits; a leading weekday is dropped, a zone's name for UTC is read as its offset, a missing zone is the session's (UTC)."""
    text = F.regexp_replace(F.trim(col(c)), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", "")
    text = F.regexp_replace(text, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def embedded_date(c: Column | str) -> Column:
    """dd-MM-yyyy anywhere in a text."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(col(c), r"(\d{2}-\d{2}-\d{4})", 1), F.lit("")), F.lit("dd-MM-yyyy"))


def zoned_date(c: Column | str) -> Column:
    """'28-Apr-2026 00:00 (GMT -4.00)': the offset is taken off."""
    base = F.try_to_timestamp(F.nullif(F.regexp_extract(col(c), r"(\d{1,2}-[A-Za-z]{3}-\d{4} \d{2}:\d{2})", 1), F.lit("")), F.lit("d-MMM-yyyy HH:mm"))
    hours = F.coalesce(F.expr(f"try_cast(nullif(regexp_extract({_sql(c)}, 'GMT ([+-]?[0-9]+(?:[.][0-9]+)?)', 1), '') as double)"), F.lit(0.0))
    return F.timestamp_micros((F.unix_micros(base) - hours * 3_600_000_000).cast("long"))


def meridiem_date(c: Column | str, offset_hours: int = -4) -> Column:
    """'13-May-26 @ 10:00 AM (New York time)'; a year glued to the hour ('14-May-2610:00') is taken apart; 24-hour times fall back to the date."""
    text = F.regexp_replace(col(c), r"(\d{1,2}-[A-Za-z]{3}-\d{2})(\d{2}:\d{2})", "$1 $2")
    day = F.nullif(F.regexp_extract(text, r"(\d{1,2}-[A-Za-z]{3}-\d{2})", 1), F.lit(""))
    time = F.nullif(F.regexp_extract(text, r"(\d{1,2}:\d{2} [AP]M)", 1), F.lit(""))
    stamped = F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("d-MMM-yy h:mm a"))
    return F.when(time.isNotNull(), F.timestamp_micros(F.unix_micros(stamped) - F.lit(offset_hours * 3_600_000_000))).otherwise(F.try_to_timestamp(day, F.lit("d-MMM-yy")))


def _sql(c: Column | str) -> str:
    if not isinstance(c, str):
        raise TypeError("a column name is needed here")
    return f"`{c}`"


def run_slot(ts: Column | str, zone: str = "Europe/Istanbul") -> Column:
    return F.when(F.hour(F.from_utc_timestamp(col(ts), zone)) < 12, "sabah").otherwise("oglen")


def rfc822(ts: Column | str) -> Column:
    return F.concat(F.date_format(col(ts), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


# Month names of display dates.
MONTHS = "Ocak Şubat Mart Nisan Mayıs Haziran Temmuz Ağustos Eylül Ekim Kasım Aralık".split()


def display_date(ts: Column | str) -> Column:
    return F.concat_ws(" ", F.dayofmonth(col(ts)).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(col(ts))), F.year(col(ts)).cast("string"))


def countdown(now: Column, deadline: Column) -> Column:
    left = F.greatest(F.lit(0), (F.unix_micros(deadline) - F.unix_micros(now)) / 1_000_000).cast("long")
    return F.struct((left / 86400).cast("long").alias("days"), (left % 86400 / 3600).cast("long").alias("hours"), (left % 3600 / 60).cast("long").alias("minutes"), (left % 60).alias("seconds"), (deadline <= now).alias("expired"))


def tender_status(now: Column, starts: Column, deadline: Column) -> Column:
    return F.when(deadline < now, "expired").when(starts > now, "planned").otherwise("active")


def progress(now: Column, starts: Column, ends: Column) -> Column:
    """Share of the time that has passed, in percent, with its band."""
    span = F.unix_micros(ends) - F.unix_micros(starts)
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (F.unix_micros(now) - F.unix_micros(starts)) / F.nullif(span, F.lit(0))))
    return F.struct(share.alias("percent"), F.when(share >= 85, "late").when(share >= 60, "middle").otherwise("early").alias("band"))


def in_window(now: Column, deadline: Column, published: Column, days: int = 7) -> Column:
    """A deadline ahead, or published lately, or neither known."""
    recent = published >= now - F.expr(f"interval {days} days")
    return F.coalesce(deadline > now, F.lit(False)) | F.coalesce(recent, F.lit(False)) | (deadline.isNull() & published.isNull())


def modified_date(published: Column, scraped: Column, updated: Column, minutes: int = 10) -> Column:
    return F.when(updated > scraped + F.expr(f"interval {minutes} minutes"), updated).otherwise(published)


# How an amount stands with its currency, in order of precedence; '#' is an amount with an optional multiplier.
MONEY = [("US?\\$\\s*#", "USD"), ("#\\s*USD", "USD"), ("USD\\s*#", "USD"), ("€\\s*#", "EUR"), ("#\\s*EUR(?:O)?", "EUR"), ("EUR\\s*#", "EUR"), ("£\\s*#", "GBP"), ("GBP\\s*#", "GBP"), ("CHF\\s*#", "CHF")]


def budget_usd(text: Column | str, rates: dict[str, float] | None = None) -> Column:
    """Money in a text, in dollars: the first way of writing whose first match is a valid amount (over 0, at most 10^12 before conversion) counts."""
    found = []
    for form, currency in MONEY:
        pattern = "(?i)" + form.replace("#", r"([0-9,.]+)\s*(million|billion|M|B)?")
        word = F.lower(F.regexp_extract(col(text), pattern, 2))
        times = F.when(word.isin("billion", "b"), 1e9).when(word.isin("million", "m"), 1e6).otherwise(1.0)
        amount = F.nullif(F.replace(F.regexp_extract(col(text), pattern, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("double") * times
        found.append(F.when((amount > 0) & (amount <= 1e12), F.bround(amount * (rates or RATES)[currency], 2)))
    return F.coalesce(*found)


def md5_mod(c: Column | str, n: int) -> Column:
    """The md5 of a text, read as a 128-bit number, modulo n (n under 2^31)."""
    digest = F.md5(col(c))
    words = [F.conv(F.substring(digest, i, 8), 16, 10).cast("long") for i in (1, 9, 17, 25)]
    return reduce(lambda a, w: (a * 4294967296 + w) % n, words, F.lit(0).cast("long"))


def hex_words(c: Column | str, digits: int = 64) -> Column:
    """A hexadecimal hash as numbers of 8 digits each."""
    return F.array(*(F.conv(F.substring(col(c), i, 8), 16, 10).cast("long") for i in range(1, digits, 8)))


def differing_bits(a: Column, b: Column, digits: int = 64) -> Column:
    """Bits that differ between two hashes as ``hex_words`` gives them."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(digits // 8)))


def hamming_hex(a: Column | str, b: Column | str, digits: int = 64) -> Column:
    """Bits that differ between two hexadecimal hashes, 8 digits at a time."""
    word = lambda c, i: F.conv(F.substring(col(c), i, 8), 16, 10).cast("long")
    return reduce(lambda x, y: x + y, (F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(1, digits, 8)))


def budget_simple(text: Column | str) -> Column:
    """An amount with an optional 'million', no currency: null where there is none."""
    amount = F.regexp_replace(F.regexp_extract(col(text), r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "")
    return F.nullif(amount, F.lit("")).try_cast("double") * F.when(F.lower(col(text)).contains("million"), 1_000_000.0).otherwise(1.0)


def remap(tags: Column | str, changes: dict[str, str | None]) -> Column:
    """Distinct sorted array after a mapping; what maps to None goes, an empty array stays empty."""
    pairs = [x for k, v in changes.items() for x in (F.lit(k), F.lit(v))]
    table = F.create_map(*pairs)
    keys = F.array(*map(F.lit, changes))
    mapped = F.transform(col(tags), lambda t: F.when(F.array_contains(keys, t), table[t]).otherwise(t))
    return F.array_sort(F.array_distinct(F.filter(mapped, lambda t: t.isNotNull())))


def allow(tags: Column | str, allowed: list[str], most: int) -> Column:
    return F.slice(F.filter(col(tags), lambda t: t.isin(allowed)), 1, most)


def rotate(items: Column, by: Column) -> Column:
    n = F.size(items)
    at = F.pmod(by, n).cast("int")
    return F.concat(F.slice(items, at + 1, n), F.slice(items, F.lit(1), at))


def reading_minutes(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(col(c), F.lit(""))) / 1500).cast("int"))


def clamp(c: Column | str, low: int = 1, high: int = 10) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def json_number(text: str, field: str, default: int) -> Column:
    """A number from a model's reply: strict JSON first, then the field by pattern, then any number, then the default."""
    block = F.regexp_extract(F.col(text), r"(?s)(\{.*?\})", 1)
    strict = F.from_json(block, f"`{field}` int")[field]
    loose = F.expr(f"""try_cast(nullif(regexp_extract(`{text}`, '"?{field}"?\\\\s*[:=]\\\\s*"?([0-9]+)', 1), '') as int)""")
    bare = F.expr(f"try_cast(nullif(regexp_extract(`{text}`, '\\\\b([0-9]+)\\\\b', 1), '') as int)")
    return F.coalesce(strict, loose, bare, F.lit(default))
