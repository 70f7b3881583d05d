"""Text expressions: folding, slugs, counts, strippers, escaping, URL and image-name helpers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "çğıöşüâîûáàäãåéèêëíìïóòôõúùñýÇĞİÖŞÜÂÎÛÁÀÄÃÅÉÈÊËÍÌÏÓÒÔÕÚÙÑÝ"
PLAIN = "cgiosuaiuaaaaaeeeeiiioooouunyCGIOSUAIUAAAAAEEEEIIIOOOOUUNY"
#: A word for the Unicode-aware count, and what separates the words of the other count.
WORD_RUN, BLANK_RUN = r"[\p{L}\p{N}_]+", r"\s+"
TAG = r"<[^>]+>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is worked out once and not wherever it stands, above all not once an element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def turkish_lower(c: Column | str) -> Column:
    """Lower case by Turkish rules: dotless and dotted i keep their dots."""
    return F.lower(F.translate(col(c), "İI", "iı"))


def fold(c: Column | str) -> Column:
    """ASCII folding of the accented letters above."""
    return F.translate(col(c), ACCENTED, PLAIN)


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """What the compatibility decomposition leaves of each non-ASCII sign of the basic plane in ASCII: (signs, the one sign each leaves, signs that leave several)."""
    one, several = {}, {}
    for code in range(0x80, 0x10000):
        left = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode() if not 0xD800 <= code < 0xE000 else ""
        if left:
            (one if len(left) == 1 else several)[chr(code)] = left
    return "".join(one), "".join(one.values()), several


_SIGNS, _LEFT, _SEVERAL = _decomposed()


def _ranges(signs: list[str], gap: int) -> str:
    """A pattern of few ranges that hold all the signs (and, with a gap, some others)."""
    codes, out = sorted(map(ord, signs)), []
    for code in codes:
        if out and code - out[-1][1] <= gap:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


_SEVERAL_ABOUT, _SEVERAL_CLASS = _ranges(list(_SEVERAL), 24), _ranges(list(_SEVERAL), 1)


def to_ascii(c: Column | str, turkish: bool = True) -> Column:
    """Dotless and dotted i as Turkish has them (unless told not to), every other sign by its decomposition, what has none goes.

    Signs that leave several letters (ligatures, fractions) are rare: only texts that hold one are taken apart.
    """
    s = F.translate(col(c), "çşığöüÇŞİĞÖÜ", "csigoucsigou") if turkish else col(c)
    table = F.create_map(*(F.lit(x) for pair in _SEVERAL.items() for x in pair))
    found = lambda s: F.array_distinct(F.regexp_extract_all(s, F.lit(f"({_SEVERAL_CLASS})")))
    s = let(s, lambda s: F.when(s.rlike(_SEVERAL_ABOUT), F.aggregate(found(s), s, lambda t, x: F.replace(t, x, F.try_element_at(table, x)))).otherwise(s))
    return F.regexp_replace(F.translate(s, _SIGNS, _LEFT), r"[^\x00-\x7F]", "")


def slug(c: Column | str, cut: int = 80, default: str | None = None) -> Column:
    """URL key: ASCII, lower, other signs than letters, digits, '_', '-' and blanks go, runs of blanks and '_' to '-' (dashes of the text stay), no dash at the ends, before and after the cut."""

    def made(t: Column) -> Column:
        s = F.regexp_replace(F.lower(to_ascii(t)), r"[^a-z0-9_\s\x1c-\x1f-]", "")
        return F.regexp_replace(F.regexp_replace(s, r"[\s\x1c-\x1f_]+", "-"), "^-+", "")

    # What follows the cut does not matter: where the beginning of a long text gives more than that, the rest is not read.
    def whole(t: Column, head: Column) -> Column:
        ends = lambda s: F.regexp_replace(s, "-+$", "")
        return F.when(F.length(head) > cut, head).when(F.length(t) <= 4 * cut, ends(head)).otherwise(ends(made(t)))

    s = let(col(c), lambda t: let(made(F.substring(t, 1, 4 * cut)), lambda head: whole(t, head)))
    s = F.regexp_replace(F.substring(s, 1, cut), "-+$", "")
    return s if default is None else let(s, lambda s: F.when(s != "", s).otherwise(F.lit(default)))


def strip_tags(c: Column | str, to: str = " ") -> Column:
    return F.regexp_replace(col(c), TAG, to)


def excerpt(c: Column | str, size: int = 200) -> Column:
    return F.trim(F.substring(strip_tags(c, ""), 1, size))


def count_runs(c: Column | str) -> Column:
    """Words as runs of letters, digits and '_'."""
    return F.regexp_count(col(c), F.lit(WORD_RUN))


def count_blank_separated(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"\S+"))


def dashes_to_commas(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s*(?:—|–|--)\s*", ", ")


def dashes_to_commas_strict(c: Column | str) -> Column:
    """The same for a text that keeps runs of three or more hyphens."""
    return F.regexp_replace(col(c), r"\s*(?:—|–|(?<!-)--(?!-))\s*", ", ")


def strip_caption_credit(c: Column | str) -> Column:
    """A credit at the end of a caption goes: in brackets, or behind a bar or 'Photo:'."""
    return F.trim(F.regexp_replace(col(c), r"(?i)\s*(?:\([^()]*(?:photo|image|credit|getty|reuters|afp|source)[^()]*\)|\|[^|]*|(?:photo|image|credit|source)s?\s*[:/].*)$", ""))


def rewrite_image(url: Column | str, pattern: Column, to: Column) -> Column:
    """The rewrite rule of a source, given as columns; a source without a rule keeps its URL."""
    return F.when(pattern.isNull(), col(url)).otherwise(F.regexp_replace(col(url), pattern, F.coalesce(to, F.lit(""))))


def strip_dateline(c: Column | str) -> Column:
    """'LONDON (Agency) — ' or 'LONDON, 3 May (Agency), ' goes at the start of a text or of its first paragraph; a bare dash is no dateline."""
    return F.regexp_replace(col(c), r"^(<p[^>]*>)?\s*\p{Lu}[\p{L}\s/-]{1,40}(?:,\s*[\p{L}\p{N}_\s]+?)?\s*\([\p{L}\s/.-]{2,50}\)\s*[,–—-]\s*", "$1")


def untranslated(translated: Column | str, original: Column | str) -> Column:
    """Equal to the original (both missing included), or empty."""
    return col(translated).eqNullSafe(col(original)) | (F.coalesce(col(translated), F.lit("")) == "")


def strip_label(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?i)\b(?:summary|özet|résumé|resumo)\s*:\s*", "")


def strip_byline(c: Column | str) -> Column:
    """Lines that hold only an author or only a date go; runs of blank lines become one."""
    c = F.regexp_replace(col(c), r"(?m)^(?:By|Par|Por|Yazan)[ :][^\n]{1,60}$", "")
    c = F.regexp_replace(c, r"(?m)^\d{1,2}[ ./-]\w{2,12}[ ./-]\d{4}$", "")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def cap_title(c: Column | str, size: int = 120) -> Column:
    """Cut at the last whole word within the size."""
    c = col(c)
    return F.when(F.length(c) > size, F.regexp_replace(F.regexp_replace(F.substring(c, 1, size), r"\s+\S*$", ""), r"[ ,;:.-]+$", "")).otherwise(c)


def meta_band(c: Column | str) -> Column:
    n = F.length(col(c))
    return F.when(n.between(135, 160), "ideal").when(n.between(105, 170), "safe").otherwise("out")


def cut_at_sentence(c: Column | str, words: int) -> Column:
    """The first words of a text up to the last sentence end among them; without one the whole text."""
    parts = F.split(F.trim(col(c)), r"\s+")
    head = F.array_join(F.slice(parts, 1, words), " ")
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when((F.size(parts) > words) & (cut != ""), cut).otherwise(col(c))


def cap_words(c: Column | str, words: int = 15) -> Column:
    parts = F.split(F.trim(col(c)), r"\s+")
    return F.when(F.size(parts) > words, F.array_join(F.slice(parts, 1, words), " ")).otherwise(col(c))


def wrap_paragraphs(c: Column | str) -> Column:
    """Blocks between blank lines become paragraphs."""
    blocks = F.filter(F.transform(F.split(col(c), r"\n\s*\n"), lambda b: F.trim(b)), lambda b: b != "")
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("<p>"), b, F.lit("</p>"))), "\n")


def regroup_sentences(c: Column | str, groups: int = 5, least_words: int = 180) -> Column:
    """A long single paragraph is cut into about ``groups`` paragraphs of whole sentences."""
    sentences = F.filter(F.split(col(c), r"(?<=[.!?])\s+"), lambda s: s != "")
    n = F.size(sentences)
    each = F.greatest(F.lit(1), F.ceil(n / groups).cast("int"))
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n), each)).otherwise(F.array(F.lit(1)))
    cut = F.transform(starts, lambda at: F.array_join(F.slice(sentences, at, each), " "))
    return F.when(count_blank_separated(c) >= least_words, F.array_join(cut, "\n\n")).otherwise(col(c))


def fix_words(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Ordered (pattern, replacement) rules."""
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, col(c))


def drop_promotions(c: Column | str, pattern: str = r"(?i)(?:subscribe|newsletter|read more|follow us|sign up|abonnez|inscreva)", most: int = 500) -> Column:
    """Blocks shorter than ``most`` that match go; the rest keep their order."""
    blocks = F.split(col(c), r"\n\s*\n")
    return F.array_join(F.filter(blocks, lambda b: ~((F.length(b) < most) & b.rlike(pattern))), "\n\n")


def escape_xml(c: Column | str) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, col(c))


def first_email(c: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(col(c), "(?i)mailto:", ""), r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1)


def reference_number(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"(?i)\b(?:ref|n[o°º]|réf)[.:]?\s*([A-Z0-9][A-Z0-9/_-]{3,})", 1)


def value_after_label(parts: Column, label: str) -> Column:
    """The element behind the first one that holds the label."""
    at = F.array_position(F.transform(parts, lambda p: F.contains(F.lower(p), F.lit(label.lower()))), True)
    return F.when(at > 0, F.trim(F.get(parts, at.cast("int"))))


def append_citation(body: Column | str, url: Column | str, marker: str = "Source:") -> Column:
    return F.when(F.contains(col(body), F.lit(marker)), col(body)).otherwise(F.concat(col(body), F.lit(f"\n\n{marker} "), col(url)))


def remove_figures(c: Column | str, css: str = "injected") -> tuple[Column, Column]:
    """(text without the injected figures, how many there were)."""
    pattern = rf'(?s)<figure class="{css}">.*?</figure>'
    return F.regexp_replace(col(c), pattern, ""), F.regexp_count(col(c), F.lit(pattern))


# What says nothing about a picture, as the whole of a text of one or two words; a number may have words behind it.
FILLERS = r"photo|image|picture|img|banner|file photo|ap photo|reuters|afp|epa|getty|handout|archive|file|stock photo|stock|generic|illustration|logo|video|thumbnail|cover|hero|featured|foto|fotografia|imagem|imagen|légende|legenda|sans légende|sem legenda|arquivo|fichier|photo d'archive|destaque|\d+[\w\s]*"


def generic_alt(c: Column | str) -> Column:
    """Missing, under 5 signs, or a filler of at most two words."""
    c = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")
    return (F.length(c) < 5) | ((count_blank_separated(c) <= 2) & c.rlike(rf"(?iU)^(?:{FILLERS})$"))


def contradicts(a: Column | str, b: Column | str, pairs: tuple[tuple[str, str], ...]) -> Column:
    """One text has one word of a pair of opposites, the other text the other."""
    x, y = F.lower(fold(a)), F.lower(fold(b))
    hits = [(F.contains(x, F.lit(p)) & F.contains(y, F.lit(q))) | (F.contains(x, F.lit(q)) & F.contains(y, F.lit(p))) for p, q in pairs]
    return reduce(lambda m, n: m | n, hits)


def image_stem(c: Column | str) -> Column:
    """File name without query, extension, size or '-scaled', lower-cased."""
    name = F.regexp_replace(F.substring_index(F.regexp_replace(col(c), r"[?#].*$", ""), "/", -1), r"\.[A-Za-z0-9]{2,5}$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"-\d+x\d+$", ""), "-scaled$", ""))


def variant_widths(width: Column | str, ladder: tuple[int, ...] = (400, 800, 1200)) -> Column:
    w = col(width)
    below = F.filter(F.array(*map(F.lit, ladder)), lambda x: x < w)
    return F.array_sort(F.array_distinct(F.array_append(below, F.least(w, F.lit(ladder[-1])).cast("int"))))


def srcset(url: Column | str, widths: Column) -> Column:
    stem, ext = F.regexp_replace(col(url), r"\.[A-Za-z0-9]+$", ""), F.lit(".webp")
    return F.array_join(F.transform(widths, lambda w: F.concat(stem, F.lit("-"), w.cast("string"), ext, F.lit(" "), w.cast("string"), F.lit("w"))), ", ")


def storage_path(source: Column | str, at: Column | str, item: Column | str, name: Column | str) -> Column:
    safe = F.regexp_replace(F.lower(col(name)), r"[^a-z0-9._-]+", "-")
    return F.concat_ws("/", col(source), F.date_format(col(at), "yyyy"), F.date_format(col(at), "MM"), col(item).cast("string"), safe)


def object_paths(c: Column | str, root: str) -> Column:
    """All storage paths under ``root`` that a text mentions."""
    return F.regexp_extract_all(col(c), F.lit(rf"{root}/([A-Za-z0-9/_.-]+)"), F.lit(1))
