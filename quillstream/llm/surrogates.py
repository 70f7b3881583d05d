"""PII surrogates (op 1): detected entities get keyed, type-consistent replacements. DataFrame operations only.

Entities: e-mail addresses, phone, card, social-security and account numbers (IBAN), IPv4 addresses,
hexadecimal and other secrets, street addresses, IPv6 addresses, given names and surnames. A replacement is drawn from a keyed hash of the
entity's canonical form and keeps type, script, letter case, punctuation and length class; cards that
pass the Luhn check, IBANs and octets stay valid; given names keep their gender; a mail domain is replaced
alike in all its addresses. Since the canonical form decides, an entity has one replacement in the whole
corpus however it is written (coreference), and a name found once in a text is also replaced where it
stands alone, written alike, in that text.

Collision check: over the table of distinct entities, a replacement that two entities of a kind share, or
that is itself an entity of the corpus, goes to the one that comes first; the others draw again, until all
are distinct.

Defined cases: a null text stays null, an empty or clean text stays as it is; rows that repeat a doc_id or
a text get the same result; very long texts are searched whole, in one pass; of entities that tie for a
replacement the first in order keeps it; an empty table gives an empty result; further columns are carried,
whatever their names, except pii_count and pii_kinds, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, settle

# Given names by script and gender, titles, kinds of streets, syllables of composed surnames.
GIVEN = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Angela Sophie Camille Juliette Chloé Manon Céline Aurélie Ingrid Heike Sabine Ursula Monika Katrin Lucía Carmen Sofía Pilar Dolores Valentina Gabriela Isabel".split(),
    ("latin", "m"): "James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Timothy Ronald Jason Edward Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Pierre Jacques Guillaume Mathieu Klaus Jürgen Wolfgang Stefan Uwe Carlos José Miguel Alejandro Javier Diego Pablo".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Галина Людмила".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел Виктор Борис Григорий".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora Sr Sra".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Square Terrace".split()
SYLLABLES = {
    "latin": "bal bor cal car dal den dor fal far gal gor hal har jal kel kor lan lor mal mar nel nor pal per quin ral ros sal sor tal tor val ver wal wen yor zel zan bri cle dun fen gil hol".split(),
    "cyrillic": "бал бор вал вер гал гор дал дор жал зел кал кор лан лор мал мар нел нор пал пер рал рос сал сор".split(),
}
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "", ("cyrillic", "f"): "а", ("cyrillic", "m"): ""}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_NAMES = "|".join(sorted((n for names in GIVEN.values() for n in names), key=lambda n: (-len(n), n)))
_TITLES = "|".join(TITLES)
_EDGE, _WORD = r"(?<![\p{L}\p{N}_])", r"\p{Lu}[\p{Ll}\p{M}'’-]{1,40}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,127}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|xox[bp])[-_][0-9A-Za-z_-]{16,})(?![0-9A-Za-z])|(?<=[=:\"']|[=:][ ])(?<=(?:password|passwd|secret|api_key|apikey)[ ]?[=:][ ]?[\"']?)[^\s\"'=:]{6,}",
    "hex": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ip6": r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])",
    "street": rf"(?<![\d.,])\d{{1,5}}[ ](?:\p{{Lu}}\p{{Ll}}{{1,30}}[ ]){{1,3}}(?:{'|'.join(STREETS)})(?![\p{{L}}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+-])\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,5}(?!\d|\.\d)|(?<!\d)\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "given": rf"{_EDGE}(?=\p{{Lu}})(?:{_NAMES})(?=[ ]{_WORD})",
    "surname": rf"(?=\p{{Lu}})(?<=[\p{{L}}.][ ])(?:(?<={_EDGE}(?:{_TITLES})\.?[ ]){_WORD}|(?<={_EDGE}(?:{_NAMES})[ ]){_WORD})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A quick first look: only texts with one of these are searched.
_LOOK = rf"[@\d=:]|AKIA|(?:sk|pk|ghp|xox[bp])[-_]|[a-fA-F]{{32}}|{_EDGE}(?=\p{{Lu}})(?:{_TITLES}|{_NAMES})"


def _kind(match: Column) -> Column:
    """The kind of a match, from the match alone; given names also tell gender and script."""
    whole = lambda k: match.rlike(rf"^(?:{PATTERNS[k]})$")
    out = F.when(match.contains("@"), "email")
    for k in ("hex", "iban", "ip", "ip6", "street", "ssn"):
        out = out.when(whole(k), k)
    out = out.when(match.rlike(r"^(?:AKIA|sk[-_]|pk[-_]|ghp[-_]|xox)"), "secret").when(match.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card").when(match.rlike(r"^[+(\d][\d .()+-]+$"), "phone")
    for (script, gender), names in GIVEN.items():
        out = out.when(match.isin(names), f"given_{gender}_{script}")
    return out.when(match.rlike(rf"^{_WORD}$"), F.when(match.rlike(r"\p{IsCyrillic}"), "surname_cyrillic").otherwise("surname_latin")).otherwise("secret")


def _canonical(kind: Column, match: Column) -> Column:
    numbers = kind.isin("card", "phone", "ssn", "iban")
    return F.when(numbers, F.upper(F.regexp_replace(match, "[^0-9A-Za-z]", ""))).when(kind == "secret", match).otherwise(F.lower(match))


def _pool(names: list[str]) -> Column:
    return F.array(*map(F.lit, names))


class _Draw:
    """A keyed stream of bytes for (kind, canonical form, attempt)."""

    def __init__(self, key: str, kind: Column, form: Column, attempt: Column):
        seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), form)
        self.hex = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|more")), 256))

    def byte(self, i: Column) -> Column:
        return F.conv(F.substr(self.hex, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def number(self, i: int) -> Column:
        return F.conv(F.substring(self.hex, 1 + 12 * i, 12), 16, 10).cast("long")


def _chars(form: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(form))), lambda i: F.struct(F.substr(form, i, F.lit(1)).alias("c"), (i - 1).alias("i")))


def _letters(alphabet: str, b: Column) -> Column:
    return F.substr(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _swap(form: Column, draw: _Draw) -> Column:
    """Every digit for a digit, every letter for one of its script, all else as it is."""

    def one(x: Column) -> Column:
        c, b = x["c"], draw.byte(x["i"])
        return (
            F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), _letters(ALPHABETS["latin"], b)).when(c.rlike("[A-Z]"), F.upper(_letters(ALPHABETS["latin"], b)))
            .when(c.rlike(r"\p{IsCyrillic}"), _letters(ALPHABETS["cyrillic"], b)).when(c.rlike(r"\p{IsGreek}"), _letters(ALPHABETS["greek"], b)).when(c.rlike(r"\p{L}"), _letters(ALPHABETS["latin"], b)).otherwise(c)
        )

    return F.array_join(F.transform(_chars(form), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last one is the check digit."""
    n = F.length(digits)
    value = lambda x: F.when((n - x["i"]) % 2 == 0, x["c"].cast("int") * 2 - F.when(x["c"].cast("int") > 4, 9).otherwise(0)).otherwise(x["c"].cast("int"))
    return F.aggregate(F.transform(_chars(digits), value), F.lit(0), lambda a, x: a + x)


def _replacement(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The replacement of a canonical form, in canonical form."""
    draw = _Draw(key, kind, form, attempt)
    digit = lambda i: (draw.byte(F.lit(i)) % 10).cast("string")
    swapped = _swap(form, draw)
    kept_first = F.concat(F.substring(form, 1, 1), F.substr(swapped, F.lit(2)))
    domain = F.substring_index(form, "@", -1)
    host, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.substring_index(domain, ".", -1)
    mail = F.concat(_swap(F.substring_index(form, "@", 1), draw), F.lit("@"), _swap(host, _Draw(key, F.lit("domain"), host, F.lit(0))), F.lit("."), top)
    front = F.substr(kept_first, F.lit(1), F.length(form) - 1)
    check = (10 - _luhn_sum(F.concat(front, F.lit("0"))) % 10) % 10
    card = F.when(_luhn_sum(form) % 10 == 0, F.concat(front, check.cast("string"))).otherwise(kept_first)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (draw.byte(i) % 254 + 1).cast("string")), ".")
    hexed = F.array_join(F.transform(_chars(form), lambda x: _letters("0123456789abcdef", draw.byte(x["i"]))), "")
    groups = F.array_join(F.transform(_chars(form), lambda x: F.when(x["c"] == ":", ":").otherwise(_letters("0123456789abcdef", draw.byte(x["i"])))), "")
    ssn = F.concat((draw.byte(F.lit(60)) % 8 + 1).cast("string"), F.substr(swapped, F.lit(2)))
    body, country = F.substr(swapped, F.lit(5)), F.substring(form, 1, 2)
    value = lambda x: F.when(x["c"].rlike("[0-9]"), x["c"]).otherwise((F.ascii(x["c"]) - 55).cast("string"))
    rest = F.aggregate(_chars(F.concat(body, country, F.lit("00"))), F.lit(0).cast("long"), lambda a, x: (a * F.when(x["c"].rlike("[0-9]"), 10).otherwise(100) + value(x).cast("long")) % 97)
    iban = F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)
    out = F.when(kind == "email", mail).when(kind == "card", card).when(kind == "ip", ip).when(kind == "hex", hexed).when(kind == "ip6", groups).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "phone", kept_first)
    composed = {}
    for script, syllables in SYLLABLES.items():
        part = lambda i, s=syllables: F.element_at(_pool(s), (draw.number(i) % len(s) + 1).cast("int"))
        more = [F.when(attempt >= 3 * k, part(2 + k)).otherwise("") for k in (1, 2)]
        composed[script] = F.concat(part(0), part(1), part(2), *more)
        out = out.when(kind == f"surname_{script}", composed[script])
    number = F.substr(swapped, F.lit(1), F.length(F.substring_index(form, " ", 1)))
    house = F.concat((draw.byte(F.lit(61)) % 9 + 1).cast("string"), F.substr(number, F.lit(2)))
    out = out.when(kind == "street", F.concat_ws(" ", house, composed["latin"], F.substring_index(form, " ", -1)))
    for (script, gender), names in GIVEN.items():
        pick = F.lower(F.element_at(_pool(names), (draw.number(0) % len(names) + 1).cast("int")))
        # A list that is used up is gone on with by composed names.
        out = out.when(kind == f"given_{gender}_{script}", F.when(attempt < 6, pick).otherwise(F.concat(composed[script], F.lit(ENDINGS[script, gender]))))
    return out.otherwise(swapped)


def _render(match: Column, kind: Column, new: Column) -> Column:
    """The replacement in the written form of the match."""
    at = lambda i: F.length(F.regexp_replace(F.substr(match, F.lit(1), i), "[^0-9A-Za-z]", ""))
    spots = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(match)))
    filled = F.array_join(F.transform(spots, lambda i: F.when(F.substr(match, i, F.lit(1)).rlike("[0-9A-Za-z]"), F.substr(new, at(i), F.lit(1))).otherwise(F.substr(match, i, F.lit(1)))), "")
    cased = F.array_join(F.transform(spots, lambda i: F.when(F.substr(match, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substr(new, i, F.lit(1)))).otherwise(F.substr(new, i, F.lit(1)))), "")
    return F.when(kind.isin("card", "phone", "ssn", "iban"), filled).when(kind.isin("email", "hex"), cased).when(kind.startswith("given") | kind.startswith("surname") | (kind == "street"), F.when(F.upper(match) == match, F.upper(new)).otherwise(F.initcap(new))).otherwise(new)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, new) for distinct (kind, form): distinct replacements, none of them an entity itself."""
    # A fixed number of partitions: drawing is costly per row and small in bytes, so adaptive merging would leave it to one task.
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(entities.select("kind", "form").distinct().withColumn("attempt", F.lit(0)).repartition(parts, "kind", "form"))
    while True:
        drawn = settle(rows.withColumn("new", _replacement(F.col("kind"), F.col("form"), F.col("attempt"), key)))
        first = drawn.groupBy("kind", "new").agg(F.min(F.struct("attempt", "form")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("kind", "new", F.col("first.form").alias("owner"))
        real = drawn.select("kind", F.col("form").alias("new"), F.lit(True).alias("real"))
        joined = drawn.join(first, ["kind", "new"], "left").join(real, ["kind", "new"], "left")
        judged = settle(joined.select("kind", "form", "attempt", "new", (F.coalesce(F.col("owner") != F.col("form"), F.lit(False)) | F.coalesce("real", F.lit(False))).alias("again")))
        if judged.filter("again").isEmpty():
            return judged.select("kind", "form", "new")
        rows = judged.select("kind", "form", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")).repartition(parts, "kind", "form")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text's entities replaced and the columns pii_count and pii_kinds (sorted) behind; columns of these names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("pii_count", "pii_kinds")])
    ref_name, new_name = free_names(docs, "ref", "new")
    text = F.col(f"`{text_col}`")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    none = [F.lit(0).alias("pii_count"), F.array().cast("array<string>").alias("pii_kinds")]
    # Texts that the first look clears are done; only the others are searched and joined.
    look = F.coalesce(text.rlike(_LOOK), F.lit(False))
    clean = docs.filter(~look).select(*columns, *none)
    ref = F.sha2(text, 256)
    spots = docs.filter(look).select(ref.alias("ref"), F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("at", "match")).distinct()
    spots = spots.withColumn("kind", _kind(F.col("match")))
    spots = settle(spots.withColumn("form", _canonical(F.col("kind"), F.col("match"))))
    new = assign(spots, key)
    placed = spots.join(new, ["kind", "form"]).select("ref", F.struct("at", _render(F.col("match"), F.col("kind"), F.col("new")).alias("new"), "match", F.split("kind", "_")[0].alias("kind")).alias("x"))
    per_text = settle(placed.groupBy(F.col("ref").alias(ref_name)).agg(F.array_sort(F.collect_list("x")).alias(new_name)))
    rows = docs.filter(look).withColumn(ref_name, ref).join(per_text, ref_name, "left")
    between, found = F.split(text, PATTERN, -1), F.col(new_name)
    put = F.concat(F.array_join(F.transform(found, lambda x: F.concat(F.get(between, x["at"]), x["new"])), ""), F.get(between, F.size(found)))
    names = F.array_distinct(F.transform(F.filter(found, lambda x: x["kind"].isin("given", "surname")), lambda x: F.struct(x["match"].alias("old"), x["new"].alias("new"))))
    # A name that was found is the same person where it stands alone in the text; a replacement is never replaced again, since none is a name of the corpus.
    put = F.aggregate(names, put, lambda t, s: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), s["old"], F.lit(r"\E(?![\p{L}\p{N}_])")), s["new"]))
    kinds = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["kind"])))
    hit = found.isNotNull()
    put, count = F.when(hit, put).otherwise(text), F.coalesce(F.when(hit, F.size(found)), F.lit(0))
    kinds = F.coalesce(kinds, F.array().cast("array<string>"))
    done = rows.select(*[put.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], count.alias("pii_count"), kinds.alias("pii_kinds"))
    return clean.unionByName(done)
