"""PII surrogates: format, validity, distinctness, coreference."""

import re

import pytest

from quillstream.llm import surrogates


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


TEXTS = {
    1: "mail Jürgen.67@mail7.example.com or JÜRGEN.67@mail7.example.com now, also other@mail7.example.com.",
    2: "call +1 (803) 555-5351 or +1-803-555-5351, pay 4111 1111 1111 1111 or 4111111111111112",
    3: 'from 146.47.206.184 token = "7f5790b897549908038b7daaf9a2684b46e90db0" and SSN 123-45-6789',
    4: "Mary Smithson met Dr. Kowalski. Smithson left; MARY stayed with Robert Kowalski.",
    5: "IBAN DE89 3704 0044 0532 0130 00 ends.",
    6: "Clean text, with 1234 numbers 3.14 and 10:30.",
    7: None,
    8: "",
    10: "at 221 Baker Hill Street or +33 1 23 45 67 89, host 2001:0db8:85a3:0000:0000:8a2e:0370:7334.",
    9: "Анна Петрова пришла",
}


@pytest.fixture(scope="module")
def out(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS.items()] + [(2, TEXTS[2], "x")], "doc_id long, text string, kind string")
    got = surrogates.replace(docs, "secret key")
    assert got.columns == ["doc_id", "text", "kind", "pii_count", "pii_kinds"]
    rows = got.collect()
    assert len(rows) == 11
    assert len({r["text"] for r in rows if r["doc_id"] == 2}) == 1
    return {r["doc_id"]: r for r in rows}


def test_clean_and_empty_texts_stay(out):
    for i in (6, 7, 8):
        assert out[i]["text"] == TEXTS[i] and out[i]["pii_count"] == 0


def test_mail_keeps_form_case_and_shared_domain(out):
    a, b, c = re.findall(r"\S+@[\w.]+\w", out[1]["text"])
    assert a.lower() == b.lower() and a != b and "67" not in a.split("@")[0][-2:] or a != "Jürgen.67@mail7.example.com"
    assert a.split("@")[1] == c.split("@")[1] != "mail7.example.com" and a.endswith(".com")
    assert re.fullmatch(r"[A-Z][a-z]{5}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", a)


def test_numbers_keep_form_and_validity(out):
    m = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1-\d{3}-\d{3}-\d{4}), pay (\d{4} \d{4} \d{4} \d{4}) or (\d{16})", out[2]["text"])
    assert re.sub(r"\D", "", m[1]) == re.sub(r"\D", "", m[2]) != "18035555351"
    assert luhn(m[3]) and m[3] != "4111 1111 1111 1111" and m[4] != "4111111111111112"
    m = re.fullmatch(r'from (\d+\.\d+\.\d+\.\d+) token = "([0-9a-f]{40})" and SSN (\d{3}-\d{2}-\d{4})', out[3]["text"])
    assert m and all(1 <= int(x) <= 254 for x in m[1].split(".")) and m[3] != "123-45-6789"
    m = re.fullmatch(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) ends\.", out[5]["text"])
    s = m[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 and s != "DE89370400440532013000"


def test_places_and_hosts(out):
    m = re.fullmatch(r"at (\d{3}) ([A-Z][a-z]+) Street or (\+3\d \d \d\d \d\d \d\d \d\d), host ([0-9a-f]{4}(?::[0-9a-f]{4}){7})\.", out[10]["text"])
    assert m and m[3] != "+33 1 23 45 67 89" and "db8" not in m[4]


def test_names_keep_gender_script_and_coreference(out):
    m = re.fullmatch(r"(\w+) (\w+) met Dr\. (\w+)\. (\w+) left; MARY stayed with (\w+) (\w+)\.", out[4]["text"])
    assert m[1] in surrogates.GIVEN["latin", "f"] and m[5] in surrogates.GIVEN["latin", "m"]
    assert m[2] == m[4] != "Smithson" and m[3] == m[6] != "Kowalski"
    first, second, _ = out[9]["text"].split(" ")
    assert first in surrogates.GIVEN["cyrillic", "f"] and re.fullmatch("[А-Я][а-я]+", second)


def test_collisions_are_drawn_again(spark):
    forms = [("ip", f"10.{i // 250}.7.{i % 250}") for i in range(3000)] + [(f"given_f_latin", n.lower()) for n in surrogates.GIVEN["latin", "f"]] + [("ssn", f"{i:09d}") for i in range(2000)]
    got = surrogates.assign(spark.createDataFrame(forms, "kind string, form string"), "k").collect()
    assert len(got) == len(forms) == len({(r["kind"], r["new"]) for r in got})
    assert not {(r["kind"], r["new"]) for r in got} & set(forms)


def test_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    done = surrogates.replace(docs, "k")
    assert "Python" not in done._jdf.queryExecution().toString()
    left = done.filter(done.text.rlike(r"mail\d\.example\.com|\+1 \(\d{3}\) 555-")).count()
    assert done.count() == docs.count() and left == 0


def test_every_entity_of_the_table_against_another_reading(spark):
    """What ``regex`` finds with the same patterns is replaced, everything between stays, and replacements are a function of the entity."""
    import regex

    pattern = regex.compile(surrogates.PATTERN)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    after = {r["doc_id"]: r for r in surrogates.replace(docs, "k").collect()}
    assert set(before) == set(after)
    drawn = {}
    for i, text in before.items():
        spots = list(pattern.finditer(text)) if regex.search(surrogates._LOOK, text) else []
        assert after[i]["pii_count"] == len(spots)
        if not spots:
            assert (after[i]["text"] or "") == text
            continue
        ends = [0, *(m.end() for m in spots)]
        between = [regex.escape(text[a:b]) for a, b in zip(ends, [*(m.start() for m in spots), len(text)], strict=True)]
        names = {m[0] for m in spots if regex.fullmatch(surrogates._WORD, m[0])}
        for n in names:
            between = [regex.sub(rf"(?<![\p{{L}}\p{{N}}_]){n}(?![\p{{L}}\p{{N}}_])", r"[\\p{L}]+", b) for b in between]
        found = regex.fullmatch("(?s)" + "(.+?)".join(between), after[i]["text"])
        assert found, i
        for m, new in zip(spots, found.groups(), strict=True):
            # Names depend on their kind too, and lazily matched groups are only told apart by their surroundings.
            if m[0] not in names and "@" in m[0]:
                assert drawn.setdefault(m[0].lower(), new.lower()) == new.lower() and new != m[0]


def test_long_secrets_and_names_alone(spark):
    token = "eyJ" + "aB3_" * 80
    texts = [f"api_key={token} end", "f" * 200, "sk-" + "q1W" * 60, "Mary Smithson came. Then Mary left.", "Марина, Анна Петрова и Анна"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in surrogates.replace(docs, "k").collect()}
    assert "aB3_" not in got[0] and len(got[0]) == len(texts[0]) and got[0].endswith(" end")
    assert "ffff" * 5 not in got[1] and len(got[1]) == 200 and "q1Wq1W" not in got[2]
    assert "Mary" not in got[3] and got[3].split()[0] == got[3].split()[4] and "Анна" not in got[4] and got[4].startswith("Марина, ")


def test_composed_given_names_keep_gender(spark):
    names = [n.lower() for g in surrogates.GIVEN.values() for n in g]
    forms = [(f"given_{g}_{s}", n.lower()) for (s, g), own in surrogates.GIVEN.items() for n in own]
    got = surrogates.assign(spark.createDataFrame(forms, "kind string, form string"), "k").collect()
    assert not {r["new"] for r in got if r["new"] in names and r["kind"].endswith("cyrillic")}
    for r in got:
        if r["kind"].startswith("given_f"):
            assert r["new"].endswith("а" if r["kind"].endswith("cyrillic") else "a") or r["new"] in names
