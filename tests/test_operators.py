"""Worked examples and properties of the operators that the catalogue does not reach."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import values as V
from quillstream.operators import changes, gates, metrics, reads, search, similarity
from quillstream.sources import files, html


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (T.slug, "Gâna'da kakao fiyatları ARTTI!  çok_iyi", "ganada-kakao-fiyatlari-artti-cok-iyi"),
        (lambda c: T.slug(c, 10), "abcdefghi jkl", "abcdefghi"),
        (lambda c: T.slug(c, default="tender"), "!!!", "tender"),
        (T.strip_dateline, "LONDON (Reuters) — Text", "Text"),
        (T.image_stem, "https://x/a/rand2-820x615.jpg?q", "rand2"),
        (T.image_stem, "https://x/a/3I3A-scaled.jpg", "3i3a"),
        (T.cap_title, "a" * 100 + " " + "b" * 30 + ", c", "a" * 100),
        (lambda c: T.cut_at_sentence(c, 4), "One two. Three four five six", "One two."),
        (T.escape_xml, "a&<b>\"'", "a&amp;&lt;b&gt;&quot;&apos;"),
        (T.first_email, "write to mailto:ann@site.org now", "ann@site.org"),
        (T.reference_number, "Tender Ref: AB/2024-17 open", "AB/2024-17"),
        (T.turkish_lower, "Iİ", "ıi"),
        (T.wrap_paragraphs, "a\n\n b \n\n", "<p>a</p>\n<p>b</p>"),
        (T.drop_promotions, "one\n\nSubscribe now\n\ntwo", "one\n\ntwo"),
        (lambda c: V.run_slot(F.col(c).cast("timestamp")), "2024-01-01 10:00:00", "oglen"),
        (lambda c: V.rfc822(F.col(c).cast("timestamp")), "2024-01-05 10:00:00", "Fri, 05 Jan 2024 10:00:00 GMT"),
        (lambda c: V.display_date(F.col(c).cast("timestamp")), "2024-02-05 10:00:00", "5 Şubat 2024"),
    ],
)
def test_text_examples(spark, make, value, want):
    assert one(spark, value, make) == want


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (V.zoned_date, "28-Apr-2026 00:00 (GMT -4.00)", dt.datetime(2026, 4, 28, 4)),
        (V.meridiem_date, "13-May-26 @ 10:00 AM (New York time)", dt.datetime(2026, 5, 13, 14)),
        (V.meridiem_date, "14-May-2610:00", dt.datetime(2026, 5, 14)),
        (V.embedded_date, "Expire le 25-05-2026", dt.datetime(2026, 5, 25)),
        (V.parse_date, "21/05/2026 10:00:00", dt.datetime(2026, 5, 21, 10)),
        (V.parse_date, "Tue, 05 Mar 2024 10:20:30 +0200", dt.datetime(2024, 3, 5, 8, 20, 30)),
    ],
)
def test_dates(spark, make, value, want):
    assert one(spark, value, lambda c: F.date_format(make(c), "yyyy-MM-dd HH:mm:ss")) == str(want)


def test_numbers_and_arrays(spark):
    assert one(spark, "Score: 7 of 10", lambda c: V.json_number(c, "score", 5)) == 7
    assert one(spark, 'x {"score": 9} y', lambda c: V.json_number(c, "score", 5)) == 9
    assert one(spark, "nothing", lambda c: V.json_number(c, "score", 5)) == 5
    for text in ("a", "kâr", ""):
        import hashlib

        assert one(spark, text, lambda c: V.md5_mod(c, 7)) == int(hashlib.md5(text.encode()).hexdigest(), 16) % 7
    tags = spark.createDataFrame([(["telecom", "pay", "fair"],), ([],)], "t array<string>")
    got = [r["y"] for r in tags.select(V.remap("t", {"telecom": "tech", "pay": "tech", "fair": None}).alias("y")).collect()]
    assert got == [["tech"], []]
    assert one(spark, 500, lambda c: T.variant_widths(c), "int") == [400, 500]
    assert one(spark, "EUR . or USD 2,000 million", V.budget_usd) == 2e9


def test_query_expansion():
    table = search.synonym_table([["mısır", "misir", "egypt"], ["altın", "altin", "gold"], ["güney afrika", "south africa"]])
    assert search.expand("mısır altın", table) == [["mısır", "misir", "egypt"], ["altın", "altin", "gold"]]
    assert {"south", "africa", "güney", "guney"} <= set(search.expand("Güney Afrika", table)[0])
    assert search.expand("x !", table) == []


def test_allocated_keys_are_unique(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["x", "y", "x-2", "z"])) for i in range(60)]
    taken = spark.createDataFrame([("x",), ("x-5",), ("y-2",)], "key string")
    got = changes.allocate_keys(spark.createDataFrame(rows, "id int, base string"), "base", [F.col("id")], taken).collect()
    keys = [row["key"] for row in got]
    assert len(keys) == 60 == len(set(keys)) and not {"x", "x-5", "y-2"} & set(keys)


def test_next_in_order_equals_one_window(spark):
    r = random.Random(2)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randint(0, 300))) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, published_at timestamp_ntz")
    got = {x["id"]: x["next_id"] for x in reads.next_in_order(frame).collect()}
    order = [i for i, _ in sorted(rows, key=lambda x: (x[1], x[0]), reverse=True)]
    assert got == dict(zip(order, [*order[1:], None], strict=True))


def test_near_pairs_equal_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(r.choices(words, k=60)) for _ in range(6)]
    texts = []
    for i in range(40):
        w = base[i % 6].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = r.choice(words)
        texts.append(" ".join(w))
    texts += ["", "a b", texts[0], texts[0]]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    members, links = similarity.near_classes(rows)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    assert set(rep) == {i for i, x in enumerate(sets) if x} and all(rep[i] == min(j for j in rep if sets[j] == sets[i]) for i in rep)
    linked = {(r["a"], r["b"]) for r in links.collect()}
    # Written out, links between representatives and equal sets are exactly the pairs.
    assert {(i, j) for i in rep for j in rep if i < j and (rep[i] == rep[j] or (min(rep[i], rep[j]), max(rep[i], rep[j])) in linked)} == want
    assert {(x["a"], x["b"]) for x in similarity.near_pairs(rows).collect()} == linked | {(rep[i], i) for i in rep if rep[i] != i}
    from datetime import datetime, timedelta

    at = [datetime(2024, 1, 1) + timedelta(hours=(i * 13) % 90) for i in range(len(texts))]
    timed = spark.createDataFrame([(i, t, at[i]) for i, t in enumerate(texts)], "id long, body string, published_at timestamp_ntz")
    both = want | {(j, i) for i, j in want}
    before = {i: max(((at[j], j) for k, j in both if k == i and (at[j], j) < (at[i], i) and at[i] - at[j] <= timedelta(hours=48)), default=None) for i in rep}
    assert {r["id"]: r["earlier_id"] for r in similarity.near_before(timed, 48).collect()} == {i: x[1] for i, x in before.items() if x}


def test_patch_and_histograms(spark):
    now = F.lit("now")
    current = spark.createDataFrame([(1, "a", "t", "old"), (2, "b", "u", "old")], "id int, title string, slug string, updated_at string")
    patches = spark.createDataFrame([(1, "A", None), (2, None, "s")], "id int, title string, slug string")
    got = {r["id"]: tuple(r)[1:] for r in changes.patch(current, patches, "id", ["title"], ["title"], now).collect()}
    assert got == {1: ("A", "t", "now"), 2: ("b", "u", "old")}
    rows = spark.createDataFrame([("ok:1",), ("ok",), ("bad: x",)], "s string")
    assert {r["status"]: r["n"] for r in metrics.status_histogram(rows, "s").collect()} == {"ok": 2, "bad": 1}
    same = changes.write_if_changed(current, {"title": F.upper("title")}).count()
    assert same == 2 and changes.write_if_changed(current, {"title": F.lower("title")}).count() == 0


def test_gates(spark):
    rows = spark.createDataFrame([(1, "<p>x</p>", "y" * 50), (2, "<h2 id=a>t</h2><p>Done.</p>", "z")], "id int, html string, body string")
    got = [r["r"] for r in rows.select(gates.finalise("html", F.lit(False)).alias("r")).collect()]
    assert got == ["truncated", None]
    assert rows.filter(gates.keeps_tags("html", "html")).count() == 2
    card = gates.report_card(spark.createDataFrame([("s", "w " * 300, "t", "2024-01-01")], "source string, body string, title string, published_at string")).first()
    assert card["passed"]


def test_html_columns(spark):
    assert one(spark, "<h3>a</h3><h4>b</h4><h3> </h3>", html.headings_column) == "<h2>a</h2><h3>b</h3>"
    assert one(spark, "<p>none</p>", html.headings_column) == "<p>none</p>" and one(spark, None, html.headings_column) is None
    assert one(spark, '<img data-src="https://x.org/1.jpg" src="data:1"><img src="s.gif">', html.images_column) == ["https://x.org/1.jpg"]
    assert one(spark, "".join(f'<img src="https://x.org/{i}.jpg">' for i in range(7)), html.images_column) == []
    assert one(spark, "<table><tr><th>a</th><td> b <i>c</i></td></tr></table>", html.tables_column) == [["a", "b c"]]


def test_clean_pages_against_another_reading(spark):
    """Cleaning keeps allowed tags only, loses no text outside dropped elements, and leaves a clean page as it is."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html", html.clean_column("html").alias("done"), html.content_column("html").alias("c")).collect()
    squeeze = lambda t: re.sub(r"\s+", "", unescape(re.sub(r"<[^>]+>", "", t)))
    for r in pages:
        assert {t.lower() for t in re.findall(r"</?([A-Za-z0-9]+)", r["done"])} <= html.ALLOWED
        bare = re.sub(r"(?is)<!--.*?-->|<!DOCTYPE[^>]*>", "", r["html"])
        for t in html.DROPPED:
            bare = re.sub(rf"(?is)<{t}\b.*?(?:</{t}>|$)", "", bare)
        assert squeeze(r["done"]) == squeeze(bare)
        assert html.clean(r["done"]) == r["done"]
        assert r["c"]["text"] == html.main_text(r["html"]) and r["c"]["cut"] == html.ends_cut(r["html"])
        assert squeeze(r["c"]["text"]) == "" or squeeze(r["c"]["text"])[:20] in squeeze(bare)


def test_html():
    dirty = '<div onclick="x()"><p class="a">One <script>bad()</script><a href="javascript:x" title="t">two</a><a href="/ok">3</a><b>open</p>'
    assert html.clean(dirty) == '<p>One <a title="t">two</a><a href="/ok">3</a><b>open</b></p>'
    assert html.clean(None) is None
    assert not html.ends_cut("<p>x.</p><table><tr><td>260000</td></tr></table>") and html.ends_cut("<p>cut off</p>")
    page = "<nav><a href=/>menu</a></nav><article><p>" + "Long text. " * 30 + "</p></article><footer>foot</footer>"
    assert html.main_text(page) == ("Long text. " * 30).strip()


def test_readers(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>a</title><link>http://x/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate></item><item><title>b</title><guid>http://x/2</guid></item><item><link>http://x/1</link></item><item><link>ftp://x</link></item></channel></rss>")
    feed = files.read_feed(spark, str(tmp_path / "feed.xml"))
    assert {r["link"] for r in feed.collect()} == {"http://x/1", "http://x/2"}
    late = F.lit("2025-01-01").cast("timestamp")
    assert [r["link"] for r in files.recent_entries(feed.filter("link = 'http://x/2'"), late).collect()] == ["http://x/2"]
    (tmp_path / "map.xml").write_text("<urlset><url><loc>http://x/1</loc><lastmod>2024-03-05</lastmod></url><url><loc>http://x/2</loc></url></urlset>")
    pages = files.read_sitemap(spark, str(tmp_path / "map.xml"))
    assert files.recent_entries(pages, F.lit("2024-01-01").cast("timestamp"), keep_undated=False).count() == 1
    (tmp_path / "tags.md").write_text("# Head\n\nAfCFTA (x), **Gold**, oil\n- oil, a\n")
    terms = [r["term"] for r in files.read_vocabulary(spark, str(tmp_path / "tags.md")).orderBy("place").collect()]
    assert terms == ["AfCFTA", "Gold", "oil"]
    (tmp_path / "n.json").write_text('{"procnotices": {"1": {"id": "1", "noticetitle": "", "bid_description": "d", "deadline": "2030-01-01", "country": "K"}, "2": {"id": "2", "noticetitle": "t", "deadline": "2020-01-01"}}}')
    notices = files.read_notices(spark, str(tmp_path / "n.json"), F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["id"], r["title"]) for r in notices] == [("1", "d")]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("published x\ndropped y\npublished z")
    assert files.read_logs(spark, str(tmp_path / "logs"), {"published": "published", "dropped": "dropped"}).first()["published"] == 2
    assert files.list_objects(spark, str(tmp_path / "logs")).first()["bytes"] == 33
    (tmp_path / "d.tsv").write_text("a\tb\n1\t2\n\t\n1\t2\n3\t4\n")
    rows = files.read_delimited(spark, str(tmp_path / "d.tsv"))
    assert rows.count() == 2
    assert files.html_table(rows, [F.col("a")]).first()["html"] == "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from quillstream.streaming import events as S

    path = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(path)
    S.run_available(S.first_seen(S.read(spark, path), ["event_id"]), "seen", str(tmp_path / "c1"))
    assert spark.table("seen").count() == spark.read.parquet(path).select("event_id").distinct().count()
    S.run_available(S.daily_counts(S.read(spark, path)), "daily", str(tmp_path / "c2"))
    twin = spark.read.parquet(path).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    got = spark.table("daily")
    # Append mode holds back the windows that the watermark has not passed.
    assert got.count() > 0 and got.join(twin, ["day", "event_type", "n"], "left_anti").count() == 0


def test_models(spark):
    from quillstream.operators import models as M

    class Flaky(M.KeywordModel):
        def answer(self, prompts):
            if len(prompts) > 2:
                raise ValueError("too many")
            return super().answer(prompts)

    rows = spark.createDataFrame([(1, "a bad one"), (2, "fine"), (3, None)], "id int, prompt string")
    got = {r["id"]: r["a"] for r in M.ask(rows, "prompt", "a", M.KeywordModel([("bad", "BLOCK")], "PASS")).collect()}
    assert got == {1: "BLOCK", 2: "PASS", 3: None}
    assert {r["a"] for r in M.ask(rows.coalesce(1), "prompt", "a", Flaky([("bad", "x")]), batch=2).collect()} == {"x", None}
    kept = M.ask(rows, "prompt", "a", M.KeywordModel([("bad", "BLOCK")], "PASS")).filter(M.verdict(F.col("a")))
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]
    two = M.ask_survivors(rows, F.col("prompt").contains("bad"), "prompt", "a", M.KeywordModel([], "yes"), "no")
    assert {r["id"]: r["a"] for r in two.collect()} == {1: "yes", 2: "no", 3: "no"}
    texts = spark.createDataFrame([("long original", "short"), ("long original", "x"), ("long original", None)], "o string, r string")
    assert [r["y"] for r in texts.select(M.accept_rewrite(F.col("o"), F.col("r")).alias("y")).collect()] == ["short", "long original", "long original"]
    tries = spark.createDataFrame([(1, ["a"], 1), (1, ["b", "c"], 2), (1, ["d", "e"], 3)], "k int, v array<string>, n int")
    assert M.best_attempt(tries, "k", "v", "n").first()["v"] == ["b", "c"]


def test_slugs_follow_the_decomposition(spark):
    import re
    import unicodedata

    def want(t, cut=80):
        t = t.translate(str.maketrans("çşığöüÇŞİĞÖÜ", "csigoucsigou"))
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        return re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", t)).strip("-")[:cut].strip("-")

    texts = ["a - b", "Ærø ﬁeld ½ naïve™ ǅ", "Ştraße  __x", "—dash— ok…", "Ñandú Žižek Đorđe Łódź", "", "---", "x" * 79 + " y", "ﬀ①㎏ № ℡", "tab\tand\x1cmore", "日本 ｆｕｌｌ", "— " * 500 + "late words " * 50, "word_ " * 100, "é" * 319 + " - x", "a" * 80 + " " * 400 + "b", "ab " * 27 + "-" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.slug("t").alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: want(t) for i, t in enumerate(texts)}


def test_keys_take_the_first_free_number(spark):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(["x", "x", "x", "x-2", "y", "y", "x-9", "z"])], "i int, base string")
    taken = spark.createDataFrame([("x",), ("x-5",), ("y-2",), ("y-3",), ("w",)], "key string")
    got = {r["i"]: r["key"] for r in changes.allocate_keys(rows, "base", [F.col("i")], taken).collect()}
    assert got == {0: "x-3", 1: "x-4", 2: "x-6", 3: "x-2", 4: "y", 5: "y-4", 6: "x-9", 7: "z"}


def test_unreferenced_finds_raw_mentions(spark):
    objects = spark.createDataFrame([(p,) for p in ("a/b.jpg", "img/long-name.jpg", "z.p", "img/gone.png", "q")], "path string")
    texts = spark.createDataFrame([("see store/a/b.jpg",), ("xximg/long-name.jpgyy",), ("a z.png b",), (None,), ("",)], "body string")
    left = changes.unreferenced(objects, "path", texts, "body", "store")
    assert sorted(r["path"] for r in left.collect()) == ["img/gone.png", "q"]
    assert changes.unreferenced(objects, "path", texts.limit(0), "body", "store").count() == 5


def test_upkeep(spark):
    from quillstream.functions import urls
    from quillstream.operators import search, upkeep

    assert search.groups_of("a & (b | C)", "raw words") == [["a"], ["b", "c"]] and search.groups_of("a & (b", "Raw words!") == [["raw"], ["words"]]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(urls.page_param(F.lit("7"))) == 7 and one(urls.page_param(F.lit("-3"))) == 1 and one(urls.page_param(F.lit(None).cast("string"))) == 1
    assert one(urls.canonical(F.lit("https://h/x/?page=2&b=1&a=2#f"), ["a", "b"])) == "/x/page/2?a=2&b=1"
    assert one(urls.assistant(F.lit("/x"), F.lit("https://chat.openai.com/c"))) == "chat.openai.com"
    rows = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 10), (2, 2, 12), (3, 1, 13)], "page int, position int, id int")
    assert sorted(r["id"] for r in upkeep.until_few_new(rows, 2).collect()) == [10, 11, 12]
    assert upkeep.until_few_new(rows.limit(0), 2).count() == 0
    assert one(upkeep.or_original(F.lit("  "), F.lit("o"))) == "o"


def test_hash_matches_against_all_pairs(spark):
    from quillstream.operators import similarity

    r = random.Random(9)
    hashes = []
    for _ in range(12):
        h = r.getrandbits(256)
        hashes += [h] + [h ^ sum(1 << b for b in r.sample(range(256), n)) for n in (1, 8, 20, 24, 25, 30)]
    hashes.append(hashes[0])
    rows = spark.createDataFrame([(i, f"{h:064x}") for i, h in enumerate(hashes)] + [(999, None), (1000, "ab")], "id int, h string")
    want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(len(hashes) - 1) for j in range(i + 1, len(hashes) - 1) if 0 < (hashes[i] ^ hashes[j]).bit_count() <= 24}
    assert {(x["a"], x["b"], x["bits"]) for x in similarity.hash_matches(rows, "id", "h").collect()} == want


def test_notices_in_both_forms(spark, tmp_path):
    import json

    notice = lambda i, d: {"id": i, "noticetitle": "", "bid_description": f"b{i}", "deadline": d, "country": "X"}
    (tmp_path / "a.json").write_text(json.dumps({"procnotices": {"k1": notice("1", "2030-01-01"), "k2": notice("2", "2001-01-01")}}))
    (tmp_path / "b.json").write_text(json.dumps({"procnotices": [notice("1", "2030-01-01"), notice("3", "2031-01-01")]}))
    got = files.read_notices(spark, str(tmp_path), F.lit("2024-01-01").cast("timestamp")).collect()
    assert {(r["id"], r["title"]) for r in got} == {("1", "b1"), ("3", "b3")}


def test_sitemaps_and_manifests(spark, tmp_path):
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc> https://x/1.xml </loc></sitemap><sitemap><loc>https://x/2.xml</loc></sitemap><sitemap><loc>https://x/3.xml</loc></sitemap></sitemapindex>")
    index = files.read_sitemap_index(spark, str(tmp_path / "i.xml"))
    assert [r["loc"] for r in files.last_children(index, 2).collect()] == ["https://x/3.xml", "https://x/2.xml"]
    rows = spark.createDataFrame([("a,b", 3), ('q"x', 4)], "path string, bytes long")
    files.write_manifest(rows, str(tmp_path / "m"))
    assert {tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m")).collect()} == {("a,b", 3), ('q"x', 4)}
    with pytest.raises(ValueError):
        files.html_table(rows, [F.col("path")], most=1)


def test_feeds_of_both_kinds(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title>A</title><link>https://x/1</link></item><item><guid>https://x/2</guid></item></channel></rss>")
    (tmp_path / "atom.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link rel="alternate" href="https://x/3"/><updated>2024-03-05T10:00:00Z</updated></entry></feed>')
    got = files.read_feed(spark, str(tmp_path)).collect()
    assert {r["link"] for r in got} == {"https://x/1", "https://x/2", "https://x/3"}


def test_answers_that_are_cut_are_asked_again(spark, tmp_path):
    class Stutters:
        """Ends an answer only from the second time on that it is asked."""

        def __init__(self, folder):
            self.folder = folder

        def answer(self, prompts):
            import os

            out = []
            for p in prompts:
                path = os.path.join(self.folder, p)
                out.append("whole." if os.path.exists(path) and p != "never" else "cut of")
                open(path, "a").close()
            return out

    from quillstream.operators import models

    rows = spark.createDataFrame([("a", None, None), ("never", None, None), ("known", "0f4137ed1502b5045d6083aa258b5c42", "old"), (None, None, None)], "p string, h string, y string")
    got = {r["p"]: r["y"] for r in models.ask_whole(rows, "p", "y", Stutters(str(tmp_path)), "h").collect()}
    import hashlib

    known = hashlib.md5(b"known").hexdigest()
    assert got["a"] == "whole." and got["never"] is None and got[None] is None
    rows = spark.createDataFrame([("known", known, "old")], "p string, h string, y string")
    assert models.ask_whole(rows, "p", "y", Stutters(str(tmp_path)), "h").first()["y"] == "old"


def test_tokens_that_collide_lose_no_link(spark, monkeypatch):
    """Tokens of few bits fall together within and between texts; links and members stay those of whole hashes."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[k : k + 40]) for k in range(6)] + [" ".join(words[:40]), " ".join(reversed(words))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    want = {tuple(r) for r in similarity.near_pairs(rows).collect()}
    assert (0, 6, 1.0) in want and len(want) > 5
    monkeypatch.setattr(similarity, "TOKEN_BITS", 5)
    assert {tuple(r) for r in similarity.near_pairs(rows).collect()} == want


def test_narrow_tables_with_much_work_are_spread(spark):
    """One small file is not one task's work, and a slug takes a short text apart once."""
    from quillstream.plans import QUERIES

    for name in ("inline_images", "slug_variants"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_counts_of_several_queries_read_texts_once(spark):
    from quillstream.operators import search

    rows = spark.createDataFrame([(1, "a", "Alpha beta", "gamma delta"), (2, "b", "alpha", "gamma"), (3, None, None, None)], "id long, tab string, title string, body string")
    asked = [("alpha gamma", {}), ("gamma", {"tab": "a"}), ("x", {}), ("alphq", {}), ("", {})]
    got = {r["asked"]: r["n"] for r in search.counts(rows, asked, {}).collect()}
    assert got == {k: search.count(rows, raw, {}, **f).first()["n"] for k, (raw, f) in enumerate(asked)}
    assert search.counts(spark.range(5).selectExpr("id", "'a' AS tab", "'t' AS title", "'b' AS body"), asked, {})._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1


def test_total_makes_the_report_once(spark):
    from quillstream.operators import gates

    stats = spark.range(6).selectExpr("concat('s', id % 2) AS source", "id").groupBy("source").agg(F.count(F.lit(1)).alias("scraped"), F.avg("id").alias("avg_score"))
    made = gates.with_total(stats)
    assert {tuple(r) for r in made.collect()} == {("s0", 3, 2.0), ("s1", 3, 3.0), ("total", 6, None)}
    assert "Range" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_outcomes_are_worked_out_once(spark, tmp_path, monkeypatch):
    from quillstream.operators import ledger

    seen, settle = [], ledger.settle
    monkeypatch.setattr(ledger, "settle", lambda df: (seen.append(df), settle(df))[1])
    rows = spark.range(6).selectExpr("id", "concat('t', id) AS t")
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    assert book.run(rows, "id", "r", 1, ["t"], lambda df: F.when(F.col("id") < 4, F.concat(F.lit("ok:xyzzy"), "t"))) == 4
    assert book.rows().count() == 4 and book.pending(rows, "id", "r", 1, ["t"]).columns == ["id", "t"]
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("xyzzy") == 1


@pytest.mark.parametrize("frequent", [1, 9, 10**6])
def test_recommendations_equal_a_comparison_of_all(spark, monkeypatch, frequent):
    monkeypatch.setattr(reads, "FREQUENT", frequent)
    draw, now = random.Random(3), dt.datetime(2024, 1, 31)
    rows = []
    for i in range(90):
        at = None if i % 30 == 7 else now - dt.timedelta(days=draw.randrange(30))
        sectors = draw.choice([None, [], ["x"], ["x", "y"], ["y", "x"], ["a", None], ["z", "z"]])
        rows.append((i, at, draw.choice([None, None, "a", "b"]), sectors, draw.choice([None, [], ["p"], ["p", "q", "p"], ["q", "r"]])))
    want = set()
    for i, _, tab, sectors, tags in rows:
        own, tags = {s for s in sectors or [] if s}, tags or []
        near = [b for b in rows if b[0] != i and b[1] and b[1] >= now - dt.timedelta(days=20) and (tab is not None and b[2] == tab or own & set(b[3] or []) or tab is None and not sectors)]
        near = sorted(near, key=lambda b: (b[1], b[0]), reverse=True)[:6]
        scored = [(2 * sum(t in tags for t in b[4] or []) + 3 * sum(s in own for s in b[3] or []) + (tab is not None and b[2] == tab), b[1], b[0]) for b in near]
        want |= {(i, x[2], x[0], n + 1) for n, x in enumerate(sorted((x for x in scored if x[0]), reverse=True)[:3])}
    table = spark.createDataFrame(rows, "id long, published_at timestamp_ntz, tab string, sectors array<string>, tags array<string>")
    found = reads.similar(table, F.lit("2024-01-31").cast("timestamp_ntz"), k=3, newest=6, days=20)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 150
    assert "Window" not in found._jdf.queryExecution().toString()  # pairs are ranked where their row lies
