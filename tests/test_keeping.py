"""Versions of a table, the ledger of backfills, walks over a mirror, mentions of paths."""

import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import changes, crawl, ledger, upkeep
from quillstream.operators.snapshots import Snapshot
from quillstream.sources import rules
from quillstream.storage import table_path

ROWS = "id long, name string, updated_at string"


def upsert(now, new):
    return changes.upsert(now, new, "id", ["name"], F.lit("later"))


def test_merge_reads_and_writes_only_touched_buckets(spark):
    rows = spark.range(4000).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("then").alias("updated_at"))
    kept = Snapshot.create(rows, table_path(spark, "snapshot"), ["id"], 32)
    schema = rows.schema
    whole = set(kept.read(schema).inputFiles())
    batch = spark.createDataFrame([(5, "new"), (9_999, "new")], "id long, name string")
    read = []

    def rule(now, new):
        read.extend(now.inputFiles())
        return upsert(now, new)

    assert kept.merge(batch, schema, rule) == 1 and kept.version() == 1
    # Two keys touch at most two buckets of 32: that share of the files is read, and all other files are carried.
    assert 0 < len(read) <= 2 < len(whole) / 10
    after = set(kept.read(schema).inputFiles())
    assert len(whole & after) >= 30 and len(after - whole) <= 2
    want = sorted(map(tuple, upsert(rows, batch).collect()))
    assert sorted(map(tuple, kept.read(schema).collect())) == want
    assert kept.read(schema, version=0).count() == 4000


def test_broken_merge_leaves_the_version_before(spark):
    rows = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], ROWS)
    kept = Snapshot.create(rows, table_path(spark, "snapshot"), ["id"], 4)
    with pytest.raises(Exception, match="broken"):
        kept.merge(rows, rows.schema, lambda now, new: new.withColumn("name", F.raise_error(F.lit("broken")).cast("string")))
    assert kept.version() == 0 and kept.read(rows.schema).count() == 2
    # Deleting all rows of a bucket, and of the table.
    assert kept.merge(rows, rows.schema, lambda now, new: now.limit(0)) == 1
    assert kept.read(rows.schema).count() == 0 and kept.merge(rows, rows.schema, upsert) == 2 and kept.read(rows.schema).count() == 2


def test_empty_snapshot_and_odd_keys(spark):
    none = spark.createDataFrame([], ROWS)
    kept = Snapshot.create(none, table_path(spark, "snapshot"), ["id"], 4)
    assert kept.read(none.schema).count() == 0
    odd = spark.createDataFrame([(None, "x", "t"), (3, None, None)], ROWS)
    kept.merge(odd, none.schema, lambda now, new: now.unionByName(new))
    assert sorted(map(tuple, kept.read(none.schema).collect()), key=str) == sorted([(None, "x", "t"), (3, None, None)], key=str)


def test_a_second_run_selects_nothing_and_a_broken_one_goes_on(spark):
    rows = spark.createDataFrame([(i, f"t{i % 7}", None if i % 5 == 0 else "x") for i in range(100)], "id long, a string, b string")
    book = ledger.Ledger(spark, table_path(spark, "ledger"))
    done = lambda r: F.concat(F.lit("ok:"), F.coalesce(F.col("b"), F.lit("none")))
    failing = lambda r: F.when(F.pmod(F.xxhash64("id"), F.lit(4)) == 2, F.raise_error(F.lit("stop")).cast("string")).otherwise(done(r))
    with pytest.raises(Exception, match="stop"):
        book.run(rows, "id", "r", 1, ["a", "b"], failing, slices=4)
    kept = book.rows().count()
    assert 0 < kept < 100
    assert book.run(rows, "id", "r", 1, ["a", "b"], done, slices=4) == 100 - kept
    assert book.run(rows, "id", "r", 1, ["a", "b"], done) == 0 and [tuple(r) for r in book.histogram("r", 1).collect()] == [("ok", 100)]
    # Null and empty are different inputs; another rule and another version know nothing of these.
    assert book.pending(rows.withColumn("b", F.coalesce("b", F.lit(""))), "id", "r", 1, ["a", "b"]).count() == 20
    assert book.pending(rows, "id", "other", 1, ["a", "b"]).count() == 100 == book.pending(rows, "id", "r", 2, ["a", "b"]).count()
    # A row without an outcome stays pending.
    assert book.run(rows, "id", "r", 2, ["a"], lambda r: F.when(F.col("id") < 10, "skip:x")) == 10 and book.pending(rows, "id", "r", 2, ["a"]).count() == 90


LONG = "word " * 70


@pytest.mark.parametrize(
    "current, source, new, outcome",
    [
        ("Whole.", LONG + "end.", "x", "skip:not-truncated"), ("", LONG + "end.", "x", "skip:not-truncated"), (None, LONG + "end.", "x", "skip:not-truncated"), ("cut off", LONG + "[…] end.", "New.", "skip:source-truncated"), ("cut off", LONG + "[...] end.", "New.", "skip:source-truncated"),
        ("cut off", LONG + "end", "New.", "skip:source-truncated"), ("cut off", "Too thin.", "New.", "skip:original-too-thin"), ("cut off", None, "New.", "skip:original-too-thin"), ("cut off", LONG + "end.", "", "fail:no-translation"), ("cut off", LONG + "end.", None, "fail:no-translation"),
        ("cut off", LONG + "end.", "bad text here.", "fail:quality-bad"), ("three words cut", LONG + "end.", "Two words.", "fail:shorter-than-current"), ("<p>two cut</p>", LONG + "end.", "<p>Now</p> <b>three words.</b>", "ok:2->3w"),
    ],
)
def test_outcomes_of_a_rerun(spark, current, source, new, outcome):
    rows = spark.createDataFrame([(current, source, new)], "current string, source string, new string")
    made = ledger.rerun_outcome("current", "source", "new", F.when(F.col("new").startswith("bad"), "bad"))
    row = rows.select(made.alias("o"), ledger.rerun("current", made, "new").alias("t")).first()
    assert row["o"] == outcome and row["t"] == (new if outcome.startswith("ok") else current)


def test_walk_like_until_few_new(spark):
    rng = random.Random(2)
    pages = {n: [rng.randrange(60) for _ in range(8)] for n in range(12)}
    url = lambda n: f"https://s.example/list/{n}"
    html = lambda n: "<ul>" + "".join(f'<li><a href="/i/{x}">t</a>' for x in pages[n]) + f'</ul><a rel="next" href="/list/{n + 1}">on</a>'
    mirror = spark.createDataFrame([("s", url(n), html(n)) for n in pages], "source string, url string, html string")
    sites = spark.createDataFrame([("s", None, url(0))], "source string, parameter string, url string")
    own = spark.createDataFrame([("s", "row", None, 0, "li", None), ("s", "field", "href", 0, "a", "@href"), ("s", "next", None, 0, "a[rel='next']", None)], rules.RULES_DDL)
    walked = crawl.scan(crawl.listing_pages(mirror, sites, own), sites.select("source", "url"), least=4, most_pages=20)
    got = sorted((r["page"] - 1, int(r["link"].rsplit("/", 1)[1])) for r in walked.collect())
    rows = spark.createDataFrame([(n, k, x) for n, xs in pages.items() for k, x in enumerate(xs)], "page int, position int, id int")
    assert got == sorted((r["page"], r["id"]) for r in upkeep.until_few_new(rows, 4).collect()) and len({p for p, _ in got}) < 12


def test_walk_ends(spark):
    html = '<li><a href="/i/1">t</a><a rel="next" href="/list">on</a>'
    own = spark.createDataFrame([("s", "row", None, 0, "li", None), ("s", "field", "href", 0, "a", "@href"), ("s", "next", None, 0, "a[rel='next']", None)], rules.RULES_DDL)
    mirror = spark.createDataFrame([("s", "https://e/list", html), ("s", "https://e/none", None)], "source string, url string, html string")
    sites = spark.createDataFrame([("s", None)], "source string, parameter string")
    pages = crawl.listing_pages(mirror, sites, own)
    walk = lambda url: crawl.scan(pages, spark.createDataFrame([("s", url)], "source string, url string")).count()
    assert walk("https://e/list") == 1 and walk("https://e/none") == 0 and walk("https://e/missing") == 0


def test_mentions_of_paths_like_brute_force(spark):
    rng = random.Random(3)
    names = ["a", "ab", "img", "x/y", "pic-1.jpg", "şekil.png"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"", "img/2024/very/long/folder/name/shared/by/all/1.jpg", "img/2024/very/long/folder/name/shared/by/all/2.jpg"})
    texts = [f"see {rng.choice(['', 'x', 'é', '/'])}{p}{rng.choice(['', '.bak', ' ', 'z'])} end" for p in rng.sample(paths, 25)] + [None, "", "img/2024/very/long/folder/name/shared/by/all/1.jpgs"]
    objects = spark.createDataFrame([(p,) for p in paths], "path string")
    left = {r["path"] for r in changes.unreferenced(objects, "path", spark.createDataFrame([(t,) for t in texts], "body string"), "body", "store").collect()}
    assert left == {p for p in paths if p == "" or not any(p in (t or "") for t in texts)}


def test_a_long_run_posts_a_row_a_byte(spark):
    """A picture within a page is one run of a megabyte: places carry hashes, not the run."""
    run = "data:image/png;base64," + "AbC/" * 250_000 + "/img/found-1.jpg"
    objects = spark.createDataFrame([("img/found-1.jpg",), ("img/other-2.jpg",), (None,)], "path string")
    left = changes.unreferenced(objects, "path", spark.createDataFrame([(run,)], "body string"), "body", "store")
    assert sorted((r["path"] for r in left.collect()), key=str) == [None, "img/other-2.jpg"]
