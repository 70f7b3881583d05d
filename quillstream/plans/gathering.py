"""Catalogue: listings and article fields by the registry, over the tables' pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import registry, rules
from ..storage import table_path
from ..tables import table

#: Sources of the tables' pages: list items of the navigation; all links under a pattern; one without rules.
OWN = [
    ("s0", "row", None, 0, "nav li", None), ("s0", "field", "href", 0, "a", "@href"), ("s0", "field", "title", 0, "a.none", "text"), ("s0", "field", "title", 1, "li > a", "texts"), ("s0", "exclude", None, 0, "/[rstw][^/]*$", None),
    ("s1", "row", None, 0, "a[href]", None), ("s1", "field", "href", 0, "a", "@href"), ("s1", "field", "title", 0, "a", "text"), ("s1", "include", None, 0, "/[A-Ma-m][^/]*$", None), ("s1", "exclude", None, 0, "/d[^/]*$", None), ("s1", "next", None, 0, "nav li:nth-child(2) + li a, a.next", None),
]


def _sourced(spark: SparkSession, d: str, n: int) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", "html", F.concat(F.lit("s"), F.pmod("page_id", F.lit(n)).cast("string")).alias("source"))


def _read(pages: DataFrame, own: DataFrame) -> DataFrame:
    """What the rules find, as a table: rows and following pages both come from it, and a page is parsed once."""
    path = table_path(pages.sparkSession, "found")
    rules.read(pages, own).drop("steps").write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def registry_index(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame(OWN, rules.RULES_DDL)
    found = _read(_sourced(spark, d, 3), own)
    rows = rules.listing(found, own, keys=("page_id",)).select("page_id", "link", F.col("values")["title"].alias("title"))
    following = found.filter("row = 0 and values['next'] is not null").select("page_id", F.concat(F.lit("next "), F.col("values")["next"]).alias("link"), F.lit(None).cast("string").alias("title"))
    return rows.unionByName(following)


LAYOUTS = ["world_bank", "undp", "ungm", "african_union", "burkina", "ghana"]
#: A listing of each source: before the rows, a row (with {h} the link, {t} its text, {d} and {p} dates), behind them.
FORMS = {
    "world_bank": ('<table class="x procurement-table"><thead><tr><th>no</th></tr></thead><tbody>', "<tr><td>{h}</td><td>c</td><td> {p} </td><td>{d}</td></tr>", '</tbody></table><li class="next"><a href="?page=2">more</a></li>'),
    "undp": ("<div>", '<div class="procurement-item">{h}<span class="closing">{d}</span><i class="pub-date">{p}</i></div>', "</div>"),
    "ungm": ('<table class="tableNotices"><tbody>', '<tr><td>1<td>{h}<td>x<td class="published">{p}<td>{d}', "</table><a rel='next' href='/ungm/2'>2</a>"),
    "african_union": ('<table class="views-table"><tbody>', '<tr><td class="views-field-title"><b>{h}</b></td><td class="views-field-field-date"><span class="date-display-single">{d}</span></td><td class="views-field-field-text-bidnumber"> N-{t} </td><td>{p}</td></tr>', "</tbody></table>"),
    "burkina": ("<main>", '<div class="job"><p>{j}</p><small class="expire-date"><b>{d}</b></small><small class="societe">{t} Ltd</small></div>', '<ul class="pagination"><li class="active">1</li><li><a href="?page=3">3</a></li></ul></main>'),
    "ghana": ('<table id="T01"><tr><td>head<td><a href="/head">head</a>', '<tr><td>1<td>{h}<td>{t} office<td>x<td><i>{d}</i><td>y<td>open <b>now</b><td><a href="/n.pdf">pdf</a><td>{p}', "</table><div class='Pagination'><a href='?p=1'>1</a><a href='?p=2'>2</a></div>"),
}


def tender_listings(spark: SparkSession, d: str) -> DataFrame:
    """Listings in the six layouts made of the links of each page; some rows without a link, some dates that are none."""
    links = F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">[^<]*</a>'), F.lit(1))

    def row(form: str, x: Column, i: Column) -> Column:
        name = F.substring(x, 2, 100)
        tag = lambda css: F.when(i % 4 == 3, F.lit("no link")).otherwise(F.concat(F.lit(f"<a{css} href='"), x, F.lit("'>"), name, F.lit("</a>")))
        day = F.lpad((F.col("page_id") % 9 + i % 18 + 1).cast("string"), 2, "0")
        values = {"{h}": tag(""), "{j}": tag(' class="job-title"'), "{t}": name, "{d}": F.when(i % 3 == 2, "soon").otherwise(F.concat(F.lit("2024-03-"), day)), "{p}": F.concat(day, F.lit("/02/2024"))}
        out = F.lit(form)
        for k, v in values.items():
            out = F.replace(out, F.lit(k), v)
        return out

    made = F.coalesce(*_rendered(links, row))
    source = F.element_at(F.array(*map(F.lit, LAYOUTS)), (F.pmod("page_id", F.lit(6)) + 1).cast("int"))
    listings = table(spark, d, "pages").withColumn("source", source).select("page_id", "source", F.lit("https://n.example/list/1").alias("url"), made.alias("html"))
    shipped = registry.shipped(spark)
    found = _read(listings, shipped)
    value = lambda c: F.col("values")[c].alias(c)
    rows = rules.listing(found, shipped, keys=("page_id",)).select("page_id", "source", "link", *(value(c) for c in ("title", "deadline_at", "published_at", "institution", "country", "reference", "status", "document")))
    none = [F.lit(None).cast("string").alias(c) for c in ("title", "deadline_at", "published_at", "institution", "country", "reference", "status", "document")]
    return rows.unionByName(found.filter("row = 0 and values['next'] is not null").select("page_id", "source", F.col("values")["next"].alias("link"), *none))


def _rendered(links: Column, row) -> list[Column]:
    def one(source: str, form: tuple[str, str, str]) -> Column:
        return F.when(F.col("source") == source, F.concat(F.lit(form[0]), F.array_join(F.transform(links, lambda x, i: row(form[1], x, i)), ""), F.lit(form[2])))

    return [one(s, f) for s, f in FORMS.items()]


#: What is put before </head> and behind <h1>...</h1>, by page_id % 7.
HEADS = [
    '<meta property="og:title" content="Told &amp; sold"><meta property="article:published_time" content="2024-02-03T04:05:06+02:00"><meta name="author" content="A. Meta">',
    '<script type="application/ld+json">[{"@graph": [{"@type": "Site", "name": "no"}, {"headline": "From the graph", "datePublished": "2024-02-04"}]}]</script>',
    '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"name": "Named", "uploadDate": "Sat, 03 Feb 2024 10:00:00 GMT"}</script>',
    '<meta property="og:title" content="  "><meta property="article:published_time" content="soon">',
    '<meta property="og:image" content="https://img.example/a_S.jpg"><meta property="og:image:alt" content="told alt">',
    "",
    '<script type="application/ld+json">{"@graph": [{"headline": "undated"}]}</script>',
]
BODIES = [
    '<p class="byline-name"><b>x</b></p>',
    '<span class="author-name">no <a>By Name</a></span><figure><img src="/first.jpg" alt=" first "><figcaption>Credit <b>x</b></figcaption></figure>',
    '<a rel="author"> Rel Author </a>',
    '<time datetime="2024-02-05T00:00:00Z">x</time><time>later</time>',
    '<div class="itemDateCreated">Saturday, 03 <b>February</b> 2024 17:47</div><div class="itemImage"><img alt="item alt" src="/i.jpg"></div>',
    '<div class="image-credit">Photo</div><time datetime="never">x</time>',
    "",
]


def article_fields(spark: SparkSession, d: str) -> DataFrame:
    """Title, date, author, picture, its description and credit of each page: the first valid of their steps, and which it was."""
    k = F.pmod("page_id", F.lit(7)).cast("int") + 1
    pick = lambda made: F.element_at(F.array(*map(F.lit, made)), k)
    html = F.replace(F.replace("html", F.lit("</head>"), F.concat(pick(HEADS), F.lit("</head>"))), F.lit("</h1>"), F.concat(F.lit("</h1>"), pick(BODIES)))
    source = F.when(F.col("page_id") % 2 == 0, "ecofin").otherwise("unknown")
    found = rules.read(table(spark, d, "pages").select("page_id", source.alias("source"), html.alias("html")), registry.shipped(spark)).filter("row = 0")
    rows = found.withColumn("image", F.col("values")["image"])
    rows = rules.rewritten(rows, registry.shipped(spark), "image")
    told = [c for f in ("title", "published_at", "author", "alt", "credit") for c in (F.col("values")[f].alias(f), F.col("steps")[f].alias(f"{f}_step"))]
    return rows.select("page_id", "image", F.col("steps")["image"].alias("image_step"), *told)


QUERIES = {f.__name__: f for f in (registry_index, tender_listings, article_fields)}

_LINKS = "unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">[^<]*</a>', 1)) AS x, unnest(range(len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">[^<]*</a>', 1)))) AS i"
_SITE = "regexp_extract(url, '^(\\w+://[^/?#]+)', 1)"
_STEP = lambda made: "[" + ", ".join("NULL" if m is None else (repr(m) if isinstance(m, int) else "'" + m.replace("'", "''") + "'") for m in made) + "][page_id % 7 + 1]"
_TITLE = "trim(regexp_replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&'), '\\s+', ' ', 'g'))"
ORACLE = {
    "registry_index": f"""WITH l AS (SELECT page_id, url, {_LINKS} FROM pages), f AS (SELECT page_id, {_SITE} || x AS link, substr(x, 2) AS title, min(i) AS i FROM l GROUP BY ALL)
        SELECT page_id, link, title FROM f WHERE (page_id % 3 = 0 AND NOT regexp_matches(link, '/[rstw][^/]*$')) OR (page_id % 3 = 1 AND regexp_matches(link, '/[A-Ma-m][^/]*$') AND NOT regexp_matches(link, '/d[^/]*$'))
        UNION ALL SELECT page_id, 'next ' || x, NULL FROM l WHERE page_id % 3 = 1 AND i = 2""",
    "tender_listings": f"""WITH l AS (SELECT page_id, {_LINKS} FROM pages),
        r AS (SELECT *, substr(x, 2) AS t, 'https://n.example' || x AS link, lpad((page_id % 9 + i % 18 + 1)::VARCHAR, 2, '0') AS day, {[s for s in LAYOUTS]!r}[page_id % 6 + 1] AS source FROM l WHERE i % 4 <> 3 QUALIFY row_number() OVER (PARTITION BY page_id, x ORDER BY i) = 1)
        SELECT page_id, source, link, t AS title, CASE WHEN i % 3 <> 2 THEN '2024-03-' || day || ' 00:00:00' END AS deadline_at, CASE WHEN source NOT IN ('african_union', 'burkina') THEN '2024-02-' || day || ' 00:00:00' END AS published_at,
               CASE source WHEN 'burkina' THEN t || ' Ltd' WHEN 'ghana' THEN t || ' office' END AS institution, CASE source WHEN 'burkina' THEN 'Burkina Faso' END AS country, CASE source WHEN 'african_union' THEN 'N-' || t END AS reference,
               CASE source WHEN 'ghana' THEN 'open now' END AS status, CASE source WHEN 'ghana' THEN '/n.pdf' END AS document FROM r
        UNION ALL SELECT page_id, {[s for s in LAYOUTS]!r}[page_id % 6 + 1] AS source, ['?page=2', NULL, '/ungm/2', NULL, '?page=3', '?p=2'][page_id % 6 + 1] AS link, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pages WHERE page_id % 6 IN (0, 2, 4, 5)""",
    "article_fields": f"""WITH p AS (SELECT *, page_id % 2 = 0 AS known FROM pages)
        SELECT page_id, {_STEP([None, "/first.jpg", None, None, "https://img.example/a_S.jpg", None, None]).replace("'https://img.example/a_S.jpg'", "CASE WHEN known THEN 'https://img.example/a_Generic.jpg' ELSE 'https://img.example/a_S.jpg' END")} AS image, {_STEP([None, 1, None, None, 0, None, None])}::INTEGER AS image_step,
               coalesce({_STEP(["Told & sold", "From the graph", "Named", None, None, None, None])}, {_TITLE}) AS title, {_STEP([0, 1, 2, 3, 3, 3, 3])}::INTEGER AS title_step,
               CASE WHEN page_id % 7 = 4 AND known THEN '2024-02-03 17:47:00' ELSE {_STEP(["2024-02-03 02:05:06", "2024-02-04 00:00:00", "2024-02-03 10:00:00", "2024-02-05 00:00:00", None, None, None])} END AS published_at,
               CASE WHEN page_id % 7 = 4 AND known THEN 4 ELSE {_STEP([0, 1, 2, 3, None, None, None])} END::INTEGER AS published_at_step,
               {_STEP(["A. Meta", "By Name", "Rel Author", None, None, None, None])} AS author, {_STEP([2, 0, 1, None, None, None, None])}::INTEGER AS author_step,
               CASE WHEN page_id % 7 = 4 AND known THEN 'item alt' ELSE {_STEP([None, "first", None, None, "told alt", None, None])} END AS alt, CASE WHEN page_id % 7 = 4 AND known THEN 1 ELSE {_STEP([None, 0, None, None, 1, None, None])} END::INTEGER AS alt_step,
               {_STEP([None, "Credit", None, None, None, "Photo", None])} AS credit, {_STEP([None, 0, None, None, None, 0, None])}::INTEGER AS credit_step FROM p""",
}
