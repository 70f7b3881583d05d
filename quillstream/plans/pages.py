"""Catalogue: pages as trees. The tables' pages, with blocks nested in them by page, against a walk over tags in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as P
from ..sources import html, tree
from ..tables import table

#: What is put behind <article> and before </article>, by page_id % 4: nested furniture, an own header, tails of lists, pictures.
OPEN = {
    0: '<article class="article-content"><header>Site</header><div class="article__header"><div>lead <span class="share">s</span></div></div><div class="promo-box"><div>x <div>y</div></div> LEFT</div>',
    1: '<article id="Story-Header"><section class="box related-stories"><section><p>deep</section> more</section><aside><div>a</aside>',
    2: '<article><ul class="points"><li>one<li>two <ul><li>inner</ul></ul><div id="ad-container"><nav>n</nav></div>kept',
    3: "<article><h3></h3>",
}
CLOSE = {
    0: '<div class="list-folder"><article class="card"><img src="https://img.example/other-article.jpg"></article> tail</div><p>after</p></article>',
    1: '<section><h3><b>Related</b> <i>coverage</i></h3><p>other</p><ul><li>more</ul></section><h4 class="k">Kept &amp; low</h4><p>after</p></article>',
    2: '<figure><a href="/x"><img class="w" src="https://img.example/x-150x150.jpg"></a><figcaption>cap</figcaption></figure><img src="data:image/gif;base64,AAAA" data-src="https://img.example/body-1200x800.jpg"><img src="https://img.example/follow-us.png"></article>',
    3: '<div><h2>Read more</h2>gone<p>gone</p></div>stays<img src="https://img.example/a-picture.jpg" width="300" height="250"><img srcset="https://img.example/set-picture.jpg 2x, https://img.example/b.jpg" width="50"><img src="https://img.example/set-picture.jpg"></article>',
}


def _case(made: dict[int, str]) -> F.Column:
    k = F.col("page_id") % 4
    return F.when(k == 0, made[0]).when(k == 1, made[1]).when(k == 2, made[2]).otherwise(made[3])


def nested(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, html, found): the pages with nested blocks put into their article, and their elements."""
    html = F.replace(F.replace(F.col("html"), F.lit("<article>"), _case(OPEN)), F.lit("</article>"), _case(CLOSE))
    return table(spark, d, "pages").select("page_id", html.alias("html")).withColumn("found", tree.nodes("html"))


def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = tree.node_table(nested(spark, d).select("page_id", "html"))
    return rows.select("page_id", "node", "parent", "depth", "tag", F.col("attrs")["class"].alias("classes"))


def page_body(spark: SparkSession, d: str) -> DataFrame:
    return nested(spark, d).select("page_id", P.without_noise("html", F.col("found"), P.container(F.col("found"), ["section.none"])).alias("body"))


def page_without_embedded(spark: SparkSession, d: str) -> DataFrame:
    return nested(spark, d).select("page_id", P.without_embedded("html", F.col("found")).alias("html"))


def page_heading_levels(spark: SparkSession, d: str) -> DataFrame:
    return nested(spark, d).select("page_id", P.normalised_headings("html", F.col("found")).alias("html"))


def page_lead_list(spark: SparkSession, d: str) -> DataFrame:
    """Bodies cut out of the pages: a list in front of them goes."""
    bodies = nested(spark, d).select("page_id", tree.source_of("html", P.container(F.col("found"))).alias("html")).select("page_id", F.regexp_replace("html", r"(?s)^<article[^>]*>", "").alias("html"))
    return bodies.withColumn("found", tree.nodes("html")).select("page_id", tree.edited("html", P.leading_bullets("html", F.col("found"))).alias("html"))


def page_furniture_images(spark: SparkSession, d: str) -> DataFrame:
    return nested(spark, d).select("page_id", tree.edited("html", P.noise_images(F.col("found"))).alias("html"))


def page_inline_images(spark: SparkSession, d: str) -> DataFrame:
    return nested(spark, d).select("page_id", F.array_join(P.inline_images(F.col("found")), " ").alias("images"))


def page_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return nested(spark, d).select("page_id", P.cleaned("html", F.col("found")).alias("html"))


def _parted(spark: SparkSession, d: str) -> DataFrame:
    return nested(spark, d).drop("found").withColumn("parts", tree.parts("html")).withColumn("body", P.body_runs(F.col("parts")))


def page_main_text(spark: SparkSession, d: str) -> DataFrame:
    return _parted(spark, d).select("page_id", P.main_text(F.col("parts"), F.col("body"), ["div.none", "article"]).alias("text"), P.ends_cut(F.col("parts"), F.col("body")).alias("cut"))


def heading_insertion(spark: SparkSession, d: str) -> DataFrame:
    """Questions proposed for the pages' bodies, at places that repeat, are out of order, or lie outside."""
    k = F.col("page_id").cast("int")
    at = F.array(F.lit(9) + k % 7, k % 5, F.lit(2), k % 3 + 2, F.lit(100), F.when(k % 2 == 0, 4))
    heads = F.array(*(F.lit(h) for h in ("A late one", "What first??", " Two? ", "Which?", "Last", "None")))
    return nested(spark, d).select("page_id", P.put_headings("html", F.col("found"), heads, at).alias("html"))


def body_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """The container without furniture, then cleaned: what a stored body goes through."""
    body = nested(spark, d).select("page_id", P.without_noise("html", F.col("found"), P.container(F.col("found"))).alias("html"))
    return tree.with_nodes(body).select("page_id", P.cleaned("html", F.col("found")).alias("html"))


QUERIES = {f.__name__: f for f in (page_nodes, page_body, page_without_embedded, page_heading_levels, page_lead_list, page_furniture_images, page_inline_images, page_cleaned, page_main_text, heading_insertion, body_cleaning)}

_quote = lambda s: "'" + s.replace("'", "''") + "'"
_names = lambda names: "(" + ", ".join(_quote(n) for n in sorted(names)) + ")"
_list = lambda names: "[" + ", ".join(_quote(n) for n in sorted(names)) + "]"
_sql_case = lambda made: "CASE page_id % 4 " + " ".join(f"WHEN {k} THEN {_quote(v)}" for k, v in made.items()) + " END"
MADE_SQL = f"SELECT page_id, replace(replace(html, '<article>', {_sql_case(OPEN)}), '</article>', {_sql_case(CLOSE)}) AS html FROM pages"
_SIBLINGS = " ".join(f"WHEN name = '{n}' THEN greatest({', '.join(f'last_of(stack, {_quote(w)})' for w in sorted(closes))}) * (greatest({', '.join(f'last_of(stack, {_quote(w)})' for w in sorted(closes))}) > {'greatest(' + ', '.join(f'last_of(stack, {_quote(w)})' for w in sorted(limits)) + ')' if limits else '0'})::INT" for n, (closes, limits) in tree.SIBLINGS.items())


def _last(name: str) -> str:
    """Place of the last open element of a name, 0 without one."""
    return f"coalesce((len(stack) + 1 - list_position(list_reverse(list_transform(stack, lambda x: x.name)), {name})) % (len(stack) + 1), 0)"


def _expand(sql: str) -> str:
    import re

    return re.sub(r"last_of\(stack, ('[^']*'|name)\)", lambda m: _last(m[1]), sql)


#: CTEs ``made`` and ``tok``: the pages cut into tags, comments and texts.
_TOKENS = rf"""RECURSIVE made AS ({{made}}),
    cut AS (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<![^>]*>|<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>|<[^>]*>|[^<]+|<') AS t FROM made),
    raw AS (SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM cut),
    tok AS MATERIALIZED (SELECT page_id, i, tok, lower(regexp_extract(tok, '^</?([a-zA-Z][^\s/>]*)', 1)) AS name,
        CASE WHEN NOT regexp_matches(tok, '^</?[a-zA-Z]') THEN 'text' WHEN tok LIKE '</%' THEN 'end'
             WHEN regexp_matches(tok, '(?is)^<(script|style)\b.*</') THEN 'whole' WHEN name IN {_names(tree.VOID)} THEN 'whole' ELSE 'start' END AS kind FROM raw)"""


def tree_sql(made: str) -> str:
    """CTEs: ``tok`` (page_id, i, tok, kind, name), ``el`` (page_id, i, stop, ended, parent, name, tok): elements by the numbers of their first and last token. A walk from token to token with a stack."""
    scopes = "greatest(" + ", ".join(f"last_of(stack, {_quote(n)})" for n in sorted(tree.SCOPES)) + ")"
    return _expand(
        rf"""{_TOKENS.format(made=made)},
    walk AS (
        SELECT page_id, 0::BIGINT AS i, []::STRUCT(name VARCHAR, i BIGINT)[] AS stack, []::STRUCT(i BIGINT, stop BIGINT, ended BOOLEAN)[] AS closed, NULL::BIGINT AS parent FROM made
        UNION ALL
        SELECT page_id, i, CASE kind WHEN 'start' THEN list_append(rest, {{'name': name, 'i': i}}) WHEN 'end' THEN rest ELSE rest END,
               CASE WHEN place > 0 THEN list_transform(list_slice(stack, place, len(stack)), lambda x: {{'i': x.i, 'stop': CASE WHEN kind = 'end' AND x.i = stack[place].i THEN i ELSE i - 1 END, 'ended': kind = 'end' AND x.i = stack[place].i}}) ELSE [] END,
               CASE WHEN len(rest) > 0 THEN rest[len(rest)].i END
        FROM (SELECT *, CASE WHEN place > 0 THEN list_slice(stack, 1, place - 1) ELSE stack END AS rest FROM (
              SELECT w.page_id, t.i, t.kind, t.name, w.stack,
                     CASE WHEN kind = 'text' THEN 0 WHEN kind = 'end' THEN last_of(stack, name)
                          WHEN name IN {_names(tree.BLOCKS)} THEN last_of(stack, 'p') * (last_of(stack, 'p') > {scopes})::INT {_SIBLINGS} ELSE 0 END AS place
              FROM walk w JOIN tok t ON t.page_id = w.page_id AND t.i = w.i + 1))),
    last AS (SELECT page_id, max(i) AS stop FROM tok GROUP BY page_id),
    shut AS (SELECT page_id, unnest(closed, recursive := true) FROM (SELECT page_id, closed FROM walk)
             UNION ALL SELECT page_id, s.i, stop, false FROM (SELECT w.page_id, l.stop, unnest(stack) AS s FROM walk w JOIN last l ON l.page_id = w.page_id AND l.stop = w.i)
             UNION ALL SELECT page_id, i, i, false FROM tok WHERE kind = 'whole'),
    el AS MATERIALIZED (SELECT s.page_id, s.i, s.stop, s.ended, w.parent, t.name, t.tok, regexp_extract(t.tok, '(?i)\sclass="([^"]*)"', 1) AS classes, regexp_extract(t.tok, '(?i)\sid="([^"]*)"', 1) AS ident
           FROM shut s JOIN tok t USING (page_id, i) JOIN walk w USING (page_id, i))"""
    )


def _unescaped(tok: str) -> str:
    for name, sign in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("#x27", "''"), ("#39", "''"), ("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0"), ("amp", "&")):
        tok = f"replace({tok}, '&{name};', '{sign}')"
    return tok


def _without(gone: str, scope: str = "", tok: str = "tok") -> str:
    """The text of each page but for the tokens that lie in rows (page_id, i, stop) of ``gone``."""
    return f"SELECT m.page_id, coalesce(string_agg({tok}, '' ORDER BY k.i) FILTER (g.page_id IS NULL), '') AS html FROM made m LEFT JOIN tok k USING (page_id) {scope} LEFT JOIN (SELECT DISTINCT k.page_id, k.i FROM tok k JOIN {gone} g ON g.page_id = k.page_id AND k.i BETWEEN g.i AND g.stop) g ON g.page_id = k.page_id AND g.i = k.i GROUP BY m.page_id"


_NOISY = rf"(name IN {_names(P.STRUCTURAL)} OR ((regexp_matches(classes, '(?i){P.NOISE}') OR regexp_matches(ident, '(?i){P.NOISE}')) AND NOT regexp_matches(classes, '(?i){P.OWN_HEADER}') AND NOT regexp_matches(ident, '(?i){P.OWN_HEADER}')))"
_CONTAINER = "box AS (SELECT page_id, i, stop FROM (SELECT *, CASE WHEN list_contains(string_split(classes, ' '), 'article-content') THEN 1 WHEN name = 'article' THEN 2 END AS nth FROM el) WHERE nth IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY nth, i) = 1)"
_INNER_TEXT = rf"(SELECT coalesce(string_agg(trim(regexp_replace({_unescaped('k.tok')}, '\s+', ' ', 'g')), '' ORDER BY k.i), '') FROM tok k WHERE k.page_id = h.page_id AND k.i BETWEEN h.i AND h.stop AND k.kind = 'text' AND k.tok NOT LIKE '<%')"
_HEADINGS = rf"""heads AS MATERIALIZED (SELECT h.*, {_INNER_TEXT} AS label FROM el h WHERE name IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')),
    tails AS MATERIALIZED (SELECT h.page_id, h.i, h.stop FROM heads h WHERE label = ''
              UNION ALL SELECT h.page_id, h.i, CASE WHEN p.ended THEN p.stop - 1 ELSE p.stop END FROM heads h JOIN el p ON p.page_id = h.page_id AND p.i = h.parent WHERE regexp_matches(label, '(?i)^\s*({P.NOISE_HEADINGS.replace("'", "''")})(?:\W|$)'))"""
_LEVELS = """left_ AS (SELECT h.* FROM heads h LEFT JOIN {gone} t ON t.page_id = h.page_id AND t.i <= h.i AND h.stop <= t.stop WHERE t.page_id IS NULL),
    named AS (SELECT page_id, i, stop, ended, name AS old, CASE WHEN name = min(name) OVER (PARTITION BY page_id) THEN 'h2' ELSE 'h3' END AS new FROM left_),
    renamed AS (SELECT page_id, i, new FROM named UNION ALL SELECT page_id, stop, new FROM named WHERE ended)"""
_RENAMED = "CASE WHEN r.new IS NULL THEN k.tok ELSE regexp_replace(k.tok, '^(</?)..', '\\1' || r.new) END"
_JOIN_NAMES = "LEFT JOIN renamed r ON r.page_id = k.page_id AND r.i = k.i"
_ATTR = lambda n: rf"""regexp_extract(tok, '(?i)\s{n}="([^"]*)"', 1)"""
_IMAGES = rf"""pics AS MATERIALIZED (SELECT *, CASE WHEN length({_ATTR("data-src")}) > 10 THEN {_ATTR("data-src")} WHEN {_ATTR("srcset")} LIKE 'http%' THEN regexp_extract({_ATTR("srcset")}, '^[^\s,]+') WHEN length({_ATTR("src")}) > 10 AND {_ATTR("src")} NOT LIKE 'data:%' THEN {_ATTR("src")} ELSE '' END AS src,
        {_ATTR("width")} AS w, {_ATTR("height")} AS h FROM el WHERE name = 'img'),
    noisy AS MATERIALIZED (SELECT *, src = '' OR regexp_matches(src, '(?i){P.NOISE_ADDRESS}') OR w || 'x' || h IN {_names(P.AD_SIZES)} OR coalesce(regexp_extract(src, '-(\d+x\d+)\.[a-z]+$', 1) IN {_names(P.AD_SIZES)} OR least(try_cast(regexp_extract(src, '-(\d+)x\d+\.[a-z]+$', 1) AS INT), try_cast(regexp_extract(src, '-\d+x(\d+)\.[a-z]+$', 1) AS INT)) < {P.LEAST_SIDE}, false) AS noise FROM pics),
    dropped AS MATERIALIZED (SELECT n.page_id, coalesce(max_by(f.i, f.i), n.i) AS i, coalesce(max_by(f.stop, f.i), n.stop) AS stop FROM noisy n LEFT JOIN el f ON f.name = 'figure' AND f.page_id = n.page_id AND f.i < n.i AND n.stop <= f.stop WHERE noise GROUP BY n.page_id, n.i, n.stop)"""
_EMBEDDED = f"(SELECT page_id, i, stop FROM el WHERE regexp_matches(classes || ' ' || ident, '(?i){P.EMBEDDED}'))"
_BODIES = f"""SELECT page_id, regexp_replace(string_agg(tok, '' ORDER BY i), '^<article[^>]*>', '') AS html FROM (WITH {{tree}}, {_CONTAINER} SELECT k.* FROM tok k JOIN box b ON b.page_id = k.page_id AND k.i BETWEEN b.i AND b.stop) GROUP BY page_id"""
_LEADS = r"""SELECT page_id, i, stop FROM (SELECT * FROM el WHERE parent IS NOT DISTINCT FROM NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) = 1) f
        WHERE name = 'ul' AND NOT EXISTS (FROM tok k WHERE k.page_id = f.page_id AND k.i < f.i AND k.tok NOT LIKE '<!%' AND trim(k.tok, E' \n\t\r') <> '')"""

_READY = f"SELECT * FROM (WITH {tree_sql(MADE_SQL)}, {_CONTAINER}, gone AS (SELECT e.page_id, e.i, e.stop FROM el e JOIN box b ON b.page_id = e.page_id AND e.i > b.i AND e.stop <= b.stop WHERE {_NOISY}) {_without('gone', 'JOIN box b ON b.page_id = k.page_id AND k.i BETWEEN b.i AND b.stop')})"
_RUNS = rf"""cuts AS (SELECT page_id, i, tok, kind, sum((kind <> 'text' AND name IN {_names(tree.CUTS)})::INT) OVER (PARTITION BY page_id ORDER BY i) AS run FROM tok),
    hid AS (SELECT page_id, i, stop FROM el WHERE name IN {_names(tree.HIDDEN)}), link AS (SELECT page_id, i, stop FROM el WHERE name = 'a'),
    words AS (SELECT c.page_id, c.i, c.run, {_unescaped('tok')} AS tok, EXISTS (FROM link l WHERE l.page_id = c.page_id AND c.i BETWEEN l.i AND l.stop) AS linked
              FROM cuts c WHERE kind = 'text' AND tok NOT LIKE '<%' AND NOT EXISTS (FROM hid h WHERE h.page_id = c.page_id AND c.i BETWEEN h.i AND h.stop)),
    runs AS MATERIALIZED (SELECT page_id, run, min(i) AS i, trim(regexp_replace(string_agg(tok, '' ORDER BY i), '\s+', ' ', 'g')) AS text, coalesce(sum(length(trim(regexp_replace(tok, '\s+', ' ', 'g')))) FILTER (linked), 0) AS linked FROM words GROUP BY page_id, run HAVING text <> ''),
    outside AS (SELECT page_id, i, stop FROM el WHERE name IN {_names(P.OUTSIDE)} OR regexp_matches(classes || ' ' || ident, '(?i){P.EMBEDDED}') OR regexp_matches(classes || ' ' || ident, '(?i)(?:^|[\s_-])(?:ads?|promo|sponsored)(?:$|[\s_-])')),
    remain AS (SELECT *, greatest(length(text) - linked, 0) AS dense FROM runs r WHERE NOT EXISTS (FROM outside o WHERE o.page_id = r.page_id AND r.i BETWEEN o.i AND o.stop)),
    marked AS MATERIALIZED (SELECT *, (lag(dense, 1, 0) OVER w + 2 * dense + lead(dense, 1, 0) OVER w) / 4 >= {P.DENSITY} AND linked <= {P.LINK_SHARE} * length(text) AS keep FROM remain WINDOW w AS (PARTITION BY page_id ORDER BY i)),
    bounds AS (SELECT page_id, min(i) AS a, max(i) AS b FROM marked WHERE keep GROUP BY page_id),
    lists AS (SELECT e.page_id, e.i, e.stop FROM el e JOIN bounds USING (page_id) WHERE e.name IN {_names(P.KEPT_WHOLE)} AND e.i > a AND e.stop < b),
    main AS MATERIALIZED (SELECT * FROM marked m WHERE keep OR EXISTS (FROM lists l WHERE l.page_id = m.page_id AND m.i BETWEEN l.i AND l.stop)),
    body AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS text FROM main GROUP BY page_id),
    box AS (SELECT page_id, i, stop FROM el WHERE name = 'article' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) = 1),
    chosen AS (SELECT r.page_id, string_agg(text, chr(10) ORDER BY r.i) AS text FROM runs r JOIN box b ON b.page_id = r.page_id AND r.i BETWEEN b.i AND b.stop GROUP BY r.page_id),
    whole AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS text FROM runs GROUP BY page_id),
    final AS (SELECT * FROM main QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i DESC) = 1),
    ended AS (SELECT f.page_id, coalesce(max_by(e.name, e.i), '') NOT IN {_names(P.NEVER_CUT)} AND right(f.text, 1) NOT IN ('.', '!', '?', '"', '”', '»', ')', ']', '…', ':') AS cut FROM final f LEFT JOIN el e ON e.page_id = f.page_id AND e.i < f.i AND f.i <= e.stop AND e.name IN {_names(tree.CUTS)} GROUP BY f.page_id, f.text)"""

ORACLE = {
    "page_nodes": f"WITH {tree_sql(MADE_SQL)}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS node FROM el), a AS (SELECT c.page_id, c.i, count(*) AS depth FROM el c JOIN el o ON o.page_id = c.page_id AND o.i < c.i AND c.stop <= o.stop GROUP BY c.page_id, c.i) SELECT n.page_id, n.node, coalesce(p.node, -1) AS parent, coalesce(depth, 0) AS depth, n.name AS tag, nullif(n.classes, '') AS classes FROM n LEFT JOIN n p ON p.page_id = n.page_id AND p.i = n.parent LEFT JOIN a ON a.page_id = n.page_id AND a.i = n.i",
    "page_body": f"WITH {tree_sql(MADE_SQL)}, {_CONTAINER}, gone AS (SELECT e.page_id, e.i, e.stop FROM el e JOIN box b ON b.page_id = e.page_id AND e.i > b.i AND e.stop <= b.stop WHERE {_NOISY}) SELECT page_id, html AS body FROM ({_without('gone', 'JOIN box b ON b.page_id = k.page_id AND k.i BETWEEN b.i AND b.stop')})",
    "page_without_embedded": f"WITH {tree_sql(MADE_SQL)} {_without(_EMBEDDED)}",
    "page_heading_levels": f"WITH {tree_sql(MADE_SQL)}, {_HEADINGS}, {_LEVELS.format(gone='tails')} {_without('tails', _JOIN_NAMES, _RENAMED)}",
    "page_lead_list": f"WITH {tree_sql(_BODIES.format(tree=tree_sql(MADE_SQL)))}, gone AS ({_LEADS}) {_without('gone')}",
    "page_furniture_images": f"WITH {tree_sql(MADE_SQL)}, {_IMAGES} {_without('dropped')}",
    "page_inline_images": f"""WITH {tree_sql(MADE_SQL)}, {_CONTAINER}, {_IMAGES}, gone AS (SELECT e.page_id, e.i, e.stop FROM el e JOIN box b ON b.page_id = e.page_id AND e.i > b.i AND e.stop <= b.stop WHERE {_NOISY}),
        own AS (SELECT n.page_id, n.src, min(n.i) AS i FROM noisy n JOIN box b ON b.page_id = n.page_id AND n.i > b.i AND n.stop <= b.stop
                WHERE NOT noise AND src LIKE 'http%' AND coalesce(try_cast(w AS INT) NOT BETWEEN 1 AND 99, true) AND coalesce(try_cast(h AS INT) NOT BETWEEN 1 AND 99, true) AND NOT EXISTS (FROM gone g WHERE g.page_id = n.page_id AND n.i BETWEEN g.i AND g.stop) GROUP BY n.page_id, n.src)
        SELECT m.page_id, CASE WHEN count(o.i) > 6 THEN '' ELSE coalesce(string_agg(o.src, ' ' ORDER BY o.i), '') END AS images FROM made m LEFT JOIN own o USING (page_id) GROUP BY m.page_id""",
    "page_cleaned": f"WITH {tree_sql(MADE_SQL)}, {_HEADINGS}, {_IMAGES}, gone AS MATERIALIZED (SELECT * FROM {_EMBEDDED} UNION ALL FROM tails UNION ALL FROM dropped), {_LEVELS.format(gone='gone')} {_without('gone', _JOIN_NAMES, _RENAMED)}",
    "page_main_text": f"WITH {tree_sql(MADE_SQL)}, {_RUNS} SELECT m.page_id, CASE WHEN length(coalesce(b.text, '')) >= {P.LEAST_BODY} THEN b.text WHEN length(coalesce(c.text, '')) > 0 THEN c.text ELSE coalesce(w.text, '') END AS text, coalesce(e.cut, false) AS cut FROM made m LEFT JOIN body b USING (page_id) LEFT JOIN chosen c USING (page_id) LEFT JOIN whole w USING (page_id) LEFT JOIN ended e USING (page_id)",
    "heading_insertion": f"""WITH {tree_sql(MADE_SQL)}, para AS (SELECT page_id, i, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n, count(*) OVER (PARTITION BY page_id) AS total FROM el WHERE name = 'p'),
        wanted AS (SELECT page_id, unnest([9 + page_id % 7, page_id % 5, 2, page_id % 3 + 2, 100, CASE WHEN page_id % 2 = 0 THEN 4 END]) AS spot, unnest(['A late one', 'What first', 'Two', 'Which', 'Last', 'None']) AS h, unnest(range(6)) AS k FROM made),
        held AS (SELECT w.page_id, greatest(2, least(spot, total - 1)) AS place, h, spot AS raw, k FROM wanted w JOIN (SELECT DISTINCT page_id, total FROM para) USING (page_id) WHERE spot IS NOT NULL AND total >= 3),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY raw, k) AS nth FROM (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY page_id, place ORDER BY raw, k) = 1) QUALIFY nth <= 3),
        put AS (SELECT p.page_id, p.i, '<h2>' || h || '?</h2>' AS h FROM firsts f JOIN para p ON p.page_id = f.page_id AND p.n = f.place)
        SELECT m.page_id, CASE WHEN count(p.i) > 0 THEN string_agg(coalesce(p.h, '') || k.tok, '' ORDER BY k.i) END AS html FROM made m LEFT JOIN tok k USING (page_id) LEFT JOIN put p ON p.page_id = k.page_id AND p.i = k.i GROUP BY m.page_id""",
    "body_cleaning": f"WITH {tree_sql(_READY)}, {_HEADINGS}, {_IMAGES}, lead_ AS MATERIALIZED ({_LEADS}), gone AS MATERIALIZED (SELECT * FROM {_EMBEDDED} UNION ALL FROM tails UNION ALL FROM dropped UNION ALL FROM lead_), {_LEVELS.format(gone='gone')} {_without('gone', _JOIN_NAMES, _RENAMED)}",
    "html_sanitise": rf"""WITH {_TOKENS.format(made="SELECT page_id, html FROM pages")},
    walk AS (SELECT page_id, 0::BIGINT AS i, []::VARCHAR[] AS stack, '' AS piece FROM made
        UNION ALL SELECT page_id, i, CASE WHEN kind = 'start' AND name IN {_names(html.ALLOWED)} THEN list_append(stack, name) WHEN place > 0 THEN list_slice(stack, 1, place - 1) ELSE stack END,
            CASE WHEN kind = 'text' AND tok NOT LIKE '<%' THEN replace(replace(replace({_unescaped('tok')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
                 WHEN kind IN ('start', 'whole') AND name IN {_names(html.ALLOWED)} THEN '<' || name || CASE WHEN name = 'a' AND tok LIKE '% href="%' THEN ' href="' || regexp_extract(tok, ' href="([^"]*)"', 1) || '"' ELSE '' END || '>'
                 WHEN place > 0 THEN array_to_string(list_transform(list_reverse(list_slice(stack, place, len(stack))), lambda x: '</' || x || '>'), '') ELSE '' END
        FROM (SELECT w.page_id, t.i, t.kind, t.name, t.tok, w.stack, CASE WHEN t.kind = 'end' AND list_contains(w.stack, t.name) THEN len(w.stack) + 1 - list_position(list_reverse(w.stack), t.name) ELSE 0 END AS place FROM walk w JOIN tok t ON t.page_id = w.page_id AND t.i = w.i + 1))
    SELECT page_id, string_agg(piece, '' ORDER BY i) || array_to_string(list_transform(list_reverse(max_by(stack, i)), lambda x: '</' || x || '>'), '') AS html FROM walk GROUP BY page_id""",
    "main_content": rf"""WITH {_TOKENS.format(made="SELECT page_id, html FROM pages")},
    marked AS (SELECT *, name IN {_names(html.DROPPED | {"title"})} AS dropped, name IN {_names(html.FURNITURE)} OR (name = 'div' AND kind = 'start' AND regexp_matches(tok, '(?:class|id)="[^"]*\b(?:ad|ads|promo|share|related|cookie)\b')) AS furnished, name IN {_names(html.BLOCKS)} AS block FROM tok),
    walk AS (SELECT page_id, 0::BIGINT AS i, 0 AS skip, 0 AS furn, 0 AS links, 'body' AS tag, 0 AS n, '' AS said FROM made
        UNION ALL SELECT w.page_id, t.i,
            CASE WHEN dropped AND kind = 'start' THEN skip + 1 WHEN dropped AND kind = 'end' THEN greatest(0, skip - 1) ELSE skip END,
            CASE WHEN dropped THEN furn WHEN kind = 'start' AND furnished THEN furn + 1 WHEN kind = 'end' AND (t.name IN {_names(html.FURNITURE)} OR t.name = 'div') THEN greatest(0, furn - 1) ELSE furn END,
            CASE WHEN t.name = 'a' AND kind = 'start' THEN links + 1 WHEN t.name = 'a' AND kind = 'end' THEN greatest(0, links - 1) ELSE links END,
            CASE WHEN kind = 'start' AND NOT dropped AND (furnished OR block) THEN t.name ELSE tag END,
            CASE WHEN NOT dropped AND kind IN ('start', 'end') AND (furnished OR block) THEN n + 1 ELSE n END,
            CASE WHEN kind = 'text' AND tok NOT LIKE '<%' AND skip = 0 THEN {_unescaped('tok')} ELSE '' END
        FROM walk w JOIN marked t ON t.page_id = w.page_id AND t.i = w.i + 1),
    found AS (SELECT page_id, n, any_value(tag) AS tag, any_value(furn) > 0 AS furnished, trim(regexp_replace(string_agg(said, '' ORDER BY i), '\s+', ' ', 'g')) AS text, coalesce(sum(length(said)) FILTER (links > 0), 0) AS linked FROM walk WHERE said <> '' GROUP BY page_id, n HAVING trim(regexp_replace(string_agg(said, '' ORDER BY i), '\s+', ' ', 'g')) <> ''),
    texts AS (SELECT page_id, coalesce(string_agg(text, chr(10) ORDER BY n) FILTER (NOT furnished AND linked * 2 < length(text)), '') AS body, string_agg(text, chr(10) ORDER BY n) AS every,
              max_by(tag NOT IN ('td', 'tr', 'li', 'figcaption') AND right(text, 1) NOT IN ('.', '!', '?', '"', '”', '»', ')', ']', '…', ':'), n) FILTER (NOT furnished) AS cut FROM found GROUP BY page_id)
    SELECT m.page_id, CASE WHEN length(coalesce(body, '')) >= 200 THEN body ELSE coalesce(every, '') END AS text, coalesce(cut, false) AS cut FROM made m LEFT JOIN texts USING (page_id)""",
}
