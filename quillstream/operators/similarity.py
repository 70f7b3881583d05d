"""Near duplicates by shingles, for a look-back window and against a second table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..filters import hit_filter, probed
from ..storage import settle

TOKENS = r"[^\p{L}\p{N}]+"
#: Bits of a shingle's hash that travel to find candidates; both sets are compared by all 64 afterwards.
TOKEN_BITS = 40


def _per_text(rows: DataFrame, id_col: str, text_col: str, width: int, make: Callable[[Column], Column], name: str) -> DataFrame:
    """(id, name): ``make`` of each text's array of windows, structs of ``width`` neighbouring words.

    The words are bound as a lambda's variable and the result passes an explode, so that a text is split
    once: no optimizer rule repeats the expression for a filter or for every window.
    """
    words = F.filter(F.split(F.lower(text_col), TOKENS), lambda w: w != "")

    def windows(w: Column) -> Column:
        n = F.greatest(F.lit(0), F.size(w) - (width - 1))
        return F.arrays_zip(*(F.slice(w, F.lit(i + 1), n).alias(f"w{i}") for i in range(width)))

    return rows.select(F.col(id_col).alias("id"), F.explode(F.transform(F.array(words), lambda w: make(windows(w)))).alias(name))


def _fields(x: Column, width: int) -> list[Column]:
    return [x[f"w{i}"] for i in range(width)]


def shingles(rows: DataFrame, id_col: str, text_col: str, width: int = 5) -> DataFrame:
    """(id, shingle): the distinct word shingles of each text."""
    made = _per_text(rows, id_col, text_col, width, lambda x: F.array_distinct(F.transform(x, lambda y: F.concat_ws(" ", *_fields(y, width)))), "s")
    return made.select("id", F.explode("s").alias("shingle"))


def _sets(rows: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, class_key, n, s): each text's distinct shingles as sorted 64-bit hashes; texts without any are left out.

    ``class_key`` is a 256-bit digest of the set, so that equal sets meet under one key and others do not.
    """
    sets = _per_text(rows, id_col, text_col, width, lambda x: F.sort_array(F.array_distinct(F.transform(x, lambda y: F.xxhash64(*_fields(y, width))))), "s")
    key = F.sha2(F.array_join(F.col("s").cast("array<string>"), " "), 256)
    return sets.filter(F.size("s") > 0).select("id", key.alias("class_key"), F.size("s").alias("n"), "s")


def _class_links(classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) for classes a < b of (rep, n, s) whose sets reach the threshold; ``sets`` holds (id, s) of the representatives at least.

    Prefix filter: shingles are ordered from rare to frequent, and two sets over the threshold share one of
    the first (1 - threshold) * n + 1 of either. Only class numbers, sizes and places travel through that
    join; the place of a shared shingle bounds what two sets can share at most, and what is left is made
    distinct before both sets are fetched, once for a pair, of those that are in a pair.

    Shingles travel as tokens of ``TOKEN_BITS``, distinct in a set. Shingles of a set that share a token only
    lengthen its prefix, which loses no pair: n counts the shingles, and tokens are no more than those.
    """
    tokens = F.array_distinct(F.transform("s", lambda h: h.bitwiseAND(F.lit((1 << TOKEN_BITS) - 1))))
    posts = classes.select("rep", "n", tokens.alias("s")).select("rep", "n", F.size("s").alias("t"), F.explode("s").alias("h"))
    # One exchange tells the frequencies and keeps the rows beside them.
    known = posts.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("df > 1")
    order = known.groupBy("rep", "n", "t").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"), F.count(F.lit(1)).alias("m"))
    # Shingles of one set alone come first in the order and join with nothing: they only move the places.
    alone = (F.col("t") - F.col("m")).cast("int")
    reach = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int")
    keys = order.select("rep", "n", F.posexplode(F.slice("x", F.lit(1), F.greatest(F.lit(0), reach - alone))).alias("i", "x"), alone.alias("alone"))
    keys = keys.select("rep", "n", (F.col("i") + F.col("alone")).alias("i"), F.col("x.h").alias("h"))
    other = keys.select(F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("i").alias("i_b"), "h")
    # The first shared place of a pair: at most that one and all behind it are shared.
    most = F.least(F.col("n") - F.col("i"), F.col("n_b") - F.col("i_b"))
    first = keys.join(other, "h").filter("rep < rep_b AND n >= {0} * n_b AND n_b >= {0} * n".format(threshold))
    first = first.groupBy("rep", "rep_b", "n", "n_b").agg(F.max(most).alias("most")).filter(F.col("most") >= threshold / (1 + threshold) * (F.col("n") + F.col("n_b")) - 1e-6)
    pairs = settle(first.select("rep", "rep_b"))
    held = probed(sets.select("id", "s"), settle(hit_filter(pairs.select(F.explode(F.array("rep", "rep_b")).alias("digest")))), "id", "met").filter("met")
    pairs = pairs.join(held.select(F.col("id").alias("rep"), "s"), "rep").join(held.select(F.col("id").alias("rep_b"), F.col("s").alias("s_b")), "rep_b")
    both = F.size(F.array_intersect("s", "s_b"))
    share = both / (F.size("s") + F.size("s_b") - both)
    return pairs.select(F.col("rep").alias("a"), F.col("rep_b").alias("b"), share.alias("similarity")).filter(F.col("similarity") >= threshold)


def near_classes(rows: DataFrame, id_col: str = "id", text_col: str = "body", width: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members (id, rep), links (a, b, similarity) between representatives a < b).

    Texts with equal sets of shingles form a class, named by its smallest id; links are found once for a
    class, so copies are never expanded into pairs and no link between different sets is lost.
    """
    sets = settle(_sets(rows, id_col, text_col, width))
    several = settle(sets.groupBy("class_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("class_key", "rep"))
    # Sets that the filter clears have no copy and stay where they lie.
    marked = probed(sets, settle(hit_filter(several.select(F.col("class_key").alias("digest")))), "class_key", "copied")
    single, copied = marked.filter("not copied"), marked.filter("copied")
    met = settle(copied.select("id", "class_key").join(several, "class_key", "left").select("id", F.coalesce("rep", "id").alias("rep")))
    members = single.select("id", F.col("id").alias("rep")).unionAll(met)
    kept = copied.join(met.filter("id = rep"), "id", "left_semi")
    classes = single.unionAll(kept).select(F.col("id").alias("rep"), "n", "s")
    return members, _class_links(classes, sets, threshold)


def near_pairs(rows: DataFrame, id_col: str = "id", text_col: str = "body", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity): links between the representatives of classes, and (representative, member, 1) for the rest of each class."""
    members, links = near_classes(rows, id_col, text_col, width, threshold)
    own = members.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return links.unionByName(own)


def near_before(rows: DataFrame, hours: int, id_col: str = "id", text_col: str = "body", time_col: str = "published_at", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, earlier_id, similarity): for each row with a near duplicate in the ``hours`` before it, the latest such (ties: the larger id).

    Rows look into the timelines of the classes linked to their own, cut into spans of ``hours``; members
    stand in their own span and the next one, so a look-back never leaves a span and no timeline is whole
    in one task.
    """
    members, links = near_classes(rows, id_col, text_col, width, threshold)
    at = rows.select(F.col(id_col).alias("id"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("at")).filter("at is not null")
    member = members.join(at, "id")
    back = hours * 3_600_000_000
    both = links.unionAll(links.select("b", "a", "similarity")).select(F.col("a").alias("rep"), F.col("b").alias("line"), "similarity")
    asks = member.join(both, "rep").select("line", "id", "at", "similarity").unionByName(member.select(F.col("rep").alias("line"), "id", "at", F.lit(1.0).alias("similarity")))
    span = F.floor(F.col("at") / F.lit(back)).cast("long")
    asks = asks.select("line", span.alias("span"), "at", "id", F.lit(0).alias("kind"), "similarity")
    held = member.select(F.col("rep").alias("line"), F.explode(F.array(span, span + 1)).alias("span"), "at", "id", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("similarity"))
    before = Window.partitionBy("line", "span").orderBy("at", "id", "kind").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == 1, F.struct("at", "id")), ignorenulls=True).over(before)
    seen = asks.unionByName(held).withColumn("last", last).filter((F.col("kind") == 0) & (F.col("last.at") >= F.col("at") - back))
    best = seen.groupBy("id").agg(F.max(F.struct(F.col("last.at").alias("at"), F.col("last.id").alias("id"), "similarity")).alias("x"))
    return best.select("id", F.col("x.id").alias("earlier_id"), F.col("x.similarity").alias("similarity"))


def near_newest(batch: DataFrame, stored: DataFrame, now: Column, hours: int = 48, newest: int = 200, id_col: str = "id", text_col: str = "body", time_col: str = "published_at", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, duplicate_of, similarity) for rows of the batch that are near one of the candidates: the ``newest`` stored rows of the last ``hours``.

    Rows of the batch that are stored already (updates) are not judged. The most similar candidate counts, of
    equals the newest. At most ``newest`` rows are compared with, so each batch row meets a bounded table.
    """
    held = stored.filter(F.col(time_col) >= now - F.expr(f"interval {hours} hours")).orderBy(F.col(time_col).desc_nulls_last(), F.col(id_col).desc()).limit(newest)
    fresh = batch.join(stored.select(id_col), id_col, "left_anti")
    a = _sets(fresh, id_col, text_col, width).select("id", "s", "n")
    b = _sets(held, id_col, text_col, width).select(F.col("id").alias("other"), F.col("s").alias("s_b"), F.col("n").alias("n_b"))
    posts = a.select("id", "n", F.explode("s").alias("h")).join(b.select("other", "n_b", F.explode("s_b").alias("h")), "h")
    shared = posts.groupBy("id", "other", "n", "n_b").agg(F.count(F.lit(1)).alias("both"))
    near = shared.withColumn("similarity", F.col("both") / (F.col("n") + F.col("n_b") - F.col("both"))).filter(F.col("similarity") >= threshold)
    near = near.join(held.select(F.col(id_col).alias("other"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("at")), "other")
    best = near.groupBy("id").agg(F.max(F.struct("similarity", "at", "other")).alias("x"))
    return best.select("id", F.col("x.other").alias("duplicate_of"), F.col("x.similarity").alias("similarity"))


def overlap(rows: DataFrame, targets: DataFrame, id_col: str, text_col: str, target_id: str, target_text: str, width: int = 5) -> DataFrame:
    """(id, target, shared): how many distinct shingles of a target stand in a text; texts without any are left out.

    64-bit hashes of shingles meet the targets' hashes first, and only texts that hold one are taken apart again
    as text: what is shuffled of the others is eight bytes a shingle, and nothing at all where the targets'
    hashes are few enough to be sent to the tasks.
    """
    wanted = shingles(targets, target_id, target_text, width).select(F.col("id").alias("target"), "shingle")
    told = wanted.select(F.xxhash64("shingle").alias("h")).distinct()
    hashes = _per_text(rows, id_col, text_col, width, lambda x: F.array_distinct(F.transform(x, lambda y: F.xxhash64(F.concat_ws(" ", *_fields(y, width))))), "s")
    near = settle(hashes.select("id", F.explode("s").alias("h")).join(told, "h", "left_semi").select("id").distinct())
    some = rows.join(near.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return shingles(some, id_col, text_col, width).join(wanted, "shingle").groupBy("id", "target").agg(F.count(F.lit(1)).alias("shared"))


def hash_matches(rows: DataFrame, id_col: str, hash_col: str, most_bits: int = 24) -> DataFrame:
    """(a, b, bits) for 256-bit hexadecimal hashes that differ in at most ``most_bits`` bits, each pair of different hashes once and copies by their smallest id.

    Of 16 words of 16 bits, at most 31 differing bits leave one word with at most one. Each hash is sent to
    its words and to every word one bit away; pairs that meet there are compared whole, so none is lost.
    """
    if not 0 <= most_bits < 32:
        raise ValueError("the words hold for at most 31 bits")
    from ..functions.values import hamming_hex

    nodes = rows.filter(F.length(hash_col) == 64).groupBy(F.lower(hash_col).alias("h")).agg(F.min(id_col).alias("id"))
    word = F.array(*(F.struct(F.lit(k).alias("k"), F.conv(F.substring("h", 1 + 4 * k, 4), 16, 10).cast("int").alias("w")) for k in range(16)))
    own = nodes.select("id", "h", F.explode(word).alias("x")).select("id", "h", "x.k", "x.w")
    flips = F.array(F.col("w"), *(F.col("w").bitwiseXOR(F.lit(1 << i)) for i in range(16)))
    spread = own.select(F.col("id").alias("a"), F.col("h").alias("h_a"), "k", F.explode(flips).alias("w"))
    met = spread.join(own, ["k", "w"]).filter("a < id").select("a", F.col("id").alias("b"), "h_a", "h").distinct()
    return met.select("a", "b", hamming_hex("h_a", "h").cast("long").alias("bits")).filter(F.col("bits") <= most_bits)
