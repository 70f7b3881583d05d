"""Change capture and merge semantics over snapshots: no table format is assumed, results are new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def upsert(current: DataFrame, batch: DataFrame, key: str, protected: list[str], stamp: Column | None = None) -> DataFrame:
    """Merge on the key: new rows come in whole; known rows take the batch's values except in protected columns.

    With ``stamp``, updated_at moves only where an unprotected column changes.
    """
    columns = [c for c in current.columns if c != key]
    a, b = current.alias("a").withColumn("__a", F.lit(True)), batch.alias("b").withColumn("__b", F.lit(True))
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    old, new = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    free = [c for c in columns if c not in protected and c != "updated_at" and c in batch.columns]
    moved = F.lit(False)
    for c in free:
        moved |= ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))

    def value(c: str) -> Column:
        if c not in batch.columns:
            return F.when(old & new & moved, stamp).when(new & ~old, stamp).otherwise(F.col(f"a.{c}")) if c == "updated_at" and stamp is not None else F.col(f"a.{c}")
        if c in protected:
            return F.when(old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        return F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(value(c).alias(c) for c in columns))


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last write of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def key_history(old: DataFrame, new: DataFrame, history: DataFrame, item: str, key: str) -> DataFrame:
    """(old_key, item): a key that changed points to its item; a key in use again leaves the history; the latest change wins."""
    moved = old.select(item, F.col(key).alias("old_key")).join(new.select(item, F.col(key).alias("new_key")), item).filter(~F.col("old_key").eqNullSafe(F.col("new_key")))
    entries = history.select("old_key", item, F.lit(0).alias("turn")).unionByName(moved.select("old_key", item, F.lit(1).alias("turn")))
    live = new.select(F.col(key).alias("old_key"))
    best = entries.join(live, "old_key", "left_anti").groupBy("old_key").agg(F.max_by(item, F.struct("turn", item)).alias(item))
    return best


def patch(current: DataFrame, patches: DataFrame, key: str, allowed: list[str], visible: list[str], now: Column) -> DataFrame:
    """Only allowed columns are patched (null: unchanged); updated_at moves only for visible ones."""
    joined = current.join(patches.select(key, *(F.col(c).alias(f"__{c}") for c in allowed)), key, "left")
    moved = F.lit(False)
    for c in set(visible) & set(allowed):
        moved |= F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c))
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in allowed else (F.when(moved, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c)) for c in current.columns))


def toggle(saved: DataFrame, clicks: DataFrame, keys: list[str]) -> DataFrame:
    """Bookmarks after clicks that each add or remove one: those in one table but not, an odd number of times, in the other."""
    odd = clicks.groupBy(*keys).count().filter("count % 2 = 1").select(*keys)
    return saved.select(*keys).join(odd, keys, "left_anti").unionByName(odd.join(saved.select(*keys), keys, "left_anti"))


def reserved(live: DataFrame, retired: DataFrame, key: str) -> DataFrame:
    """Keys that no new row may take: those in use and those that were."""
    return live.select(key).unionByName(retired.select(key)).distinct()


def key_conflicts(gone: DataFrame, live: DataFrame, retired: DataFrame) -> DataFrame:
    """(key, conflict): a key listed as gone may be live, retired by the history, or the stem of a live one with a hash behind it, in this order."""
    one = lambda rows, name: rows.select(F.col("key").alias(name)).distinct()
    joined = gone.join(one(live, "a"), F.col("key") == F.col("a"), "left").join(one(retired, "b"), F.col("key") == F.col("b"), "left")
    joined = joined.join(one(live, "c"), F.regexp_replace("key", "-[0-9a-f]{6}$", "") == F.col("c"), "left")
    return joined.select("key", F.when(F.col("a").isNotNull(), "live").when(F.col("b").isNotNull(), "retired").when(F.col("c").isNotNull(), "stem").otherwise("none").alias("conflict"))


def purge(rows: DataFrame, deadline: str, now: Column) -> DataFrame:
    """Rows whose deadline has passed go; an unknown deadline stays."""
    return rows.filter(F.col(deadline).isNull() | (F.col(deadline) >= now))


def write_if_changed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows for which any new value differs, with the new values."""
    made = rows.withColumns({f"__{c}": v for c, v in columns.items()})
    differs = F.lit(False)
    for c in columns:
        differs |= changed(c, f"__{c}")
    return made.filter(differs).select(*(F.col(f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def unreferenced(objects: DataFrame, path: str, texts: DataFrame, text: str, root: str, least: int = 4) -> DataFrame:
    """Objects that no text mentions: an anti-join on extracted paths, then on raw mentions anywhere in a run of path signs.

    A path's fingerprint is its last 2^k bytes, k as large as its length allows: the end of a path tells it
    from others where folders are shared. Of each run the windows of 2^k bytes, for the k that paths have, are
    posted as (run's hash, place, window's hash): no more rows than bytes for each k, whatever a run's length.
    Places where a fingerprint meets are compared whole, by bytes, with the run, which is fetched by its hash
    and once. Paths under ``least`` bytes are compared with the runs that hold them at all.
    """
    from ..functions.text import object_paths

    named = texts.select(F.explode(object_paths(text, root)).alias(path)).distinct()
    size = F.octet_length(F.col(path))
    left = objects.join(named, path, "left_anti").withColumn("__n", F.when(size < least, size).otherwise(F.pow(F.lit(2), F.floor(F.log2(size))).cast("int")))
    sizes = sorted(r[0] for r in left.select("__n").distinct().collect() if r[0])  # one for each power of two
    runs = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}/_.%~+@-]+"), F.lit(0)))).alias("__text")).distinct()
    runs = runs.select(F.sha2("__text", 256).alias("__run"), F.col("__text").cast("binary").alias("__bytes"))
    raw = F.col(path).cast("binary")
    tails = left.filter("__n > 0").select(path, "__n", F.octet_length(raw).alias("__size"), F.xxhash64("__n", F.substr(raw, F.octet_length(raw) - F.col("__n") + 1, F.col("__n"))).alias("__h"))
    places = None
    for n in sizes:
        own = runs.filter(F.octet_length("__bytes") >= n).select("__run", F.posexplode(_windows(n)).alias("__at", "__h"))
        places = own if places is None else places.unionByName(own)
    left = left.drop("__n")
    if places is None:
        return left
    # Where the whole path would begin, from 1.
    met = tails.join(places, "__h").select(path, "__size", "__run", (F.col("__at") + F.col("__n") - F.col("__size") + 1).alias("__begin")).filter("__begin > 0")
    found = met.join(runs, "__run").filter(F.substr("__bytes", F.col("__begin"), F.col("__size")) == raw).select(path).distinct()
    return left.join(found, path, "left_anti")


def _windows(n: int) -> Column:
    """The hashes of all windows of n bytes. The run is bound once: a row's field is copied whole each time it is read."""
    from ..functions.text import let

    return let(F.col("__bytes"), lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(b) - n + 1)), lambda i: F.xxhash64(F.lit(n), F.substr(b, i, F.lit(n)))))


def registry_drift(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem) for keys in one table only and fields that differ."""
    x, y = a.alias("x"), b.alias("y")
    joined = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full")
    problems = F.array(
        F.when(F.col(f"y.{key}").isNull(), "only first"),
        F.when(F.col(f"x.{key}").isNull(), "only second"),
        *(F.when(F.col(f"x.{key}").isNotNull() & F.col(f"y.{key}").isNotNull() & ~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), f"differs in {f}") for f in fields),
    )
    return joined.select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def allocate_keys(rows: DataFrame, base: str, order: list[Column], taken: DataFrame | None = None) -> DataFrame:
    """Unique keys: a base's rows get, in order, the bare base and then '-2', '-3', ..., the first ones that are free.

    Not free are the keys of ``taken`` and the literal bases of other rows ('x-2'), which keep their bare
    form. The k-th row takes the k-th free number: the taken numbers t of a base, in order, move it on while
    t - (its place among them) is at most k.
    """
    literal = rows.select(F.col(base).alias("key")).distinct().filter(F.col("key").rlike("-[1-9][0-9]{0,8}$"))
    numbered = literal if taken is None else literal.unionByName(taken.select("key"))
    number = F.expr("try_cast(nullif(regexp_extract(key, '-([1-9][0-9]{0,8})$', 1), '') as long)")
    used = numbered.select(F.regexp_replace("key", "-[0-9]{1,9}$", "").alias("__stem"), number.alias("__m")).filter("__m >= 2")
    if taken is not None:
        used = used.unionByName(taken.select(F.col("key").alias("__stem"), F.lit(1).cast("long").alias("__m")))
    gaps = used.distinct().groupBy("__stem").agg(F.sort_array(F.collect_list("__m")).alias("__t"))
    gaps = gaps.select("__stem", F.transform("__t", lambda t, i: t - i).alias("__t"))
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order)).cast("long")
    placed = rows.withColumn("__k", n).join(gaps, F.col(base) == F.col("__stem"), "left")
    at = F.col("__k") + F.coalesce(F.size(F.filter("__t", lambda t: t <= F.col("__k"))), F.lit(0))
    return placed.withColumn("key", F.when(at == 1, F.col(base)).otherwise(F.concat_ws("-", base, at.cast("string")))).drop("__k", "__stem", "__t")
