"""Filters, joins, updates, set operations and rankings over plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.sources.shared import written


def matches(item: Column, phrase: str, strategy: str = "start", more: bool = False, cased: bool = False) -> Column:
    """Whether ``item`` starts, ends, contains, equals or (unanchored regex) matches ``phrase``.

    Without ``cased`` both sides are lower-cased, the pattern of a regex too.
    ``more`` keeps only items that, trimmed but in their own case, are longer
    than the phrase and differ from it. An unknown strategy matches nothing.
    """
    p = phrase if cased else phrase.lower()
    x = item if cased else F.lower(item)
    tests = {"start": x.startswith(p), "end": x.endswith(p), "contains": x.contains(p), "exact": x == p, "regex": x.rlike(p)}
    found = tests.get(strategy, F.lit(False))
    if more:
        bare = F.regexp_replace(item, r"^\s+|\s+$", "")
        found = found & (F.length(bare) > len(p)) & (bare != p)
    return found


def not_the_query(item: Column, query: str) -> Column:
    return F.lower(F.trim(item)) != query.strip().lower()


def page(df: DataFrame, key: str, skip: int = 0, limit: int = 10) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` in the order of ``key``."""
    return df.orderBy(key).offset(skip).limit(limit)


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has ``limit`` rows at most, counted; else the join is Spark's to choose."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _keys(parents: DataFrame, pairs: dict[str, str], n: int) -> tuple[DataFrame, Column]:
    """Distinct keys of ``parents`` under fresh names, and the condition that all ``pairs`` (column, parent's column) are equal."""
    names = {c: f"_k{n}_{i}" for i, c in enumerate(pairs)}
    keys = parents.select(*[F.col(p).alias(names[c]) for c, p in pairs.items()]).distinct()
    return keys, reduce(lambda a, b: a & b, [F.col(c) == F.col(k) for c, k in names.items()])


def accepted(rows: DataFrame, *checks: tuple[DataFrame, dict[str, str]]) -> DataFrame:
    """Rows whose foreign keys all exist: each check is a table of parents and the columns that must be in one of its rows together.

    A null key has no parent.
    """
    for n, (parents, pairs) in enumerate(checks):
        rows = rows.join(*_keys(parents, pairs, n), "left_semi")
    return rows


def rejected(rows: DataFrame, *checks: tuple[DataFrame, dict[str, str]]) -> DataFrame:
    """The other rows: those that fail at least one check."""
    known = rows.columns
    for n, (parents, pairs) in enumerate(checks):
        keys, same = _keys(parents, pairs, n)
        rows = rows.join(keys.withColumn(f"_hit{n}", F.lit(True)), same, "left")
    hits = reduce(lambda a, b: a & b, [F.col(f"_hit{n}").isNotNull() for n in range(len(checks))])
    return rows.where(~hits).select(*known)


def numbered(df: DataFrame, custom: str | None = None) -> DataFrame:
    """``df`` with a column ``id``: the column ``custom`` renamed (an error if there is none), else ``doc_id`` renamed, else a number from 1 over all rows.

    The numbers follow the order of the partitions: rows are counted by
    partition first, so that none has to hold them all.
    """
    if custom is not None:
        if custom not in df.columns:
            raise ValueError(f"no column {custom!r}; there are {df.columns}")
        return df.withColumnRenamed(custom, "id")
    if "doc_id" in df.columns:
        return df.withColumnRenamed("doc_id", "id")
    placed = written(df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "rows")
    parts = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    parts = parts.select("_part", "_first", before.alias("_before"))
    return placed.join(small(parts), "_part").withColumn("id", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_first", "_before")


def typed(rows: DataFrame, kinds: dict[str, str], required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of rows (value: JSON object): good ones have exactly the keys of ``kinds``, each null or of its JSON type, and no null in ``required``.

    Types are those of ``schema_of_variant``: STRING, BIGINT, DOUBLE, BOOLEAN
    and so on. What is no object is bad, null too.
    """
    v = F.try_parse_json("value")
    keys = F.json_object_keys("value")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    missing = lambda k: F.coalesce(kind(k) == "VOID", F.lit(True))
    fine = F.coalesce(F.array_sort(keys) == F.array_sort(F.array(*[F.lit(k) for k in kinds])), F.lit(False))
    for k, t in kinds.items():
        ok = F.coalesce(kind(k) == t, F.lit(False))
        fine = fine & (ok if k in required else ok | missing(k))
    marked = rows.withColumn("_fine", fine)
    return marked.where("_fine").drop("_fine"), marked.where("NOT _fine").drop("_fine")


def owned_update(base: DataFrame, asked: DataFrame, key: str, owner: str, change: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``base`` with ``change`` where its owner asked for it (rows key, owner), and what was refused with the reason: an unknown key, or another owner."""
    a = asked.select(F.col(key).alias("_k"), F.col(owner).alias("_o")).distinct()
    hits = a.where(F.col("_o").isNotNull()).withColumn("_hit", F.lit(True))
    done = base.join(hits, (F.col(key) == F.col("_k")) & (F.col(owner) == F.col("_o")), "left")
    done = done.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in change.items()}).select(*base.columns)
    owners = base.select(F.col(key).alias("_b"), F.col(owner).alias("_is"))
    reason = F.when(F.col("_b").isNull(), "not found").when(~F.col("_o").eqNullSafe(F.col("_is")) | F.col("_o").isNull(), "not the owner")
    refused = a.join(owners, F.col("_k") == F.col("_b"), "left").select(F.col("_k").alias(key), F.col("_o").alias(owner), reason.alias("reason"))
    return done, refused.where("reason IS NOT NULL")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``b`` whose key, null included, is not in ``a``."""
    other = a.select(F.col(key).alias("_k")).distinct()
    return b.join(other, F.col(key).eqNullSafe(F.col("_k")), "left_anti")


def update_keeping_old(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All rows of ``a`` and those of ``b`` with new keys; a key in both keeps the version of ``a``."""
    return a.unionByName(difference(a, b, key), allowMissingColumns=True)


def merge_keeping_new(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Upsert: a key in both takes the version of ``b``."""
    return b.unionByName(difference(b, a, key), allowMissingColumns=True)


def patch(base: DataFrame, change: DataFrame, key: str, rule: str = "not_null") -> DataFrame:
    """``base`` with the columns of ``change``: a null keeps the old value ("not_null"), so do 0, "" and false ("truthy"), or nothing does ("overwrite")."""
    names = [c for c in change.columns if c != key]
    kinds = dict(base.dtypes)
    c = change.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *[F.col(n).alias(f"_{n}") for n in names])
    joined = base.join(c, F.col(key) == F.col("_k"), "left")

    def value(n: str) -> Column:
        new = F.col(f"_{n}")
        if rule == "overwrite":
            return F.when(F.col("_hit"), new).otherwise(F.col(n))
        if rule == "truthy":
            empty = F.lit("") if kinds[n] == "string" else F.lit(False) if kinds[n] == "boolean" else F.lit(0)
            new = F.when(new != empty, new)
        return F.coalesce(new, F.col(n))

    return joined.select(*[value(n).alias(n) if n in names else F.col(n) for n in base.columns])


def first_match(df: DataFrame, condition: Column, by: list[str], order: list) -> DataFrame:
    """Of each group the first row, in a total order, that meets the condition."""
    return top(df.where(condition), by, order, 1, "_r").drop("_r")


def mode_of(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """The most frequent value of ``col`` per group, or of all rows without ``by``, with ``n``; ties go to the smallest. Counts are compared where they are, no group is sorted."""
    counts = df.groupBy(*by, col).agg(F.count("*").alias("n"))
    first = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(col).alias("v"))).alias("_f")).where("_f IS NOT NULL")
    return first.select(*by, F.col("_f.v").alias(col), (-F.col("_f.m")).alias("n"))


def top(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order, with their rank."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def first_seen(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the position where each came first."""
    return df.groupBy(value).agg(F.min(pos).alias(pos))


def seeded_order(*cols: str, seed: str = "0") -> Column:
    """A reproducible shuffle: order by this."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def lanes(priority: Column, urgent: int = 5) -> Column:
    """0 for what is handled at once, 1 for what is queued."""
    return F.when(priority >= urgent, 0).otherwise(1)


def natural_key(s: Column) -> Column:
    """Sort key under which runs of digits compare as numbers, of any length, and the rest in lower case: a run becomes how many digits it has, then the digits."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"\d+|\D+"), F.lit(0))

    def run(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), run(p)).otherwise(p)), "")


def batches(df: DataFrame, order: list, size: int, by: list[str] | None = None) -> DataFrame:
    """``df`` with a batch number: rows in order, ``size`` to a batch, per group of ``by``; without it over all rows, which ranges number so that no task sorts them all."""
    if not by:
        from .tries import in_order

        return in_order(df, *order).withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long")).drop("place")
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def chain(df: DataFrame, steps: list[tuple[int, str, object]]) -> DataFrame:
    """Row plug-ins in ascending priority: ("map", df -> df) or ("filter", column -> boolean column of all columns)."""
    for _, kind, step in sorted(steps, key=lambda s: s[0]):
        df = df.where(step(df)) if kind == "filter" else df.transform(step)
    return df


def is_valid(ts: Column, period: Column, now: Column) -> Column:
    """A message without a period is always valid, else until ``ts + period``."""
    return period.isNull() | (now <= ts + period)


def zipped(df: DataFrame, *arrays: str) -> DataFrame:
    """One row per index of the longest array; shorter ones are padded with nulls, empty rows stay as one row of nulls."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.posexplode_outer(F.arrays_zip(*arrays)).alias("pos", "_z")).select(*rest, "pos", *[F.col(f"_z.{a}").alias(a) for a in arrays])
