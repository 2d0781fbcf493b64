"""Recommendations, similarity of users, engagement and achievements."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.sources.shared import written

from .relational import mode_of, top
from .similarity import rounded


def rated(ratings: DataFrame) -> DataFrame:
    """Ratings (user, item, rating) that are not null and not 0."""
    return ratings.where(F.coalesce("rating", F.lit(0)) != 0)


#: Users of a block of ratings, about; rows of a block that are compared at once; pairs of ratings that are.
RATING_USERS, RATING_ROWS, RATING_PAIRS = 4096, 256, 1 << 22
#: Items that more than this share of a block's users rated are multiplied as dense columns, so many at once.
DENSE_SHARE, DENSE_ITEMS = 0.05, 256


class _Ratings:
    """A block's ratings by item: users in order of id, entries in order of item."""

    def __init__(self, block: pa.Table, side: str):
        order = np.argsort(block.column(side).to_numpy(), kind="stable")
        self.users = block.column(side).to_numpy()[order]
        lists = [block.column(f"{side}_{c}").combine_chunks().take(pa.array(order)) for c in ("items", "values")]
        sizes = np.diff(lists[0].offsets.to_numpy())
        items, values = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        self.row = np.repeat(np.arange(len(self.users)), sizes)
        self.item, self.value = items, values

    def by_item(self) -> None:
        at = np.argsort(self.item, kind="stable")
        self.row, self.value = self.row[at], self.value[at]
        self.known, self.first = np.unique(self.item[at], return_index=True)
        self.size = np.diff(np.append(self.first, len(at)))


def _dense(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> list[np.ndarray]:
    """Number, sum and sum of squares of the values in each cell."""
    cell, n = rows * shape[1] + columns, shape[0] * shape[1]
    return [np.bincount(cell, w, n).reshape(shape) for w in (None, values, values * values)]


def _compared(left: _Ratings, right: _Ratings):
    """(rows of ``left``, common, similarity) for a few rows at a time; both matrices have a column for each user of ``right``.

    Ratings of items that few users of the block have meet one by one. Items
    of many users are multiplied as matrices, so that an item that all
    have costs a column and not all pairs.
    """
    n = len(right.users)
    at = np.minimum(np.searchsorted(right.known, left.item), max(len(right.known) - 1, 0))
    met = right.known[at] == left.item if len(right.known) else np.zeros(len(at), bool)
    row, at, value = left.row[met], at[met], left.value[met]
    dense = right.size > max(16, DENSE_SHARE * n)
    columns = np.flatnonzero(dense)
    place = np.cumsum(dense) - 1
    for lo in range(0, len(left.users), RATING_ROWS):
        m = min(RATING_ROWS, len(left.users) - lo)
        own = slice(*np.searchsorted(row, [lo, lo + m]))
        r, i, v = row[own] - lo, at[own], value[own]
        sums = [np.zeros(m * n) for _ in range(4)]  # common, dot, squares of either side
        few = ~dense[i]
        fr, fi, fv = r[few], i[few], v[few]
        ends = np.cumsum(right.size[fi])
        start = 0
        while start < len(fi):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + RATING_PAIRS, side="right")))
            size = right.size[fi[start:stop]]
            entry = np.repeat(right.first[fi[start:stop]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            mine, theirs = np.repeat(fv[start:stop], size), right.value[entry]
            cell = np.repeat(fr[start:stop], size) * n + right.row[entry]
            for total, w in zip(sums, (None, mine * theirs, mine * mine, theirs * theirs)):
                total += np.bincount(cell, w, m * n)
            start = stop
        sums = [s.reshape(m, n) for s in sums]
        many = ~few
        for t in range(0, len(columns), DENSE_ITEMS):
            some = columns[t : t + DENSE_ITEMS]
            here = many & (place[i] >= t) & (place[i] < t + len(some))
            if not here.any():
                continue
            a = _dense(r[here], place[i[here]] - t, v[here], (m, len(some)))
            entry = np.concatenate([np.arange(right.first[c], right.first[c] + right.size[c]) for c in some])
            b = _dense(np.repeat(np.arange(len(some)), right.size[some]), right.row[entry], right.value[entry], (len(some), n))
            for total, (x, y) in zip(sums, ((a[0], b[0]), (a[1], b[1]), (a[2], b[0]), (a[0], b[2]))):
                total += x @ y
        common, dot, x, y = sums
        yield slice(lo, lo + m), common, np.where(common > 0, dot / np.where(common > 0, np.sqrt(x) * np.sqrt(y), 1), 0)


def _rating_blocks(ratings: DataFrame, users: DataFrame, fold, schema: str) -> DataFrame:
    """``fold`` (users of a few rows, users of a block, common, similarity) of all pairs of blocks of ``users`` (user).

    A user's ratings are one row. Users are dealt by a hash into blocks of
    about RATING_USERS, counted, and a row goes once to each pair of blocks
    its own is in: what is shuffled does not depend on how many share an item.
    """
    lists = rated(ratings).select(F.col("user").cast("long").alias("user"), F.xxhash64("item").alias("item"), F.col("rating").cast("double").alias("rating"))
    lists = lists.groupBy("user").agg(F.collect_list(F.struct("item", "rating")).alias("r"))
    each_user = users.select(F.col("user").cast("long").alias("user")).where("user IS NOT NULL").distinct()
    rows = written(each_user.join(lists, "user", "left").select("user", F.coalesce(F.col("r.item"), F.array().cast("array<bigint>")).alias("items"), F.coalesce(F.col("r.rating"), F.array().cast("array<double>")).alias("values")), "rating-lists")
    parts = -(-rows.count() // RATING_USERS) or 1
    # Both sides' keys have one type: cogroups are dealt by a hash, which tells an int from a long.
    deal, all_ = F.pmod(F.xxhash64("user"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    side = lambda *names: [F.col(c).alias(n) for c, n in zip(rows.columns, names)]
    # Fresh names on both sides, as they come from the same rows.
    a = rows.select(*side("i", "i_items", "i_values"), deal.alias("a"), all_.alias("b"))
    b = rows.select(*side("j", "j_items", "j_values"), all_.alias("a"), deal.alias("b"))
    kinds = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in T.StructType.fromDDL(schema)])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        x, y = _Ratings(left, "i"), _Ratings(right, "j")
        y.by_item()
        found = [pa.table(fold(x.users[at], y.users, common, s), schema=kinds) for at, common, s in _compared(x, y)]
        return pa.concat_tables(found)

    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(met, schema)


#: Meetings of two ratings are compared item by item if there are at most one for so many pairs of users; entries of lists that meet a block at once, and a wave.
SPARSE, LIST_ENTRIES, WAVE_ENTRIES = 8, 1 << 22, 1 << 26


def _by_lists(own: pa.Table, lists: pa.Table):
    """(users, others, common, similarity) for a few users of ``own`` (i, item, x) at a time: their pairs with users of ``lists`` (item, js, ys) that share an item."""
    items, order = np.unique(lists.column("item").to_numpy(), return_index=True)
    js, ys = (lists.column(c).combine_chunks().take(pa.array(order)) for c in ("js", "ys"))
    size = np.diff(js.offsets.to_numpy())
    first = np.cumsum(size) - size
    others, code = np.unique(js.flatten().to_numpy(), return_inverse=True)
    y = ys.flatten().to_numpy(zero_copy_only=False)
    i, item, x = (own.column(c).to_numpy() for c in ("i", "item", "x"))
    at = np.minimum(np.searchsorted(items, item), len(items) - 1)
    met = items[at] == item
    order = np.flatnonzero(met)[np.argsort(i[met], kind="stable")]
    i, at, x = i[order], at[order], x[order]
    users, starts = np.unique(i, return_index=True)
    before = np.append(np.append(0, np.cumsum(size[at]))[starts], size[at].sum())
    starts = np.append(starts, len(i))
    u = 0
    while u < len(users):
        v = max(u + 1, int(np.searchsorted(before, before[u] + RATING_PAIRS, side="right")) - 1)
        rows = slice(starts[u], starts[v])
        n = size[at[rows]]
        entry = np.repeat(first[at[rows]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.repeat(np.searchsorted(users[u:v], i[rows]), n)
        mine, theirs = np.repeat(x[rows], n), y[entry]
        key, cell = np.unique(row * len(others) + code[entry], return_inverse=True)
        common, dot, xx, yy = (np.bincount(cell, w, len(key)) for w in (None, mine * theirs, mine * mine, theirs * theirs))
        a, b = users[u:v][key // len(others)], others[key % len(others)]
        real = a != b
        yield a[real], b[real], common[real], (dot / (np.sqrt(xx) * np.sqrt(yy)))[real]
        u = v


def _rating_lists(ratings: DataFrame, users: DataFrame, fold, schema: str, waves: bool) -> DataFrame | None:
    """``fold`` (users, others, common, similarity) of all pairs of ``users`` (user) that share an item, or None where so many do that blocks cost less.

    Users are dealt into blocks, and the list of an item goes to the blocks
    that have a user with it, so the cost grows with the meetings of two
    ratings and not with the pairs of users. All pairs of a user and an other
    meet in one group; the meetings are counted first. In ``waves`` only some
    of the blocks have their lists on the way at once.
    """
    each_user = users.select(F.col("user").cast("long").alias("user")).where("user IS NOT NULL").distinct()
    rows = rated(ratings).select(F.col("user").cast("long").alias("user"), F.xxhash64("item").alias("item"), F.col("rating").cast("double").alias("x"))
    rows = written(rows.join(each_user, "user", "left_semi"), "ratings")
    n = each_user.count()
    blocks = -(-n // RATING_USERS) or 1
    deal = lambda c, parts, *seed: F.pmod(F.xxhash64(c, *seed), F.lit(parts)).cast("int")
    sizes = rows.groupBy("item").agg(F.count("*").cast("double").alias("n"), F.count_distinct(deal(F.col("user"), blocks)).alias("b"))
    meetings, entries = sizes.agg(F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * F.col("b"))).first()
    if (meetings or 0) * SPARSE > n * n:
        return None
    parts = int((entries or 0) // blocks // LIST_ENTRIES) + 1
    lists = rows.groupBy("item").agg(F.collect_list(F.struct(F.col("user").alias("j"), F.col("x").alias("y"))).alias("r"), F.collect_set(deal(F.col("user"), blocks)).alias("blocks"))
    lists = written(lists, "item-lists")
    count = int((entries or 0) // WAVE_ENTRIES) + 1 if waves else 1
    kinds = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in T.StructType.fromDDL(schema)])

    def met(own: pa.Table, theirs: pa.Table) -> pa.Table:
        if not own.num_rows or not theirs.num_rows:
            return kinds.empty_table()
        return pa.concat_tables([kinds.empty_table()] + [pa.table(fold(*found), schema=kinds) for found in _by_lists(own, theirs)])

    out = []
    for wave in range(count):
        now = lambda c: F.pmod(c, F.lit(count)) == wave  # noqa: E731, B023
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("b")
        own = rows.withColumn("a", deal(F.col("user"), blocks)).where(now(F.col("a"))).select("a", part, F.col("user").alias("i"), "item", "x")
        sent = lists.select(F.explode(F.filter("blocks", now)).alias("a"), "item", "r").select("a", part, "item", "r")
        own_part = F.filter("r", lambda e: deal(e["j"], parts, F.lit(1)) == F.col("b")) if parts > 1 else F.col("r")
        sent = sent.withColumn("r", own_part).select("a", "b", "item", F.col("r.j").alias("js"), F.col("r.y").alias("ys"))
        found = own.groupBy("a", "b").cogroup(sent.groupBy("a", "b")).applyInArrow(met, schema)
        out.append(written(found, "compared") if waves else found)
    return reduce(DataFrame.unionByName, out)


def user_cosine(ratings: DataFrame) -> DataFrame:
    """(user, other, common, similarity): cosine over the items both rated; only pairs with such items. Users are whole numbers.

    The result has every pair of users that share an item, so it is for what
    is small enough for that; ``similar_by_ratings`` keeps the best of each.
    """

    def pairs(i, j, common, s):
        row, col = np.nonzero((common > 0) & (i[:, None] != j[None, :]))
        return [i[row], j[col], common[row, col].astype(np.int64), s[row, col]]

    schema = "user bigint, other bigint, common bigint, similarity double"
    users = rated(ratings).select("user")
    found = _rating_lists(ratings, users, lambda i, j, common, s: [i, j, common.astype(np.int64), s], schema, waves=False)
    return _rating_blocks(ratings, users, pairs, schema) if found is None else found


def similar_by_ratings(ratings: DataFrame, users: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """Each of ``users``' ``k`` most similar others of ``users`` by ``user_cosine``, rounded; users without a common item have similarity 0; ties go to the smaller id.

    Of each group only a user's best ``k`` go on, or all that share an item
    with one who has fewer than ``k`` of more than 0, see ``similar``.
    """

    def listed(i, j, common, s):
        s = rounded(s, digits)
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        _, start, row = np.unique(i, return_index=True, return_inverse=True)
        kept = (np.arange(len(i)) - start[row] < k) | (np.bincount(row, s > 0)[row] < k if len(i) else False)
        return [i[kept], j[kept], s[kept]]

    schema = "user bigint, other bigint, similarity double"
    found = _rating_lists(ratings, users, listed, schema, waves=True)
    if found is not None:
        return similar(found, users.select(F.col("user").cast("long").alias("user")).where("user IS NOT NULL").distinct(), k, digits)

    def best(i, j, common, s):
        s = rounded(s, digits)
        s[i[:, None] == j[None, :]] = -np.inf
        rows, found = np.arange(len(i)), []
        for _ in range(min(k, len(j))):
            at = s.argmax(axis=1)  # of equal ones the smaller id
            found.append((i, j[at], s[rows, at]))
            s[rows, at] = -np.inf
        u, o, x = (np.concatenate(c) for c in zip(*found))
        real = np.isfinite(x)
        return [u[real], o[real], x[real]]

    return top(_rating_blocks(ratings, users, best, schema), ["user"], [F.desc("similarity"), "other"], k)


def similar(pairs: DataFrame, users: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """Each of ``users``' ``k`` most similar others of ``users``; a pair that is not in ``pairs`` has similarity 0; ties go to the smaller id.

    Others with 0 only matter to users with fewer than ``k`` better ones. Such
    a user with n pairs looks at the first n + k + 1 users by id: enough of
    them are neither the user nor in one of the pairs.
    """
    pairs = written(pairs.select("user", "other", F.round("similarity", digits).alias("similarity")), "similar")
    have = pairs.groupBy("user").agg(F.count("*").alias("n"), F.count_if(F.col("similarity") > 0).alias("better"))
    lacking = users.select("user").distinct().join(have, "user", "left").where(F.coalesce("better", F.lit(0)) < k)
    lacking = lacking.select("user", (F.coalesce("n", F.lit(0)) + k + 1).alias("n"))
    most = lacking.agg(F.max("n")).first()[0]
    if most:
        first = users.select(F.col("user").alias("other")).distinct().orderBy("other").limit(most)
        first = first.withColumn("place", F.row_number().over(W.orderBy("other")).cast("long"))  # ``most`` rows
        zeros = lacking.select("user", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("place")).join(first, "place").where("user <> other")
        zeros = zeros.join(pairs, ["user", "other"], "left_anti").select("user", "other", F.lit(0.0).alias("similarity"))
        pairs = pairs.unionByName(zeros)
    return top(pairs, ["user"], [F.desc("similarity"), "other"], k)


def recommend_items(ratings: DataFrame, users: DataFrame, neighbours: int = 5, k: int = 3) -> DataFrame:
    """Items that a user's most similar others have (``ratings``: user, item, rating; rated or not) and the user did not rate; the first ``k`` by id."""
    near = similar_by_ratings(ratings, users, neighbours).select("user", "other")
    theirs = near.join(ratings.select(F.col("user").alias("other"), "item"), "other").select("user", "item").distinct()
    return top(theirs.join(rated(ratings).select("user", "item").distinct(), ["user", "item"], "left_anti"), ["user"], ["item"], k)


def jaccard(owned: DataFrame) -> DataFrame:
    """(user, other, similarity) over the distinct types (user, type), null being one; pairs without a common type are left out."""
    types = owned.select("user", F.xxhash64("type").alias("type")).distinct()
    sizes = types.groupBy("user").agg(F.count("*").alias("n"))
    both = types.join(types.withColumnRenamed("user", "other"), "type").where("user != other").groupBy("user", "other").agg(F.count("*").alias("c"))
    sized = both.join(sizes, "user").join(sizes.select(F.col("user").alias("other"), F.col("n").alias("m")), "other")
    return sized.select("user", "other", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("similarity"))


#: Rows of two blocks of ``similar_by_types`` that are compared at once, about; types of a tile.
BLOCK_USERS = 2048
TILE_TYPES = 2048
#: Sets of a block and their types, at most about, and blocks that smaller tables are dealt into.
BLOCK_SETS, BLOCK_TYPES, BLOCKS = 1 << 15, 1 << 22, 16


class _Sets:
    """Sets (id, types) as rows, in order of id."""

    def __init__(self, block: pa.Table):
        order = np.argsort(block.column(0).to_numpy())
        self.ids = block.column(0).to_numpy()[order]
        lists = block.column(1).combine_chunks().take(pa.array(order))
        self.ends = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
        self.types = lists.flatten().to_numpy()
        self.size = np.diff(self.ends)
        if "least" in block.column_names:
            self.least, self.last = (block.column(c).to_numpy()[order] for c in ("least", "last"))
        else:
            self.least, self.last = np.zeros(len(order)), np.full(len(order), np.iinfo(np.int64).max)

    def tile(self, lo: int, hi: int, first: int, n: int) -> np.ndarray:
        """The rows from ``lo`` to ``hi`` as 0 and 1 for ``n`` types from ``first`` on, and two more columns."""
        own = slice(self.ends[lo], self.ends[hi])
        row, column = np.repeat(np.arange(hi - lo), self.size[lo:hi]), self.types[own] - first
        inside = (column >= 0) & (column < n)
        out = np.zeros((hi - lo, n + 2), np.float32)
        out[row[inside], column[inside]] = 1
        return out


def _best_sets(left: _Sets, right: _Sets, k: int, digits: int):
    """(id, other, similarity): of each set of ``left`` the ``k`` best of ``right`` with a type in common, from ``least`` (and its ``last`` id) on.

    A pair of n and m types, c in common, is as similar as ``least`` if c is
    at least (n + m) * least / (1 + least). That bound is two more columns of
    the product of 0-1 matrices, and only what passes it, with some room for
    the rounding of floats, is scored in doubles. Bounds rise with what is found.
    """
    known, number = np.unique(np.concatenate([left.types, right.types]), return_inverse=True)
    left.types, right.types = np.split(number, [len(left.types)])
    width = min(TILE_TYPES, len(known))
    tiles = range(0, len(known), width)
    # Few columns first: they make the bounds by which the others are looked at.
    cuts, at = [0], min(BLOCK_USERS, 256)
    while cuts[-1] < len(right.ids):
        cuts.append(min(cuts[-1] + at, len(right.ids)))
        at = min(4 * at, BLOCK_USERS)
    kept = {}

    def columns(c: int, t: int) -> np.ndarray:
        """A tile of ``right``; all are kept if they are few types wide."""
        if (c, t) in kept:
            return kept[c, t]
        m = right.tile(cuts[c], cuts[c + 1], t, width)
        if t == 0:
            m[:, width], m[:, width + 1] = right.size[cuts[c] : cuts[c + 1]], 1
        if len(tiles) == 1:
            kept[c, t] = m
        return m

    for lo in range(0, len(left.ids), BLOCK_USERS):
        hi = min(lo + BLOCK_USERS, len(left.ids))
        n, least, last = left.size[lo:hi].astype(np.float64), left.least[lo:hi].copy(), left.last[lo:hi].copy()
        rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        own = [left.tile(lo, hi, t, width) for t in tiles] if len(tiles) == 1 else None
        for c in range(len(cuts) - 1):
            near = np.maximum(least - 10.0**-digits, 0)
            share = near / (1 + near)
            room = 1e-3 + 1e-6 * (n + right.size.max())
            passed = np.zeros((hi - lo, cuts[c + 1] - cuts[c]), np.float32)
            for t in tiles:
                x = own[0] if own else left.tile(lo, hi, t, width)
                if t == 0:
                    x[:, width], x[:, width + 1] = -share, np.where(near > 0, room - share * n, -0.5)
                passed = x @ columns(c, t).T if own else passed + x @ columns(c, t).T
            cell = np.flatnonzero(passed >= 0)
            if not len(cell):
                continue
            r, j = np.divmod(cell, passed.shape[1])
            m = right.size[cuts[c] + j]
            common = np.rint(passed.reshape(-1)[cell] - np.where(near > 0, room - share * n, -0.5)[r] + share[r] * m)
            s, other = rounded(common / (n[r] + m - common), digits), right.ids[cuts[c] + j]
            good = (common > 0) & ((s > least[r]) | ((s == least[r]) & (other <= last[r])))
            rows, ids, scores = (np.concatenate(x) for x in ((rows, r[good]), (ids, other[good]), (scores, s[good])))
            order = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, ids, scores, place = (x[place < k] for x in (rows, ids, scores, place))
            full = place == k - 1
            least[rows[full]], last[rows[full]] = scores[full], ids[full]
        yield left.ids[lo:hi][rows], ids, scores


def _nearest_sets(sets: DataFrame, k: int, digits: int) -> DataFrame:
    """(id, other, similarity): the ``k`` most similar of different ``sets`` (id, types), each being its own nearest; ties go to the smaller id.

    Sets are dealt into blocks of bounded size, counted. Each first meets its
    own block, and what it finds there bounds what other blocks have to look
    at and to return.
    """
    count, entries = sets.agg(F.count("*"), F.sum(F.size("types"))).first()
    parts = max(-(-count // BLOCK_SETS), -(-(entries or 0) // BLOCK_TYPES), min(-(-count // BLOCK_USERS), BLOCKS), 1)
    # Keys of one type on both sides, see _rating_blocks.
    deal, each = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    schema = "id long, other long, similarity double"
    out = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        return pa.concat_tables([pa.table(list(best), schema=out) for best in _best_sets(_Sets(left), _Sets(right), k, digits)])

    best = written(sets.withColumn("a", deal).groupBy("a").applyInArrow(lambda t: found(t, t), schema), "nearest-sets")
    if parts > 1:
        last = F.max_by("other", F.struct(-F.col("similarity"), "other"))
        bound = best.groupBy("id").agg(F.count("*").alias("n"), F.min("similarity").alias("least"), last.alias("last"))
        bound = bound.where(F.col("n") == k).drop("n")
        a = sets.join(bound, "id", "left").select("id", "types", F.coalesce("least", F.lit(0.0)).alias("least"), F.coalesce("last", F.lit((1 << 63) - 1)).alias("last"), deal.alias("a"), each.alias("b"))
        b = sets.select(F.col("id").alias("j"), F.col("types").alias("j_types"), each.alias("a"), deal.alias("b"))  # fresh names, see there too
        others = a.where("a <> b").groupBy("a", "b").cogroup(b.where("a <> b").groupBy("a", "b")).applyInArrow(found, schema)
        best = written(best.unionByName(others), "nearest-sets")
    # Where fewer have a type in common, the first ``2 * k`` ids have enough of the others.
    lacking = best.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") < k).select("id")
    zeros = lacking.crossJoin(F.broadcast(sets.select(F.col("id").alias("other")).orderBy("other").limit(2 * k)))
    zeros = zeros.join(best, ["id", "other"], "left_anti").withColumn("similarity", F.lit(0.0))
    return top(best.unionByName(zeros), ["id"], [F.desc("similarity"), "other"], k).drop("rank")


def similar_by_types(owned: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """``similar`` of ``jaccard`` without its pairs: each user's ``k`` most similar others by the types (user, type) they own, similarities of 0 included.

    Users of the same types are one set, named by its smallest user, and only
    different sets are compared. What is best for a user is among the first
    ``k + 1`` users of the best ``k + 1`` sets, by similarity and smallest
    user. Types are few and shared by many, so nearly all pairs of sets have
    one in common, and all blocks of sets meet.
    """
    sets = owned.where("user IS NOT NULL").groupBy(F.col("user").cast("long").alias("user")).agg(F.array_sort(F.collect_set(F.xxhash64("type"))).alias("types"))
    sets = written(sets, "type-sets")
    different = written(sets.groupBy("types").agg(F.min("user").alias("id")).select("id", "types"), "different-sets")
    # Joined by sorting: files of such lists are small, and tables that Spark broadcasts by their size are not.
    members = written(sets.join(different.hint("merge"), "types").select("user", "id"), "members")
    first = top(members, ["id"], ["user"], k + 1).select(F.col("id").alias("near"), F.col("user").alias("other"))
    near = _nearest_sets(different, k + 1, digits).withColumnRenamed("other", "near")
    lists = top(near.join(first.hint("merge"), "near").select("id", "other", "similarity"), ["id"], [F.desc("similarity"), "other"], k + 1).drop("rank")
    found = members.join(lists.hint("merge"), "id").where("user <> other").select("user", "other", "similarity")
    return top(found, ["user"], [F.desc("similarity"), "other"], k)


def new_types(owned: DataFrame, cards: DataFrame, k: int = 3) -> DataFrame:
    """For each user the first ``k`` cards by id of types the user does not own.

    With types in the order of their first cards, a user of n types needs to
    look at the first n + k types only: at least k of them are not owned, and
    later types begin with later cards. So no user meets all types.
    """
    types = owned.select("user", "type").distinct()
    sizes = types.groupBy("user").agg((F.count("*") + k).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    order = cards.groupBy("type").agg(F.min("card").alias("first")).orderBy("first", "type").limit(most)
    order = order.select("type", F.row_number().over(W.orderBy("first", "type")).cast("long").alias("place"))  # ``most`` rows
    firsts = top(cards.join(order, "type"), ["type"], ["card"], k).select("type", "place", "card")
    near = sizes.select("user", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("place")).join(firsts, "place")
    return top(near.join(types, ["user", "type"], "left_anti").select("user", "type", "card"), ["user"], ["card"], k)


def with_similar_cards(owned: DataFrame, cards: DataFrame, neighbours: int = 5, k: int = 3) -> DataFrame:
    """``new_types`` with the cards of similar users of such types added, distinct. They are among all cards, so they add none; the step is kept."""
    near = similar_by_types(owned, neighbours).select("user", "other")
    # Of a type that a user has not, the first ``k`` cards of an other are enough: lists of an other are one row, and none of their cards is one before they are chosen.
    first = top(owned.select("user", "type", "card").distinct(), ["user", "type"], ["card"], k)
    lists = first.groupBy(F.col("user").alias("other")).agg(F.array_sort(F.collect_list(F.struct("card", "type"))).alias("theirs"))
    types = owned.groupBy("user").agg(F.collect_set("type").alias("types"))
    # A null type is like no other, as in a join.
    new = F.filter("theirs", lambda c: ~F.coalesce(F.array_contains("types", c["type"]), F.lit(False)))
    theirs = near.join(types, "user").join(lists, "other").select("user", F.explode(F.slice(new, 1, k)).alias("c"))
    theirs = theirs.select("user", "c.type", "c.card").distinct()
    both = new_types(owned, cards, k).drop("rank").unionByName(top(theirs, ["user"], ["card"], k).drop("rank")).distinct()
    return top(both, ["user"], ["card"], k)


def of_mode_type(owned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of the most frequent type, over all or per group."""
    mode = mode_of(owned, by or [], "type").drop("n")
    return owned.join(mode, [*(by or []), "type"], "left_semi")


def on_mood(latest_moods: DataFrame, intensity: str, moods: tuple[str, ...], scripts: DataFrame, scenes: DataFrame, kind: str, k: int = 3) -> DataFrame:
    """(user, list, pos, id) for users whose latest mood (user, mood, intensity) is one of ``moods`` at ``intensity``.

    Both lists are the same for all: the ``k`` scripts (script, type, rating)
    of ``kind`` rated best, and the ``k`` latest scenes (scene, type) by id.
    """
    low = latest_moods.where((F.col("intensity") == intensity) & F.col("mood").isin(*moods)).select("user").distinct()
    best = scripts.where(F.col("type") == kind).orderBy(F.desc("rating"), "script").limit(k)
    new = scenes.where(F.col("type") == kind).orderBy(F.desc("scene")).limit(k)
    place = lambda *order: F.row_number().over(W.orderBy(*order)).alias("pos")
    lists = best.select(F.lit("scripts").alias("list"), place(F.desc("rating"), "script"), F.col("script").alias("id"))
    lists = lists.unionByName(new.select(F.lit("scenes").alias("list"), place(F.desc("scene")), F.col("scene").alias("id")))
    return low.join(F.broadcast(lists), how="cross")  # 2 * k rows


def engagement(users: DataFrame, sessions: DataFrame, emotions: DataFrame) -> DataFrame:
    """(user, score): int(0.4 sessions + 0.3 mean duration + 0.3 emotions).

    Null and 0 durations are left out of the mean; no session means a mean of
    0, and sessions without any duration mean a score of 0. Both sides are
    counted before they are joined.
    """
    s = sessions.groupBy("user").agg(F.count("*").alias("s"), F.avg(F.nullif(F.col("duration"), F.lit(0.0))).alias("d"))
    e = emotions.groupBy("user").agg(F.count("*").alias("e"))
    j = users.join(s, "user", "left").join(e, "user", "left")
    n, m = F.coalesce("s", F.lit(0)), F.coalesce("e", F.lit(0))
    score = (0.4 * n + 0.3 * F.coalesce("d", F.lit(0.0)) + 0.3 * m).cast("long")
    return j.select("user", F.when((n > 0) & F.col("d").isNull(), F.lit(0).cast("long")).otherwise(score).alias("score"))


def connection(compatible: Column, score: Column) -> Column:
    return (F.when(compatible, 50).otherwise(0) + 0.5 * score).cast("long")


#: Thresholds and their titles.
TITLES = ((1, "First Goal Achieved"), (5, "Five Goals Achieved"), (10, "Ten Goals Achieved"))


def achievements(goals: DataFrame) -> DataFrame:
    """(user, title): a title for each threshold that the number of achieved goals (user, status) reaches."""
    counts = goals.groupBy("user").agg(F.count_if(F.col("status") == "achieved").alias("n"))
    titles = F.array_compact(F.array(*[F.when(F.col("n") >= n, F.lit(t)) for n, t in TITLES]))
    return counts.select("user", F.explode(titles).alias("title"))


def award(held: DataFrame, earned: DataFrame) -> DataFrame:
    """``held`` with the (user, title) pairs of ``earned`` that are not there yet."""
    return held.unionByName(earned.distinct().join(held, ["user", "title"], "left_anti"))


def latest(df: DataFrame, by: str, time: str, tie: str) -> DataFrame:
    return top(df, [by], [F.desc(time), F.desc(tie)], 1, "_r").drop("_r")
