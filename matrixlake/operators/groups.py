"""Groups of cells and tables of group pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixlake.functions.draws import order


class Side:
    """``src.time`` is the column ``source_time``; names with blanks go in brackets."""

    def __init__(self, prefix: str):
        self._prefix = prefix

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Column:
        return F.col(f"`{self._prefix}{name}`")


src, tgt = Side("source_"), Side("target_")

#: rows that one slot of row numbers spans, as a power of two; hexadecimal digits of a draw that name its slot
SLOT_BITS, SLOT_DIGITS = 20, 3
#: rows of a group that are multiplied at once with as many of another one; products that are held meanwhile
BLOCK, PRODUCTS = 8192, 1 << 21


def ranked(rows: DataFrame, keys: Sequence[str], by: Sequence[Column | str], slot: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, their rank from 0 among the rows of the same ``keys`` in the order of ``by``.

    ``slot`` cuts that order into stretches: it must not fall along it. Ranks are taken
    in a stretch and offset by the sizes of those before, so no task sorts a whole group.
    """
    at = rows.withColumn("_slot", slot)
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slot")) - F.col("_n")
    starts = at.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_slot", before.alias("_start"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*by)) - 1
    return at.withColumn("_rank", rank).join(starts, [*keys, "_slot"]).withColumn(name, F.col("_start") + F.col("_rank")).drop("_slot", "_start", "_rank")


def shuffled(rows: DataFrame, keys: Sequence[str], draw: Column, name: str) -> DataFrame:
    """The same in the order of a draw (``order``), rows that tie by number."""
    return ranked(rows.withColumn("_draw", draw), keys, ["_draw", "row"], F.substring("_draw", 1, SLOT_DIGITS), name).drop("_draw")


class Groups:
    """``table``: a row per group (group, keys, n_cells, derived columns); ``rows``: (group, row); ``by``: the keys."""

    def __init__(self, table: DataFrame, rows: DataFrame, by: Sequence[str]):
        self.table, self.rows, self.by = table, rows, list(by)

    def with_columns(self, **columns: Column | str) -> Groups:
        return Groups(self.table.withColumns({k: F.expr(c) if isinstance(c, str) else c for k, c in columns.items()}), self.rows, self.by)

    def members(self) -> DataFrame:
        """Rows with their rank in the group, by row."""
        return ranked(self.rows, ["group"], ["row"], F.shiftright("row", SLOT_BITS), "k")


def make_groups(table: DataFrame, by: Sequence[str], row: str = "row") -> Groups:
    """Groups in the order in which their first row appears; null and NaN are one key value of their own."""
    by = [by] if isinstance(by, str) else list(by)
    kinds = dict(table.dtypes)
    clean = table.select(F.col(row).alias("row"), *(F.nanvl(F.col(c), F.lit(None).cast(kinds[c])).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in by))
    found = clean.groupBy(*by).agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("n_cells"))
    found = found.withColumn("group", (F.row_number().over(Window.orderBy("_first")) - 1).cast("int"))
    cond = None
    g = found.select("group", *(F.col(c).alias(f"_{c}") for c in by))
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = same if cond is None else cond & same
    rows = clean.join(g, cond).select("group", "row")
    return Groups(found.select("group", *by, "n_cells"), rows, by)


def cross(groups: Groups, on: Sequence[str] = (), source: Column | str | None = None, target: Column | str | None = None, where: Column | None = None) -> DataFrame:
    """Pairs of groups with prefixed columns: all, or those equal on ``on`` (null equals null). Conditions become part of the join."""
    side = lambda p, cond: (groups.table.where(cond) if cond is not None else groups.table).select(*(F.col(f"`{c}`").alias(p + c) for c in groups.table.columns))
    s, t = side("source_", source), side("target_", target)
    cond = where
    for c in [on] if isinstance(on, str) else on:
        same = src[c].eqNullSafe(tgt[c])
        cond = same if cond is None else cond & same
    return s.crossJoin(t) if cond is None else s.join(t, cond)


def combine(*tables: DataFrame) -> DataFrame:
    """Union of pair tables; of repeated pairs the first table's stays. Columns that a table lacks are null."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("_no", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy("source_group", "target_group").orderBy("_no")
    return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_no")


def describe(pairs: DataFrame, by: str = "rule") -> DataFrame:
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("source_group").alias("n_source_groups"), F.count_distinct("target_group").alias("n_target_groups"))


def never_used(groups: Groups, pairs: DataFrame) -> DataFrame:
    used = pairs.select(F.col("source_group").alias("group")).union(pairs.select("target_group")).distinct()
    return groups.table.join(used, "group", "left_anti")


def drop_small(pairs: DataFrame, n_source: int | str, n_target: int | str) -> DataFrame:
    """Pairs whose groups have the cells asked for; "all" asks for none."""
    for name, n in (("source", n_source), ("target", n_target)):
        if n != "all":
            pairs = pairs.where(F.col(f"{name}_n_cells") >= n)
    return pairs


def heaviest(links: DataFrame, k: int, pair: str = "pair", tie: Sequence[str] = ("source_row", "target_row")) -> DataFrame:
    """Links among the k heaviest of their source or of their target, within a pair."""
    for side in ("source", "target"):
        w = Window.partitionBy(pair, f"{side}_row").orderBy(F.desc("weight"), *tie)
        links = links.withColumn(f"_{side}", F.row_number().over(w))
    return links.where((F.col("_source") <= k) | (F.col("_target") <= k)).drop("_source", "_target")


def links_by_expression(groups: Groups, pairs: DataFrame, features: DataFrame, weight: Callable[[str, str], Column], top_k: int | None = None) -> DataFrame:
    """Links of all cell pairs of each allowed group pair, weighted by an expression of their features' columns ``x`` and ``y``.

    The candidates are cells of one group against those of its partner, as the
    pair table allows; with ``top_k`` only the heaviest of either side stay.
    """
    cells = groups.rows.join(features, "row")
    a = cells.select(F.col("group").alias("source_group"), F.col("row").alias("source_row"), F.col("feature").alias("x"))
    b = cells.select(F.col("group").alias("target_group"), F.col("row").alias("target_row"), F.col("feature").alias("y"))
    p = pairs.select("source_group", "target_group").distinct().withColumn("pair", F.concat_ws(":", "source_group", "target_group"))
    out = p.join(a, "source_group").join(b, "target_group").select("pair", "source_row", "target_row", weight("x", "y").alias("weight"))
    return heaviest(out, top_k) if top_k else out


def dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)


def links_by_dot(groups: Groups, pairs: DataFrame, features: DataFrame, top_k: int) -> DataFrame:
    """As ``links_by_expression`` with ``dot`` and ``top_k``, for vectors of whole numbers, without a row for each candidate.

    All cells of a pair are multiplied, in blocks of rows of both groups; a block
    gives the heaviest links of each of its rows, of which the heaviest of all blocks
    stay. Vectors that are null, hold nulls, differ in length or whose products
    may exceed 53 bits go the plain way.
    """
    import numpy as np
    import pyarrow as pa

    f = F.col("feature")
    r = features.agg(
        F.coalesce(F.bool_or(f.isNull() | F.exists(f, lambda x: x.isNull())), F.lit(False)).alias("odd"),
        F.min(F.size(f)).alias("least"),
        F.max(F.size(f)).alias("most"),
        F.max(F.greatest(F.array_max(f), -F.array_min(f).cast("decimal(20)"))).alias("top"),
    ).first()
    if r["odd"] or r["least"] != r["most"] or int(r["top"] or 0) ** 2 * r["most"] >= 1 << 53 or (r["top"] or 0) >= 1 << 31:
        return links_by_expression(groups, pairs, features, dot, top_k)

    sizes = groups.table.select("group", F.ceil(F.col("n_cells") / BLOCK).cast("int").alias("n"))
    p = pairs.select("source_group", "target_group").distinct()
    tiles = p.select(F.least("source_group", "target_group").alias("lo"), F.greatest("source_group", "target_group").alias("hi")).distinct()
    tiles = tiles.join(sizes.select(F.col("group").alias("lo"), F.col("n").alias("n_lo")), "lo").join(sizes.select(F.col("group").alias("hi"), F.col("n").alias("n_hi")), "hi")
    parts = min(2000, 2 * (tiles.agg(F.sum(F.col("n_lo") * F.col("n_hi"))).first()[0] or 1))
    cells = groups.rows.join(features, "row").select("group", "row", f.cast("array<int>").alias("v"))
    key = ["lo", "hi", "at_lo", "at_hi"]

    def side(own: str, other: str, mark: str):
        at = cells.join(F.broadcast(tiles), F.col("group") == F.col(own))
        at = at.withColumn(f"at_{own}", F.pmod(F.xxhash64("row"), F.col(f"n_{own}")).cast("int")).withColumn(f"at_{other}", F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        names = [c + mark for c in key]
        return at.select(*(F.col(c).alias(c + mark) for c in (*key, "row", "v"))).repartition(parts, *names).groupBy(*names)

    def numbers(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        *_, row, v = t.sort_by(t.column_names[-2]).columns
        row, v = row.to_numpy(), pa.concat_arrays(v.chunks).flatten().to_numpy(zero_copy_only=False)
        return row, v.reshape(len(t), len(v) // len(t)).astype(np.float64)

    def best(a: np.ndarray, b: np.ndarray):
        """Of each row of a, the numbers of its heaviest rows of b, of which the first win ties; and their products."""
        k = min(top_k, len(b))
        at, w = np.empty((len(a), k), np.int64), np.empty((len(a), k), np.int64)
        step = max(1, PRODUCTS // len(b))
        for i in range(0, len(a), step):
            x = a[i : i + step] @ b.T
            own = np.arange(len(x))
            for j in range(k):
                at[i : i + step, j] = m = x.argmax(axis=1)
                w[i : i + step, j] = x[own, m]
                x[own, m] = -np.inf
        return at, w

    def run(tile, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["own_group", "other_group", "own_row", "other_row", "weight"]
        lo, hi, *_ = (x.as_py() for x in tile)
        out = []
        if len(left) and len(right):
            (s, a), (t, b) = numbers(left), numbers(right)
            if np.sqrt((a * a).sum(1).max() * (b * b).sum(1).max()) < 1 << 23:  # bounds all sums and parts of them: exact in 24 bits
                a, b = a.astype(np.float32), b.astype(np.float32)
            for g, h, own, other, x, y in ((lo, hi, s, t, a, b), (hi, lo, t, s, b, a))[: 1 if lo == hi else 2]:
                at, w = best(x, y)
                out.append((np.full(at.size, g, np.int32), np.full(at.size, h, np.int32), np.repeat(own, at.shape[1]), other[at.ravel()], w.ravel()))
        types = [np.int32, np.int32, np.int64, np.int64, np.int64]
        return pa.table({n: np.concatenate([x[c] for x in out]) if out else np.zeros(0, types[c]) for c, n in enumerate(names)})

    found = side("lo", "hi", "").cogroup(side("hi", "lo", "_")).applyInArrow(run, "own_group int, other_group int, own_row long, other_row long, weight long")
    w = Window.partitionBy("own_group", "other_group", "own_row").orderBy(F.desc("weight"), "other_row")
    found = found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_k)
    # a link is among the heaviest of its source, of its target, or of both
    ways = F.explode(F.array(*(F.struct(F.col(f"{a}_group").alias("source_group"), F.col(f"{b}_group").alias("target_group"), F.col(f"{a}_row").alias("source_row"), F.col(f"{b}_row").alias("target_row"), "weight") for a, b in (("own", "other"), ("other", "own")))))
    links = found.select(ways.alias("x")).select("x.*").join(F.broadcast(p), ["source_group", "target_group"]).distinct()
    return links.select(F.concat_ws(":", "source_group", "target_group").alias("pair"), "source_row", "target_row", "weight")


def links_by_callback(groups: Groups, pairs: DataFrame, match: Callable, top_k: int | None = None) -> DataFrame:
    """Links from ``match(source rows, target rows) -> (i, j[, weight])``, called once for each allowed pair with NumPy arrays."""
    import numpy as np
    import pandas as pd

    p = pairs.select("source_group", "target_group").distinct().withColumn("pair", F.concat_ws(":", "source_group", "target_group"))
    a = p.join(groups.rows.withColumnRenamed("group", "source_group"), "source_group").select("pair", "row")
    b = p.join(groups.rows.withColumnRenamed("group", "target_group"), "target_group").select(F.col("pair").alias("pair_"), F.col("row").alias("row"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s, t = np.sort(left["row"].to_numpy()), np.sort(right["row"].to_numpy())
        if not len(s) or not len(t):
            return pd.DataFrame({"pair": [], "source_row": [], "target_row": [], "weight": []})
        i, j, *w = match(s, t)
        return pd.DataFrame({"pair": key[0], "source_row": s[np.asarray(i)], "target_row": t[np.asarray(j)], "weight": np.asarray(w[0], float) if w else 1.0})

    out = a.groupBy("pair").cogroup(b.groupBy("pair_")).applyInPandas(run, "pair string, source_row long, target_row long, weight double")
    return heaviest(out, top_k) if top_k else out


def write_order(groups: Groups, seed: int = 0, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(order, blocks): new position of each row, groups sorted with nulls first and shuffled inside; start and stop of each group.

    The position is the group's start plus a rank inside the group, so no window spans all cells or a whole group.
    """
    rows = groups.rows if keep is None else groups.rows.join(keep.select("row"), "row", "left_semi")
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n_cells"))
    table = groups.table.drop("n_cells").join(sizes, "group")
    stop = F.sum("n_cells").over(Window.orderBy(*(F.asc_nulls_first(c) for c in groups.by)).rowsBetween(Window.unboundedPreceding, 0))
    blocks = table.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("n_cells"))
    placed = shuffled(rows, ["group"], order(seed, F.col("row")), "_k").join(blocks.select("group", "start"), "group")
    return placed.select("row", (F.col("start") + F.col("_k")).alias("new_row"), "group"), blocks
