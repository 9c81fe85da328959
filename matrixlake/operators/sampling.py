"""Samples from a table of group pairs.

Every draw is a function of a key (seed, step, ...), so a sample can be made
again, in parts, on any number of executors. Draws shared by several pair rows
are made once for their key and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixlake.functions.draws import order, uniform
from matrixlake.operators.groups import Groups, drop_small, shuffled

LINKS = ("none", "random", "self", "table")


def pick(cells: DataFrame, weights: DataFrame, keys: list[str], items: list[str], weight: str, u: Column) -> DataFrame:
    """``cells`` with one row of ``weights`` (keys, items, weight) each, drawn by weight among those of its keys.

    Intervals of the running weight are joined by slots of equal width, as many as
    there are intervals, so the work follows the cells and not cells by intervals.
    """
    span = Window.partitionBy(*keys)
    w = weights.select(*keys, *items, F.col(weight).cast("double").alias("_w")).where("_w > 0")
    w = w.withColumn("_hi", F.sum("_w").over(span.orderBy(*items).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("_w").over(span)).withColumn("_n", F.count(F.lit(1)).over(span))
    w = w.withColumn("_lo", F.col("_hi") - F.col("_w"))
    size = w.groupBy(*keys).agg(F.first("_total").alias("_total"), F.first("_n").alias("_n"))
    # a slot more on either side than the bounds say, against rounding
    slots = F.sequence(F.greatest(F.lit(0), F.floor(F.col("_lo") * F.col("_n") / F.col("_total")) - 1), F.floor(F.col("_hi") * F.col("_n") / F.col("_total")) + 1)
    bins = w.select(*keys, *items, "_lo", "_hi", F.explode(slots).alias("_slot"))
    sized = cells.join(size, keys) if keys else cells.join(F.broadcast(size))  # without keys that is one row
    at = sized.withColumn("_at", u * F.col("_total")).withColumn("_slot", F.floor(u * F.col("_n")))
    return at.join(bins, [*keys, "_slot"]).where("_lo <= _at and _at < _hi").drop("_lo", "_hi", "_at", "_slot", "_total", "_n")


def distinct_ranks(n: int | Column, size: Column, u) -> Column:
    """Array of min(n, size) distinct numbers below ``size``, in order of drawing; ``u``: from a number's Column to its draw.

    Each draw is among what is left, counted past the numbers drawn before.
    """
    many = F.least(F.lit(n) if isinstance(n, int) else n, size)
    steps = F.when(many > 0, F.sequence(F.lit(0).cast("long"), many.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))

    def draw(done: Column, j: Column) -> Column:
        left = F.floor(u(j) * (size - j)).cast("long")
        return F.array_append(done, F.aggregate(F.array_sort(done), left, lambda x, c: F.when(c <= x, x + 1).otherwise(x)))

    return F.aggregate(steps, F.array().cast("array<bigint>"), draw)


def bundles(pairs: DataFrame, bundle_by: list[str] | None = None, weight: str | None = None, order_by: tuple[str, ...] = ("source_group", "target_group")) -> DataFrame:
    """``pairs`` with ``pair_no``, ``bundle`` (numbered by first appearance) and ``bundle_weight``."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    numbered = pairs.withColumn("pair_no", F.row_number().over(Window.orderBy(*order_by)) - 1).withColumn("_w", w)
    if not bundle_by:
        return numbered.withColumn("bundle", F.col("pair_no")).withColumn("bundle_weight", F.col("_w")).drop("_w")
    keys = numbered.groupBy(*bundle_by).agg(F.min("pair_no").alias("_first"), F.sum("_w").alias("bundle_weight"))
    keys = keys.withColumn("bundle", F.row_number().over(Window.orderBy("_first")) - 1).drop("_first")
    cond = None
    k = keys.select("bundle", "bundle_weight", *(F.col(c).alias(f"_{c}") for c in bundle_by))
    for c in bundle_by:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = same if cond is None else cond & same
    return numbered.join(k, cond).drop("_w", *(f"_{c}" for c in bundle_by))


def cdf(bundled: DataFrame) -> DataFrame:
    """(bundle, lo, hi, total): intervals of the running weight; a bundle without weight has none."""
    w = bundled.select("bundle", "bundle_weight").distinct()
    hi = F.sum("bundle_weight").over(Window.orderBy("bundle").rowsBetween(Window.unboundedPreceding, 0))
    return w.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("bundle_weight")).withColumn("total", F.sum("bundle_weight").over(Window.partitionBy()))


class Sampler:
    """Draws bundles by weight and cells from their groups.

    ``n_source``, ``n_target``: cells a side, or "all"; ``links``: how a target is
    chosen for a source cell: ``none`` (independent), ``random``, ``self`` (the same
    cell; needs source and target group alike) or ``table`` (by ``link_table``).
    """

    def __init__(self, groups: Groups, pairs: DataFrame, n_source: int | str = 1, n_target: int | str | None = None, bundle_by: list[str] | None = None, links: str | Column = "none", link_table: DataFrame | None = None, weight: str | None = None, small: bool = False, run_length: int = 1):
        if isinstance(links, str) and links not in LINKS:
            raise ValueError(f"unknown kind of link: {links}")
        if isinstance(links, str) and (links == "table") != (link_table is not None):
            raise ValueError("a link table goes with links='table'")
        self.groups, self.n = groups, {"source": n_source, "target": n_source if n_target is None else n_target}
        pairs = drop_small(pairs, self.n["source"], self.n["target"]) if small else pairs
        self.pairs = bundles(pairs.withColumn("link", F.lit(links) if isinstance(links, str) else links), bundle_by, weight)
        if not self.pairs.where("link = 'self' and source_group <> target_group").isEmpty():
            raise ValueError("self links need the same group on both sides")
        self.link_table, self.run_length = link_table, run_length

    def draw_bundles(self, samples: DataFrame, seed: int = 0) -> DataFrame:
        """``samples`` (sample) with a bundle each, by weight, with replacement."""
        w = self.pairs.select("bundle", "bundle_weight").distinct()
        return pick(samples, w, [], ["bundle"], "bundle_weight", uniform(seed, F.col("sample"), "bundle")).select("sample", "bundle")

    def cells_of(self, drawn: DataFrame, seed: int) -> DataFrame:
        """(sample, side, group, ord, row): for each side and group of the drawn bundles, cells without replacement, drawn once."""
        pairs = drawn.join(self.pairs.select("bundle", "source_group", "target_group"), "bundle")
        sides = pairs.select("sample", F.lit("source").alias("side"), F.col("source_group").alias("group")).union(pairs.select("sample", F.lit("target"), "target_group")).distinct()
        sides = sides.join(self.groups.table.select("group", F.col("n_cells").cast("long").alias("n_cells")), "group")
        out = None
        for side, n in self.n.items():
            mine = sides.where(F.col("side") == side)
            got = self._all(mine, seed) if n == "all" else self._some(mine, n, seed)
            out = got if out is None else out.unionByName(got)
        return out

    def _all(self, sides: DataFrame, seed: int) -> DataFrame:
        """Whole groups, shuffled."""
        draw = order(seed, F.col("sample"), F.col("side"), F.col("group"), F.col("row"))
        return shuffled(sides.join(self.groups.rows, "group"), ["sample", "side", "group"], draw, "ord").select("sample", "side", "group", "ord", "row")

    def _some(self, sides: DataFrame, n: int, seed: int) -> DataFrame:
        """n cells of each group: ranks are drawn in an array, then looked up, so nothing grows with the groups' sizes."""
        size, r = F.col("n_cells"), self.run_length
        u = lambda j: uniform(seed, F.col("sample"), F.col("side"), F.col("group"), j)
        if r > 1:  # runs of neighbours after a turn of the group by a random offset; one run may be short
            off = F.floor(uniform(seed, F.col("sample"), F.col("side"), F.col("group"), "off") * size).cast("long")
            runs = distinct_ranks(-(-n // r) + 1, F.ceil(size / r).cast("long"), u)
            ranks = F.slice(F.flatten(F.transform(runs, lambda x: F.sequence(x * r, F.least(x * r + r, size) - 1))), 1, n)
            ranks = F.transform(ranks, lambda x: F.pmod(x + off, size))
        else:
            ranks = distinct_ranks(n, size, u)
        drawn = sides.select("sample", "side", "group", F.posexplode(ranks).alias("ord", "k"))
        return drawn.join(self.groups.members(), ["group", "k"]).select("sample", "side", "group", "ord", "row")

    def sample(self, samples: DataFrame, seed: int = 0) -> DataFrame:
        """(sample, bundle, pair_no, side, ord, row) for a table of sample numbers; cells of a group are shared by the bundle's pairs."""
        drawn = self.draw_bundles(samples, seed)
        cells = self.cells_of(drawn, seed)
        pairs = drawn.join(self.pairs.select("bundle", "pair_no", "source_group", "target_group"), "bundle")
        sides = pairs.select("sample", "bundle", "pair_no", F.lit("source").alias("side"), F.col("source_group").alias("group")).union(pairs.select("sample", "bundle", "pair_no", F.lit("target"), "target_group"))
        return sides.join(cells, ["sample", "side", "group"]).select("sample", "bundle", "pair_no", "side", "group", "ord", "row")

    def step(self, spark, step: int, n: int = 1, seed: int = 0) -> DataFrame:
        """n samples of one step; their numbers are step:0 ... step:n-1."""
        return self.sample(spark.range(n).select(F.concat(F.lit(f"{step}:"), F.col("id")).alias("sample")), seed)

    def partners(self, cells: DataFrame, seed: int = 0, cover: str = "source") -> DataFrame:
        """``cells`` (key, row, pair_no) with ``partner``: a cell of the pair's other group, the cell itself, or a linked one by weight; unlinked cells go."""
        other = "target" if cover == "source" else "source"
        p = self.pairs.select("pair_no", "link", F.col(f"{other}_group").alias("group"))
        sizes = self.groups.table.select("group", "n_cells")
        at = cells.join(p, "pair_no").join(sizes, "group").withColumn("k", F.floor(uniform(seed, F.col("key"), "partner") * F.col("n_cells")))
        member = self.groups.members().select("group", "k", F.col("row").alias("_random"))
        out = at.join(member, ["group", "k"], "left")
        if self.link_table is not None:
            mine, theirs = f"{cover}_row", f"{other}_row"
            w = F.col("weight") if "weight" in self.link_table.columns else F.lit(1.0)
            links = self.link_table.select(F.col(mine).alias("row"), F.col(theirs).alias("_linked"), w.cast("double").alias("_w"))
            links = links.join(self.groups.rows.select(F.col("row").alias("_linked"), "group"), "_linked")
            span = Window.partitionBy("row", "group")
            links = links.withColumn("_hi", F.sum("_w").over(span.orderBy("_linked").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("_w").over(span))
            pick = uniform(seed, F.col("key"), "link") * F.col("_total")
            found = at.where("link = 'table'").join(links, ["row", "group"]).where((pick < F.col("_hi")) & (pick >= F.col("_hi") - F.col("_w"))).select("key", "_linked")
            out = out.join(found, "key", "left")
        else:
            out = out.withColumn("_linked", F.lit(None).cast("long"))
        partner = F.when(F.col("link") == "self", F.col("row")).when(F.col("link") == "table", F.col("_linked")).otherwise(F.col("_random"))
        return out.withColumn("partner", partner).where("partner is not null").select("key", "row", "pair_no", "partner")

    def epoch_rows(self, epoch: int = 0, seed: int = 0, cover: str = "source") -> DataFrame:
        """(ord_key, source_row, target_row, pair_no): each cell of every covered group once, with a partner.

        A cell's pair is drawn among its group's pairs by weight; the order of the
        epoch is that of ``ord_key``.
        """
        w = self.pairs.select("pair_no", F.col(f"{cover}_group").alias("group"), F.col("bundle_weight").alias("w"))
        cells = pick(self.groups.rows, w, ["group"], ["pair_no"], "w", uniform(seed, epoch, F.col("row"), "pair"))
        cells = cells.select(F.concat(F.lit(f"{epoch}:"), "row").alias("key"), "row", "pair_no")
        got = self.partners(cells, seed, cover)
        mine, theirs = ("source_row", "target_row") if cover == "source" else ("target_row", "source_row")
        return got.select(order(seed, epoch, F.col("row")).alias("ord_key"), F.col("row").alias(mine), F.col("partner").alias(theirs), "pair_no")

    def epoch(self, epoch: int = 0, seed: int = 0, cover: str = "source", drop_last: bool = False) -> DataFrame:
        """(group, chunk, ord, row, bundle): each covered group cut into sets of n cells, each set with a bundle that has the group."""
        n = self.n[cover]
        chunked = epoch_chunks(self.groups, self.pairs.select(F.col(f"{cover}_group").alias("group")).distinct(), n, seed, epoch, drop_last)
        w = self.pairs.groupBy(F.col(f"{cover}_group").alias("group"), "bundle").agg(F.first("bundle_weight").alias("w"))
        return pick(chunked, w, ["group"], ["bundle"], "w", uniform(seed, epoch, F.col("group"), F.col("chunk"), "bundle")).select("group", "chunk", "ord", "row", "bundle")


def epoch_chunks(groups: Groups, covered: DataFrame, n: int | str, seed: int = 0, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """(group, chunk, ord, row): shuffled cells of each covered group in sets of n; the last may be short."""
    rows = groups.rows.join(covered, "group", "left_semi")
    size = F.lit(2**62 if n == "all" else n)
    out = shuffled(rows, ["group"], order(seed, epoch, F.col("row")), "_r").withColumn("chunk", F.floor(F.col("_r") / size)).withColumn("ord", F.pmod("_r", size))
    if drop_last and n != "all":
        out = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("group", "chunk"))).where(F.col("_n") == n).drop("_n")
    return out.drop("_r")


def cell_batches(groups: Groups, batch_size: int, epoch: int = 0, seed: int = 0, same_group: bool = False, drop_last: bool = False) -> DataFrame:
    """(batch, ord, row): every cell once an epoch, in shuffled batches, of one group each if asked for."""
    keys = ["group"] if same_group else []
    out = shuffled(groups.rows, keys, order(seed, epoch, F.col("row")), "_r")
    out = out.withColumn("batch", F.concat_ws(":", *keys, F.floor(F.col("_r") / batch_size)))
    out = out.withColumn("ord", F.pmod("_r", F.lit(batch_size))).select("batch", "ord", "group", "row")
    if drop_last:
        out = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("batch"))).where(F.col("_n") == batch_size).drop("_n")
    return out
