"""Groups, pair tables, links, samples, write orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixlake.operators import groups as P
from matrixlake.operators import sampling as S
from matrixlake.queries.data import CELLS_SQL, cells, groups_sql, table, u_sql

src, tgt = P.src, P.tgt
_G2 = groups_sql("status, yr")


def _groups(spark, d, by=("status", "year")) -> P.Groups:
    return P.make_groups(cells(spark, d), list(by))


def _keys(df: DataFrame, *more: str) -> DataFrame:
    return df.select("source_group", "target_group", *more)


def _small(df: DataFrame, rank: str) -> DataFrame:
    """Ranks are long, since groups have no bound; their SQL casts to int, and so do these; larger ones are an error in both."""
    return df.withColumn(rank, F.col(rank).cast("int"))


def groups_first_seen(spark, d) -> DataFrame:
    return _groups(spark, d).table.withColumnRenamed("year", "yr")


def group_members(spark, d) -> DataFrame:
    return _small(_groups(spark, d).members(), "k")


def pair_cross_filtered(spark, d) -> DataFrame:
    return _keys(P.cross(_groups(spark, d), source="status = 'F'", target="status = 'O' and year > 1998"), "source_year", "target_year")


def pair_on_nullsafe(spark, d) -> DataFrame:
    return _keys(P.cross(_groups(spark, d), on=["status"]), "source_n_cells", "target_n_cells")


def _forward(spark, d, g=None) -> DataFrame:
    return P.cross(g or _groups(spark, d), on=["status"], where=tgt.year > src.year)


def pair_theta_time_forward(spark, d) -> DataFrame:
    return _keys(_forward(spark, d))


def pair_fallback_anti(spark, d) -> DataFrame:
    """Targets without a strict source take any earlier group of another status."""
    g = _groups(spark, d)
    strict = P.cross(g, on=["status"], where=src.year == tgt.year - 3)
    rest = P.cross(g, where=(src.year == tgt.year - 1) & ~src.status.eqNullSafe(tgt.status)).join(strict.select("target_group"), "target_group", "left_anti")
    out = P.combine(strict.withColumn("rule", F.lit("strict")), rest.withColumn("rule", F.lit("fallback")))
    return _keys(out, "rule")


def pair_membership_semi(spark, d) -> DataFrame:
    g = _groups(spark, d)
    big = g.table.where("n_cells > 700").select(F.col("group").alias("source_group"))
    return _keys(_forward(spark, d, g).join(big, "source_group", "left_semi").where(~F.col("target_year").isin(1997, 2000)))


def pair_combine_first_wins(spark, d) -> DataFrame:
    g = _groups(spark, d)
    a = P.cross(g, on=["status"], where=tgt.year == src.year + 1).withColumn("rule", F.lit("next"))
    b = P.cross(g, on=["status"], where=tgt.year > src.year).withColumn("gap", F.col("target_year") - F.col("source_year"))
    return _keys(P.combine(a, b), "rule", "gap")


def pair_token_subset(spark, d) -> DataFrame:
    """Pairs of types of which the source's words are among the target's, and fewer."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.concat_ws("+", F.array_sort(F.array_distinct(F.split(F.concat_ws(" ", F.split("p_name", " ")[1], F.when(F.col("p_size") > 40, F.lit("large"))), " ")))).alias("kind"))
    g = P.make_groups(t, ["kind"])
    out = P.cross(g, where=(F.size(F.array_except(F.split(src.kind, r"\+"), F.split(tgt.kind, r"\+"))) == 0) & (src.kind != tgt.kind))
    return out.select("source_kind", "target_kind")


def pair_next_time(spark, d) -> DataFrame:
    g = _groups(spark, d).with_columns(next_year="lead(year) over (partition by status order by year)")
    return _keys(P.cross(g, on=["status"], where=tgt.year == src.next_year))


def pair_top_dose(spark, d) -> DataFrame:
    g = _groups(spark, d).with_columns(top=F.max("year").over(Window.partitionBy("status")))
    return _keys(P.cross(g, on=["status"], target="year = top", where=src.year < tgt.year))


def pair_balanced_weight(spark, d) -> DataFrame:
    p = _forward(spark, d)
    return _keys(p.withColumn("weight", F.round(1.0 / F.count(F.lit(1)).over(Window.partitionBy("target_group")), 9)), "weight")


def pair_describe(spark, d) -> DataFrame:
    g = _groups(spark, d)
    a = P.cross(g, on=["status"], where=tgt.year == src.year + 1).withColumn("rule", F.lit("next"))
    b = P.cross(g, on=["status"], where=tgt.year > src.year).withColumn("rule", F.lit("later"))
    return P.describe(P.combine(a, b))


def groups_never_used(spark, d) -> DataFrame:
    g = _groups(spark, d)
    return P.never_used(g, P.cross(g, on=["status"], source="year = 1995", where=tgt.year == src.year + 2)).select("group", "n_cells")


def drop_small_pairs(spark, d) -> DataFrame:
    return _keys(P.drop_small(_forward(spark, d), 720, 430))


def _links(spark, d, k=None) -> DataFrame:
    """Vectors of label 0 and 1, linked by the sum of products of their first eight numbers, in whole thousandths."""
    e = table(spark, d, "embeddings")
    cells_ = e.select(F.col("vec_id").alias("row"), "label")
    feature = e.select(F.col("vec_id").alias("row"), F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x.cast("double") * 1000)).alias("feature"))
    g = P.make_groups(cells_, ["label"])
    pairs = P.cross(g, source="label in (0, 1)", target="label in (2, 3)")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)
    return P.links_by_expression(g, pairs, feature, dot, k)


def links_topk_all_labels(spark, d) -> DataFrame:
    """Whole vectors, in whole thousandths, of each label against those of each other one."""
    e = table(spark, d, "embeddings")
    feature = e.select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("feature"))
    g = P.make_groups(e.select(F.col("vec_id").alias("row"), "label"), ["label"])
    return P.links_by_dot(g, P.cross(g, where=src.label != tgt.label), feature, 2).select("source_row", "target_row", "weight")


def links_callback(spark, d) -> DataFrame:
    """A callback links cells of equal rank in their groups."""
    def same_rank(s, t):
        import numpy as np

        n = np.arange(min(len(s), len(t)))
        return n, n, n + 1.0

    g = _groups(spark, d)
    return P.links_by_callback(g, P.cross(g, on=["status"], where=tgt.year == src.year + 1), same_rank).select("source_row", "target_row", "weight")


def _weighted(spark, d):
    g = _groups(spark, d)
    pairs = _forward(spark, d, g).withColumn("w", (F.col("source_group") % 3 + F.col("target_group") % 2).cast("int"))
    return g, pairs


def bundle_weights_cdf(spark, d) -> DataFrame:
    _, pairs = _weighted(spark, d)
    b = S.bundles(pairs, ["target_group"], "w")
    c = S.cdf(b)
    return b.join(c.select("bundle", "lo", "hi"), "bundle").select("source_group", "target_group", "pair_no", "bundle", "bundle_weight", "lo", "hi")


def _sampler(spark, d, **kw) -> S.Sampler:
    g, pairs = _weighted(spark, d)
    return S.Sampler(g, pairs, weight="w", **kw)


def _samples(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("5:"), "id").alias("sample"))


def sample_step_weighted(spark, d) -> DataFrame:
    s = _sampler(spark, d, n_source=3)
    return s.sample(_samples(spark, 40), 11).select("sample", "pair_no", "side", "group", "ord", "row")


def sample_batch_single(spark, d) -> DataFrame:
    s = _sampler(spark, d)
    out = s.step(spark, 5, 700, 11)
    return out.groupBy("sample", "pair_no").agg(F.max(F.when(F.col("side") == "source", F.col("row"))).alias("source_row"), F.max(F.when(F.col("side") == "target", F.col("row"))).alias("target_row"))


def sample_bundle_shared(spark, d) -> DataFrame:
    """Pairs of a bundle share the cells drawn for their common group."""
    s = _sampler(spark, d, n_source=2, bundle_by=["target_group"])
    return s.sample(_samples(spark, 20), 3).select("sample", "bundle", "pair_no", "side", "group", "ord", "row")


def runs_draw(spark, d) -> DataFrame:
    s = _sampler(spark, d, n_source=6, run_length=4)
    return s.sample(_samples(spark, 15), 2).select("sample", "pair_no", "side", "group", "ord", "row")


def epoch_cover_source(spark, d) -> DataFrame:
    g = _groups(spark, d)
    return _small(S.epoch_chunks(g, g.table.where("status = 'F'").select("group"), 64, 7, 1), "ord")


def epoch_drop_last(spark, d) -> DataFrame:
    g = _groups(spark, d)
    return S.epoch_chunks(g, g.table.select("group"), 100, 7, 1, drop_last=True).groupBy("group").agg(F.count_distinct("chunk").alias("chunks"), F.count(F.lit(1)).alias("cells"))


def epoch_bundles(spark, d) -> DataFrame:
    return _small(_sampler(spark, d, n_source=50).epoch(1, 7), "ord")


def epoch_rows_single(spark, d) -> DataFrame:
    return _sampler(spark, d).epoch_rows(1, 7).select("source_row", "target_row", "pair_no")


def epoch_self_links(spark, d) -> DataFrame:
    g = _groups(spark, d)
    pairs = P.cross(g, on=["status", "year"])
    return S.Sampler(g, pairs, links="self").epoch_rows(0, 1).select("source_row", "target_row")


def links_lookup_all(spark, d) -> DataFrame:
    """Partners by links, with three hashed partners in the next year's group for every cell that has one."""
    g = _groups(spark, d)
    pairs = P.cross(g, on=["status"], where=tgt.year == src.year + 1)
    at = g.rows.withColumnRenamed("group", "source_group").join(pairs.select("source_group", F.col("target_group").alias("group")), "source_group").join(g.table.select("group", "n_cells"), "group")
    at = at.select(F.col("row").alias("source_row"), "group", "n_cells", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).withColumn("k", F.pmod(F.col("source_row") * 31 + F.col("j") * 7, F.col("n_cells")))
    links = at.join(g.members().select("group", "k", F.col("row").alias("target_row")), ["group", "k"]).select("source_row", "target_row", (F.col("target_row") % 4 + 1).alias("weight")).distinct()
    return S.Sampler(g, pairs, links="table", link_table=links).epoch_rows(0, 9).select("source_row", "target_row")


def cells_batches(spark, d) -> DataFrame:
    return S.cell_batches(_groups(spark, d), 256, 2, 5).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("d"), F.min("ord").alias("lo"), F.max("ord").alias("hi"))


def cells_same_group(spark, d) -> DataFrame:
    return _small(S.cell_batches(_groups(spark, d), 64, 2, 5, same_group=True).select("batch", "ord", "row"), "ord")


def write_order_blocks(spark, d) -> DataFrame:
    return P.write_order(_groups(spark, d), 13)[0].select("row", "new_row")


def write_order_keep(spark, d) -> DataFrame:
    g = _groups(spark, d)
    order, blocks = P.write_order(g, 13, table(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_orderkey").alias("row")))
    return order.groupBy("group").agg(F.min("new_row").alias("lo"), F.max("new_row").alias("hi"), F.count(F.lit(1)).alias("n")).join(blocks.select("group", "start", "stop"), "group")


_SAME = "s.status IS NOT DISTINCT FROM t.status"
_PAIR = f"WITH {_G2} SELECT s.grp AS source_group, t.grp AS target_group"
_FWD = f"SELECT s.grp AS source_group, t.grp AS target_group, s.yr AS sy, t.yr AS ty, s.n AS sn, t.n AS tn FROM g s JOIN g t ON {_SAME} AND t.yr > s.yr"
_W = f"pw AS (SELECT *, source_group % 3 + target_group % 2 AS w, row_number() OVER (ORDER BY source_group, target_group) - 1 AS pair_no FROM ({_FWD}))"
_CDF = "cdf AS (SELECT *, sum(w) OVER (ORDER BY pair_no) AS hi, sum(w) OVER (ORDER BY pair_no) - w AS lo, sum(w) OVER () AS total FROM pw)"


def _draw(seed: int, n: int) -> str:
    at = u_sql(f"'{seed}:' || sample || ':bundle'")
    return f"sm AS (SELECT '5:' || i AS sample FROM (SELECT unnest(range({n})) AS i)), dr AS (SELECT sample, cdf.* FROM sm JOIN cdf ON {at} * total >= lo AND {at} * total < hi)"


def _cells(seed: int, n: int) -> str:
    """Distinct ranks, each drawn among what is left and counted past those drawn before."""
    u = u_sql(f"'{seed}:' || sample || ':' || side || ':' || grp || ':' || j")
    return f"""sides AS (SELECT DISTINCT sample, 'source' AS side, source_group AS grp FROM dr UNION SELECT DISTINCT sample, 'target', target_group FROM dr),
picked AS (SELECT sample, side, grp, n, CAST(0 AS BIGINT) AS j, CAST([] AS BIGINT[]) AS done FROM sides JOIN g USING (grp)
  UNION ALL SELECT sample, side, grp, n, j + 1, list_append(done, list_reduce(list_prepend(CAST(floor({u} * (n - j)) AS BIGINT), list_sort(done)), lambda x, c: CASE WHEN c <= x THEN x + 1 ELSE x END)) FROM picked WHERE j < least({n}, n)),
got AS (SELECT p.sample, p.side, p.grp, mem.r, i - 1 AS ord FROM (SELECT *, unnest(range(1, len(done) + 1)) AS i FROM picked WHERE j = least({n}, n)) p JOIN mem ON mem.grp = p.grp AND mem.k = p.done[i])"""


def _runs(seed: int, n: int, r: int) -> str:
    at = u_sql(f"'{seed}:' || sample || ':' || side || ':' || grp || ':' || j")
    off = u_sql(f"'{seed}:' || p.sample || ':' || p.side || ':' || p.grp || ':off'")
    m = -(-n // r) + 1
    return f"""sides AS (SELECT DISTINCT sample, 'source' AS side, source_group AS grp FROM dr UNION SELECT DISTINCT sample, 'target', target_group FROM dr),
picked AS (SELECT sample, side, grp, n, (n + {r - 1}) // {r} AS q, CAST(0 AS BIGINT) AS j, CAST([] AS BIGINT[]) AS done FROM sides JOIN g USING (grp)
  UNION ALL SELECT sample, side, grp, n, q, j + 1, list_append(done, list_reduce(list_prepend(CAST(floor({at} * (q - j)) AS BIGINT), list_sort(done)), lambda x, c: CASE WHEN c <= x THEN x + 1 ELSE x END)) FROM picked WHERE j < least({m}, q)),
posed AS (SELECT sample, side, grp, n, i, done[i] * {r} + o AS pos, o FROM (SELECT *, unnest(range(1, len(done) + 1)) AS i FROM picked WHERE j = least({m}, q)), (SELECT unnest(range({r})) AS o)),
kept AS (SELECT *, row_number() OVER (PARTITION BY sample, side, grp ORDER BY i, o) - 1 AS ord FROM posed WHERE pos < n),
got AS (SELECT p.sample, p.side, p.grp, mem.r, p.ord FROM kept p JOIN mem ON mem.grp = p.grp AND mem.k = (p.pos + CAST(floor({off} * p.n) AS BIGINT)) % p.n WHERE p.ord < {n})"""


_SIDES = "SELECT {cols}, g2.side, g2.grp AS \"group\", CAST(g2.ord AS INTEGER) AS ord, g2.r AS row FROM (SELECT dr.*, 'source' AS side, source_group AS grp FROM dr UNION ALL SELECT dr.*, 'target', target_group FROM dr) p JOIN got g2 ON g2.sample = p.sample AND g2.side = p.side AND g2.grp = p.grp"
_MULTI = "SELECT * FROM (SELECT grp, r, row_number() OVER (PARTITION BY grp ORDER BY md5('{s}:{e}:' || r), r) - 1 AS k FROM mem)"

QUERIES = {
    "groups_first_seen": (groups_first_seen, f'WITH {_G2} SELECT grp AS "group", status, yr, n AS n_cells FROM g'),
    "group_members": (group_members, f'WITH {_G2} SELECT grp AS "group", r AS row, CAST(k AS INTEGER) AS k FROM mem'),
    "pair_cross_filtered": (pair_cross_filtered, f"{_PAIR}, s.yr AS source_year, t.yr AS target_year FROM g s, g t WHERE s.status = 'F' AND t.status = 'O' AND t.yr > 1998"),
    "pair_on_nullsafe": (pair_on_nullsafe, f"{_PAIR}, s.n AS source_n_cells, t.n AS target_n_cells FROM g s JOIN g t ON {_SAME}"),
    "pair_theta_time_forward": (pair_theta_time_forward, f"{_PAIR} FROM g s JOIN g t ON {_SAME} AND t.yr > s.yr"),
    "pair_fallback_anti": (
        pair_fallback_anti,
        f"WITH {_G2}, st AS (SELECT s.grp AS source_group, t.grp AS target_group FROM g s JOIN g t ON {_SAME} AND s.yr = t.yr - 3) SELECT *, 'strict' AS rule FROM st UNION ALL SELECT s.grp, t.grp, 'fallback' FROM g s JOIN g t ON s.yr = t.yr - 1 AND NOT ({_SAME}) WHERE t.grp NOT IN (SELECT target_group FROM st)",
    ),
    "pair_membership_semi": (pair_membership_semi, f"{_PAIR} FROM g s JOIN g t ON {_SAME} AND t.yr > s.yr WHERE s.n > 700 AND t.yr NOT IN (1997, 2000)"),
    "pair_combine_first_wins": (
        pair_combine_first_wins,
        f"{_PAIR}, CASE WHEN t.yr = s.yr + 1 THEN 'next' END AS rule, CASE WHEN t.yr <> s.yr + 1 THEN t.yr - s.yr END AS gap FROM g s JOIN g t ON {_SAME} AND t.yr > s.yr",
    ),
    "pair_token_subset": (
        pair_token_subset,
        "WITH k AS (SELECT DISTINCT array_to_string(list_sort(list_distinct(CASE WHEN p_size > 40 THEN [split_part(p_name, ' ', 2), 'large'] ELSE [split_part(p_name, ' ', 2)] END)), '+') AS kind FROM part) SELECT s.kind AS source_kind, t.kind AS target_kind FROM k s, k t WHERE s.kind <> t.kind AND list_has_all(string_split(t.kind, '+'), string_split(s.kind, '+'))",
    ),
    "pair_next_time": (pair_next_time, f"WITH {_G2}, n AS (SELECT *, lead(yr) OVER (PARTITION BY status ORDER BY yr) AS nx FROM g) SELECT s.grp AS source_group, t.grp AS target_group FROM n s JOIN g t ON {_SAME} AND t.yr = s.nx"),
    "pair_top_dose": (pair_top_dose, f"WITH {_G2}, n AS (SELECT *, max(yr) OVER (PARTITION BY status) AS top FROM g) SELECT s.grp AS source_group, t.grp AS target_group FROM g s JOIN n t ON {_SAME} AND t.yr = t.top AND s.yr < t.yr"),
    "pair_balanced_weight": (pair_balanced_weight, f"WITH {_G2} SELECT source_group, target_group, round(1.0 / count(*) OVER (PARTITION BY target_group), 9)::DOUBLE AS weight FROM ({_FWD})"),
    "pair_describe": (
        pair_describe,
        f"WITH {_G2} SELECT CASE WHEN ty = sy + 1 THEN 'next' ELSE 'later' END AS rule, count(*) AS n_pairs, count(DISTINCT source_group) AS n_source_groups, count(DISTINCT target_group) AS n_target_groups FROM ({_FWD}) GROUP BY 1",
    ),
    "groups_never_used": (
        groups_never_used,
        f'WITH {_G2}, p AS (SELECT s.grp AS a, t.grp AS b FROM g s JOIN g t ON {_SAME} AND s.yr = 1995 AND t.yr = 1997) SELECT grp AS "group", n AS n_cells FROM g WHERE grp NOT IN (SELECT a FROM p UNION SELECT b FROM p)',
    ),
    "drop_small_pairs": (drop_small_pairs, f"WITH {_G2} SELECT source_group, target_group FROM ({_FWD}) WHERE sn >= 720 AND tn >= 430"),
    "links_topk_all_labels": (
        links_topk_all_labels,
        """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS f FROM embeddings),
        l AS (SELECT s.label AS a, t.label AS b, s.vec_id AS source_row, t.vec_id AS target_row, CAST(list_sum(list_transform(list_zip(s.f, t.f), lambda z: z[1] * z[2])) AS BIGINT) AS weight FROM e s JOIN e t ON s.label <> t.label),
        r AS (SELECT *, row_number() OVER (PARTITION BY a, b, source_row ORDER BY weight DESC, source_row, target_row) AS rs, row_number() OVER (PARTITION BY a, b, target_row ORDER BY weight DESC, source_row, target_row) AS rt FROM l)
        SELECT source_row, target_row, weight FROM r WHERE rs <= 2 OR rt <= 2""",
    ),
    "links_callback": (
        links_callback,
        f"WITH {_G2}, p AS (SELECT s.grp AS a, t.grp AS b FROM g s JOIN g t ON {_SAME} AND t.yr = s.yr + 1) SELECT x.r AS source_row, y.r AS target_row, CAST(x.k + 1 AS DOUBLE) AS weight FROM p JOIN mem x ON x.grp = a JOIN mem y ON y.grp = b AND y.k = x.k",
    ),
    "bundle_weights_cdf": (
        bundle_weights_cdf,
        f"WITH {_G2}, {_W}, b AS (SELECT target_group, sum(w) AS bw, row_number() OVER (ORDER BY min(pair_no)) - 1 AS bundle FROM pw GROUP BY 1), c AS (SELECT *, sum(bw) OVER (ORDER BY bundle) AS hi FROM b) SELECT source_group, target_group, CAST(pair_no AS INTEGER) AS pair_no, CAST(bundle AS INTEGER) AS bundle, CAST(bw AS DOUBLE) AS bundle_weight, CAST(hi - bw AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM pw JOIN c USING (target_group)",
    ),
    "sample_step_weighted": (sample_step_weighted, f"WITH RECURSIVE {_G2}, {_W}, {_CDF}, {_draw(11, 40)}, {_cells(11, 3)} " + _SIDES.format(cols="p.sample, CAST(pair_no AS INTEGER) AS pair_no")),
    "sample_batch_single": (
        sample_batch_single,
        f"WITH RECURSIVE {_G2}, {_W}, {_CDF}, {_draw(11, 700)}, {_cells(11, 1)} SELECT d.sample, CAST(d.pair_no AS INTEGER) AS pair_no, a.r AS source_row, b.r AS target_row FROM dr d JOIN got a ON a.sample = d.sample AND a.side = 'source' JOIN got b ON b.sample = d.sample AND b.side = 'target'",
    ),
    "sample_bundle_shared": (
        sample_bundle_shared,
        f"WITH RECURSIVE {_G2}, {_W}, b AS (SELECT target_group, sum(w) AS w, row_number() OVER (ORDER BY min(pair_no)) - 1 AS pair_no FROM pw GROUP BY 1), cdf AS (SELECT target_group AS tg, pair_no AS bundle, sum(w) OVER (ORDER BY pair_no) AS hi, sum(w) OVER (ORDER BY pair_no) - w AS lo, sum(w) OVER () AS total FROM b), sm AS (SELECT '5:' || i AS sample FROM (SELECT unnest(range(20)) AS i)), "
        f"d0 AS (SELECT sample, tg, bundle FROM sm JOIN cdf ON {u_sql(chr(39) + '3:' + chr(39) + ' || sample || ' + chr(39) + ':bundle' + chr(39))} * total >= lo AND {u_sql(chr(39) + '3:' + chr(39) + ' || sample || ' + chr(39) + ':bundle' + chr(39))} * total < hi), dr AS (SELECT sample, bundle, pw.* FROM d0 JOIN pw ON pw.target_group = tg), {_cells(3, 2)} " + _SIDES.format(cols="p.sample, CAST(p.bundle AS INTEGER) AS bundle, CAST(p.pair_no AS INTEGER) AS pair_no"),
    ),
    "runs_draw": (
        runs_draw,
        f"WITH RECURSIVE {_G2}, {_W}, {_CDF}, {_draw(2, 15)}, {_runs(2, 6, 4)} " + _SIDES.format(cols="p.sample, CAST(pair_no AS INTEGER) AS pair_no"),
    ),
    "epoch_cover_source": (
        epoch_cover_source,
        f"WITH {_G2}, q AS ({_MULTI.format(s=7, e=1)}) SELECT q.grp AS \"group\", r AS row, CAST(k // 64 AS BIGINT) AS chunk, CAST(k % 64 AS INTEGER) AS ord FROM q JOIN g USING (grp) WHERE g.status = 'F'",
    ),
    "epoch_drop_last": (epoch_drop_last, f'WITH {_G2} SELECT grp AS "group", n // 100 AS chunks, n // 100 * 100 AS cells FROM g WHERE n >= 100'),
    "epoch_bundles": (
        epoch_bundles,
        f"WITH {_G2}, {_W}, c AS (SELECT source_group AS grp, pair_no, w, sum(w) OVER (PARTITION BY source_group ORDER BY pair_no) AS hi, sum(w) OVER (PARTITION BY source_group) AS total FROM pw WHERE w > 0), q AS ({_MULTI.format(s=7, e=1)}), z AS (SELECT grp, r, k // 50 AS chunk, k % 50 AS ord FROM q) "
        f"SELECT z.grp AS \"group\", CAST(chunk AS BIGINT) AS chunk, CAST(ord AS INTEGER) AS ord, r AS row, CAST(pair_no AS INTEGER) AS bundle FROM z JOIN c USING (grp) WHERE {u_sql(chr(39) + '7:1:' + chr(39) + ' || z.grp || ' + chr(39) + ':' + chr(39) + ' || chunk || ' + chr(39) + ':bundle' + chr(39))} * total < hi AND {u_sql(chr(39) + '7:1:' + chr(39) + ' || z.grp || ' + chr(39) + ':' + chr(39) + ' || chunk || ' + chr(39) + ':bundle' + chr(39))} * total >= hi - w",
    ),
    "epoch_rows_single": (
        epoch_rows_single,
        f"WITH {_G2}, {_W}, c AS (SELECT source_group AS grp, target_group, pair_no, w, sum(w) OVER (PARTITION BY source_group ORDER BY pair_no) AS hi, sum(w) OVER (PARTITION BY source_group) AS total FROM pw WHERE w > 0), "
        f"x AS (SELECT mem.r, pair_no, target_group FROM mem JOIN c USING (grp) WHERE {u_sql(chr(39) + '7:1:' + chr(39) + ' || mem.r || ' + chr(39) + ':pair' + chr(39))} * total < hi AND {u_sql(chr(39) + '7:1:' + chr(39) + ' || mem.r || ' + chr(39) + ':pair' + chr(39))} * total >= hi - w) "
        f"SELECT x.r AS source_row, t.r AS target_row, CAST(pair_no AS INTEGER) AS pair_no FROM x JOIN mem t ON t.grp = x.target_group AND t.k = CAST(floor({u_sql(chr(39) + '7:1:' + chr(39) + ' || x.r || ' + chr(39) + ':partner' + chr(39))} * t.n) AS BIGINT)",
    ),
    "epoch_self_links": (epoch_self_links, "SELECT o_orderkey AS source_row, o_orderkey AS target_row FROM orders"),
    "links_lookup_all": (
        links_lookup_all,
        f"WITH {CELLS_SQL}, m AS (SELECT r, status, yr, row_number() OVER (PARTITION BY status, yr ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY status, yr) AS n FROM cells), l AS (SELECT DISTINCT a.r AS s, b.r AS t, b.r % 4 + 1 AS w FROM m a CROSS JOIN (SELECT unnest(range(3)) AS j) JOIN m b ON a.status IS NOT DISTINCT FROM b.status AND b.yr = a.yr + 1 AND b.k = (a.r * 31 + j * 7) % b.n), c AS (SELECT *, sum(w) OVER (PARTITION BY s ORDER BY t) AS hi, sum(w) OVER (PARTITION BY s) AS total FROM l) "
        f"SELECT s AS source_row, t AS target_row FROM c WHERE {u_sql(chr(39) + '9:0:' + chr(39) + ' || s || ' + chr(39) + ':link' + chr(39))} * total < hi AND {u_sql(chr(39) + '9:0:' + chr(39) + ' || s || ' + chr(39) + ':link' + chr(39))} * total >= hi - w",
    ),
    "cells_batches": (cells_batches, "WITH n AS (SELECT count(*) AS n FROM orders) SELECT CAST(i AS VARCHAR) AS batch, least(256, n - i * 256) AS n, least(256, n - i * 256) AS d, CAST(0 AS BIGINT) AS lo, least(256, n - i * 256) - 1 AS hi FROM n, (SELECT unnest(range(100000)) AS i) WHERE i * 256 < n"),
    "cells_same_group": (cells_same_group, f"WITH {_G2}, q AS ({_MULTI.format(s=5, e=2)}) SELECT grp || ':' || k // 64 AS batch, CAST(k % 64 AS INTEGER) AS ord, r AS row FROM q"),
    "write_order_blocks": (
        write_order_blocks,
        f"WITH {_G2}, b AS (SELECT grp, sum(n) OVER (ORDER BY status NULLS FIRST, yr NULLS FIRST) - n AS start FROM g) SELECT r AS row, CAST(start + row_number() OVER (PARTITION BY grp ORDER BY md5('13:' || r), r) - 1 AS BIGINT) AS new_row FROM mem JOIN b USING (grp)",
    ),
    "write_order_keep": (
        write_order_keep,
        f"WITH {_G2}, s AS (SELECT grp, count(*) AS n FROM mem JOIN orders ON o_orderkey = r WHERE o_totalprice > 150000 GROUP BY 1), b AS (SELECT s.grp, s.n, CAST(sum(s.n) OVER (ORDER BY status NULLS FIRST, yr NULLS FIRST) AS BIGINT) AS stop FROM s JOIN g USING (grp)) SELECT grp AS \"group\", stop - n AS lo, stop - 1 AS hi, n, stop - n AS start, stop FROM b",
    ),
}
