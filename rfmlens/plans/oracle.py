"""DuckDB oracle SQL for the registered queries.

The SQL follows the reference's *literal* semantics -- the many-to-many
userbase join, the app x connection cross product, row_number top-1, the
single global percent_rank window -- so that it checks the factorised,
skew-safe Spark plans against the straightforward formulation.

Type alignment with Spark: integer sums are cast back to BIGINT (DuckDB widens
to HUGEINT), day differences to INTEGER, month differences to DOUBLE, and
double -> bigint casts truncate (Spark semantics) via ``trunc``.
"""

from __future__ import annotations

from rfmlens.config import DEFAULT_SEED, REFERENCE_AGE_BANDS, REFERENCE_AUDIENCE_LABEL, REFERENCE_SWEEP_KS
from rfmlens.sources.standins import APP_CATEGORIES, PLACE_CODES, STANDIN_CONFIG

_C = STANDIN_CONFIG
_AD = _C.anchor_day.isoformat()
_AM_INDEX = _C.anchor_day.year * 12 + _C.anchor_day.month
_FX = repr(float(_C.fx_rate))
_SCALE = repr(float(_C.scale))


def _not_like_all(col: str, values) -> str:
    return " AND ".join(f"NOT ({col} LIKE '{v}')" for v in values)


def _pr(col: str, direction: str) -> str:
    """percent_rank among non-null values; null values get a null rank (T14)."""
    return (f"CASE WHEN {col} IS NULL THEN NULL ELSE percent_rank() OVER "
            f"(PARTITION BY {col} IS NULL ORDER BY {col} {direction}) END")


BASE_CTES = f"""
ub AS (
  SELECT DISTINCT o_custkey AS ifa, o_orderpriority AS req_con_type_desc,
         o_orderstatus AS req_carrier_name
  FROM orders),
usage_rec AS (
  SELECT o.o_custkey AS ifa, l.l_suppkey AS bundle, o.o_orderdate AS last_seen,
         CAST(trunc(l.l_quantity) AS BIGINT) AS brq_count,
         o.o_orderkey, strftime(o.o_orderdate, '%Y%m') AS month
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
connections AS (
  SELECT o_orderkey, unnest([o_orderpriority, CASE o_orderstatus WHEN 'F' THEN '1-URGENT' WHEN 'O' THEN '5-LOW' END]) AS req_con_type_desc
  FROM orders),
prices AS (
  SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' THEN 0.0
                 WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice END AS price
  FROM orders),
main_df AS (
  SELECT ub.ifa, ub.req_con_type_desc, ub.req_carrier_name, u.last_seen, u.brq_count,
         CAST(u.last_seen AS DATE) AS date,
         CAST(date_trunc('month', CAST(u.last_seen AS DATE)) AS DATE) AS month,
         CAST({_AM_INDEX} - (year(u.last_seen) * 12 + month(u.last_seen)) AS DOUBLE) AS period_months,
         CAST(date_diff('day', CAST(u.last_seen AS DATE), DATE '{_AD}') AS INTEGER) AS days_since
  FROM ub JOIN usage_rec u ON ub.ifa = u.ifa),
daily AS (
  SELECT ifa, date, period_months, days_since, CAST(sum(brq_count) AS BIGINT) AS sum_brq_daily
  FROM main_df WHERE {_not_like_all('req_con_type_desc', _C.daily_excluded)}
  GROUP BY ifa, date, period_months, days_since),
base AS (
  SELECT ifa, min(date) AS earliest_date, max(date) AS latest_date,
         max(days_since) AS first_seen, min(days_since) AS last_seen,
         min(period_months) AS min_period, max(period_months) AS max_period,
         count(date) AS data_usage_freq, CAST(sum(sum_brq_daily) AS BIGINT) AS brq_count,
         max(period_months) - min(period_months) + 1 AS duration_months
  FROM daily GROUP BY ifa),
tax AS (
  SELECT m.bundle, lv.app_l1_name, lv.app_l2_name, lv.app_l3_name, ls.lifestage_name
  FROM (SELECT s_suppkey AS bundle, CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS app_level_id FROM supplier) m
  LEFT JOIN (SELECT n_nationkey AS app_level_id, n_name AS app_l1_name, lower(n_name) AS app_l2_name,
                    substr(n_name, 1, 3) AS app_l3_name, n_regionkey AS app_lifestage_id FROM nation) lv
    ON m.app_level_id = lv.app_level_id
  LEFT JOIN (SELECT r_regionkey AS app_lifestage_id, r_name AS lifestage_name FROM region) ls
    ON lv.app_lifestage_id = ls.app_lifestage_id),
dev_ranked AS (
  SELECT o_custkey AS ifa, strftime(o_orderdate, '%Y%m') AS month, o_orderstatus AS device_name,
         o_orderpriority AS device_model, price,
         row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y%m')
                            ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM prices),
dev AS (SELECT ifa, month, device_name, device_model, price FROM dev_ranked WHERE rn = 1),
priced AS (SELECT ifa, month, price * CAST({_FX} AS DOUBLE) AS myr_price FROM dev WHERE price <> 0.0),
app_conn AS (
  SELECT u.ifa, u.month, u.bundle, u.brq_count, c.req_con_type_desc,
         t.app_l1_name, t.lifestage_name
  FROM usage_rec u JOIN connections c ON u.o_orderkey = c.o_orderkey LEFT JOIN tax t ON u.bundle = t.bundle),
streaming AS (
  SELECT ifa, month, CAST(sum(brq_count) AS BIGINT) AS data_streaming
  FROM app_conn
  WHERE {_C.category_col} = '{_C.category}' AND {_not_like_all('req_con_type_desc', _C.spend_excluded)}
  GROUP BY ifa, month),
spend AS (
  SELECT p.ifa, p.month, p.myr_price + s.data_streaming AS spend
  FROM priced p JOIN streaming s ON p.ifa = s.ifa AND p.month = s.month),
peak AS (
  SELECT ifa, spend FROM (
    SELECT ifa, spend, row_number() OVER (PARTITION BY ifa ORDER BY spend DESC NULLS LAST) AS rn
    FROM spend) WHERE rn = 1),
rfm AS (
  SELECT b.ifa, b.last_seen, b.data_usage_freq / b.duration_months AS usage_frequency,
         b.brq_count / b.duration_months AS brq_frequency, b.data_usage_freq,
         round(p.spend / b.duration_months) AS avg_spend, b.brq_count
  FROM base b JOIN peak p ON b.ifa = p.ifa),
ranked AS (
  SELECT *,
    {_pr("last_seen", "DESC")} AS r_percentile,
    {_pr("usage_frequency", "ASC")} AS vf_percentile,
    {_pr("brq_frequency", "ASC")} AS bf_percentile,
    {_pr("avg_spend", "ASC")} AS m_percentile
  FROM rfm),
scores AS (
  SELECT *, r_percentile * {_SCALE} AS r, vf_percentile * {_SCALE} AS vf,
         bf_percentile * {_SCALE} AS bf, m_percentile * {_SCALE} AS m
  FROM ranked)
"""


_F = ("avg_spend", "prediction", "last_seen", "device_price", "usage_frequency", "overall_brq")
_APP_SUM, _POI_SUM = "coalesce(ap.n, 0)", "coalesce(pl.n, 0)"
_MEANS_OF = ("r", "vf", "m", "usage_frequency", "avg_spend", "last_seen", "device_price",
             "overall_brq", *APP_CATEGORIES, "overall_brq_poi", *PLACE_CODES)

PROFILE_CTES = f"""
age AS (SELECT c_custkey AS ifa, CAST(((c_nationkey % 5) + 5) % 5 AS DOUBLE) AS prediction FROM customer),
devp AS (
  SELECT ifa, price * CAST({_FX} AS DOUBLE) AS device_price FROM (
    SELECT o_custkey AS ifa, price,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM prices) WHERE rn = 1 AND price <> 0.0),
apps AS (
  SELECT user_id AS ifa, {", ".join(f"count(*) FILTER (WHERE event_type = '{c}') AS {c}" for c in APP_CATEGORIES)}, count(*) AS n
  FROM events GROUP BY user_id),
places AS (
  SELECT o.o_custkey AS ifa,
         {", ".join(f"count(*) FILTER (WHERE 'RF_' || l.l_returnflag = '{c}') AS {c}" for c in PLACE_CODES)}, count(*) AS n
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey),
wide AS (
  SELECT s.*, a.prediction, dp.device_price, {_APP_SUM} AS overall_brq,
         {", ".join(f"coalesce(ap.{c}, 0) AS {c}" for c in APP_CATEGORIES)},
         {_POI_SUM} AS overall_brq_poi,
         {", ".join(f"coalesce(pl.{c}, 0) AS {c}" for c in PLACE_CODES)}
  FROM scores s LEFT JOIN age a ON s.ifa = a.ifa LEFT JOIN devp dp ON s.ifa = dp.ifa
  LEFT JOIN apps ap ON s.ifa = ap.ifa LEFT JOIN places pl ON s.ifa = pl.ifa),
clustered AS (SELECT *, LEAST(CAST(floor(r) AS INTEGER), 4) AS cluster FROM wide),
feat AS (
  SELECT ifa, cluster, {", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS x{i}" for i, c in enumerate(_F))}
  FROM clustered WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _F)}),
sd AS (SELECT {", ".join(f"stddev_samp(x{i}) AS s{i}" for i in range(len(_F)))} FROM feat),
z AS (
  SELECT f.ifa, f.cluster,
         {", ".join(f"CASE WHEN sd.s{i} = 0 THEN 0.0 ELSE f.x{i} / sd.s{i} END AS z{i}" for i in range(len(_F)))}
  FROM feat f CROSS JOIN sd),
zz AS (SELECT *, {" + ".join(f"z{i} * z{i}" for i in range(len(_F)))} AS nrm FROM z),
cstat AS (
  SELECT cluster, count(*) AS n, {", ".join(f"sum(z{i}) AS t{i}" for i in range(len(_F)))}, sum(nrm) AS q
  FROM zz GROUP BY cluster),
pdist AS (
  SELECT p.ifa, p.cluster AS own, c.cluster AS other, c.n,
         p.nrm + c.q / c.n - 2 * ({" + ".join(f"p.z{i} * c.t{i}" for i in range(len(_F)))}) / c.n AS dist
  FROM zz p CROSS JOIN cstat c),
psil AS (
  SELECT ifa, max(CASE WHEN own = other THEN n END) AS n_own,
         max(CASE WHEN own = other AND n > 1 THEN dist * n / (n - 1) END) AS a,
         min(CASE WHEN own <> other THEN dist END) AS b
  FROM pdist GROUP BY ifa)
"""


def with_base(select: str, profile: bool = False) -> str:
    ctes = BASE_CTES.strip() + ("," + PROFILE_CTES.rstrip() if profile else "")
    return f"WITH {ctes}\n{select.strip()}"


def _r(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


SCORING_SQL = {
    "explode_usage": "SELECT ifa, last_seen, brq_count FROM usage_rec",
    "explode_star": "SELECT ifa, bundle, last_seen, brq_count FROM usage_rec",
    "explode_cross": """
        SELECT ifa, month, bundle, req_con_type_desc, count(*) AS pairs, CAST(sum(brq_count) AS BIGINT) AS brq
        FROM app_conn GROUP BY ifa, month, bundle, req_con_type_desc""",
    "userbase_tree": """
        SELECT req_con_type_desc, req_carrier_name, count(*) AS n FROM ub GROUP BY ALL""",
    "csv_by_name": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "choose_k": """
        SELECT CAST(k AS INTEGER) AS k FROM (
          SELECT l_linenumber + 1 AS k, round(avg(l_discount), 9) AS silhouette FROM lineitem GROUP BY l_linenumber)
        WHERE k >= 4 ORDER BY silhouette DESC, k LIMIT 1""",
    "enrich_usage": """
        SELECT ifa, date, month, period_months, days_since, count(*) AS main_rows,
               CAST(sum(brq_count) AS BIGINT) AS main_brq
        FROM main_df GROUP BY ifa, date, month, period_months, days_since""",
    "enrich_usage_colocated": """
        SELECT ifa, date, month, period_months, days_since, count(*) AS main_rows,
               CAST(sum(brq_count) AS BIGINT) AS main_brq
        FROM main_df GROUP BY ifa, date, month, period_months, days_since""",
    "usage_histogram": """
        SELECT sum_brq, count(ifa) AS ifa_count FROM (
          SELECT ifa, CAST(sum(brq_count) AS BIGINT) AS sum_brq
          FROM (SELECT DISTINCT ifa, brq_count FROM main_df) GROUP BY ifa)
        GROUP BY sum_brq ORDER BY sum_brq""",
    "daily_usage": "SELECT * FROM daily",
    "rfm_base": "SELECT * FROM base",
    "app_taxonomy": "SELECT * FROM tax",
    "latest_device": "SELECT * FROM dev",
    "priced_device": "SELECT * FROM priced",
    "category_usage": "SELECT * FROM streaming",
    "monthly_spend": "SELECT * FROM spend",
    "peak_spend": "SELECT * FROM peak",
    "spend_stream": "SELECT * FROM spend",
    "spend_stream_mixed": "SELECT * FROM spend",
    "mixed_month_schemas": "SELECT * FROM priced",
    "rank_after_delta": "SELECT ifa, spend, percent_rank() OVER (ORDER BY spend) AS pct FROM peak",
    "rfm_base_incremental": "SELECT * FROM base",
    "rfm_measures": "SELECT * FROM rfm",
    "dist_recency": """
        SELECT last_seen, count(DISTINCT ifa) AS ifa_count FROM rfm GROUP BY last_seen ORDER BY last_seen""",
    "dist_frequency": """
        SELECT usage_frequency, count(DISTINCT ifa) AS ifa_count FROM rfm
        GROUP BY usage_frequency ORDER BY usage_frequency""",
    "dist_monetary": """
        SELECT avg_spend, count(DISTINCT ifa) AS ifa_count FROM rfm GROUP BY avg_spend ORDER BY avg_spend""",
    "report_csv_roundtrip": """
        SELECT last_seen, count(DISTINCT ifa) AS ifa_count FROM rfm GROUP BY last_seen""",
    "report_overwrite": """
        SELECT last_seen, count(DISTINCT ifa) AS ifa_count FROM rfm GROUP BY last_seen""",
    "report_order": """
        SELECT row_number() OVER (ORDER BY last_seen) - 1 AS pos, last_seen, count(DISTINCT ifa) AS ifa_count
        FROM rfm GROUP BY last_seen""",
    "rfm_scores": "SELECT * FROM scores",
    "uniqueness_check": """
        SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT ifa FROM scores)) AS distinct_keys,
               count(*) = (SELECT count(*) FROM (SELECT DISTINCT ifa FROM scores)) AS is_unique
        FROM scores""",
}


_MONTHS = ("200105", "200106", "200107", "200108")
_MONTH_LIST = ", ".join(f"'{m}'" for m in _MONTHS)
_BANDS = tuple((repr(float(v)), label) for v, label in REFERENCE_AGE_BANDS)

SCAN_SQL = {
    "median_exact": "SELECT l_returnflag, " + ", ".join(
        f"quantile_disc({c}, {q}) AS {n}_{c}" for c in ("l_extendedprice", "l_quantity")
        for n, q in (("lower", 0.25), ("median", 0.5), ("upper", 0.75))) + " FROM lineitem GROUP BY l_returnflag",
    "global_row_number": """
        SELECT l_orderkey, l_linenumber, l_returnflag,
               row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos,
               row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos_in_flag
        FROM lineitem""",
    "distinct_sketches": """
        SELECT strftime(o_orderdate, '%Y') AS year, count(DISTINCT o_custkey) AS devices, true AS within_3_percent
        FROM orders GROUP BY 1""",
    "percent_rank_scaled": """
        SELECT l_orderkey, l_linenumber,
               percent_rank() OVER (ORDER BY l_extendedprice ASC NULLS FIRST) AS price_pct,
               percent_rank() OVER (ORDER BY l_shipdate DESC NULLS LAST) AS ship_pct
        FROM lineitem""",
    "percent_rank_signed": """
        SELECT l_orderkey, l_linenumber,
               percent_rank() OVER (ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN -l_discount ELSE l_discount END) AS pct
        FROM lineitem""",
    "percent_rank_text": """
        SELECT l_orderkey, l_linenumber,
               percent_rank() OVER (ORDER BY 'device-of-the-order-with-number-' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0')) AS pct
        FROM lineitem""",
    "month_pruned_scan": f"""
        SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS orders,
               count(DISTINCT o_custkey) AS devices
        FROM orders WHERE strftime(o_orderdate, '%Y%m') IN ({_MONTH_LIST}) GROUP BY 1""",
    "legacy_month_scan": f"""
        SELECT month, count(*) AS rows, count(DISTINCT ifa) AS devices,
               CAST(sum(brq_count) AS BIGINT) AS brq
        FROM usage_rec WHERE month IN ({_MONTH_LIST}) GROUP BY month""",
    "monthly_roundtrip": f"""
        SELECT month, count(*) AS rows, count(DISTINCT ifa) AS devices,
               CAST(sum(brq_count) AS BIGINT) AS brq
        FROM usage_rec WHERE month IN ({_MONTH_LIST}) GROUP BY month""",
}

def _lloyd(steps: int) -> str:
    """Lloyd steps from the means of the rule-given segments, unrolled."""
    zs = range(len(_F))
    means = ", ".join(f"avg(z{i}) AS m{i}" for i in zs)
    out = [f"c0 AS (SELECT cluster AS c, {means} FROM z GROUP BY cluster)"]
    dist = " + ".join(f"(z.z{i} - m{i}) * (z.z{i} - m{i})" for i in zs)
    for s in range(1, steps + 1):
        out.append(f"a{s} AS (SELECT * FROM (SELECT z.*, c, row_number() OVER (PARTITION BY z.ifa ORDER BY {dist}, c) AS rn "
                   f"FROM z CROSS JOIN c{s - 1}) WHERE rn = 1)")
        out.append(f"c{s} AS (SELECT c, count(*) AS n, {means} FROM a{s} GROUP BY c)")
    cols = ", ".join(f"round(m{i}, 6) AS {f}" for i, f in enumerate(_F))
    return f"SELECT * FROM (WITH {', '.join(out)} SELECT c AS cluster, n AS ifa_count, {cols} FROM c{steps})"


def _fixed_point_kmeans(ks: tuple[int, ...], select: str, seed: int = DEFAULT_SEED, steps: int = 20) -> str:
    """Seeding and Lloyd steps in whole numbers, unrolled; ``select`` reads p (points), own (ifa, k, j, d) and fin (k, j, centre)."""
    w = range(len(_F))
    cols, table = lambda f: ", ".join(f(i) for i in w), []
    add = lambda name, body: table.append(f"{name} AS MATERIALIZED ({body})")
    dist = " + ".join(f"(p.z{i} - c.z{i}) * (p.z{i} - c.z{i})" for i in w)
    whole = "CAST(4294967296 AS DOUBLE)"
    add("q", "SELECT ifa, " + cols(lambda i: f"CAST(floor(x{i} * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS q{i}") + " FROM feat")
    add("mo", "SELECT CAST(count(*) AS HUGEINT) AS n, " + cols(lambda i: f"sum(q{i}) AS s{i}, sum(CAST(q{i} AS HUGEINT) * q{i}) AS t{i}") + " FROM q")
    add("fa", "SELECT " + cols(lambda i: f"CASE WHEN n * t{i} > s{i} * s{i} THEN CAST(4096 AS DOUBLE) / "
                                         f"sqrt(CAST(n * t{i} - s{i} * s{i} AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) ELSE 0 END AS f{i}") + " FROM mo")
    add("p", "SELECT ifa, " + cols(lambda i: f"CAST(floor(CAST(q{i} AS DOUBLE) * f{i}) AS BIGINT) AS z{i}") + " FROM q CROSS JOIN fa")
    for r in range(max(ks)):
        u = (f"(CAST(CAST('0x' || substr(md5(CAST(ifa AS VARCHAR) || ':{seed}:{r}'), 1, 8) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / {whole}")
        far = ("SELECT p.*, 1 AS w FROM p" if r == 0 else
               f"SELECT p.ifa, {cols(lambda i: f'p.z{i}')}, min({dist}) AS w FROM p CROSS JOIN s{r - 1} c GROUP BY ALL")
        pick = (f"SELECT {r} AS j, {cols(lambda i: f'z{i}')} FROM ({far}) WHERE w > 0 ORDER BY (-ln({u})) / CAST(w AS DOUBLE), ifa LIMIT 1")
        add(f"s{r}", f"SELECT * FROM ({pick})" if r == 0 else f"SELECT * FROM s{r - 1} UNION ALL SELECT * FROM ({pick})")
    add("c0", f"SELECT k.k, c.* FROM s{max(ks) - 1} c CROSS JOIN (SELECT unnest([{', '.join(map(str, ks))}]) AS k) k WHERE c.j < k.k")
    near = lambda c: (f"SELECT ifa, k, dj % 64 AS j, dj // 64 AS d, {cols(lambda i: f'z{i}')} FROM ("  # noqa: E731
                      f"SELECT p.ifa, c.k, {cols(lambda i: f'p.z{i}')}, min(CAST({dist} AS HUGEINT) * 64 + c.j) AS dj FROM p CROSS JOIN {c} c GROUP BY ALL)")
    for t in range(1, steps + 1):
        add(f"m{t}", f"SELECT k, j, count(*) AS n, {cols(lambda i: f'sum(z{i}) AS s{i}')} FROM ({near(f'c{t - 1}')}) GROUP BY k, j")
        add(f"c{t}", "SELECT c.k, c.j, " + cols(lambda i: f"CAST(CASE WHEN n IS NULL THEN c.z{i} ELSE (s{i} - ((s{i} % n) + n) % n) // n END AS BIGINT) AS z{i}")
            + f" FROM c{t - 1} c LEFT JOIN m{t} m ON c.k = m.k AND c.j = m.j")
    add("fin", f"SELECT k, row_number() OVER (PARTITION BY k ORDER BY {cols(lambda i: f'z{i}')}) - 1 AS j, {cols(lambda i: f'z{i}')} FROM c{steps}")
    add("own", near("fin"))
    return f"SELECT * FROM (WITH {', '.join(table)} {select})"


_Z = range(len(_F))
_SWEEP_SELECT = f"""
, st AS MATERIALIZED (
  SELECT k, j, CAST(count(*) AS DOUBLE) AS n, CAST(sum({" + ".join(f"z{i} * z{i}" for i in _Z)}) AS DOUBLE) AS q,
         {", ".join(f"CAST(sum(z{i}) AS DOUBLE) AS t{i}" for i in _Z)} FROM own GROUP BY k, j),
di AS (
  SELECT o.ifa, o.k, o.j, st.j AS other, st.n,
         CAST({" + ".join(f"z{i} * z{i}" for i in _Z)} AS DOUBLE) * st.n + st.q
         - CAST(2 AS DOUBLE) * ({" + ".join(f"CAST(z{i} AS DOUBLE) * t{i}" for i in _Z)}) AS e
  FROM own o JOIN st ON o.k = st.k),
ab AS (
  SELECT ifa, k, max(CASE WHEN j = other THEN n END) AS n, max(CASE WHEN j = other THEN e / greatest(n - 1, 1) END) AS a,
         min(CASE WHEN j <> other THEN e / n END) AS b
  FROM di GROUP BY ifa, k),
sil AS (
  SELECT k, CAST(sum(CAST(floor((CASE WHEN n = 1 THEN 0 WHEN a < b THEN CAST(1 AS DOUBLE) - a / b WHEN a > b THEN b / a - CAST(1 AS DOUBLE) ELSE 0 END)
                                * CAST(1000000000 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / 1000000000 / count(*) AS silhouette
  FROM ab GROUP BY k),
cost AS (SELECT k, CAST(sum(d) AS DOUBLE) / 16777216 AS training_cost FROM own GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, silhouette, training_cost FROM sil JOIN cost USING (k)"""


PROFILE_SQL = {
    "kmeans_hashed": _fixed_point_kmeans((6,), "SELECT ifa, CAST(j AS INTEGER) AS cluster FROM own"),
    "sweep_from_centres": _fixed_point_kmeans(REFERENCE_SWEEP_KS, _SWEEP_SELECT),
    "audience_files": """
        SELECT cluster, CAST((count(DISTINCT ifa) + 39) // 40 AS BIGINT) AS files, count(DISTINCT ifa) AS rows,
               least(count(DISTINCT ifa), 40) AS most
        FROM clustered GROUP BY cluster""",
    "profile_order": """
        SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY cluster) - 1 AS pos, cluster
        FROM (SELECT DISTINCT cluster FROM clustered) CROSS JOIN (SELECT unnest(['means', 'bands', 'medians']) AS profile)""",
    "kmeans_from_centres": _lloyd(3),
    "assignment_check": """
        SELECT count(*) AS rows, count(DISTINCT ifa) AS distinct_keys, CAST(0 AS BIGINT) AS not_nearest FROM feat""",
    "audience_all": "SELECT DISTINCT ifa FROM clustered",
    "clustered_csv": "SELECT ifa, cluster, avg_spend, overall_brq FROM clustered",
    "features_scaled": "SELECT ifa, " + ", ".join(
        f"round(z{i}, 6) AS z_{c}" for i, c in enumerate(_F)) + " FROM z",
    "feature_row_counts": """
        SELECT (SELECT count(*) FROM clustered) AS rows_in, (SELECT count(*) FROM feat) AS rows_out,
               (SELECT count(*) FROM clustered) - (SELECT count(*) FROM feat) AS rows_dropped""",
    "silhouette_given_labels": """
        SELECT round(avg(CASE WHEN n_own = 1 THEN 0.0 WHEN a < b THEN 1 - a / b
                              WHEN a > b THEN b / a - 1 ELSE 0.0 END), 9) AS silhouette
        FROM psil""",
    "cluster_means": "SELECT cluster, " + ", ".join(
        _r(f"avg(CAST({c} AS DOUBLE))", c) for c in _MEANS_OF)
        + ", count(ifa) AS ifa_count FROM clustered GROUP BY cluster ORDER BY cluster",
    "category_shares": "SELECT cluster, " + ", ".join(
        _r(f"avg(CAST({c} AS DOUBLE))", c) if c not in APP_CATEGORIES + PLACE_CODES else
        _r(f"avg(CAST({c} AS DOUBLE)) / avg(CAST("
           f"{'overall_brq' if c in APP_CATEGORIES else 'overall_brq_poi'} AS DOUBLE))", c)
        for c in _MEANS_OF)
        + ", count(ifa) AS ifa_count FROM clustered GROUP BY cluster ORDER BY cluster",
    "band_values": "SELECT DISTINCT CASE " + " ".join(
        f"WHEN prediction = {v} THEN '{b}'" for v, b in _BANDS) + " END AS age FROM clustered",
    "band_distribution": "SELECT cluster, " + ", ".join(
        f"nullif(count(*) FILTER (WHERE prediction = {v}), 0) AS \"{b}\"" for v, b in _BANDS)
        + ", count(ifa) AS ifa_count FROM clustered GROUP BY cluster ORDER BY cluster",
    "mean_vs_median": "SELECT cluster, " + ", ".join(
        f"{_r(f'avg({c})', f'mean_{c}')}, quantile_disc({c}, 0.5) AS median_{c}, "
        f"{_r(f'avg({c}) / quantile_disc({c}, 0.5)', f'mean_to_median_{c}')}"
        for c in ("avg_spend", "device_price"))
        + " FROM clustered GROUP BY cluster ORDER BY cluster",
    "audience_lists": "SELECT DISTINCT cluster, ifa FROM clustered",
    "audience_parquet": "SELECT DISTINCT cluster, ifa FROM clustered",
    "audience_csv": f"""
        SELECT DISTINCT cluster, CAST(ifa AS VARCHAR) AS "{REFERENCE_AUDIENCE_LABEL}"
        FROM clustered""",
}


def oracle_sql() -> dict[str, str]:
    out = {name: with_base(sel) for name, sel in SCORING_SQL.items()}
    out.update({name: with_base(sel) for name, sel in SCAN_SQL.items()})
    out.update({name: with_base(sel, profile=True) for name, sel in PROFILE_SQL.items()})
    return out
