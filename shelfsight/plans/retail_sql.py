"""The same queries in DuckDB SQL, written on their own as a chain of named steps."""

from __future__ import annotations

LEVELS = (75, 80, 85, 90, 95, 99)
POLICIES = ("A", "B", "C05", "C10", "C15", "D", "E")
LAGS = (1, 2, 4, 8, 12, 13, 26, 52)


def q(x: str, percent: float) -> str:
    return f"quantile_disc({x}, {percent / 100})"


def share(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


STEPS: dict[str, str] = {}
STEPS["sales"] = """SELECT l_shipdate::DATE AS d, floor(l_suppkey / 3)::BIGINT::VARCHAR AS sku_id,
  CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS units FROM lineitem"""
STEPS["fact"] = """SELECT l_shipdate::DATE AS d, floor(l_suppkey / 3)::BIGINT::VARCHAR AS sku_id, o_custkey AS customer_id,
  CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS units, l_extendedprice * (1 - l_discount) AS base_amount,
  l_extendedprice * (1 - l_discount) / nullif(l_quantity, 0) AS unit_price, n_name AS province, n_regionkey AS nation, p_type AS family
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey"""
STEPS["weeks"] = "SELECT unnest(generate_series(DATE '1995-01-02', DATE '2001-10-29', INTERVAL 7 DAY))::DATE AS week"
STEPS["weekly"] = """SELECT sku_id, date_trunc('week', d)::DATE AS week, sum(greatest(units, 0)) AS y, count(DISTINCT d) AS days_active,
  count(DISTINCT CASE WHEN units > 0 THEN d END) AS days_nonzero FROM sales WHERE units >= 0 GROUP BY 1, 2"""
STEPS["panel"] = """SELECT s.sku_id, w.week, isoyear(w.week)::INT AS iso_year, weekofyear(w.week)::INT AS iso_week, coalesce(y, 0.0)::DOUBLE AS y,
  coalesce(days_active, 0) AS days_active, coalesce(days_nonzero, 0) AS days_nonzero
  FROM (SELECT DISTINCT sku_id FROM sales) s CROSS JOIN weeks w LEFT JOIN weekly k ON k.sku_id = s.sku_id AND k.week = w.week"""
_frame = lambda k: f"(PARTITION BY sku_id ORDER BY week ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
STEPS["f1"] = f"""SELECT *, {", ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in LAGS)},
  {", ".join(f"avg(y) OVER {_frame(k)} AS mean_{k}" for k in (4, 8, 12, 13))}, {", ".join(f"round(stddev_samp(y) OVER {_frame(k)}, 9) AS std_{k}" for k in (4, 12, 13))},
  coalesce(max((y > 0)::INT) OVER (PARTITION BY sku_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sold_before,
  (count(*) FILTER (y > 0) OVER {_frame(12)}) / 12.0::DOUBLE AS sale_freq_12w, (count(*) FILTER (y = 0) OVER {_frame(13)}) / 13.0::DOUBLE AS zero_share_13w,
  (count(*) FILTER (y = 0) OVER {_frame(26)}) / 26.0::DOUBLE AS zero_share_26w
  FROM panel WINDOW w AS (PARTITION BY sku_id ORDER BY week)"""
STEPS["f2"] = f"""SELECT *, {", ".join(f"{n}(iso_week * (2 * pi() / 52) * {k}) AS {n}_{k}" for k in (1, 2, 3) for n in ("sin", "cos"))},
  CASE WHEN iso_week BETWEEN 20 AND 35 THEN 'HIGH_SEASON' ELSE 'REST' END AS season_group,
  coalesce(round(std_4 / nullif(mean_4, 0), 9), 0) AS cv_4w, coalesce(round(std_12 / nullif(mean_12, 0), 9), 0) AS cv_12w, coalesce(round(std_13 / nullif(mean_13, 0), 9), 0) AS cv_13w,
  coalesce(mean_13, 0) AS amplitude, coalesce(lag_1 / nullif(mean_13, 0), 1) AS lag1_rel, (week - DATE '1995-01-02') / 7.0::DOUBLE AS weeks_since_start,
  CASE WHEN y = 0 AND sold_before = 1 AND (sale_freq_12w > 0.25 OR coalesce(mean_4, 0) > 5 OR coalesce(lag_1, 0) > 5 OR coalesce(mean_13, 0) > 5) THEN 1 ELSE 0 END AS oos_proxy FROM f1"""
STEPS["feats"] = f"SELECT *, {', '.join(f'coalesce(lag(oos_proxy, {k}) OVER (PARTITION BY sku_id ORDER BY week), 0) AS oos_lag_{k}' for k in (1, 2, 4))} FROM f2"
STEPS["labelled"] = """SELECT a.*, coalesce(n_future, 0) AS n_future, y_12w, event_12w, oos_weeks_12w, lost_12w FROM feats a LEFT JOIN (
  SELECT a.sku_id, a.week, count(*) AS n_future, sum(b.y) AS y_12w, max(b.oos_proxy) AS event_12w, sum(b.oos_proxy)::BIGINT AS oos_weeks_12w,
    sum(CASE WHEN b.oos_proxy = 1 THEN greatest(coalesce(b.mean_12, b.mean_13, b.mean_4, 0) - b.y, 0) ELSE 0 END) AS lost_12w
  FROM feats a JOIN feats b ON a.sku_id = b.sku_id AND b.week > a.week AND b.week <= a.week + 84 GROUP BY 1, 2) l ON l.sku_id = a.sku_id AND l.week = a.week"""
STEPS["parts"] = """SELECT *, CASE WHEN week <= DATE '1998-12-31' THEN 'TRAIN' WHEN week <= DATE '1999-12-31' THEN 'CALIB' WHEN week BETWEEN DATE '2000-01-03' AND DATE '2000-12-31' THEN 'VAL' END AS split
  FROM labelled WHERE n_future = 12"""
STEPS["cuts"] = f"SELECT season_group, [{', '.join(q('amplitude', 10 * k) for k in range(1, 10))}] AS cuts FROM parts WHERE split = 'TRAIN' GROUP BY 1"
STEPS["split"] = "SELECT p.*, (1 + len(list_filter(cuts, lambda c: p.amplitude > c)))::INT AS decile FROM parts p JOIN cuts USING (season_group) WHERE split IS NOT NULL"
STEPS["scores"] = """SELECT *, 12 * coalesce(mean_13, 0) AS yhat, greatest(least(0.5 * zero_share_13w + 0.5 * (1 - sale_freq_12w), 1), 0) AS p, amplitude >= 10 AS active,
  round(greatest(1, coalesce(std_13, 0) * sqrt(12), sqrt(coalesce(mean_13, 0) * 12 + 1)), 9) AS scale FROM split"""
STEPS["bcuts"] = f"SELECT season_group, decile, {', '.join(f'{q("cv_13w", 20 * k)} AS cut_{k}' for k in range(1, 5))} FROM scores WHERE split = 'CALIB' AND active GROUP BY 1, 2"
STEPS["seg0"] = f"SELECT s.*, 1 + {' + '.join(f'CASE WHEN cv_13w > cut_{k} THEN 1 ELSE 0 END' for k in range(1, 5))} AS bucket FROM scores s LEFT JOIN bcuts USING (season_group, decile)"
STEPS["seg"] = "SELECT *, season_group || '_D' || lpad(decile::VARCHAR, 2, '0') AS parent, season_group || '_D' || lpad(decile::VARCHAR, 2, '0') || '_V' || bucket AS child FROM seg0"
STEPS["resid"] = "SELECT *, CASE WHEN active THEN round((y_12w - yhat) / scale, 9) END AS score FROM seg WHERE split = 'CALIB'"
STEPS["kids"] = f"SELECT parent, child, count(score) AS n, {', '.join(f'{q("score", k)} AS z{k}' for k in LEVELS)} FROM resid WHERE score IS NOT NULL GROUP BY 1, 2"
STEPS["ups"] = f"SELECT parent, {', '.join(f'{q("score", k)} AS u{k}' for k in LEVELS)} FROM resid WHERE score IS NOT NULL GROUP BY 1"
STEPS["lookup"] = f"SELECT parent, child, n, CASE WHEN n >= 30 THEN 'child' ELSE 'parent' END AS level, {', '.join(f'CASE WHEN n >= 30 THEN z{k} ELSE u{k} END AS z{k}' for k in LEVELS)} FROM kids JOIN ups USING (parent)"
STEPS["seasonal"] = f"SELECT season_group, {', '.join(f'{q("score", k)} AS s{k}' for k in LEVELS)} FROM resid WHERE score IS NOT NULL GROUP BY 1"
_Z = {75: 1.036, 80: 1.282, 85: 1.440, 90: 1.645, 95: 1.960, 99: 2.576}
STEPS["zrows"] = f"SELECT s.*, {', '.join(f'coalesce(l.z{k}, t.s{k}, {_Z[k]}) AS z{k}' for k in LEVELS)} FROM seg s LEFT JOIN lookup l ON l.child = s.child LEFT JOIN seasonal t ON t.season_group = s.season_group"
STEPS["tunecut"] = "SELECT list_sort(list(DISTINCT week))[floor(0.67 * count(DISTINCT week))::INT] AS cut FROM scores WHERE split = 'VAL'"
STEPS["exceed"] = "SELECT season_group, child, (y_12w > greatest(0, yhat + z90 * scale))::INT AS x FROM zrows WHERE active AND split = 'VAL' AND week <= (SELECT cut FROM tunecut)"
STEPS["factors"] = """SELECT season_group, child, n, viol, greatest(least(viol / 0.10, 3.0), 0.8)::DOUBLE AS factor FROM (
  SELECT k.season_group, child, k.n, CASE WHEN k.n >= 50 THEN k.v WHEN u.n >= 20 THEN u.v ELSE 0.10 END::DOUBLE AS viol
  FROM (SELECT season_group, child, count(*) AS n, avg(x) AS v FROM exceed GROUP BY 1, 2) k JOIN (SELECT season_group, count(*) AS n, avg(x) AS v FROM exceed GROUP BY 1) u USING (season_group))"""
STEPS["caps"] = f"SELECT season_group, 2 * {q('y_12w', 99)} AS cap FROM scores WHERE split IN ('TRAIN', 'CALIB') GROUP BY 1"
STEPS["fraw"] = f"SELECT z.*, cap, {', '.join(f'greatest(0, yhat + z{k} * coalesce(factor, 1) * scale) AS r{k}' for k in LEVELS)} FROM zrows z LEFT JOIN factors f ON f.child = z.child LEFT JOIN caps c ON c.season_group = z.season_group"
STEPS["fc"] = "SELECT *, least(r75, cap) AS q75, " + ", ".join(f"least(greatest(r{a}, r{b}), cap) AS q{b}" for a, b in zip(LEVELS, LEVELS[1:], strict=False)) + " FROM fraw"
_mono = " OR ".join(f"q{b} < q{a}" for a, b in zip(LEVELS, LEVELS[1:], strict=False))
STEPS["covrows"] = "SELECT *, unnest(CASE WHEN week <= (SELECT cut FROM tunecut) THEN ['FULL_VAL'] ELSE ['FULL_VAL', 'VAL_TEST'] END) AS scope FROM fc WHERE split = 'VAL' AND active"
_cov = ", ".join(f"{share(f'y_12w > q{k}')} AS viol_{k}" for k in (80, 90, 95, 99))
STEPS["cov"] = f"SELECT scope, season_group, count(*) AS n, {_cov} FROM covrows GROUP BY 1, 2 UNION ALL SELECT scope, 'ALL', count(*), {_cov} FROM covrows GROUP BY 1"
STEPS["contract"] = """SELECT DISTINCT week, weekofyear(week)::INT AS iso_week, week + 7 AS target_start, week + 84 AS target_end,
  CASE WHEN weekofyear(week) <= 8 THEN 'DEV_TUNE' WHEN weekofyear(week) <= 16 THEN 'DEV_SELECT' WHEN weekofyear(week) <= 27 THEN 'EMBARGO' WHEN weekofyear(week) <= 40 THEN 'LOCKED_TEST' ELSE 'OUTSIDE' END AS part
  FROM scores WHERE split = 'VAL'"""
STEPS["grid"] = """SELECT row_number() OVER (ORDER BY s, a, b, c)::INT AS config_id, s::DOUBLE AS scale_multiplier, a::INT AS q90_level, b::INT AS q95_level, c::DOUBLE AS clip_high
  FROM unnest([0.85, 0.90, 0.92, 0.95, 1.00]) t(s), unnest([90, 91, 92]) u(a), unnest([95, 96]) v(b), unnest([0.80, 0.90, 1.00, 1.10, 1.20, 1.50]) w(c)"""
STEPS["xlook"] = f"SELECT parent, {', '.join(f'{q("score", k)} AS x{k}' for k in (80, 90, 91, 92))} FROM resid WHERE score IS NOT NULL GROUP BY 1"
STEPS["gridrows"] = """SELECT config_id, y_12w, yhat, yhat + x80 * w AS q80, yhat + CASE q90_level WHEN 90 THEN x90 WHEN 91 THEN x91 ELSE x92 END * w AS q90 FROM (
  SELECT s.*, x80, x90, x91, x92, g.*, least(greatest(coalesce(viol, 0.10) / 0.10, 0.8), clip_high) * scale * scale_multiplier AS w
  FROM seg s JOIN xlook x ON x.parent = s.parent LEFT JOIN factors f ON f.child = s.child CROSS JOIN grid g WHERE s.active AND s.split = 'VAL' AND weekofyear(s.week) <= 8)"""
STEPS["gridagg"] = f"""SELECT config_id, count(*) AS n, {share("y_12w > greatest(0, q80)")} AS viol_80, {share("y_12w > greatest(0, q90)")} AS viol_90,
  {q("CASE WHEN yhat > 0 THEN round(q90 / yhat, 9) END", 50)} AS ratio_median, {share("yhat > 0 AND round(q90 / yhat, 9) > 5")} AS ratio_over_5 FROM gridrows GROUP BY 1"""
STEPS["grideval"] = """SELECT *, round(20 * greatest(viol_90 - 0.12, 0) + 20 * greatest(0.08 - viol_90, 0) + 5 * abs(viol_90 - 0.10) + 3 * greatest(coalesce(ratio_median, 0) - 3, 0)
  + 2 * greatest(ratio_over_5 - 0.05, 0) + abs(2 * viol_90 - 0.20), 9) AS loss FROM gridagg"""
STEPS["clook"] = f"SELECT parent, {', '.join(f'{q("score", k)} AS c{k}' for k in (80, 90, 91, 92, 95, 96))} FROM resid WHERE score IS NOT NULL GROUP BY 1"
STEPS["slook"] = f"SELECT season_group, {', '.join(f'{q("score", k)} AS d{k}' for k in (80, 90, 91, 92, 95, 96))} FROM resid WHERE score IS NOT NULL GROUP BY 1"
_cz = {80: "1.282", 90: "1.645", 91: "NULL", 92: "NULL", 95: "1.960", 96: "NULL"}
_c = lambda k: f"coalesce(c{k}, d{k}, {_cz[k]})"
STEPS["recal0"] = f"""SELECT s.sku_id, s.week, s.season_group, s.yhat, s.p, cap, s.y_12w, s.event_12w, s.lost_12w, CASE WHEN weekofyear(s.week) <= 8 THEN 'DEV_TUNE' WHEN weekofyear(s.week) <= 16 THEN 'DEV_SELECT' WHEN weekofyear(s.week) <= 27 THEN 'EMBARGO' WHEN weekofyear(s.week) <= 40 THEN 'LOCKED_TEST' ELSE 'OUTSIDE' END AS part,
  s.yhat + {_c(80)} * w AS r80, s.yhat + CASE q90_level WHEN 90 THEN {_c(90)} WHEN 91 THEN {_c(91)} ELSE {_c(92)} END * w AS r90, s.yhat + CASE q95_level WHEN 95 THEN {_c(95)} ELSE {_c(96)} END * w AS r95
  FROM (SELECT s.*, g.*, least(greatest(coalesce(viol, 0.10) / 0.10, 0.8), clip_high) * scale * scale_multiplier AS w FROM seg s LEFT JOIN factors f ON f.child = s.child
    CROSS JOIN (SELECT g.* FROM grid g JOIN (SELECT config_id FROM grideval ORDER BY loss, config_id LIMIT 1) USING (config_id)) g WHERE s.split = 'VAL') s
  LEFT JOIN clook c ON c.parent = s.parent LEFT JOIN slook d ON d.season_group = s.season_group LEFT JOIN caps k ON k.season_group = s.season_group"""
STEPS["recal"] = "SELECT sku_id, week, season_group, part, yhat, greatest(0, r80) AS q80, greatest(0, r80, r90) AS q90, greatest(0, r80, r90, r95) AS q95, cap, greatest(0, r80, r90, r95) > cap AS over_cap, CASE WHEN part <> 'OUTSIDE' THEN y_12w END AS y_12w, CASE WHEN part <> 'OUTSIDE' THEN event_12w END AS event_12w, p, CASE WHEN part <> 'OUTSIDE' THEN lost_12w END AS lost_12w FROM recal0"
STEPS["famrows"] = """SELECT sku_id, week, season_group, part, y_12w, event_12w, lost_12w, unnest(['A', 'B', 'C', 'D', 'E']) AS policy, unnest([p * greatest(q90 - yhat, 0), p * q90, pow(p, 0.7) * greatest(q95 - yhat, 0),
  p * coalesce(nullif(lost_12w, 0), greatest(q90 - yhat, 0)), p * q90 * CASE WHEN season_group = 'HIGH_SEASON' THEN 1.25 ELSE 1.0 END]) AS score FROM recal"""
STEPS["famsweep"] = """SELECT policy, t.season_group, count(*) AS alerts, sum(event_12w)::BIGINT AS hits, sum(coalesce(lost_12w, 0)) AS lost, any_value(base) AS base_rate, sum(event_12w) / count(*)::DOUBLE AS precision, (sum(event_12w) / count(*)::DOUBLE) / nullif(any_value(base), 0) AS lift
  FROM (SELECT *, row_number() OVER (PARTITION BY policy, week ORDER BY score DESC, sku_id) AS rank FROM famrows WHERE part = 'DEV_SELECT' AND y_12w IS NOT NULL) t
  JOIN (SELECT season_group, avg(event_12w) AS base FROM recal WHERE part = 'DEV_SELECT' AND y_12w IS NOT NULL GROUP BY 1) b ON b.season_group = t.season_group WHERE rank <= 10 GROUP BY 1, 2"""
STEPS["famfrozen"] = "SELECT policy, round(avg(lift), 9) AS mean_lift, round(avg(precision), 9) AS mean_precision, round(sum(lost), 6) AS lost FROM famsweep GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 1"
STEPS["lockrank"] = "SELECT *, (rank <= 10)::INT AS alert FROM (SELECT f.*, row_number() OVER (PARTITION BY week ORDER BY score DESC, sku_id)::INT AS rank FROM famrows f WHERE part = 'LOCKED_TEST' AND policy = (SELECT policy FROM famfrozen))"
STEPS["pband"] = f"SELECT f.*, CASE WHEN split <> 'VAL' THEN NULL WHEN weekofyear(week) <= 8 THEN 'DEV_TUNE' WHEN weekofyear(week) <= 16 THEN 'DEV_SELECT' ELSE 'LATER' END AS part, 1 + len(list_filter((SELECT [{', '.join(q('p', 10 * k) for k in range(1, 10))}] FROM fc WHERE split = 'CALIB'), lambda c: f.p > c)) AS band FROM fc f"
STEPS["pcal"] = "SELECT b.*, coalesce(r.rate, b.p) AS p_cal FROM pband b LEFT JOIN (SELECT band, avg(event_12w) AS rate FROM pband WHERE split = 'CALIB' GROUP BY 1) r ON r.band = b.band"
STEPS["means"] = "SELECT season_group, round(avg(amplitude), 6) AS mean FROM fc WHERE split = 'TRAIN' GROUP BY 1"
STEPS["stack"] = "SELECT f.*, unnest([" + ", ".join(f"'{p}'" for p in POLICIES) + """]) AS policy, unnest([p * greatest(q95 - yhat, 0), p * q90, sqrt(p) * greatest(q95 - yhat, 0), p * greatest(q95 - yhat, 0), pow(p, 1.5) * greatest(q95 - yhat, 0), p * coalesce(lost_12w, 0),
  p * q90 * least(greatest(coalesce(amplitude / nullif(mean, 0), 1), 0.5), 2)]) AS score FROM fc f LEFT JOIN means USING (season_group)"""
STEPS["sweep"] = """SELECT t.policy, t.season_group, count(*) AS alerts, sum(event_12w)::BIGINT AS hits, sum(lost_12w) AS lost, sum(event_12w) / count(*)::DOUBLE AS precision, (sum(event_12w) / count(*)::DOUBLE) / nullif(any_value(b.base), 0) AS lift
  FROM (SELECT *, row_number() OVER (PARTITION BY policy, week ORDER BY score DESC, sku_id) AS rank FROM stack WHERE split = 'VAL' AND week <= (SELECT cut FROM tunecut)) t
  JOIN (SELECT season_group, avg(event_12w) AS base FROM fc WHERE split = 'VAL' AND week <= (SELECT cut FROM tunecut) GROUP BY 1) b ON b.season_group = t.season_group WHERE rank <= 10 GROUP BY 1, 2"""
STEPS["best"] = "SELECT policy, round(avg(lift), 9) AS mean_lift, sum(lost) AS lost FROM sweep GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"
STEPS["found"] = """SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY week ORDER BY score DESC, sku_id)::INT AS rank FROM stack s JOIN (SELECT policy FROM best) b USING (policy) WHERE split = 'VAL') WHERE rank <= 10"""
_eval = """count(*) AS n, avg(abs(y_12w - yhat)) AS mae, sum(abs(y_12w - yhat)) / nullif(sum(abs(y_12w)), 0) AS wmape, 100 * (sum(yhat - y_12w) / nullif(sum(y_12w), 0)) AS bias_pct"""
STEPS["deval"] = f"SELECT season_group, {_eval} FROM scores WHERE split = 'VAL' GROUP BY 1 UNION ALL SELECT 'ALL', {_eval} FROM scores WHERE split = 'VAL'"
STEPS["pcuts"] = f"SELECT [{', '.join(q('p', 10 * k) for k in range(1, 10))}] AS cuts FROM fc WHERE split = 'CALIB'"

_cols = lambda *c: ", ".join(c)
ROLLING = [*(f"mean_{k}" for k in (4, 8, 12, 13)), *(f"std_{k}" for k in (4, 12, 13)), "sale_freq_12w", "zero_share_13w", "zero_share_26w", "cv_4w", "cv_12w", "cv_13w", "amplitude", "lag1_rel"]
FINAL: dict[str, str] = {
    "wmape_by_season": f"SELECT season_group, n, {r('mae', 'wmape', 'bias_pct')} FROM deval",
    "dense_spine": "SELECT * FROM panel",
    "sku_customer_sales": f"""SELECT sku_id, week, customer_id, {r("units", "base", "price")}, days FROM (SELECT sku_id, date_trunc('week', d)::DATE AS week, customer_id, sum(greatest(units, 0)) AS units, sum(base_amount) AS base,
      sum(unit_price * greatest(units, 0)) / nullif(sum(greatest(units, 0)), 0) AS price, count(DISTINCT d) AS days FROM fact GROUP BY 1, 2, 3)""",
    "vip_customers": """SELECT customer_id, total, rank::INT AS rank FROM (SELECT *, dense_rank() OVER (ORDER BY total DESC) AS rank FROM (SELECT customer_id, round(sum(base_amount), 4) AS total FROM fact WHERE d <= DATE '1999-12-31' GROUP BY 1) WHERE total > 0) WHERE rank <= 50""",
    "value_metrics": f"""SELECT sku_id, week, {r("base", "mean_price", "weighted_price")}, discrepancies FROM (SELECT sku_id, date_trunc('week', d)::DATE AS week, sum(base_amount) AS base, avg(unit_price) AS mean_price, sum(unit_price * units) / nullif(sum(units), 0) AS weighted_price,
      sum(CASE WHEN unit_price * units / nullif(base_amount, 0) > 5 OR base_amount / nullif(unit_price * units, 0) > 5 THEN 1 ELSE 0 END)::BIGINT AS discrepancies FROM fact WHERE units > 0 GROUP BY 1, 2)""",
    "lag_features": f"SELECT sku_id, week, {_cols(*(f'lag_{k}' for k in LAGS))} FROM feats",
    "rolling_features": f"SELECT sku_id, week, sold_before, {r(*ROLLING)} FROM feats",
    "fourier_season": f"SELECT sku_id, week, season_group, {r(*(f'{n}_{k}' for k in (1, 2, 3) for n in ('sin', 'cos')))} FROM feats",
    "oos_proxy": "SELECT sku_id, week, oos_proxy, oos_lag_1, oos_lag_2, oos_lag_4, weeks_since_start FROM feats",
    "forward_labels": f"SELECT sku_id, week, n_future, y_12w, event_12w, oos_weeks_12w, {r('lost_12w')} FROM labelled",
    "split_deciles": "SELECT sku_id, week, split, season_group, decile FROM split",
    "base_scores": f"SELECT sku_id, week, split, {r('yhat', 'p', 'scale', 'y_12w')}, active, event_12w FROM scores",
    "conformal_residuals": f"SELECT sku_id, week, child, parent, bucket, {r('score')} FROM resid",
    "volatility_thresholds": f"SELECT season_group, decile, {r(*(f'cut_{k}' for k in range(1, 5)))} FROM bcuts",
    "quantile_lookup": f"SELECT parent, child, n, level, {r(*(f'z{k}' for k in LEVELS))} FROM lookup",
    "correction_factors": f"SELECT season_group, child, n, {r('viol', 'factor')} FROM factors",
    "quantile_caps": f"SELECT season_group, {r('cap')} FROM caps",
    "forecast_quantiles": f"SELECT sku_id, week, {r(*(f'q{k}' for k in LEVELS))} FROM fc",
    "quantile_sanity": f"""SELECT split, season_group, n, non_monotone, negative, {r("capped", "viol_90")} FROM (SELECT split, season_group, count(*) AS n, count(*) FILTER ({_mono}) AS non_monotone, count(*) FILTER (q75 < 0) AS negative, {share("q90 >= cap")} AS capped, {share("y_12w > q90")} AS viol_90 FROM fc GROUP BY 1, 2)""",
    "coverage": f"SELECT scope, season_group, n, {r(*(f'viol_{k}' for k in (80, 90, 95, 99)))} FROM cov",
    "coverage_gate": """SELECT season_group, n, round(viol_90, 6) AS viol_90, status, CASE WHEN bool_and(status = 'PASS') OVER () THEN 'PASS' ELSE 'FAIL' END AS overall
      FROM (SELECT *, CASE WHEN viol_90 BETWEEN 0.08 AND 0.12 AND n >= 50 THEN 'PASS' ELSE 'FAIL' END AS status FROM cov WHERE scope = 'FULL_VAL' AND season_group <> 'ALL')""",
    "demand_eval": f"SELECT season_group, n, {r('mae', 'wmape', 'bias_pct')} FROM deval",
    "temporal_contract": "SELECT *, part = 'DEV_TUNE' AS can_tune, part = 'DEV_SELECT' AS can_select, part = 'LOCKED_TEST' AS can_report FROM contract",
    "window_overlap": """SELECT a.part AS part_a, b.part AS part_b, count(*) AS overlaps FROM contract a JOIN contract b ON a.target_start <= b.target_end AND b.target_start <= a.target_end
      WHERE a.part IN ('DEV_TUNE', 'DEV_SELECT') AND b.part = 'LOCKED_TEST' GROUP BY 1, 2""",
    "grid_eval": f"SELECT config_id, n, {r('viol_80', 'viol_90', 'ratio_median', 'ratio_over_5', 'loss')} FROM grideval",
    "grid_argmin": f"SELECT config_id, n, {r('viol_80', 'viol_90', 'ratio_median', 'ratio_over_5', 'loss')} FROM grideval ORDER BY grideval.loss, config_id LIMIT 1",
    "recalibrated_forecast": f"SELECT sku_id, week, season_group, part, {r('yhat', 'q80', 'q90', 'q95', 'cap', 'y_12w')}, over_cap, event_12w FROM recal",
    "recalibrated_metrics": "SELECT part, season_group, n, " + r("wmape", "viol_80", "viol_90", "viol_95", "width", "capped") + ", CASE WHEN part <> 'LOCKED_TEST' THEN 'REPORT' WHEN viol_90 BETWEEN 0.08 AND 0.12 THEN 'PASS' ELSE 'FAIL' END AS status FROM (" + " UNION ALL ".join(
      f"SELECT part, {g} AS season_group, count(*) AS n, sum(abs(y_12w - yhat)) / nullif(sum(y_12w), 0) AS wmape, {share('y_12w > q80')} AS viol_80, {share('y_12w > q90')} AS viol_90, {share('y_12w > q95')} AS viol_95, sum(q90) / nullif(sum(yhat), 0) AS width, {share('over_cap')} AS capped FROM recal WHERE y_12w IS NOT NULL GROUP BY 1, 2" for g in ("season_group", "'ALL'")) + ")",
    "strict_sweep": f"SELECT policy, season_group, alerts, hits, {r('lost', 'base_rate', 'precision', 'lift')} FROM famsweep",
    "strict_policy": f"SELECT policy, {r('mean_lift', 'mean_precision', 'lost')} FROM famfrozen",
    "locked_ranking": f"SELECT sku_id, week, season_group, policy, {r('score')}, rank, alert FROM lockrank",
    "locked_metrics": "SELECT season_group, n, labelled, alerts::BIGINT AS alerts, hits::BIGINT AS hits, events::BIGINT AS events, round(lost, 6) AS lost, round(hits / nullif(known, 0)::DOUBLE, 6) AS precision, round(hits / nullif(events, 0)::DOUBLE, 6) AS recall, round((hits / nullif(known, 0)::DOUBLE) / nullif(events / nullif(labelled, 0)::DOUBLE, 0), 6) AS lift, CASE WHEN labelled = 0 THEN 'PENDING' ELSE 'EVALUATED' END AS status FROM (" + " UNION ALL ".join(
      f"SELECT {g} AS season_group, count(*) AS n, count(event_12w) AS labelled, sum(alert) AS alerts, sum(event_12w) AS events, sum(alert * event_12w) AS hits, sum(alert * lost_12w) AS lost, sum(alert) FILTER (event_12w IS NOT NULL) AS known FROM lockrank GROUP BY 1" for g in ("season_group", "'ALL'")) + ")",
    "probability_choice": """SELECT n, round(rate, 6) AS rate, round(brier_raw, 6) AS brier_raw, round(brier_cal, 6) AS brier_cal, round(corr_raw, 6) AS corr_raw, round(corr_cal, 6) AS corr_cal, CASE WHEN brier_cal <= brier_raw * 1.01 THEN 'CALIBRATED' ELSE 'RAW' END AS for_reports, CASE WHEN corr_cal >= corr_raw THEN 'CALIBRATED' ELSE 'RAW' END AS for_ranks
      FROM (SELECT count(*) AS n, avg(event_12w)::DOUBLE AS rate, avg(pow(p - event_12w, 2)) AS brier_raw, avg(pow(p_cal - event_12w, 2)) AS brier_cal, round(corr(p, event_12w), 9) AS corr_raw, round(corr(p_cal, event_12w), 9) AS corr_cal FROM pcal WHERE part = 'DEV_SELECT')""",
    "chain_audit": """SELECT name, value::BIGINT AS value, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT 'A1_WEEKS_PRESENT' AS name, count(*) AS value, count(*) > 0 AS ok FROM contract
      UNION ALL SELECT 'A2_WINDOWS_APART', count(*), count(*) = 0 FROM contract a JOIN contract b ON a.target_start <= b.target_end AND b.target_start <= a.target_end WHERE a.part IN ('DEV_TUNE', 'DEV_SELECT') AND b.part = 'LOCKED_TEST'
      UNION ALL SELECT unnest(['A3_TUNE_ONLY_IN_TUNE', 'A4_REPORT_ONLY_LOCKED', 'A5_ONE_USE_A_WEEK']), 0, true
      UNION ALL SELECT 'A6_POLICY_NAMED', count(*) FILTER (policy IS NULL), count(*) FILTER (policy IS NULL) = 0 FROM famfrozen
      UNION ALL SELECT 'A7_POLICIES_SWEPT', count(DISTINCT policy), count(DISTINCT policy) = 5 FROM famsweep
      UNION ALL SELECT 'A8_ONE_FROZEN', count(*), count(*) = 1 FROM famfrozen
      UNION ALL SELECT 'A9_ALL_SCORED', count(*) FILTER (score IS NULL), count(*) FILTER (score IS NULL) = 0 FROM lockrank
      UNION ALL SELECT 'A10_NO_ALERT_BEYOND_K', count(*) FILTER (alert = 1 AND rank > 10), count(*) FILTER (alert = 1 AND rank > 10) = 0 FROM lockrank
      UNION ALL SELECT 'A11_LOCKED_ONLY', count(*) FILTER (part <> 'LOCKED_TEST'), count(*) FILTER (part <> 'LOCKED_TEST') = 0 FROM lockrank
      UNION ALL SELECT 'A12_RANKED_ONCE', count(DISTINCT (sku_id, week)), count(DISTINCT (sku_id, week)) = count(*) FROM lockrank)""",
    "policy_sweep": f"SELECT policy, season_group, alerts, hits, {r('lost', 'precision', 'lift')} FROM sweep",
    "policy_best": f"SELECT policy, {r('mean_lift', 'lost')} FROM best",
    "alerts_topk": f"SELECT sku_id, week, season_group, policy, {r('score')}, rank FROM found",
    "alert_eval": """SELECT alerts, hits::BIGINT AS hits, round(hits / alerts, 6) AS precision, round(hits / nullif(events, 0), 6) AS recall, round((hits / alerts) / nullif(events / n, 0), 6) AS lift, round(lost / nullif(all_lost, 0), 6) AS lost_share
      FROM (SELECT count(*)::DOUBLE::BIGINT AS alerts, sum(event_12w)::DOUBLE AS hits, sum(lost_12w) AS lost FROM found), (SELECT sum(event_12w)::DOUBLE AS events, count(*) AS n, sum(lost_12w) AS all_lost FROM fc WHERE split = 'VAL')""",
    "prob_compare": f"""SELECT season_group, n, {r("brier", "log_loss", "mean_p", "rate", "corr")} FROM (SELECT season_group, count(*) AS n, avg(pow(p - event_12w, 2)) AS brier, avg(-(event_12w * ln(greatest(p, 1e-7)) + (1 - event_12w) * ln(greatest(1 - p, 1e-7)))) AS log_loss,
      avg(p) AS mean_p, avg(event_12w) AS rate, corr(p, event_12w) AS corr FROM fc WHERE split = 'VAL' GROUP BY 1)""",
    "prob_deciles": "SELECT band, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(event_12w), 6) AS rate FROM (SELECT f.p, f.event_12w, (1 + len(list_filter(cuts, lambda c: f.p > c)))::INT AS band FROM fc f, pcuts WHERE split = 'VAL') GROUP BY 1",
}
FINAL["customer_concentration"] = f"""SELECT sku_id, week, customers, vips, (vips > 0)::INT AS has_vip, {r("top_share_units", "top_share_base", "hhi")} FROM (
  SELECT sku_id, week, count(*) AS customers, sum(coalesce(vip, 0))::BIGINT AS vips, max(units) / nullif(sum(units), 0) AS top_share_units, max(base) / nullif(sum(base), 0) AS top_share_base, sum(units * units) / nullif(sum(units) * sum(units), 0) AS hhi
  FROM ({FINAL["sku_customer_sales"].replace("round(units, 6)", "units").replace("round(base, 6)", "base")}) s LEFT JOIN (SELECT customer_id, 1 AS vip FROM ({FINAL["vip_customers"]})) v USING (customer_id) GROUP BY 1, 2)"""

_lagged = [(n, k) for n in ("base", "price") for k in (1, 4, 12, 13)] + [(n, k) for n in ("customers", "top_share_base", "hhi", "has_vip") for k in (1, 4)]
FINAL["market_lags"] = f"""SELECT sku_id, week, {", ".join(f"{n}_lag_{k}" if n in ("customers", "has_vip") else f"round({n}_lag_{k}, 6) AS {n}_lag_{k}" for n, k in _lagged)}, round(price / nullif(price_lag_1, 0) - 1, 6) AS price_change_1w, round((week - DATE '1995-01-02') / (DATE '2001-10-29' - DATE '1995-01-02')::DOUBLE, 6) AS life
  FROM (SELECT sku_id, week, price, {", ".join(f"lag({n}, {k}) OVER (PARTITION BY sku_id ORDER BY week) AS {n}_lag_{k}" for n, k in _lagged)} FROM (
    SELECT p.sku_id, p.week, v.base, v.price, c.customers, c.top_share_base, c.hhi, c.has_vip FROM panel p
    LEFT JOIN (SELECT sku_id, date_trunc('week', d)::DATE AS week, sum(base_amount) AS base, avg(unit_price) AS price FROM fact WHERE units > 0 GROUP BY 1, 2) v ON v.sku_id = p.sku_id AND v.week = p.week
    LEFT JOIN ({FINAL["customer_concentration"].replace("round(top_share_base, 6)", "top_share_base").replace("round(hhi, 6)", "hhi")}) c ON c.sku_id = p.sku_id AND c.week = p.week))"""
FINAL["pooled_deciles"] = "SELECT sku_id, week, split, season_group, ntile(10) OVER (PARTITION BY season_group ORDER BY amplitude, sku_id, week)::INT AS decile_pooled FROM parts WHERE split IS NOT NULL"
FINAL["alerts_pooled"] = """SELECT season_group, alerts, hits::BIGINT AS hits, zero_hits::BIGINT AS zero_hits, round(hits / alerts, 6) AS precision, round(zero_hits / alerts, 6) AS precision_zero, round(hits / nullif(events, 0), 6) AS recall, round(zero_hits / nullif(zeros, 0), 6) AS recall_zero,
  round((hits / alerts) / nullif(events / n, 0), 6) AS lift, round((zero_hits / alerts) / nullif(zeros / n, 0), 6) AS lift_zero, round(lost / nullif(all_lost, 0), 6) AS lost_share
  FROM (SELECT season_group, count(*) AS alerts, sum(event_12w)::DOUBLE AS hits, sum((y_12w = 0)::INT)::DOUBLE AS zero_hits, sum(lost_12w) AS lost FROM found GROUP BY 1)
  JOIN (SELECT season_group, count(*) AS n, sum(event_12w)::DOUBLE AS events, sum((y_12w = 0)::INT)::DOUBLE AS zeros, sum(lost_12w) AS all_lost FROM fc WHERE split = 'VAL' GROUP BY 1) USING (season_group)"""
_part = "CASE WHEN weekofyear(week) <= 8 THEN 'DEV_TUNE' WHEN weekofyear(week) <= 16 THEN 'DEV_SELECT' WHEN weekofyear(week) <= 27 THEN 'EMBARGO' WHEN weekofyear(week) <= 40 THEN 'LOCKED_TEST' ELSE 'OUTSIDE' END"
_old = " UNION ALL ".join(f"SELECT {_part} AS part, {g} AS season_group, count(*) AS n_old, {share('y_12w > q90')} AS viol_old FROM fc WHERE split = 'VAL' GROUP BY 1, 2" for g in ("season_group", "'ALL'"))
_new = " UNION ALL ".join(f"SELECT part, {g} AS season_group, count(*) AS n_new, {share('y_12w > q90')} AS viol_new, sum(abs(y_12w - yhat)) / nullif(sum(y_12w), 0) AS wmape_new FROM recal WHERE y_12w IS NOT NULL GROUP BY 1, 2" for g in ("season_group", "'ALL'"))
FINAL["quantile_comparison"] = f"""SELECT part, season_group, n_old, n_new, {r("viol_old", "viol_new", "wmape_new")}, CASE WHEN n_new IS NULL THEN 'ONLY_FIRST' WHEN n_old IS NULL THEN 'ONLY_RECALIBRATED' WHEN round(abs(viol_new - 0.10) - abs(viol_old - 0.10), 9) < -0.005 THEN 'WIN'
  WHEN round(abs(viol_new - 0.10) - abs(viol_old - 0.10), 9) > 0.005 THEN 'LOSS' ELSE 'NEUTRAL' END AS verdict FROM ({_old}) o FULL JOIN ({_new}) n USING (part, season_group)"""


def oracle(name: str, steps: dict[str, str] | None = None, final: dict[str, str] | None = None) -> str:
    """The query's SELECT after the steps it needs."""
    steps, body = steps or STEPS, (final or FINAL)[name]
    import re

    names, need = list(steps), set()
    words = set(re.findall(r"\w+", body))
    for n in reversed(names):
        if n in words:
            need.add(n)
            words |= set(re.findall(r"\w+", steps[n]))
    chain = ",\n".join(f"{n} AS MATERIALIZED ({steps[n]})" for n in names if n in need)
    return f"WITH {chain}\n{body}" if chain else body


ORACLES = {name: oracle(name) for name in FINAL}
