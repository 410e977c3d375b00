"""The queries of quantile regression and replenishment in DuckDB SQL, as far as SQL expresses them."""

from __future__ import annotations

from .retail_sql import oracle, q, r, share
from .states_sql import COARSE, FINE, div
from .states_sql import FINAL as BASE_FINAL

COARSE, FINE = dict(COARSE), dict(FINE)
FINAL: dict[str, str] = {}

FINE["qrf"] = f"""SELECT sku_id, week, part, y_12w, yhat, gated, q80, q90, q95, q80 - yhat AS spread_80, q90 - yhat AS spread_90, q95 - yhat AS spread_95, p, scale, ln(yhat + 1) AS log_yhat, ln(greatest(gated, yhat) + 1) AS log_gated,
  coalesce(mean_same, 0) AS mean_same, coalesce(p90_same, 0) AS p90_same, coalesce(pos_same, 0) AS pos_same, coalesce(index, 1) AS index, coalesce(mean_year, 0) AS mean_year, coalesce(pos_year, 0) AS pos_year, coalesce(slope, 0) AS slope,
  12 * coalesce(mean_same, 0) AS mean_12w, 12 * coalesce(p90_same, 0) AS p90_12w, coalesce(n_obs, 0) AS n_obs, greatest(1 - coalesce(pos_same, 0), 1 - coalesce(pos_year, 0), p) AS zero_signal,
  {div("coalesce(p90_same, 0) - coalesce(mean_same, 0)", "coalesce(mean_same, 0) + 0.01")} AS cv_signal, yhat - gated AS gate_cut, {div("yhat - gated", "yhat + 0.01")} AS gate_cut_pct, lowered,
  (coalesce(state, 'UNKNOWN') IN ('TRANSITION_UP', 'TRANSITION_DOWN'))::INT AS is_transition, (coalesce(state, 'UNKNOWN') IN ('OFF_SEASON', 'REST_OFFPEAK'))::INT AS is_off_peak, season_group, coalesce(state, 'UNKNOWN') AS state,
  CASE WHEN round(coalesce(index, 1), 9) >= 1.5 THEN 'STRONG_SEASON' WHEN round(coalesce(index, 1), 9) >= 0.75 THEN 'MODERATE_SEASON' WHEN round(coalesce(index, 1), 9) >= 0.25 THEN 'WEAK_SEASON' ELSE 'OFF_SEASON' END AS strength,
  CASE WHEN coalesce(n_obs, 0) >= 10 THEN 'HIGH' WHEN coalesce(n_obs, 0) >= 5 THEN 'MEDIUM' WHEN coalesce(n_obs, 0) >= 2 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence,
  CASE WHEN lowered = 1 THEN state || CASE WHEN p90_same > 0 THEN '_P90' ELSE '_MEAN' END ELSE 'NONE' END AS gate_reason FROM stated WHERE part IN ('DEV_TUNE', 'DEV_SELECT', 'LOCKED_TEST')"""
_numbers = ("y_12w", "yhat", "gated", "q80", "q90", "q95", "spread_80", "spread_90", "spread_95", "p", "scale", "log_yhat", "log_gated", "mean_same", "p90_same", "pos_same", "index", "mean_year", "pos_year", "slope", "mean_12w", "p90_12w", "zero_signal", "cv_signal", "gate_cut", "gate_cut_pct")
FINAL["qr_features"] = f"SELECT sku_id, week, part, {r(*_numbers)}, n_obs, lowered, is_transition, is_off_peak, season_group, state, strength, confidence, gate_reason FROM qrf"

COARSE["dclass"] = f"""SELECT sku_id, CASE WHEN sales = 0 THEN 'NO_SALES' WHEN adi < 1.32 AND coalesce(cv2, 0) < 0.49 THEN 'SMOOTH' WHEN adi < 1.32 THEN 'ERRATIC' WHEN coalesce(cv2, 0) < 0.49 THEN 'INTERMITTENT' ELSE 'LUMPY' END AS class
  FROM (SELECT *, {div("weeks", "sales")} AS adi, round(pow({div("std", "mean")}, 2), 9) AS cv2 FROM sold)"""
COARSE["trained"] = "SELECT sku_id, sum(y) AS u FROM panel WHERE week <= DATE '1998-12-31' GROUP BY 1"
COARSE["abc"] = f"SELECT sku_id, CASE WHEN u >= (SELECT {q('u', 80)} FROM trained) THEN 'A' WHEN u >= (SELECT {q('u', 50)} FROM trained) THEN 'B' ELSE 'C' END AS abc FROM trained"
COARSE["places"] = "SELECT province, place, CASE WHEN place <= 3 THEN 1 WHEN place <= 8 THEN 2 WHEN place <= 12 THEN 3 ELSE 4 END AS tier FROM (SELECT province, row_number() OVER (ORDER BY round(sum(units), 6) DESC, province) AS place FROM geo WHERE week <= DATE '1998-12-31' GROUP BY 1)"
COARSE["plan0"] = """SELECT a.sku_id, a.province, a.week, coalesce(abc, 'C') AS abc, coalesce(class, 'NO_SALES') AS demand, coalesce(tier, 4)::INT AS tier, round(share * n.yhat / 12, 6) AS pred, round(greatest(share * (n.yhat + 1.3351777 * scale) / 12, 0), 6) AS stock,
  round(1 - p, 6) AS prob, coalesce(g.units, 0) AS real, weekofyear(a.week) AS wn FROM alloc a JOIN nat n ON n.sku_id = a.sku_id AND n.week = a.week LEFT JOIN geo g ON g.sku_id = a.sku_id AND g.province = a.province AND g.week = a.week
  LEFT JOIN abc ON abc.sku_id = a.sku_id LEFT JOIN dclass c ON c.sku_id = a.sku_id LEFT JOIN places s ON s.province = a.province"""
COARSE["plan1"] = """SELECT *, CASE WHEN wn <= 4 THEN 'M01' WHEN wn <= 8 THEN 'M02' WHEN wn <= 13 THEN 'M03' WHEN wn <= 17 THEN 'M04' WHEN wn <= 22 THEN 'M05' ELSE 'M06' END AS month, CASE WHEN wn <= 9 THEN 'B1' WHEN wn <= 18 THEN 'B2' ELSE 'B3' END AS block3,
  round(pred * prob * CASE abc WHEN 'A' THEN 2.0 WHEN 'B' THEN 1.3 ELSE 0.6 END::DOUBLE * CASE tier WHEN 1 THEN 1.4 WHEN 2 THEN 1.25 WHEN 3 THEN 1.15 ELSE 1.0 END::DOUBLE * CASE WHEN demand IN ('INTERMITTENT', 'LUMPY') THEN 1.25 ELSE 1.0 END::DOUBLE, 9) AS score FROM plan0"""
COARSE["plan"] = "SELECT * EXCLUDE (wn), round(score + 0.10::DOUBLE * stock + 0.01::DOUBLE * pred, 9) AS release FROM plan1"
FINAL["replenishment_plan"] = f"SELECT sku_id, province, week, month, block3, abc, demand, tier, {r('pred', 'stock', 'prob', 'real', 'score', 'release')} FROM plan"
COARSE["prio"] = """SELECT sku_id, province, week, (f + (able AND place <= (SELECT greatest(round_even(round(sum(stock), 6), 0) - sum(floor(stock)), 0) FROM plan))::INT)::BIGINT AS weekly_priority FROM (
  SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, stock DESC, prob DESC, sku_id, province, week) AS place FROM (SELECT *, floor(stock) AS f, stock >= 0.10 AND stock > floor(stock) AS able FROM plan))"""


def _release(by: str, name: str, least: float) -> str:
    return f"""SELECT sku_id, province, week, CASE WHEN slots > 0 AND place <= slots THEN floor(units / slots) + (place <= units % slots)::INT ELSE 0 END::BIGINT AS {name} FROM (SELECT *, least(n, units) AS slots FROM (
  SELECT *, (CASE WHEN (key OR pred_ >= (SELECT {q("g", 60)} FROM (SELECT round(sum(pred), 6) AS g FROM plan GROUP BY {by})) OR total >= {least}) AND total > 0 THEN ceil(total) ELSE round_even(total, 0) END)::BIGINT AS units FROM (
  SELECT *, round(sum(stock) OVER w, 6) AS total, round(sum(pred) OVER w, 6) AS pred_, count(*) OVER w AS n, bool_or(abc = 'A' OR demand IN ('INTERMITTENT', 'LUMPY') OR tier <= 3) OVER w AS key,
  row_number() OVER (PARTITION BY {by} ORDER BY round(release + 0.001::DOUBLE * stock + 0.0001::DOUBLE * prob, 9) DESC, week) AS place FROM plan WINDOW w AS (PARTITION BY {by}))))"""


COARSE["rel1"] = _release("sku_id, province, month", "monthly_release", 0.50)
COARSE["rel3"] = _release("sku_id, province, block3", "block3_release", 0.50)
COARSE["relh"] = _release("sku_id, province", "horizon_release", 0.35)
COARSE["mmean"] = "SELECT sku_id, province, round(avg(m), 6) AS mm FROM (SELECT sku_id, province, month, sum(stock) AS m FROM plan GROUP BY 1, 2, 3) GROUP BY 1, 2"
COARSE["units"] = """SELECT p.*, round_even(stock, 0)::BIGINT AS weekly_round, weekly_priority, monthly_release, block3_release, horizon_release, CASE WHEN abc = 'A' OR tier <= 3 THEN block3_release WHEN demand IN ('INTERMITTENT', 'LUMPY') AND mm < 1 THEN horizon_release
  WHEN demand IN ('INTERMITTENT', 'LUMPY') THEN monthly_release WHEN abc = 'C' THEN weekly_priority ELSE monthly_release END AS hybrid FROM plan p JOIN prio USING (sku_id, province, week) JOIN rel1 USING (sku_id, province, week) JOIN rel3 USING (sku_id, province, week) JOIN relh USING (sku_id, province, week) JOIN mmean USING (sku_id, province)"""
_six = ("weekly_round", "weekly_priority", "monthly_release", "block3_release", "horizon_release", "hybrid")
FINAL["replenishment_units"] = f"SELECT sku_id, province, week, {', '.join(_six)} FROM units"
COARSE["rlong"] = f"SELECT sku_id, province, week, real AS demand, unnest([{', '.join(chr(39) + s + chr(39) for s in _six)}]) AS strategy, unnest([{', '.join(_six)}])::DOUBLE AS repl FROM units"
COARSE["rrun"] = "SELECT *, sum(repl - demand) OVER w AS s, row_number() OVER w AS t, count(*) OVER (PARTITION BY strategy, sku_id, province) AS weeks FROM rlong WINDOW w AS (PARTITION BY strategy, sku_id, province ORDER BY week)"
COARSE["rend"] = "SELECT *, s - least(0, min(s) OVER (PARTITION BY strategy, sku_id, province ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS ending FROM rrun"
COARSE["rsim"] = "SELECT *, coalesce(lag(ending) OVER (PARTITION BY strategy, sku_id, province ORDER BY week), 0) + repl - ending AS served FROM rend"
COARSE["rfig"] = f"""SELECT strategy, count(*) AS n, sum(demand) AS demand, sum(repl) AS replenished, {div("sum(served)", "sum(demand)")} AS fill, {div("sum(repl)", "sum(demand)")} AS stock_ratio, sum(demand - served) AS short, sum(CASE WHEN t = weeks THEN ending ELSE 0 END) AS last_stock, avg(ending) AS mean_stock,
  sum(CASE WHEN demand = 0 THEN repl ELSE 0 END) AS idle, sum(ending) AS excess FROM rsim GROUP BY 1"""
COARSE["rscore"] = """SELECT *, round(abs(fill - 0.912) + 2 * greatest(stock_ratio - 1.75, 0) + greatest(idle - 100000, 0) / greatest(demand, 1) + 5 * greatest(0.9091 - fill, 0) + 2 * greatest(fill - 0.9180, 0), 6) AS score,
  coalesce(fill BETWEEN 0.9091 AND 0.9180 AND stock_ratio <= 1.80 AND idle <= 120000, false) AS valid FROM rfig"""
FINAL["replenishment_fill"] = f"SELECT strategy, n, {r('demand', 'replenished', 'fill', 'stock_ratio', 'short', 'last_stock', 'mean_stock', 'idle', 'excess', 'score')}, valid, row_number() OVER (ORDER BY valid DESC, score, strategy) = 1 AS chosen FROM rscore"

# calibration by season and state
_levels = (80, 90, 91, 92, 95, 96)
FINE["xchild"] = f"SELECT child, {', '.join(f'{q("score", k)} AS x{k}' for k in _levels)} FROM resid WHERE score IS NOT NULL GROUP BY 1"
FINE["srows0"] = "SELECT s.*, x80, x90, x91, x92, x95, x96 FROM stated s LEFT JOIN xchild x ON x.child = s.child"
FINE["stune"] = "SELECT child, state, season_group, (y_12w > greatest(0, gated + coalesce(x90, 1.645) * scale))::INT AS x FROM srows0 WHERE part = 'DEV_TUNE' AND y_12w IS NOT NULL"
FINE["srows"] = """SELECT s.*, coalesce(f.v, g.v, (SELECT avg(x) FROM stune), 0.10)::DOUBLE AS viol FROM srows0 s LEFT JOIN (SELECT child, state, season_group, avg(x) AS v FROM stune GROUP BY 1, 2, 3) f ON f.child = s.child AND f.state = s.state AND f.season_group = s.season_group
  LEFT JOIN (SELECT state, season_group, avg(x) AS v FROM stune GROUP BY 1, 2) g ON g.state = s.state AND g.season_group = s.season_group"""
FINE["sgrid"] = """SELECT row_number() OVER (ORDER BY s, a, b, c)::INT AS config_id, s::DOUBLE AS scale_multiplier, a::INT AS q90_level, b::INT AS q95_level, c::DOUBLE AS clip_high
  FROM unnest([0.85, 0.90, 0.92, 0.95, 1.00]) t(s), unnest([90, 91, 92]) u(a), unnest([95, 96]) v(b), unnest([0.80, 0.90, 1.00, 1.10, 1.20, 1.50]) w(c)"""
_sq = """greatest(0, gated + coalesce(x80, 1.282) * w) AS g80, greatest(0, gated + CASE q90_level WHEN 90 THEN coalesce(x90, 1.645) WHEN 91 THEN coalesce(x91, x90, 1.645) ELSE coalesce(x92, x90, 1.645) END * w) AS g90,
  greatest(0, gated + CASE q95_level WHEN 95 THEN coalesce(x95, 1.960) ELSE coalesce(x96, x95, 1.960) END * w) AS g95"""
_sw = "least(clip_high, greatest(0.80, viol / 0.10)) * scale * scale_multiplier AS w"
FINE["stried"] = f"SELECT config_id, state, season_group, y_12w, gated, {_sq} FROM (SELECT r.*, g.*, {_sw} FROM srows r, sgrid g WHERE part = 'DEV_TUNE' AND y_12w IS NOT NULL)"
FINE["seval0"] = f"""SELECT config_id, state, season_group, count(*) AS n, {", ".join(f"{share(f'y_12w > g{k}')} AS viol_{k}" for k in (80, 90, 95))}, {q("CASE WHEN gated > 0 THEN round(g90 / gated, 9) END", 50)} AS ratio_median, {share("gated > 0 AND round(g90 / gated, 9) > 5")} AS ratio_over_5 FROM stried GROUP BY 1, 2, 3"""
FINE["seval"] = """SELECT *, round(20 * greatest(viol_90 - 0.12, 0) + 20 * greatest(0.08 - viol_90, 0) + CASE WHEN viol_90 < 0.02 THEN 50 ELSE 0 END + 5 * abs(viol_90 - 0.10) + 3 * greatest(coalesce(ratio_median, 0) - 3, 0) + 2 * ratio_over_5 + abs(viol_80 - 0.20) + CASE WHEN viol_80 < 0.02 THEN 30 ELSE 0 END, 5) AS loss FROM seval0"""
_flags = "'DEV_TUNE' AS evaluated_on_split, false AS used_locked_test"
FINAL["state_grid_eval"] = f"SELECT config_id, state, season_group, n, {r('viol_80', 'viol_90', 'viol_95', 'ratio_median', 'ratio_over_5', 'loss')}, {_flags} FROM seval"
FINE["sown"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state, season_group ORDER BY loss, config_id) AS place FROM seval WHERE n >= 200) WHERE place = 1"
FINE["sfrozen"] = """SELECT state, season_group, 'STATE' AS level, config_id, n, viol_80, viol_90, viol_95, loss FROM sown UNION ALL SELECT * FROM (
  SELECT 'GLOBAL_FALLBACK' AS state, 'ALL', 'GLOBAL_FALLBACK', config_id, sum(n)::BIGINT, avg(viol_80), avg(viol_90), avg(viol_95), round(avg(loss), 9) AS loss FROM seval GROUP BY config_id ORDER BY loss, config_id LIMIT 1) WHERE state NOT IN (SELECT state FROM sown)"""
FINAL["state_frozen"] = f"SELECT state, season_group, level, config_id, n, {r('viol_80', 'viol_90', 'viol_95', 'loss')}, {_flags} FROM sfrozen"
FINE["sapplied0"] = """SELECT r.*, CASE WHEN f.config_id IS NOT NULL THEN 'STATE' WHEN z.config_id IS NOT NULL THEN 'GLOBAL_FALLBACK' END AS level, coalesce(f.config_id, z.config_id) AS chosen FROM srows r
  LEFT JOIN (SELECT * FROM sfrozen WHERE level = 'STATE') f ON f.state = r.state AND f.season_group = r.season_group LEFT JOIN (SELECT * FROM sfrozen WHERE level <> 'STATE') z ON true"""
FINE["sapplied"] = f"SELECT *, greatest(gated, g80) AS p80, greatest(gated, g80, g90) AS p90, greatest(gated, g80, g90, g95) AS p95 FROM (SELECT *, {_sq} FROM (SELECT a.*, g.*, {_sw} FROM sapplied0 a LEFT JOIN sgrid g ON g.config_id = a.chosen))"
FINAL["state_recalibrated"] = "SELECT sku_id, week, part, state, season_group, level, config_id, round(gated, 6) AS p50, round(y_12w, 6) AS y_12w, round(p80, 6) AS q80, round(p90, 6) AS q90, round(p95, 6) AS q95 FROM sapplied"
FINAL["state_recalibrated_metrics"] = f"SELECT part, level, season_group, n, {r('viol_80', 'viol_90', 'viol_95', 'wmape', 'width', 'non_monotone')}, part AS evaluated_on_split FROM (" + " UNION ALL ".join(
    f"SELECT part, {a} AS level, {b} AS season_group, count(*) AS n, {', '.join(f'{share(f"y_12w > p{k}")} AS viol_{k}' for k in (80, 90, 95))}, {div('sum(abs(y_12w - gated))', 'sum(y_12w)')} AS wmape, {div('sum(p90)', 'sum(gated)')} AS width, {share('p90 < p80 OR p95 < p90')} AS non_monotone FROM sapplied WHERE y_12w IS NOT NULL GROUP BY 1, 2, 3" for a, b in (("level", "season_group"), ("'ALL'", "'ALL'"))) + ")"

# deployment
_span = ", ".join(f"{f}(week) FILTER (split = '{s}') AS {s.lower()}_{n}" for s in ("TRAIN", "CALIB", "VAL") for n, f in (("first", "min"), ("last", "max")))
COARSE["scope"] = f"""SELECT *, CASE WHEN incomplete > 0 THEN 'FAIL: incomplete labels' WHEN outside > 0 THEN 'FAIL: validation weeks outside their year' WHEN point_forecasts > 0 THEN 'FAIL: point forecasts' ELSE 'OK' END AS status FROM (
  SELECT {_span}, count(*) FILTER (n_future <> 12) AS incomplete, count(*) FILTER (split = 'VAL' AND week NOT BETWEEN DATE '2000-01-03' AND DATE '2000-12-31') AS outside, count(*) FILTER (n_future = 1) AS point_forecasts FROM scores)"""
FINAL["scope_check"] = "SELECT * FROM scope"
_late = "week > (SELECT cut FROM tunecut)"
COARSE["pall"] = "SELECT b.*, coalesce(r.rate, b.p) AS p_cal FROM pband b LEFT JOIN (SELECT band, avg(event_12w) AS rate FROM pband WHERE split = 'CALIB' GROUP BY 1) r ON r.band = b.band"
COARSE["gfig"] = f"""SELECT count(*) AS n, {share("y_12w > q90")} AS viol_90, {share("y_12w > q95")} AS viol_95, {share("q90 >= cap")} AS cap_rate, {q("round(q90 / nullif(yhat, 0), 9)", 50)} AS ratio_median, count(*) FILTER (q90 < q80 OR q95 < q90) AS non_monotone,
  {div("sum(greatest(q90 - y_12w, 0))", "sum(greatest(y_12w - q90, 0))")} AS over_under, {div("sum(abs(y_12w - yhat))", "sum(abs(y_12w))")} AS wmape, 100 * {div("sum(yhat - y_12w)", "sum(y_12w)")} AS bias_pct FROM recal WHERE y_12w IS NOT NULL AND {_late}"""
COARSE["gall"] = f"""SELECT g.*, (SELECT {div("sum(abs(y_12w - yhat))", "sum(abs(y_12w))")} FROM fc WHERE split = 'VAL' AND y_12w IS NOT NULL AND {_late}) AS wmape_first, alerts, precision, {div("hits", "events")} AS recall, precision / nullif({div("events", "rows_")}, 0) AS lift, brier, brier_raw,
  (SELECT count(*) FROM leaks WHERE status = 'FAIL') AS bad, (SELECT status FROM scope) AS scope_ FROM gfig g, (SELECT count(*) AS alerts, sum(event_12w) AS hits, {div("sum(event_12w)", "count(*)")} AS precision FROM found WHERE {_late}) a,
  (SELECT count(*) AS rows_, sum(event_12w) AS events, avg(pow(p - event_12w, 2)) AS brier_raw, avg(pow(p_cal - event_12w, 2)) AS brier FROM pall WHERE split = 'VAL' AND {_late}) b"""
_g = {"b1_leakage": ("bad = 0", "FAIL"), "b2_scope": ("scope_ = 'OK'", "FAIL"), "b3_coverage": ("viol_90 BETWEEN 0.08 AND 0.12", "FAIL"), "b3b_q95": ("viol_95 BETWEEN 0.03 AND 0.08", "CONDITIONAL"), "b3c_order": ("non_monotone = 0", "FAIL"), "b3d_cap": ("cap_rate <= 0.05", "WARN"), "b3e_ratio": ("ratio_median <= 3.0", "WARN"), "b4_lift": ("lift > 1.5", "FAIL"), "b5_brier": ("brier <= brier_raw", "FAIL"), "b6_wmape": ("wmape <= 1.10 * wmape_first", "FAIL"), "b7_stock": ("over_under <= 3.0", "WARN")}
COARSE["ggates"] = "SELECT *, " + ", ".join(f"CASE WHEN {c} THEN 'PASS' ELSE '{e}' END AS {n}" for n, (c, e) in _g.items()) + " FROM gall"
_hard = ("b1_leakage", "b2_scope", "b3_coverage", "b3c_order", "b4_lift", "b6_wmape")
_list = lambda names: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} = 'FAIL' THEN '{c}' END" for c in names) + "], lambda x: x IS NOT NULL), ',')"
FINAL["deployment_gates"] = f"SELECT n, {r('viol_90', 'viol_95', 'cap_rate', 'ratio_median', 'over_under', 'wmape', 'wmape_first', 'bias_pct', 'precision', 'recall', 'lift', 'brier', 'brier_raw')}, non_monotone, alerts, {', '.join(_g)}, {_list(_hard)} AS failed, CASE WHEN {' AND '.join(f'{c} = {chr(39)}PASS{chr(39)}' for c in _hard[:5])} THEN 'DEPLOY' ELSE 'HOLD' END AS verdict FROM ggates"
COARSE["rktop"] = """SELECT probability, event_12w FROM (SELECT *, row_number() OVER (PARTITION BY probability, week ORDER BY score DESC, sku_id) AS rank FROM (
  SELECT sku_id, week, event_12w, unnest(['RAW', 'CALIBRATED']) AS probability, unnest([round(p * q90, 9), round(p_cal * q90, 9)]) AS score FROM pall WHERE part = 'DEV_SELECT' AND event_12w IS NOT NULL)) WHERE rank <= 10"""
COARSE["rkcmp0"] = f"SELECT probability, count(*) AS alerts, sum(event_12w)::BIGINT AS hits, (SELECT {div('sum(event_12w)', 'count(*)')} FROM pall WHERE part = 'DEV_SELECT' AND event_12w IS NOT NULL) AS base_rate, {div('sum(event_12w)', 'count(*)')} AS precision FROM rktop GROUP BY 1"
COARSE["rkcmp"] = "SELECT *, precision / nullif(base_rate, 0) AS lift, row_number() OVER (ORDER BY round(precision / nullif(base_rate, 0), 9) DESC NULLS LAST, (probability = 'RAW') DESC) = 1 AS chosen FROM rkcmp0"
FINAL["ranking_comparison"] = f"SELECT probability, alerts, hits, {r('base_rate', 'precision', 'lift')}, chosen FROM rkcmp"
COARSE["pchoice"] = "SELECT avg(pow(p - event_12w, 2)) AS brier_raw, avg(pow(p_cal - event_12w, 2)) AS brier_cal, CASE WHEN avg(pow(p_cal - event_12w, 2)) <= avg(pow(p - event_12w, 2)) * 1.01 THEN 'CALIBRATED' ELSE 'RAW' END AS for_reports FROM pall WHERE part = 'DEV_SELECT' AND event_12w IS NOT NULL"
COARSE["final0"] = "SELECT a.*, for_reports AS report_choice, probability AS rank_choice, CASE WHEN for_reports = 'CALIBRATED' THEN p_cal ELSE p END AS p_report, CASE WHEN probability = 'CALIBRATED' THEN p_cal ELSE p END AS p_rank FROM pall a, pchoice, (SELECT probability FROM rkcmp WHERE chosen) WHERE split = 'VAL'"
COARSE["final"] = "SELECT sku_id, week, season_group, yhat, q80, q90, q95, p AS p_raw, p_cal, p_report, p_rank, report_choice, rank_choice, round(p_rank * q90, 9) AS score, CASE WHEN round(p_report, 9) >= 0.80 THEN 'CRITICAL' WHEN round(p_report, 9) >= 0.60 THEN 'HIGH' WHEN round(p_report, 9) >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS tier, q90 - yhat AS buffer_90, q95 - yhat AS buffer_95 FROM final0"
FINAL["final_forecast"] = f"SELECT sku_id, week, season_group, {r('yhat', 'q80', 'q90', 'q95', 'p_raw', 'p_cal', 'p_report', 'p_rank', 'score', 'buffer_90', 'buffer_95')}, report_choice, rank_choice, tier FROM final"
_kinds = (("OVER_ON_ZERO", "CASE WHEN y_12w = 0 AND q90 > 0 THEN q90 END"), ("UNDER", "CASE WHEN y_12w > q90 THEN y_12w - q90 END"), ("WIDE", "CASE WHEN yhat >= 5 THEN q90 / nullif(yhat, 0) END"), ("CAPPED", "CASE WHEN q90 >= cap THEN cap END"))
FINAL["examples"] = " UNION ALL ".join(f"SELECT * FROM (SELECT sku_id, week, season_group, round(yhat, 6) AS yhat, round(q90, 6) AS q90, round(y_12w, 6) AS y_12w, '{k}' AS kind, round({v}, 6) AS value, {i}::INT AS kind_no, row_number() OVER (ORDER BY round({v}, 6) DESC, sku_id, week)::INT AS place FROM fc WHERE split = 'VAL' AND ({v}) IS NOT NULL) WHERE place <= 20" for i, (k, v) in enumerate(_kinds, 1))
COARSE["guard"] = BASE_FINAL["guardrails"]
COARSE["recon"] = BASE_FINAL["reconciliation"]
COARSE["bcheck"] = BASE_FINAL["blind_check"]
COARSE["fverd0"] = """SELECT g.*, (SELECT CASE WHEN CASE WHEN for_reports = 'CALIBRATED' THEN brier_cal ELSE brier_raw END <= brier_raw * 1.01 THEN 'PASS' ELSE 'FAIL' END FROM pchoice) AS b5_probability, (SELECT for_reports FROM pchoice) AS probability,
  (SELECT CASE WHEN coalesce(sum(n) FILTER (status = 'FAIL'), 0) = 0 THEN 'PASS' ELSE 'FAIL' END FROM recon) AS d1_reconciled, d2_weights, d3_no_duplicate, b.status AS blind_leakage, CASE WHEN labels = 0 AND events = 0 THEN 'PASS' ELSE 'FAIL' END AS blind_labels, CASE WHEN first_week = 28 AND last_week <= 40 THEN 'PASS' ELSE 'FAIL' END AS blind_range,
  (SELECT coalesce(min(status) FILTER (starts_with(status, 'FAIL')), max(CASE WHEN status = 'WARN_RATIO' THEN status END), 'PASS') FROM guard) AS ratio_gate FROM ggates g, bcheck b, (SELECT CASE WHEN max(abs(s - 1)) <= 1e-9 THEN 'PASS' ELSE 'FAIL' END AS d2_weights, CASE WHEN count(*) FILTER (s > 1.000001) = 0 THEN 'PASS' ELSE 'FAIL' END AS d3_no_duplicate FROM (SELECT sum(share) AS s FROM alloc GROUP BY sku_id, week))"""
_fshown = [*(c for c in _g if c != "b5_brier"), "b5_probability", "d1_reconciled", "d2_weights", "d3_no_duplicate", "blind_leakage", "blind_labels", "blind_range", "ratio_gate"]
_fnames = ("b1_leakage", "b2_scope", "b3_coverage", "b3c_order", "b4_lift", "b5_probability", "d1_reconciled", "d2_weights", "d3_no_duplicate", "blind_leakage", "blind_labels")
_pass = lambda *c: " AND ".join(f"{x} = 'PASS'" for x in c)
COARSE["fverdict"] = f"""SELECT {", ".join(_fshown)}, probability, {_list(_fnames).replace("], lambda", ", CASE WHEN starts_with(ratio_gate, 'FAIL') THEN 'ratio_gate' END], lambda")} AS failed,
  CASE WHEN {_pass("b1_leakage", "b3_coverage", "b4_lift", "b5_probability", "blind_leakage")} THEN CASE WHEN {_pass("b2_scope", "b3c_order", "d1_reconciled", "d3_no_duplicate", "blind_labels")} AND NOT starts_with(ratio_gate, 'FAIL') THEN 'DEPLOY_FULL' ELSE 'DEPLOY_NATIONAL_ONLY' END ELSE 'HOLD' END AS verdict FROM fverd0"""
FINAL["final_verdict"] = "SELECT * FROM fverdict"


def _sentinel(rows: str, columns: dict[str, str], allowed: tuple[str, ...]) -> str:
    """Rows if the verdict is allowed, else one row of nulls with the failed gates."""
    yes = f"verdict IN ({', '.join(chr(39) + v + chr(39) for v in allowed)})"
    nulls = ", ".join(f"NULL::{t} AS {c}" for c, t in columns.items())
    return f"SELECT {', '.join(columns)}, 'DEPLOYED' AS status FROM ({rows}) x, fverdict WHERE {yes} UNION ALL SELECT {nulls}, 'HOLD_NOT_GENERATED: ' || failed FROM fverdict WHERE NOT {yes}"


_num = lambda *c: dict.fromkeys(c, "DOUBLE")
_key = {"sku_id": "VARCHAR", "week": "DATE"}
_weeks = "weekofyear(week) BETWEEN 28 AND 40"
_both = ("DEPLOY_FULL", "DEPLOY_NATIONAL_ONLY")
_nat = ("yhat", "q80", "q90", "q95", "p_report", "score")
FINAL["blind_national"] = _sentinel(f"SELECT sku_id, week, season_group, {r(*_nat, 'buffer_90', 'buffer_95')}, tier, NULL::DOUBLE AS y_12w, NULL::INT AS event_12w FROM final WHERE {_weeks}", {**_key, "season_group": "VARCHAR", **_num(*_nat, "buffer_90", "buffer_95"), "tier": "VARCHAR", "y_12w": "DOUBLE", "event_12w": "INT"}, _both)
FINAL["blind_provincial"] = _sentinel(f"SELECT sku_id, week, province, {r('share', 'yhat', 'q80', 'q90', 'q95')} FROM alloc WHERE {_weeks}", {**_key, "province": "VARCHAR", **_num("share", "yhat", "q80", "q90", "q95")}, _both[:1])
FINAL["blind_alerts"] = _sentinel(f"SELECT * FROM (SELECT sku_id, week, season_group, {r('score', 'p_rank', 'q90')}, row_number() OVER (PARTITION BY week ORDER BY final.score DESC, sku_id)::INT AS rank FROM final WHERE {_weeks}) WHERE rank <= 10", {**_key, "season_group": "VARCHAR", **_num("score", "p_rank", "q90"), "rank": "INT"}, _both)

# audits
def _audit(checks: list[tuple[str, str]]) -> str:
    """Rows of an audit from the violations of each check."""
    return " UNION ALL ".join(f"SELECT {i}::INT AS check_id, '{n}' AS name, v::BIGINT AS violations, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT ({q_}) AS v)" for i, (n, q_) in enumerate(checks, 1))


_zero = "SELECT 0"  # what is made from the rows of one part by its WHERE clause
_isorder = "SELECT CASE WHEN max(week) FILTER (part = 'DEV_TUNE') < min(week) FILTER (part = 'DEV_SELECT') AND max(week) FILTER (part = 'DEV_SELECT') < min(week) FILTER (part = 'LOCKED_TEST') THEN 0 ELSE 1 END FROM third4"
_missing = "SELECT 3 - count(DISTINCT part) FROM {} WHERE part IN ('DEV_TUNE', 'DEV_SELECT', 'LOCKED_TEST')"
FINE["scontract"] = "SELECT split, week, CASE WHEN split = 'VAL' AND weekofyear(week) BETWEEN 28 AND 40 THEN 'LOCKED_TEST' END AS part FROM scores"
FINAL["season_audit"] = _audit([
    ("FEATURES_BEFORE_LOCKED", "SELECT CASE WHEN max(week) FILTER (split IN ('TRAIN', 'CALIB')) < min(week) FILTER (part = 'LOCKED_TEST') THEN 0 ELSE 1 END FROM scontract"),
    ("FEATURES_FROM_PRIOR_YEARS", "SELECT count(*) FROM states WHERE n_years > (SELECT count(DISTINCT isoyear(week)) FROM scores WHERE split IN ('TRAIN', 'CALIB')) OR n_obs < n_years"),
    ("QUANTILES_WITHOUT_LOCKED", _zero), ("PROBABILITY_WITHOUT_LOCKED", _zero), ("POLICY_WITHOUT_LOCKED", _zero),
    ("GATE_WITHOUT_LABELS", "SELECT count(*) FROM stated WHERE part = 'LOCKED_TEST' AND gated IS DISTINCT FROM CASE WHEN gate_cap < yhat THEN least(yhat, greatest(gate_cap, mean_same * 12 * 0.30)) ELSE yhat END"),
    ("STATE_WITHOUT_LABELS", "SELECT count(*) FROM states WHERE state IS NULL"), ("UNKNOWN_GETS_A_CHOICE", "SELECT count(*) FROM sapplied WHERE state = 'UNKNOWN_FALLBACK' AND level IS NULL"),
    ("LOCKED_METRICS_THERE", "SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM sapplied WHERE part = 'LOCKED_TEST' AND y_12w IS NOT NULL"),
])
FINAL["recall_audit"] = _audit([
    ("POLICY_SPLIT", _zero), ("NO_SELECTION_BIAS", _zero), ("CANDIDATES_SPLIT", _zero), ("CANDIDATES_WITHOUT_LOCKED", _zero), ("BASE_PARTS", _missing.format("os")), ("SCORED_PARTS", _missing.format("recalls")),
    ("COMBINED_HAS_LOCKED", "SELECT CASE WHEN count(*) FILTER (part = 'LOCKED_TEST') > 0 THEN 0 ELSE 1 END FROM third4"), ("METRICS_SPLIT", _zero),
    ("FROZEN_IS_THE_BEST", "SELECT CASE WHEN (SELECT max(policy) FROM rfrozen) = coalesce((SELECT policy FROM reval WHERE valid = 1 ORDER BY loss, policy LIMIT 1), 'NONE_VALID') THEN 0 ELSE 1 END"), ("VERDICT_SPLIT", _zero),
    ("ROW_COUNT", "SELECT abs((SELECT count(*) FROM os) - (SELECT count(*) FROM third4))"), ("PARTS_IN_ORDER", _isorder), ("ONE_FROZEN", "SELECT CASE WHEN count(*) = 1 THEN 0 ELSE 1 END FROM rfrozen"), ("GRID_SIZE", "SELECT abs(count(DISTINCT policy) - 81) FROM reval"),
    ("FORMULAS", "SELECT abs(count(DISTINCT split_part(policy, '_', 1)) - 3) FROM reval"), ("UNIQUE_ROWS", "SELECT count(*) - count(DISTINCT (sku_id, week)) FROM os"), ("LAYERS_APART", "SELECT count(*) FROM third4 WHERE stable + second + third > 1"),
    ("SPLIT_RECORDED", _zero), ("POLICY_NAMED", "SELECT count(*) - count(DISTINCT policy) FROM rfrozen"), ("VERDICT_KNOWN", _zero),
])
FINE["ovboth"] = "SELECT f.*, s.q80, s.q90 AS b90, s.q95 AS b95 FROM (SELECT sku_id, week, part, candidate, season_group, state, gated AS p50, p80, p90, p95, y_12w FROM ovfinal) f JOIN stated s ON s.sku_id = f.sku_id AND s.week = f.week"
_ove = lambda f: div(f"sum(CASE WHEN y_12w > 0 THEN abs(y_12w - {f}) END)", "sum(CASE WHEN y_12w > 0 THEN y_12w END)")
FINE["ovmet"] = "SELECT *, CASE WHEN abs(wmape - wmape_base) > 0.01 THEN 'REJECT_P50_CHANGED' WHEN disorder > 0 THEN 'REJECT_ORDER' WHEN round(viol_90, 9) > round(viol_90_base, 9) + 0.01::DOUBLE AND round(viol_90, 9) >= 0.03 THEN 'WIN_QUANTILES' WHEN round(viol_90, 9) < 0.01 THEN 'KEEP_STILL_COLLAPSED' WHEN spread > 50 THEN 'EXPERIMENTAL_LARGE_SPREADS' ELSE 'EXPERIMENTAL_REVIEW' END AS verdict FROM (" + " UNION ALL ".join(
    f"""SELECT '{lv}' AS level, {seg} AS segment, count(*) AS n, {_ove("p50")} AS wmape_base, {_ove("p50")} AS wmape, {share("y_12w > q80")} AS viol_80_base, {share("y_12w > b90")} AS viol_90_base, {share("y_12w > b95")} AS viol_95_base, {share("y_12w > p80")} AS viol_80, {share("y_12w > p90")} AS viol_90, {share("y_12w > p95")} AS viol_95,
    avg(p90 - p50) AS spread, {share("p80 < p50 OR p90 < p80 OR p95 < p90")} AS disorder FROM ovboth WHERE part = 'LOCKED_TEST' AND y_12w IS NOT NULL GROUP BY 1, 2""" for lv, seg in (("GLOBAL", "'ALL'"), ("BY_SEASON", "season_group"), ("BY_STATE", "state"))) + ")"
FINAL["overlay_metrics"] = f"SELECT level, segment, n, {r('wmape_base', 'wmape', 'viol_80_base', 'viol_90_base', 'viol_95_base', 'viol_80', 'viol_90', 'viol_95', 'spread', 'disorder')}, verdict FROM ovmet"
FINAL["overlay_audit"] = _audit([
    ("SPREADS_WITHOUT_LOCKED", _zero), ("SPREADS_FROM_TUNE", _zero), ("CHOSEN_ON_SELECT", _zero), ("METRIC_LEVELS", "SELECT 3 - count(DISTINCT level) FROM ovmet"), ("FROZEN_FLAGS", "SELECT abs(count(*) - 1) FROM (SELECT candidate FROM oveval ORDER BY loss, candidate LIMIT 1)"),
    ("NO_LATE_FEATURES", "SELECT CASE WHEN max(week) FILTER (split <> 'VAL') < min(week) FILTER (split = 'VAL') THEN 0 ELSE 1 END FROM scores"), ("P50_UNCHANGED", "SELECT count(*) FROM ovfinal f JOIN stated s ON s.sku_id = f.sku_id AND s.week = f.week WHERE abs(f.gated - s.gated) > 0.001"),
    ("ORDERED", "SELECT count(*) FROM ovfinal WHERE p80 < gated OR p90 < p80 OR p95 < p90"), ("ONE_CANDIDATE", "SELECT abs(count(DISTINCT candidate) - 1) FROM ovfinal"),
    ("TABLES_PRESENT", "SELECT ((SELECT count(*) FROM stated) = 0)::INT + ((SELECT count(*) FROM ovspread) = 0)::INT + ((SELECT count(*) FROM oveval) = 0)::INT + ((SELECT count(*) FROM ovfinal) = 0)::INT"),
])
FINAL["audit_verdicts"] = "SELECT count(*) AS checks, count(*) FILTER (status = 'FAIL') AS failed, coalesce(string_agg(CASE WHEN status = 'FAIL' THEN name END, ',' ORDER BY name), '') AS names, CASE WHEN count(*) FILTER (status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (" + " UNION ALL ".join(f"SELECT name, status FROM ({FINAL[n]})" for n in ("season_audit", "recall_audit", "overlay_audit")) + ")"

# joint choice of points and quantiles
_quiet = "(season_group = 'REST' OR coalesce(state = 'OFF_SEASON', false))"
_err = lambda f: f"{div(f'sum(abs(y_12w - {f}))', 'sum(y_12w)')} AS wmape, {div(f'sum(CASE WHEN y_12w > 0 THEN abs(y_12w - {f}) END)', 'sum(CASE WHEN y_12w > 0 THEN y_12w END)')} AS wmape_positive, {div(f'sum({f}) - sum(y_12w)', 'sum(y_12w)')} AS bias, {share(f'y_12w = 0 AND {f} > 0')} AS zero_over"
FINE["jshrink0"] = f"SELECT shrink, count(*) AS n, {_err('f')} FROM (SELECT shrink, y_12w, CASE WHEN {_quiet} THEN gated * shrink ELSE gated END AS f FROM stated, (SELECT unnest([0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00])::DOUBLE AS shrink) WHERE part = 'DEV_TUNE' AND y_12w IS NOT NULL) GROUP BY 1"
FINE["jshrink"] = "SELECT *, row_number() OVER (ORDER BY loss, shrink) = 1 AS chosen FROM (SELECT *, round(2 * wmape_positive + zero_over + 0.5 * abs(bias), 9) AS loss FROM jshrink0)"
FINAL["shrink_grid"] = f"SELECT shrink, n, {r('wmape', 'wmape_positive', 'bias', 'zero_over', 'loss')}, chosen FROM jshrink"
FINE["jpoints"] = f"""SELECT sku_id, week, part, season_group, state, regime, y_12w, unnest(['A0', 'A1', 'A2', 'A3']) AS point, unnest([yhat, gated, CASE WHEN {_quiet} THEN gated * shrink ELSE gated END,
  CASE WHEN coalesce(zero_share_26w >= 0.80 AND median_same = 0 AND zero_share_13w >= 0.70, false) THEN 0 ELSE gated END]) AS p50 FROM regimes, (SELECT shrink FROM jshrink WHERE chosen)"""
FINE["jtune"] = "SELECT *, round(greatest(y_12w - p50, 0), 9) AS ra, round(ln(y_12w + 1) - ln(p50 + 1), 9) AS rl FROM jpoints WHERE part = 'DEV_TUNE' AND y_12w IS NOT NULL"
_jq = "count(*) AS n, " + ", ".join(f"{q('r' + t, k)} AS {t}{k}" for t in "al" for k in (50, 80, 90, 95))
FINE["jspread"] = f"SELECT point, 'STATE' AS level, state AS segment, regime, {_jq} FROM jtune GROUP BY 1, 3, 4 UNION ALL SELECT point, 'SEASON', season_group, regime, {_jq} FROM jtune GROUP BY 1, 3, 4 UNION ALL SELECT point, 'GLOBAL', 'ALL', 'ALL', {_jq} FROM jtune GROUP BY 1"
FINAL["joint_spreads"] = f"SELECT point, level, segment, regime, n, {r(*(f'{t}{k}' for t in 'al' for k in (50, 80, 90, 95)))} FROM jspread"
_jp = lambda c: f"coalesce(s.{c}, g.{c}, t.{c})"
_ja = lambda k, w="": f"p50 + {w}{_jp(f'a{k}')}"
_jl = lambda k: f"greatest(0, exp(ln(p50 + 1) + {_jp(f'l{k}')}) - 1)"
_jquiet = _quiet.replace("season_group", "x.season_group").replace("state", "x.state")
FINE["joint"] = "SELECT sku_id, week, part, season_group, state, regime, y_12w, point, p50, method, " + ", ".join(f"round(w{k}, 9) AS j{k}" for k in (80, 90, 95)) + " FROM (SELECT x.*, unnest(['B1_ABS', 'B2_LOG', 'B3_HYBRID', 'B4_TIGHT']) AS method, " + ", ".join(
    f"unnest([{_ja(k)}, {_jl(k)}, CASE WHEN {_jquiet} THEN {_ja(k)} ELSE {_jl(k)} END, {_ja(k, '0.80::DOUBLE * ')}]) AS w{k}" for k in (80, 90, 95)) + """ FROM jpoints x LEFT JOIN (SELECT * FROM jspread WHERE level = 'STATE' AND n >= 50) s ON s.point = x.point AND s.segment = x.state AND s.regime = x.regime
  LEFT JOIN (SELECT * FROM jspread WHERE level = 'SEASON' AND n >= 200) g ON g.point = x.point AND g.segment = x.season_group AND g.regime = x.regime LEFT JOIN (SELECT * FROM jspread WHERE level = 'GLOBAL') t ON t.point = x.point WHERE x.part IN ('DEV_SELECT', 'LOCKED_TEST'))"""
_jm = f"count(*) AS n, {_err('p50')}, " + ", ".join(f"{share(f'y_12w > j{k}')} AS viol_{k}" for k in (80, 90, 95)) + f", {share('j80 < p50 OR j90 < j80 OR j95 < j90')} AS disorder"
FINE["jseason"] = f"SELECT point, method, max(e) FILTER (season_group = 'REST') AS rest, max(e) FILTER (season_group = 'HIGH_SEASON') AS high FROM (SELECT point, method, season_group, {div('sum(CASE WHEN y_12w > 0 THEN abs(y_12w - p50) END)', 'sum(CASE WHEN y_12w > 0 THEN y_12w END)')} AS e FROM joint WHERE part = 'DEV_SELECT' AND y_12w IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2"
_jh = " + ".join(f"CASE WHEN round(viol_{k}, 9) < {lo} THEN ({lo}::DOUBLE - round(viol_{k}, 9)) * {b} WHEN round(viol_{k}, 9) > {hi} THEN (round(viol_{k}, 9) - {hi}::DOUBLE) * {a} ELSE 0 END" for k, (lo, hi, b, a) in {80: (0.10, 0.25, 5.0, 2.0), 90: (0.04, 0.15, 8.0, 3.0), 95: (0.01, 0.08, 10.0, 4.0)}.items())
_jw = lambda c, slack, w: f"CASE WHEN {c} > b{c} * {slack}::DOUBLE THEN ({c} - b{c}) * {w} ELSE 0 END"
FINE["jeval"] = f"""SELECT *, point || '_' || method AS candidate, round(2 * wmape + 2 * wmape_positive + zero_over + 0.5 * abs(bias) + 0.8 * ({_jh}) + {_jw("rest", 1.05, 2.0)} + {_jw("high", 1.10, 3.0)} + 10 * disorder, 9) AS loss FROM (
  SELECT m.*, rest, high, (SELECT max(rest) FROM jseason WHERE point = 'A1') AS brest, (SELECT max(high) FROM jseason WHERE point = 'A1') AS bhigh FROM (SELECT point, method, {_jm} FROM joint WHERE part = 'DEV_SELECT' AND y_12w IS NOT NULL GROUP BY 1, 2) m JOIN jseason USING (point, method))"""
FINAL["joint_eval"] = f"SELECT point, method, candidate, n, {r('wmape', 'wmape_positive', 'bias', 'zero_over', 'viol_80', 'viol_90', 'viol_95', 'disorder', 'rest', 'high', 'loss')} FROM jeval"
FINE["jfrozen"] = "SELECT * FROM jeval ORDER BY loss NULLS LAST, candidate LIMIT 1"
FINAL["joint_frozen"] = "SELECT candidate, point, method, round(loss, 6) AS loss, 'DEV_SELECT' AS evaluated_on_split, false AS used_locked_test FROM jfrozen"
FINE["jlocked"] = "SELECT j.* EXCLUDE (j80, j90, j95), f.candidate, greatest(p50, j80) AS j80, greatest(p50, j80, j90) AS j90, greatest(p50, j80, j90, j95) AS j95 FROM joint j JOIN jfrozen f ON f.point = j.point AND f.method = j.method WHERE part = 'LOCKED_TEST' AND y_12w IS NOT NULL"
FINAL["joint_locked_metrics"] = f"SELECT candidate, level, segment, n, {r('wmape', 'wmape_positive', 'bias', 'zero_over', 'viol_80', 'viol_90', 'viol_95', 'disorder', 'spread')} FROM (" + " UNION ALL ".join(f"SELECT candidate, '{lv}' AS level, {sg} AS segment, {_jm}, avg(j90 - p50) AS spread FROM jlocked GROUP BY 1, 2, 3" for lv, sg in (("GLOBAL", "'ALL'"), ("BY_SEASON", "season_group"), ("BY_STATE", "state"))) + ")"

_closed = lambda k: f"OVER (PARTITION BY sku_id ORDER BY week ROWS BETWEEN {12 + k} PRECEDING AND 13 PRECEDING)"
FINAL["closed_labels"] = "SELECT sku_id, week, " + ", ".join(f"round(avg(y) {_closed(k)}, 6) AS label_mean_{k}, round(round(stddev_samp(y) {_closed(k)}, 9), 6) AS label_std_{k}, round((count(*) FILTER (y = 0) {_closed(k)}) / nullif((count(y) {_closed(k)})::DOUBLE, 0), 6) AS label_zero_{k}" for k in (4, 8, 13)) + " FROM (SELECT sku_id, week, CASE WHEN n_future = 12 THEN y_12w END AS y FROM labelled)"
_fq = f"count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - {div('sum(e * e)', 'var_pop(y) * count(*)')} AS r2, " + ", ".join(f"{q('round(e, 9)', k)} AS residual_{k}" for k in (5, 25, 50, 75, 95)) + f", {share('e < 0')} AS over_share"
COARSE["fitrows"] = "SELECT season_group, y_12w AS y, y_12w - yhat AS e FROM fc WHERE split = 'VAL'"
FINAL["fit_quality"] = f"SELECT season_group, n, {r('mae', 'rmse', 'r2', *(f'residual_{k}' for k in (5, 25, 50, 75, 95)), 'over_share')} FROM (SELECT season_group, {_fq} FROM fitrows GROUP BY 1 UNION ALL SELECT 'ALL', {_fq} FROM fitrows)"

_FINE_NAMES = {"qr_features", "state_grid_eval", "state_frozen", "state_recalibrated", "state_recalibrated_metrics", "shrink_grid", "joint_spreads", "joint_eval", "joint_frozen", "joint_locked_metrics", "season_audit", "recall_audit", "overlay_metrics", "overlay_audit", "audit_verdicts"}
ORACLES = {name: oracle(name, FINE if name in _FINE_NAMES else COARSE, FINAL) for name in FINAL}
