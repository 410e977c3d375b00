"""The same queries in DuckDB SQL, on their own steps after those of the panel and the forecast."""

from __future__ import annotations

from .retail_sql import LEVELS, STEPS, oracle, q, r, share

FINE = {k: v.replace("floor(l_suppkey / 3)", "floor(l_suppkey / 1)") for k, v in STEPS.items()}
COARSE = dict(STEPS)
FINAL: dict[str, str] = {}
WEIGHTS = {"A1": (0.40, 0.20, 0.15, 0.10, 0.10, 0.05), "A2": (0.35, 0.25, 0.15, 0.10, 0.10, 0.05), "B1": (0.15, 0.40, 0.20, 0.10, 0.10, 0.05), "B2": (0.20, 0.35, 0.20, 0.10, 0.10, 0.05), "C1": (0.15, 0.20, 0.35, 0.15, 0.10, 0.05), "C2": (0.15, 0.20, 0.30, 0.20, 0.10, 0.05), "D1": (0.25, 0.25, 0.20, 0.15, 0.10, 0.05), "D2": (0.20, 0.20, 0.20, 0.20, 0.15, 0.05), "E1": (0.45, 0.20, 0.15, 0.10, 0.05, 0.05), "E2": (0.50, 0.15, 0.15, 0.10, 0.05, 0.05)}
_part = "CASE WHEN weekofyear(week) <= 8 THEN 'DEV_TUNE' WHEN weekofyear(week) <= 16 THEN 'DEV_SELECT' WHEN weekofyear(week) <= 27 THEN 'EMBARGO' WHEN weekofyear(week) <= 40 THEN 'LOCKED_TEST' ELSE 'OUTSIDE' END"
_pos = "greatest({}, 0)"


def div(a: str, b: str) -> str:
    return f"({a})::DOUBLE / nullif(({b})::DOUBLE, 0)"


# season states
FINE["past"] = "SELECT sku_id, isoyear(week) AS past_year, weekofyear(week) AS look, y, (y > 0)::INT AS pos FROM scores WHERE split IN ('TRAIN', 'CALIB')"
FINE["asked"] = "SELECT sku_id, week, season_group, isoyear(week) AS yr, weekofyear(week) AS iso FROM scores WHERE split = 'VAL'"
FINE["annual"] = "SELECT sku_id, avg(y) AS mean_year, avg(pos)::DOUBLE AS pos_year FROM past GROUP BY 1"
FINE["profile0"] = """SELECT a.sku_id, a.week, a.season_group, count(y) FILTER (look = iso) AS n_obs, count(DISTINCT CASE WHEN look = iso THEN past_year END) AS n_years,
  coalesce(avg(y) FILTER (look = iso), 0) AS mean_same, coalesce(quantile_disc(CASE WHEN look = iso THEN y END, 0.5), 0) AS median_same, coalesce(quantile_disc(CASE WHEN look = iso THEN y END, 0.9), 0) AS p90_same,
  coalesce(avg(pos) FILTER (look = iso), 0)::DOUBLE AS pos_same, coalesce(avg(y) FILTER (look <> iso), 0) AS mean_near, coalesce(avg(pos) FILTER (look <> iso), 0)::DOUBLE AS pos_near,
  coalesce(avg(pos) FILTER (look < iso), 0)::DOUBLE AS pos_before, coalesce(avg(pos) FILTER (look > iso), 0)::DOUBLE AS pos_after
  FROM asked a LEFT JOIN past p ON p.sku_id = a.sku_id AND p.look BETWEEN iso - 2 AND iso + 2 AND past_year < yr GROUP BY 1, 2, 3"""
FINE["profile"] = f"""SELECT p.*, coalesce(a.mean_year, 0) AS mean_year, coalesce(a.pos_year, 0) AS pos_year, {div("mean_same", "a.mean_year")} AS index, {div("pos_same", "a.pos_year")} AS pos_index, round(pos_after - pos_before, 9) AS slope
  FROM profile0 p LEFT JOIN annual a ON a.sku_id = p.sku_id"""
FINE["states"] = """SELECT *, CASE WHEN n_obs < 3 THEN 'UNKNOWN_FALLBACK' WHEN pos_year >= 0.70 AND pos_same >= 0.50 THEN 'ALWAYS_ON' WHEN pos_same < 0.15 AND round(index, 9) < 0.25 THEN 'OFF_SEASON'
  WHEN pos_same >= 0.40 AND round(index, 9) >= 1.25 THEN 'IN_SEASON' WHEN slope > 0.10 AND pos_same BETWEEN 0.15 AND 0.50 THEN 'TRANSITION_UP' WHEN slope < -0.10 AND pos_same BETWEEN 0.15 AND 0.50 THEN 'TRANSITION_DOWN'
  WHEN pos_year < 0.35 AND abs(round(pos_index, 9) - 1) < 0.40 THEN 'INTERMITTENT_RANDOM' WHEN season_group = 'REST' AND round(index, 9) < 0.60 THEN 'REST_OFFPEAK' ELSE 'IN_SEASON' END AS state FROM profile"""
FINE["stated0"] = f"""SELECT f.*, s.* EXCLUDE (sku_id, week, season_group), {_part.replace("(week)", "(f.week)")} AS part,
  CASE WHEN state = 'OFF_SEASON' AND p90_same > 0 THEN p90_same * 12 WHEN state = 'OFF_SEASON' AND mean_year > 0 THEN mean_year * 3 WHEN state = 'REST_OFFPEAK' AND p90_same > 0 THEN p90_same * 18 WHEN state = 'REST_OFFPEAK' AND mean_year > 0 THEN mean_year * 6 END AS gate_cap
  FROM fc f LEFT JOIN states s ON s.sku_id = f.sku_id AND s.week = f.week WHERE split = 'VAL'"""
FINE["stated"] = "SELECT *, CASE WHEN gate_cap < yhat THEN least(yhat, greatest(gate_cap, mean_same * 12 * 0.30)) ELSE yhat END AS gated, coalesce(gate_cap < yhat, false)::INT AS lowered FROM stated0"
FINAL["season_profile"] = f"SELECT sku_id, week, season_group, n_obs, n_years, {r('mean_same', 'median_same', 'p90_same', 'pos_same', 'mean_near', 'pos_near', 'pos_before', 'pos_after', 'mean_year', 'pos_year', 'index', 'pos_index', 'slope')} FROM profile"
FINAL["season_state"] = "SELECT sku_id, week, season_group, state FROM states"
FINAL["state_summary"] = f"SELECT state, n, skus, {r('pos_same', 'index', 'slope')} FROM (SELECT state, count(*) AS n, count(DISTINCT sku_id) AS skus, avg(pos_same) AS pos_same, avg(index) AS index, avg(slope) AS slope FROM states GROUP BY 1)"
FINAL["offseason_gate"] = f"SELECT sku_id, week, state, part, {r('yhat', 'gate_cap', 'gated')}, lowered FROM stated"
_point = lambda f: f"""count(*) AS n, avg(abs(y_12w - {f})) AS mae, sum(abs(y_12w - {f})) / nullif(sum(abs(y_12w)), 0) AS wmape,
  sum(CASE WHEN y_12w > 0 THEN abs(y_12w - {f}) END) / nullif(sum(CASE WHEN y_12w > 0 THEN y_12w END), 0) AS wmape_positive, 100 * (sum({f} - y_12w) / nullif(sum(y_12w), 0)) AS bias_pct,
  {share(f"y_12w = 0 AND {f} > 0")} AS zero_over, avg(event_12w) AS event_rate, {share("y_12w > q90")} AS viol_90"""  # noqa: E731
FINAL["breakdown_metrics"] = f"""SELECT season_group, state, level, n, {r("mae", "wmape", "wmape_positive", "bias_pct", "zero_over", "event_rate", "viol_90")} FROM (
  SELECT season_group, state, 'season_state' AS level, {_point("gated")} FROM stated GROUP BY 1, 2 UNION ALL SELECT season_group, 'ALL', 'season', {_point("gated")} FROM stated GROUP BY 1
  UNION ALL SELECT 'ALL', state, 'state', {_point("gated")} FROM stated GROUP BY 2 UNION ALL SELECT 'ALL', 'ALL', 'global', {_point("gated")} FROM stated)"""
FINE["tunex"] = "SELECT season_group, state, (y_12w > q90)::INT AS x FROM stated WHERE part = 'DEV_TUNE'"
FINAL["state_calibration"] = """SELECT season_group, state, n, level, round(viol, 6) AS viol, round(greatest(least(viol / 0.10, 1.5), 0.8), 6) AS factor FROM (SELECT o.season_group, state, o.n, CASE WHEN o.n >= 200 THEN 'STATE' WHEN s.n >= 50 THEN 'SEASON' ELSE 'GLOBAL_FALLBACK' END AS level,
  CASE WHEN o.n >= 200 THEN o.v WHEN s.n >= 50 THEN s.v ELSE (SELECT avg(x) FROM tunex) END::DOUBLE AS viol
  FROM (SELECT season_group, state, count(*) AS n, avg(x) AS v FROM tunex GROUP BY 1, 2) o JOIN (SELECT season_group, count(*) AS n, avg(x) AS v FROM tunex GROUP BY 1) s USING (season_group))"""

# suspected stock-outs
FINE["numbered"] = "SELECT sku_id, week, iso_week, y, row_number() OVER (PARTITION BY sku_id ORDER BY week) AS nr FROM panel"
_w = lambda k: f"OVER (PARTITION BY sku_id ORDER BY week ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
FINE["recent0"] = f"SELECT *, max(CASE WHEN y > 0 THEN nr END) {_w('UNBOUNDED')} AS last_at FROM numbered"
FINE["recent"] = f"""SELECT sku_id, week, least(12, nr - 1 - coalesce(last_at, 0))::INT AS zero_run, coalesce(least(12, nr - 1 - last_at), 12)::INT AS weeks_since_sale,
  {", ".join(f"1 - (count(*) FILTER (y > 0) {_w(k)}) / {k}.0::DOUBLE AS zero_share_{k}w" for k in (4, 8, 12))}, {", ".join(f"coalesce(sum(y) {_w(k)}, 0) / {k}.0::DOUBLE AS recent_mean_{k}" for k in (4, 8, 12))},
  coalesce(max(y) {_w(12)}, 0) AS recent_max_12, count(*) FILTER (y > 0) {_w(12)} AS positive_weeks_12 FROM recent0"""
FINAL["recent_sales"] = f"SELECT sku_id, week, zero_run, weeks_since_sale, {r(*(f'zero_share_{k}w' for k in (4, 8, 12)), *(f'recent_mean_{k}' for k in (4, 8, 12)), 'recent_max_12')}, positive_weeks_12 FROM recent"
FINE["oosf0"] = "SELECT s.*, c.* EXCLUDE (sku_id, week), greatest(gated - recent_mean_4, 0) AS gap FROM stated s JOIN recent c ON c.sku_id = s.sku_id AND c.week = s.week"
FINE["oosf"] = """SELECT *, CASE WHEN zero_run = 0 THEN '0' WHEN zero_run = 1 THEN '1' WHEN zero_run <= 3 THEN '2-3' WHEN zero_run <= 7 THEN '4-7' ELSE '8+' END AS run_bucket, zero_run / 12.0::DOUBLE AS c_run,
  greatest(least(gap / greatest(gated, 1), 1), 0) AS c_gap, coalesce(pos_same, 0.5) AS c_past,
  CASE state WHEN 'ALWAYS_ON' THEN 1.0 WHEN 'IN_SEASON' THEN 0.80 WHEN 'TRANSITION_UP' THEN 0.75 WHEN 'TRANSITION_DOWN' THEN 0.60 WHEN 'INTERMITTENT_RANDOM' THEN 0.50 WHEN 'REST_OFFPEAK' THEN 0.35 ELSE 0.20 END::DOUBLE AS c_season,
  greatest(least(p, 1), 0) AS c_p, greatest(least(CASE WHEN recent_mean_12 > 0 THEN CASE WHEN recent_mean_4 = 0 THEN 1 ELSE (recent_mean_12 - recent_mean_4) / recent_mean_12 END ELSE 0 END, 1), 0)::DOUBLE AS c_drop,
  (1 - coalesce(pos_same, 0.5) + zero_share_12w) / 2 AS true_zero FROM oosf0"""
_c = ("c_run", "c_gap", "c_past", "c_season", "c_p", "c_drop")
FINAL["oos_features"] = f"SELECT sku_id, week, part, run_bucket, {r(*_c, 'gap', 'true_zero')} FROM oosf"
FINE["weights"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in w)})" for k, w in WEIGHTS.items()) + ") t(policy, w1, w2, w3, w4, w5, w6)"
FINE["ogrid"] = """SELECT row_number() OVER (ORDER BY policy, t, j)::INT AS candidate_id, policy, t::DOUBLE AS threshold, scope, top_n::INT AS top_n FROM weights, unnest([0.30, 0.40, 0.50, 0.60]) x(t),
  (VALUES (1, 'global', 50), (2, 'global', 100), (3, 'global', 200), (4, 'season', 20), (5, 'season', 50)) n(j, scope, top_n)"""
_susp = "round(greatest(least((" + " + ".join(f"w{i} * {c}" for i, c in enumerate(_c, 1)) + ") * (1 - true_zero), 1), 0), 9)"
_prio = "round(suspected * ln(1 + gap) * CASE WHEN season_group = 'HIGH_SEASON' THEN 1.2 ELSE 1.0 END, 9)"
FINE["tried"] = f"SELECT *, {_prio} AS priority FROM (SELECT f.*, w.policy, {_susp} AS suspected FROM oosf f, weights w WHERE part = 'DEV_SELECT')"
FINE["orders"] = """SELECT policy, 'global' AS scope, event_12w, suspected, row_number() OVER (PARTITION BY policy ORDER BY priority DESC, sku_id, week) AS rank FROM tried
  UNION ALL SELECT policy, 'season', event_12w, suspected, row_number() OVER (PARTITION BY policy, season_group ORDER BY priority DESC, sku_id, week) FROM tried"""
FINE["ofound"] = "SELECT candidate_id, count(*) AS flags, sum(event_12w)::BIGINT AS hits FROM orders JOIN ogrid USING (policy, scope) WHERE rank <= top_n AND suspected >= threshold GROUP BY 1"
FINE["obase"] = "SELECT count(*) AS total, sum(event_12w) AS events FROM oosf WHERE part = 'DEV_SELECT'"
FINE["oeval0"] = f"""SELECT candidate_id, policy, threshold, scope, top_n, coalesce(flags, 0) AS flags, coalesce(hits, 0) AS hits, events, total, {div("hits", "flags")} AS precision, {div("coalesce(hits, 0)", "events")} AS recall,
  {div("2 * coalesce(hits, 0)", "coalesce(flags, 0) + events")} AS f1, ({div("hits", "flags")}) / nullif(events / total::DOUBLE, 0) AS lift, {div("coalesce(flags, 0) - coalesce(hits, 0)", "total - events")} AS fpr FROM ogrid LEFT JOIN ofound USING (candidate_id), obase"""
FINE["oeval"] = "SELECT * EXCLUDE (events, total), round((2 - coalesce(lift, 0)) + 0.01 * greatest(flags - events, 0) + CASE WHEN coalesce(precision, 0) < events / total::DOUBLE THEN 10 ELSE 0 END, 9) AS loss FROM oeval0"
_oe = f"candidate_id, policy, threshold, scope, top_n, flags, hits, {r('precision', 'recall', 'f1', 'lift', 'fpr', 'loss')}"
FINAL["oos_policy_eval"] = f"SELECT {_oe} FROM oeval"
FINE["ofrozen"] = "SELECT * FROM oeval ORDER BY loss, candidate_id LIMIT 1"
FINAL["oos_frozen"] = f"SELECT {_oe} FROM ofrozen"
FINE["os0"] = f"SELECT f.*, threshold, {_susp} AS suspected FROM oosf f, (SELECT policy, threshold FROM ofrozen) z JOIN weights w USING (policy)"
FINE["os"] = f"""SELECT *, round(suspected * gap, 9) AS expected_lost, {_prio} AS priority, (suspected >= threshold)::INT AS flag, (suspected >= threshold)::INT AS stable,
  (c_run >= 0.15 AND true_zero < 0.75 AND suspected < threshold)::INT AS difficult FROM os0"""
FINAL["oos_scores"] = f"SELECT sku_id, week, part, {r('suspected', 'expected_lost', 'priority')}, flag, difficult FROM os"
_fm = f"""count(*) AS n, sum(flag)::BIGINT AS flags, sum(flag * event_12w)::BIGINT AS hits, sum(event_12w)::BIGINT AS events, {div("sum(CASE WHEN flag = 1 THEN expected_lost END)", "sum(expected_lost)")} AS lost_share"""
FINE["locked"] = "SELECT * FROM os WHERE part = 'LOCKED_TEST'"
FINAL["flag_metrics"] = f"""SELECT season_group, state, n, flags, hits, events, round(lost_share, 6) AS lost_share, round({div("hits", "flags")}, 6) AS precision, round({div("hits", "events")}, 6) AS recall, round({div("2 * hits", "flags + events")}, 6) AS f1, round({div("flags - hits", "n - events")}, 6) AS fpr
  FROM (SELECT season_group, 'ALL' AS state, {_fm} FROM locked GROUP BY 1 UNION ALL SELECT 'ALL', state, {_fm} FROM locked GROUP BY 2 UNION ALL SELECT 'ALL', 'ALL', {_fm} FROM locked)"""
FINAL["topk_curve"] = f"""SELECT k::INT AS k, flags, hits, round({div("hits", "flags")}, 6) AS precision, round({div("hits", "events")}, 6) AS recall, round(({div("hits", "flags")}) / nullif(events / total::DOUBLE, 0), 6) AS lift FROM (
  SELECT k, count(*) AS flags, sum(event_12w)::BIGINT AS hits FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, sku_id, week) AS rank FROM locked), unnest([50, 100, 200, 500, 1000]) x(k) WHERE rank <= k GROUP BY 1), (SELECT sum(event_12w) AS events, count(*) AS total FROM locked)"""
FINAL["weekly_topk"] = f"""SELECT k::INT AS k, count(*) AS weeks, sum(flags)::BIGINT AS flags, sum(hits)::BIGINT AS hits, round(avg({div("hits", "flags")}), 6) AS mean_precision, round(stddev_samp({div("hits", "flags")}), 6) AS std_precision FROM (
  SELECT k, week, count(*) AS flags, sum(event_12w)::BIGINT AS hits FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY priority DESC, sku_id) AS rank FROM locked), unnest([10, 20, 50]) x(k) WHERE rank <= k GROUP BY 1, 2) GROUP BY 1"""

# layers
_pr = lambda cols, by: ", ".join(f"percent_rank() OVER (PARTITION BY {by} ORDER BY round({c}, 9)) AS pr_{c}" for c in cols)
_ranked = ("suspected", "priority", "expected_lost", "p", "gated", "c_gap")
_mix = lambda w: "round(" + " + ".join(f"{x} * pr_{c}" for x, c in zip(w, _ranked, strict=False) if x) + ", 9)"
_gate = lambda f, e, s, p: f"(gated >= {f} AND expected_lost >= {e} AND suspected >= {s} AND p >= {p})"
FINE["hard0"] = f"SELECT *, {_pr(_ranked[:5], 'part, season_group')} FROM os WHERE difficult = 1"
FINE["hard1"] = f"SELECT *, {_mix((0.30, 0.25, 0.20, 0.15, 0.10))} AS score, {_gate(5, 1, 0.05, 0.05)}::INT AS gate_A, {_gate(3, 0.5, 0.03, 0.03)}::INT AS gate_B, {_gate(1, 0.25, 0.01, 0.01)}::INT AS gate_C FROM hard0"
FINE["hard"] = "SELECT *, row_number() OVER (PARTITION BY week, season_group ORDER BY score DESC, sku_id)::INT AS rank FROM hard1"
FINAL["difficult_scores"] = f"SELECT sku_id, week, season_group, {r(*(f'pr_{c}' for c in _ranked[:5]), 'score')}, rank, gate_A, gate_B, gate_C FROM hard"
_pct = "(VALUES ('P1', {}), ('P2', {}), ('P3', {})) p(pn, pct_high, pct_rest), (VALUES ('Q1', {}), ('Q2', {}), ('Q3', {})) q(qn, quota_high, quota_rest)"
FINE["lgrid"] = "SELECT 'GATE_' || gate || '_' || pn || '_' || qn AS policy, gate, pct_high::DOUBLE AS pct_high, pct_rest::DOUBLE AS pct_rest, quota_high::INT AS quota_high, quota_rest::INT AS quota_rest FROM (VALUES ('A'), ('B'), ('C')) g(gate), " + _pct.format("0.94, 0.94", "0.90, 0.92", "0.85, 0.87", "5, 8", "10, 15", "20, 30")
_alert = "score >= CASE WHEN season_group = 'HIGH_SEASON' THEN pct_high ELSE pct_rest END AND rank <= CASE WHEN season_group = 'HIGH_SEASON' THEN quota_high ELSE quota_rest END AND CASE gate WHEN 'A' THEN gate_A WHEN 'B' THEN gate_B ELSE gate_C END = 1"
FINE["lhits"] = f"SELECT policy, week, event_12w, expected_lost FROM hard, lgrid WHERE part = 'DEV_SELECT' AND {_alert}"
FINE["lweek"] = "SELECT policy, week, count(*) AS a, sum(event_12w) AS h, sum(expected_lost) AS lost FROM lhits GROUP BY 1, 2"
FINE["lfound"] = "SELECT policy, sum(a)::BIGINT AS alerts, sum(h)::BIGINT AS hits, sum(lost) AS lost, sum(a * a)::DOUBLE AS sq FROM lweek GROUP BY 1"
FINE["ltotal"] = "SELECT count(*) AS total, sum(event_12w) AS events, count(DISTINCT week) AS weeks, sum(stable) AS stable_n, sum(stable * event_12w) AS stable_hits FROM os WHERE part = 'DEV_SELECT'"
FINE["leval0"] = f"""SELECT policy, coalesce(alerts, 0) AS alerts, coalesce(hits, 0) AS hits, coalesce(lost, 0) AS lost, {div("hits", "alerts")} AS precision, {div("coalesce(hits, 0)", "events")} AS recall, ({div("hits", "alerts")}) / nullif(events / total::DOUBLE, 0) AS lift,
  {div("coalesce(alerts, 0) - coalesce(hits, 0)", "total - events")} AS fpr, round(sqrt((coalesce(sq, 0) - coalesce(alerts, 0)::DOUBLE * coalesce(alerts, 0) / weeks) / (weeks - 1)), 9) AS weekly_std,
  {div("coalesce(hits, 0) + stable_hits", "coalesce(alerts, 0) + stable_n")} AS combined_precision, {div("coalesce(hits, 0) + stable_hits", "events")} AS combined_recall, events / total::DOUBLE AS base, total FROM lgrid LEFT JOIN lfound USING (policy), ltotal"""
FINE["leval"] = """SELECT * EXCLUDE (base, total), round((2 - coalesce(lift, 0)) - 1.5 * lost / 1000 - coalesce(recall, 0) + 100 * coalesce(fpr, 0) + CASE WHEN alerts / total::DOUBLE > 0.10 THEN 2 WHEN alerts / total::DOUBLE > 0.05 THEN 1 ELSE 0 END
  + CASE WHEN coalesce(precision, 0) < base THEN 5 WHEN coalesce(precision, 0) < 1.2 * base THEN 2 ELSE 0 END + CASE WHEN weekly_std > 5 THEN 1.5 WHEN weekly_std > 3 THEN 0.5 ELSE 0 END, 9) AS loss, (alerts > 0 AND coalesce(precision, 0) >= base AND coalesce(lift, 0) > 1)::INT AS valid FROM leval0"""
FINAL["layer_eval"] = f"SELECT policy, alerts, hits, {r('lost', 'precision', 'recall', 'lift', 'fpr', 'weekly_std', 'combined_precision', 'combined_recall', 'loss')}, valid FROM leval"
FINE["lfrozen"] = "SELECT coalesce(b.policy, 'NONE_VALID') AS policy, b.loss FROM (SELECT 1 AS one) o LEFT JOIN (SELECT policy, loss FROM leval WHERE valid = 1 ORDER BY loss, policy LIMIT 1) b ON true"
FINAL["layer_frozen"] = f"SELECT policy, {r('loss')} FROM lfrozen"
FINE["second"] = f"SELECT sku_id, week FROM hard, (SELECT g.* FROM lgrid g JOIN lfrozen f USING (policy)) WHERE {_alert}"
FINE["layered"] = """SELECT o.*, (s.sku_id IS NOT NULL)::INT AS second, CASE WHEN stable = 1 THEN 'STABLE' WHEN s.sku_id IS NOT NULL THEN 'DIFFICULT' ELSE 'NONE' END AS source, (stable = 1 OR s.sku_id IS NOT NULL)::INT AS alert
  FROM os o LEFT JOIN second s ON s.sku_id = o.sku_id AND s.week = o.week"""
FINAL["combined_alerts"] = "SELECT sku_id, week, season_group, source, alert FROM layered"
FINE["llong"] = "SELECT season_group, event_12w, expected_lost, unnest(['STABLE', 'DIFFICULT', 'COMBINED']) AS layer, unnest([(source = 'STABLE')::INT, (source = 'DIFFICULT')::INT, alert]) AS o FROM layered WHERE part = 'LOCKED_TEST'"
_lm = "count(*) AS n, sum(o)::BIGINT AS alerts, sum(o * event_12w)::BIGINT AS hits, sum(event_12w)::BIGINT AS events, sum(o * expected_lost) AS lost"
FINE["lmet"] = f"SELECT *, {div('hits', 'alerts')} AS precision, {div('hits', 'events')} AS recall, {div('alerts - hits', 'n - events')} AS fpr, ({div('hits', 'alerts')}) / nullif(events / n::DOUBLE, 0) AS lift FROM (SELECT layer, season_group, {_lm} FROM llong GROUP BY 1, 2 UNION ALL SELECT layer, 'ALL', {_lm} FROM llong GROUP BY 1)"
FINAL["layer_metrics"] = f"SELECT layer, season_group, n, alerts, hits, events, {r('lost', 'precision', 'recall', 'fpr', 'lift')} FROM lmet"
FINAL["uplift_verdict"] = f"""SELECT alerts, hits, events, n, {r("lost", "precision", "recall")}, round(base, 6) AS base_rate, CASE WHEN coalesce(precision, 0) >= 1.5 * base AND coalesce(recall, 0) >= 0.05 AND lost >= 100 THEN 'PROMOTE'
  WHEN coalesce(precision, 0) >= base AND coalesce(recall, 0) >= 0.02 AND lost >= 50 THEN 'EXPERIMENTAL' WHEN coalesce(precision, 0) < base OR hits < 5 OR lost < 20 THEN 'REJECT' ELSE 'KEEP_STABLE_ONLY' END AS verdict
  FROM (SELECT *, events / n::DOUBLE AS base FROM lmet WHERE layer = 'DIFFICULT' AND season_group = 'ALL')"""
FINE["typed"] = """SELECT *, CASE WHEN alert = 1 THEN 'NOT_CANDIDATE' WHEN c_run >= 0.15 AND round(true_zero, 9) < 0.75 THEN 'T1_ZERO_RUN' WHEN c_run >= 0.30 AND round(true_zero, 9) < 0.85 AND round(p, 9) >= 0.05 THEN 'T2_LONG_RUN'
  WHEN round(c_gap, 9) >= 0.50 AND round(true_zero, 9) < 0.85 AND round(p, 9) >= 0.05 THEN 'T3_GAP' WHEN expected_lost >= 1 AND suspected >= 0.03 AND round(true_zero, 9) < 0.90 THEN 'T4_LOSS'
  WHEN round(p, 9) >= 0.10 AND round(true_zero, 9) < 0.90 AND gated >= 1 THEN 'T5_PROBABILITY' ELSE 'NOT_CANDIDATE' END AS type FROM layered"""
FINE["seged"] = "SELECT *, CASE WHEN count(*) OVER (PARTITION BY part, season_group, type) >= 500 THEN season_group || '::' || type ELSE season_group END AS segment FROM typed WHERE type <> 'NOT_CANDIDATE'"
FINE["recall0"] = f"SELECT *, {_pr(_ranked, 'part, segment')} FROM seged"
_z = "round(true_zero, 9) < 0.90"
FINE["recalls"] = f"""SELECT *, {_mix((0.30, 0.25, 0.20, 0.15, 0.10, 0))} AS score_F1, {_mix((0.20, 0.15, 0.15, 0.30, 0, 0.20))} AS score_F2, {_mix((0.20, 0.20, 0.35, 0.10, 0.15, 0))} AS score_F3,
  {_gate(1, 0.25, 0.01, 0.01)}::INT AS gate_C, ({_gate(0.5, 0.10, 0.005, 0.005)} AND {_z})::INT AS gate_D, (expected_lost >= 1 AND gated >= 1 AND {_z})::INT AS gate_E FROM recall0"""
FINAL["recall_candidates"] = f"SELECT sku_id, week, type, segment, {r('score_F1', 'score_F2', 'score_F3')}, gate_C, gate_D, gate_E FROM recalls"
FINE["rgrid"] = "SELECT formula || '_' || gate || '_' || pn || '_' || qn AS policy, formula, gate, pct_high::DOUBLE AS pct_high, pct_rest::DOUBLE AS pct_rest, quota_high::INT AS quota_high, quota_rest::INT AS quota_rest FROM (VALUES ('F1'), ('F2'), ('F3')) f(formula), (VALUES ('C'), ('D'), ('E')) g(gate), " + _pct.format("0.87, 0.85", "0.83, 0.80", "0.80, 0.75", "30, 20", "60, 40", "90, 60")
FINE["rlong"] = "SELECT sku_id, week, season_group, event_12w, expected_lost, gate_C, gate_D, gate_E, unnest(['F1', 'F2', 'F3']) AS form, unnest([score_F1, score_F2, score_F3]) AS raw FROM recalls WHERE part = 'DEV_SELECT'"
FINE["rrank"] = "SELECT *, percent_rank() OVER (PARTITION BY form, week ORDER BY raw) AS score, row_number() OVER (PARTITION BY form, week, season_group ORDER BY raw DESC, sku_id) AS rank FROM rlong"
FINE["rfound"] = f"SELECT policy, count(*) AS alerts, sum(event_12w)::BIGINT AS hits, sum(expected_lost) AS lost FROM rrank JOIN rgrid ON form = formula WHERE {_alert.replace('gate_A', 'gate_C').replace('gate_B', 'gate_D').replace('ELSE gate_C', 'ELSE gate_E').replace(chr(39) + 'A' + chr(39), chr(39) + 'C' + chr(39)).replace(chr(39) + 'B' + chr(39), chr(39) + 'D' + chr(39))} GROUP BY 1"
FINE["rtotal"] = "SELECT count(*) AS total, sum(event_12w) AS events, sum(alert) AS prior, sum(alert * event_12w) AS prior_hits FROM layered WHERE part = 'DEV_SELECT'"
FINE["reval0"] = f"""SELECT policy, coalesce(alerts, 0) AS alerts, coalesce(hits, 0) AS hits, coalesce(lost, 0) AS lost, {div("hits", "alerts")} AS precision, {div("coalesce(hits, 0)", "events")} AS recall, ({div("hits", "alerts")}) / nullif(coalesce({div("prior_hits", "prior")}, events / total::DOUBLE), 0) AS lift,
  {div("coalesce(alerts, 0) - coalesce(hits, 0)", "total - events")} AS fpr, {div("coalesce(hits, 0) + prior_hits", "coalesce(alerts, 0) + prior")} AS combined_precision, greatest(1.5 * events / total::DOUBLE, 0.55) AS floor, coalesce(alerts, 0) / total::DOUBLE AS volume FROM rgrid LEFT JOIN rfound USING (policy), rtotal"""
FINE["reval"] = """SELECT *, round(-4 * coalesce(recall, 0) - 2 * coalesce(lift, 0) - lost / 1000 + 2 * coalesce(fpr, 0) + 2 * CASE WHEN coalesce(precision, 0) < floor THEN 10 WHEN coalesce(combined_precision, 0) < floor THEN 5 ELSE 0 END
  + CASE WHEN volume > 0.03 THEN 2 WHEN volume > 0.015 THEN 0.5 ELSE 0 END, 9) AS loss, (alerts > 0 AND coalesce(precision, 0) >= floor AND coalesce(combined_precision, 0) >= floor AND coalesce(lift, 0) >= 1.5 AND coalesce(fpr, 0) <= 0.02)::INT AS valid FROM reval0"""
FINAL["recall_eval"] = f"SELECT policy, alerts, hits, {r('lost', 'precision', 'recall', 'lift', 'fpr', 'combined_precision', 'floor', 'volume', 'loss')}, valid FROM reval"
FINE["rfrozen"] = FINE["lfrozen"].replace("leval", "reval")
FINAL["recall_verdict"] = """SELECT f.policy, alerts, hits, CASE WHEN f.policy = 'NONE_VALID' OR coalesce(alerts, 0) = 0 THEN 'KEEP' WHEN coalesce(precision, 0) >= coalesce(floor, 0) AND coalesce(lift, 0) >= 2 AND coalesce(recall, 0) >= 0.03 AND coalesce(fpr, 0) <= 0.01 THEN 'PROMOTE'
  WHEN coalesce(precision, 0) >= 0.50 AND coalesce(lift, 0) >= 1.5 AND coalesce(recall, 0) >= 0.001 AND coalesce(fpr, 0) <= 0.02 THEN 'EXPERIMENTAL' ELSE 'REJECT' END AS verdict FROM rfrozen f LEFT JOIN reval e ON e.policy = f.policy"""
FINAL["missed_events"] = """SELECT stage, count(*) AS n, round(sum(expected_lost), 6) AS expected_lost, round(avg(p), 6) AS mean_p FROM (SELECT *, CASE WHEN alert = 1 THEN 'CAUGHT' WHEN difficult = 1 THEN 'DIFFICULT_NOT_SELECTED' WHEN c_run = 0 THEN 'NO_ZERO_RUN' WHEN true_zero >= 0.75 THEN 'TRUE_ZERO_LIKELY' ELSE 'OTHER' END AS stage
  FROM layered WHERE part = 'LOCKED_TEST' AND event_12w = 1) GROUP BY 1"""
_checks = (("ROWS_PRESENT", "n", "n > 0"), ("UNIQUE_ROWS", "k", "k = n"), ("SUSPICION_BOUNDS", "oob", "oob = 0"), ("PRIORITY_NOT_NEGATIVE", "neg", "neg = 0"), ("LAYERS_APART", "lap", "lap = 0"), ("LABELS_COMPLETE", "unl", "unl = 0"), ("ALL_PARTS", "parts_n", "parts_n = 5"), ("LOCKED_WEEKS", "mis", "mis = 0"), ("GRID_SIZE", "pol", "pol = 27"), ("ONE_FROZEN_POLICY", "fro", "fro = 1"))
_third = """SELECT l.*, c.type AS candidate, c.score_F1, c.score_F2, c.score_F3, c.gate_C, c.gate_D, c.gate_E, g.formula, g.gate AS gate_name, g.pct_high, g.pct_rest, g.quota_high, g.quota_rest
  FROM layered l LEFT JOIN recalls c ON c.sku_id = l.sku_id AND c.week = l.week LEFT JOIN (SELECT g.* FROM rgrid g JOIN ({}) USING (policy)) g ON true"""
for _name, _policy in (("third", "SELECT policy FROM rfrozen"), ("what", "SELECT policy FROM reval ORDER BY loss, policy LIMIT 1")):
    FINE[f"{_name}0"] = _third.format(_policy)
    FINE[f"{_name}1"] = f"SELECT *, CASE formula WHEN 'F1' THEN score_F1 WHEN 'F2' THEN score_F2 WHEN 'F3' THEN score_F3 END AS third_score, CASE gate_name WHEN 'C' THEN gate_C WHEN 'D' THEN gate_D WHEN 'E' THEN gate_E END AS passed FROM {_name}0"
    FINE[f"{_name}2"] = f"SELECT *, percent_rank() OVER (PARTITION BY week, season_group ORDER BY third_score NULLS FIRST) AS pct, row_number() OVER (PARTITION BY week, season_group ORDER BY third_score DESC NULLS LAST, sku_id) AS place FROM {_name}1"
    FINE[f"{_name}3"] = f"""SELECT * EXCLUDE (candidate), coalesce(candidate, 'NOT_CANDIDATE') AS candidate, coalesce(alert = 0 AND candidate IS NOT NULL AND passed = 1 AND pct >= CASE WHEN season_group = 'HIGH_SEASON' THEN pct_high ELSE pct_rest END
      AND place <= CASE WHEN season_group = 'HIGH_SEASON' THEN quota_high ELSE quota_rest END, false)::INT AS third FROM {_name}2"""
    FINE[f"{_name}4"] = f"SELECT *, CASE WHEN third = 1 THEN 'RECALL_SAFE' ELSE source END AS source_3, greatest(alert, third) AS alert_3 FROM {_name}3"
    FINE[f"{_name}long"] = f"SELECT season_group, candidate, event_12w, expected_lost, unnest(['STABLE', 'PRIOR', 'INCREMENTAL', 'COMBINED']) AS layer, unnest([stable, alert, third, alert_3]) AS o FROM {_name}4 WHERE part = 'LOCKED_TEST'"
    FINAL["three_layer_metrics" if _name == "third" else "third_layer_what_if_metrics"] = f"SELECT layer, scope, n, alerts, hits, events, {r('lost')}, round({div('hits', 'alerts')}, 6) AS precision, round({div('hits', 'events')}, 6) AS recall, round({div('alerts - hits', 'n - events')}, 6) AS fpr, round({div(div('hits', 'alerts'), div('events', 'n'))}, 6) AS lift FROM (" + " UNION ALL ".join(
        f"SELECT layer, {g} AS scope, count(*) AS n, sum(o)::BIGINT AS alerts, sum(o * event_12w)::BIGINT AS hits, sum(event_12w)::BIGINT AS events, sum(o * expected_lost) AS lost FROM {_name}long GROUP BY 1, 2" for g in ("'SEASON ' || season_group", "'TYPE ' || candidate", "'ALL'")) + ")"
FINAL["alert_lists"] = f"SELECT sku_id, week, season_group, source_3, {r('priority')}, seat::INT AS place, {', '.join(f'seat <= {k} AS top_{k}' for k in (50, 100, 250, 500, 1000))} FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, sku_id, week) AS seat FROM third4 WHERE part = 'LOCKED_TEST' AND alert_3 = 1) WHERE seat <= 1000"
FINAL["version_comparison"] = "SELECT part, stable, alert, alert_3, count(*) AS n, sum(event_12w)::BIGINT AS events, round(sum(expected_lost), 6) AS lost, bool_or(event_12w = 1) AS any_event, bool_and(alert_3 >= alert) AS monotone FROM third4 GROUP BY 1, 2, 3, 4"
FINAL["three_layer_alerts"] = "SELECT sku_id, week, season_group, source_3, alert_3 FROM third4"
FINAL["third_layer_what_if"] = f"SELECT sku_id, week, candidate, {r('third_score')}, third, source_3 FROM what4"
FINE["auditone"] = """SELECT count(*) AS n, count(DISTINCT (sku_id, week)) AS k, count(*) FILTER (suspected < 0 OR suspected > 1) AS oob, count(*) FILTER (priority < 0) AS neg, count(*) FILTER (stable = 1 AND second = 1) AS lap, count(*) FILTER (event_12w IS NULL) AS unl,
  count(DISTINCT part) AS parts_n, count(*) FILTER (part = 'LOCKED_TEST' AND weekofyear(week) NOT BETWEEN 28 AND 40) AS mis, (SELECT count(DISTINCT policy) FROM leval) AS pol, (SELECT count(*) FROM lfrozen) AS fro FROM layered"""
FINAL["layer_audit"] = " UNION ALL ".join(f"SELECT {i}::INT AS check_id, '{n}' AS name, {c}::BIGINT AS value, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status FROM auditone" for i, (n, c, ok) in enumerate(_checks, 1))

# studies on the finer panel
FINE["regimes"] = "SELECT *, CASE WHEN zero_share_26w >= 0.80 THEN 'EXTREME_ZERO' WHEN zero_share_26w >= 0.65 THEN 'HIGH_ZERO' WHEN zero_share_26w >= 0.50 THEN 'MODERATE_ZERO' ELSE 'LOW_ZERO' END AS regime FROM stated"
FINE["points"] = """SELECT part, y_12w, unnest(['A0', 'A1', 'A2', 'A3']) AS candidate, unnest([yhat, gated, CASE WHEN season_group = 'REST' OR state = 'OFF_SEASON' THEN gated * 0.85 ELSE gated END,
  CASE WHEN zero_share_26w >= 0.80 AND median_same = 0 AND zero_share_13w >= 0.70 THEN 0 ELSE gated END]) AS f FROM stated"""
FINAL["point_eval"] = f"""SELECT part, candidate, n, {r("wmape", "wmape_positive", "zero_over", "bias")}, round(round(2 * wmape_positive + zero_over + 0.5 * abs(bias), 9), 6) AS loss FROM (SELECT part, candidate, count(*) AS n, sum(abs(y_12w - f)) / nullif(sum(y_12w), 0) AS wmape,
  sum(CASE WHEN y_12w > 0 THEN abs(y_12w - f) END) / nullif(sum(CASE WHEN y_12w > 0 THEN y_12w END), 0) AS wmape_positive, {share("y_12w = 0 AND f > 0")} AS zero_over, sum(f - y_12w) / nullif(sum(y_12w), 0) AS bias FROM points GROUP BY 1, 2)"""
FINE["spreadrows"] = "SELECT season_group, regime, round(greatest(y_12w - gated, 0), 9) AS x FROM regimes WHERE part = 'DEV_TUNE'"
_q3 = lambda a: ", ".join(f"{q('x', k)} AS {a}{k}" for k in (80, 90, 95))
FINE["spreads"] = f"""SELECT season_group, regime, n, CASE WHEN n >= 50 THEN 'SEGMENT' ELSE 'GLOBAL' END AS level, {", ".join(f"CASE WHEN n >= 50 THEN a{k} ELSE t{k} END AS r{k}" for k in (80, 90, 95))}
  FROM (SELECT season_group, regime, count(*) AS n, {_q3("a")} FROM spreadrows GROUP BY 1, 2), (SELECT {_q3("t")} FROM spreadrows)"""
FINAL["residual_spreads"] = f"SELECT season_group, regime, n, level, {r('r80', 'r90', 'r95')} FROM spreads"
FINE["ovrows"] = "SELECT season_group, state, y_12w, round(greatest(y_12w - gated, 0), 9) AS ra, round(ln(y_12w + 1) - ln(gated + 1), 9) AS rl FROM stated WHERE part = 'DEV_TUNE'"
_ovq = "count(*) AS n, " + ", ".join(f"{q('r' + t, k)} AS {t}{k}" for t in "al" for k in (80, 90, 95)) + f", {q('y_12w', 95)} AS hist"
FINE["ovspread"] = f"SELECT 'STATE' AS level, state AS segment, {_ovq} FROM ovrows GROUP BY 1, 2 UNION ALL SELECT 'SEASON', season_group, {_ovq} FROM ovrows GROUP BY 1, 2 UNION ALL SELECT 'GLOBAL', 'ALL', {_ovq} FROM ovrows"
FINE["ovgrid"] = "SELECT method || '_CAP' || cap || '_N' || least AS candidate, method, cap::INT AS cap, least::INT AS least FROM unnest(['C1_ABS', 'C2_LOG', 'C3_HYBRID', 'C4_MINIMAL']) t(method), unnest([0, 2, 3]) u(cap), unnest([300, 500, 1000]) v(least)"
_own = lambda c: f"coalesce(s.{c}, g.{c}, t.{c})"
_pick = lambda c: f"CASE WHEN {_own('n')} >= k.least THEN {_own(c)} ELSE t.{c} END"


def _raw(k: int) -> str:
    plain, log = f"(gated + {_pick(f'a{k}')})", f"greatest(0, exp(ln(gated + 1) + {_pick(f'l{k}')}) - 1)"
    raw = f"CASE k.method WHEN 'C1_ABS' THEN {plain} WHEN 'C2_LOG' THEN {log} WHEN 'C3_HYBRID' THEN CASE WHEN x.state IN ('OFF_SEASON', 'TRANSITION_DOWN') OR x.season_group = 'REST' THEN {plain} ELSE {log} END ELSE gated + 0.5 * {_own(f'a{k}')} END"
    return f"CASE WHEN k.cap = 0 THEN {raw} ELSE least({raw}, greatest(gated * k.cap, gated + {_own('hist')})) END AS w{k}"


_overlay = lambda rows, grid: f"""SELECT *, round(greatest(p80, w90), 9) AS p90 FROM (SELECT *, round(greatest(gated, w80), 9) AS p80 FROM (SELECT x.*, k.candidate, {_raw(80)}, {_raw(90)}, {_raw(95)} FROM ({rows}) x
  LEFT JOIN (SELECT * FROM ovspread WHERE level = 'STATE') s ON s.segment = x.state LEFT JOIN (SELECT * FROM ovspread WHERE level = 'SEASON') g ON g.segment = x.season_group, (SELECT * FROM ovspread WHERE level = 'GLOBAL') t, {grid} k))"""  # noqa: E731
FINE["ovlong"] = "SELECT *, round(greatest(p90, w95), 9) AS p95 FROM (" + _overlay("SELECT season_group, state, gated, y_12w FROM stated WHERE part = 'DEV_SELECT'", "ovgrid") + ")"
FINE["oveval"] = f"""SELECT *, round(1.5 * (abs(viol_80 - 0.10) + abs(viol_90 - 0.04) + abs(viol_95 - 0.01)) + 0.1 * greatest(spread - 20, 0) + 0.05 * spread_rest, 6) AS loss FROM (
  SELECT candidate, count(*) AS n, {", ".join(f"{share(f'y_12w > p{k}')} AS viol_{k}" for k in (80, 90, 95))}, avg(p90 - gated) AS spread, coalesce(avg(CASE WHEN season_group = 'REST' THEN p90 - gated END), 0) AS spread_rest FROM ovlong GROUP BY 1)"""
FINAL["overlay_spreads"] = f"SELECT level, segment, n, {r(*(f'{t}{k}' for t in 'al' for k in (80, 90, 95)), 'hist')} FROM ovspread"
FINAL["overlay_eval"] = f"SELECT candidate, n, {r('viol_80', 'viol_90', 'viol_95', 'spread', 'spread_rest', 'loss')} FROM oveval"
FINE["ovfinal"] = "SELECT *, round(greatest(p90, w95), 9) AS p95 FROM (" + _overlay("SELECT sku_id, week, part, season_group, state, gated, regime, y_12w FROM regimes", "(SELECT g.* FROM ovgrid g JOIN (SELECT candidate FROM oveval ORDER BY loss, candidate LIMIT 1) USING (candidate))") + ")"
FINAL["overlay_forecast"] = "SELECT sku_id, week, part, candidate, regime, round(gated, 6) AS p50, round(p80, 6) AS o80, round(p90, 6) AS o90, round(p95, 6) AS o95, round(p90 - gated, 6) AS spread_90, round(y_12w, 6) AS y_12w FROM ovfinal"

# allocation, on the coarser panel
COARSE["geo"] = "SELECT sku_id, province, date_trunc('week', d)::DATE AS week, sum(units) AS units FROM fact WHERE units > 0 GROUP BY 1, 2, 3"
COARSE["famunits"] = "SELECT sku_id, family, sum(greatest(units, 0)) AS u FROM fact GROUP BY 1, 2"
COARSE["meta"] = "SELECT f.sku_id, f.family, first_day, last_day, provinces FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY u DESC, family) AS n FROM famunits) f JOIN (SELECT sku_id, min(d) AS first_day, max(d) AS last_day, count(DISTINCT province) AS provinces FROM fact GROUP BY 1) s ON s.sku_id = f.sku_id WHERE f.n = 1"
FINAL["sku_metadata"] = "SELECT sku_id, family, first_day, last_day, provinces FROM meta"
FINAL["weekly_geo"] = f"SELECT sku_id, province, week, {r('units')} FROM geo"
COARSE["nat"] = "SELECT * FROM fc WHERE split = 'VAL'"
COARSE["decw"] = "SELECT DISTINCT week AS dw FROM nat"
COARSE["placed"] = "SELECT dw, g.sku_id, family, province, units, g.week FROM geo g JOIN meta USING (sku_id) JOIN decw ON g.week <= dw AND g.week > dw - 364"
COARSE["own"] = "SELECT dw, sku_id, family, province, sum(units) AS units, count(DISTINCT week) AS n_weeks FROM placed GROUP BY 1, 2, 3, 4"
COARSE["fam"] = "SELECT dw, family, province, sum(units) / sum(sum(units)) OVER (PARTITION BY dw, family) AS family_share FROM placed GROUP BY 1, 2, 3"
COARSE["glo"] = "SELECT dw, province, sum(units) / sum(sum(units)) OVER (PARTITION BY dw) AS global_share FROM placed GROUP BY 1, 2"
COARSE["dir0"] = """SELECT o.sku_id, o.province, o.dw AS week, units, n_weeks, sum(units) OVER w AS n_total, count(*) OVER w AS n_places, CASE WHEN units >= 5 OR n_weeks >= 3 THEN 'sku' WHEN family_share IS NOT NULL THEN 'family' ELSE 'global' END AS level, family_share, global_share
  FROM own o LEFT JOIN fam f ON f.dw = o.dw AND f.family = o.family AND f.province = o.province LEFT JOIN glo g ON g.dw = o.dw AND g.province = o.province WINDOW w AS (PARTITION BY o.sku_id, o.dw)"""
COARSE["dir1"] = "SELECT *, coalesce(CASE WHEN level <> 'global' THEN family_share END, global_share, 1.0 / n_places) AS prior, CASE level WHEN 'sku' THEN 10 WHEN 'family' THEN 25 ELSE 50 END::DOUBLE AS alpha FROM dir0"
COARSE["dir"] = "SELECT *, (units + alpha * prior) / (n_total + alpha) AS weight FROM dir1"
FINAL["dirichlet_base"] = f"SELECT sku_id, province, week, {r('units', 'n_total', 'alpha', 'prior', 'weight')}, n_weeks, level FROM dir"
COARSE["alloc"] = f"SELECT d.sku_id, d.week, province, level, share, {', '.join(f'share * n.{c} AS {c}' for c in ('yhat', 'q80', 'q90', 'q95'))} FROM (SELECT *, weight / sum(weight) OVER (PARTITION BY sku_id, week) AS share FROM dir) d JOIN nat n ON n.sku_id = d.sku_id AND n.week = d.week"
FINAL["dirichlet_alloc"] = f"SELECT sku_id, week, province, level, {r('share', 'yhat', 'q80', 'q90', 'q95')} FROM alloc"
FINAL["dirichlet_fixed"] = """SELECT n.sku_id, n.week, province, coalesce(rule, 'E_NONE') AS rule, round(share, 6) AS share FROM nat n LEFT JOIN (SELECT sku_id, week, province, CASE WHEN c = 1 THEN 'D_SINGLE' WHEN raw > 0 THEN 'A_RAW' WHEN pri > 0 THEN 'B_PRIOR' ELSE 'C_EQUAL' END AS rule,
  CASE WHEN c = 1 THEN 1 WHEN raw > 0 THEN weight / raw WHEN pri > 0 THEN prior / pri ELSE 1.0 / c END AS share FROM (SELECT *, count(*) OVER w AS c, sum(weight) OVER w AS raw, sum(prior) OVER w AS pri FROM dir WINDOW w AS (PARTITION BY sku_id, week))) d ON d.sku_id = n.sku_id AND d.week = n.week"""
FINAL["reconciliation"] = """SELECT status, count(*) AS n, round(sum(yhat), 6) AS "national", round(sum(sy), 6) AS provincial FROM (SELECT n.yhat, sy, CASE WHEN places IS NULL THEN 'NO_GEO' WHEN abs(sh - 1) <= 1e-9 AND abs(sy - n.yhat) <= 0.001 AND abs(sq - n.q90) <= 0.001 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM nat n LEFT JOIN (SELECT sku_id, week, count(*) AS places, sum(share) AS sh, sum(yhat) AS sy, sum(q90) AS sq FROM alloc GROUP BY 1, 2) a ON a.sku_id = n.sku_id AND a.week = n.week) GROUP BY 1"""
FINAL["historic_shares"] = """SELECT sku_id, province, round(units, 6) AS units, round(share, 6) AS share, round(sum(share * share) OVER (PARTITION BY sku_id), 6) AS hhi, row_number() OVER (PARTITION BY sku_id ORDER BY units DESC, province)::INT AS rank
  FROM (SELECT sku_id, province, units, units / sum(units) OVER (PARTITION BY sku_id) AS share FROM (SELECT sku_id, province, sum(units) AS units FROM geo WHERE week <= DATE '1998-12-31' GROUP BY 1, 2))"""
FINAL["national_export"] = """SELECT n.sku_id, week, family, round(yhat, 6) AS yhat, round(q80, 6) AS q80, round(q90, 6) AS q90, round(q95, 6) AS q95, round(q90 - yhat, 6) AS buffer_90, round(q95 - yhat, 6) AS buffer_95,
  CASE WHEN round(p, 9) >= 0.80 THEN 'CRITICAL' WHEN round(p, 9) >= 0.60 THEN 'HIGH' WHEN round(p, 9) >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS tier, round(p * q90, 6) AS score FROM nat n LEFT JOIN meta m ON m.sku_id = n.sku_id"""
COARSE["hidden"] = f"SELECT sku_id, week, part, yhat, q90, p, {', '.join(f'CASE WHEN part <> {chr(39)}LOCKED_TEST{chr(39)} THEN {c} END AS {c}' for c in ('y_12w', 'event_12w', 'lost_12w'))} FROM (SELECT *, {_part} AS part FROM nat)"
FINAL["blind_masking"] = f"SELECT sku_id, week, part, {r('yhat', 'q90', 'p', 'y_12w', 'lost_12w')}, event_12w FROM hidden"
FINAL["blind_check"] = """SELECT *, CASE WHEN labels = 0 AND events = 0 AND first_week >= 28 AND last_week <= 40 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS n, count(y_12w) AS labels, count(event_12w) AS events, min(weekofyear(week))::INT AS first_week, max(weekofyear(week))::INT AS last_week FROM hidden WHERE part = 'LOCKED_TEST')"""
FINAL["whole_units"] = """SELECT sku_id, week, province, (f + CASE WHEN row_number() OVER (PARTITION BY sku_id, week ORDER BY round(v - f, 6) DESC, province) <= rest THEN 1 ELSE 0 END)::BIGINT AS whole FROM (SELECT *, round(sum(v) OVER w) - sum(f) OVER w AS rest FROM (SELECT sku_id, week, province, round(q90, 6) AS v, floor(round(q90, 6)) AS f FROM alloc) WINDOW w AS (PARTITION BY sku_id, week))"""

# diagnostics
COARSE["shiftrows"] = "SELECT split, season_group, CASE WHEN active THEN round((y_12w - yhat) / scale, 9) END AS s FROM scores WHERE split IN ('CALIB', 'VAL')"
FINAL["score_shift"] = f"SELECT split, season_group, n, {r('mean', 'std', 's10', 's50', 's90', 's95')} FROM (SELECT split, season_group, count(s) AS n, avg(s) AS mean, stddev_samp(s) AS std, {', '.join(f'{q("s", k)} AS s{k}' for k in (10, 50, 90, 95))} FROM shiftrows GROUP BY 1, 2)"
COARSE["bysplit"] = f"SELECT season_group, split, avg(y_12w) AS m, {share('y_12w = 0')} AS z, avg(event_12w) AS e FROM scores GROUP BY 1, 2"
FINAL["distribution_shift"] = "SELECT season_group, " + ", ".join(f"round(max({a}) FILTER (split = '{s}'), 6) AS {s.lower()}_{n}" for s in ("TRAIN", "CALIB", "VAL") for a, n in (("m", "mean"), ("z", "zero"), ("e", "rate"))) + ", " + ", ".join(f"round(100 * ((max(m) FILTER (split = '{s}') - max(m) FILTER (split = 'TRAIN')) / nullif(max(m) FILTER (split = 'TRAIN'), 0)), 6) AS {s.lower()}_shift_pct" for s in ("CALIB", "VAL")) + " FROM bysplit GROUP BY 1"
_band = lambda c, *cuts: " + ".join(f"CASE WHEN coalesce({c}, 0) >= {x} THEN 1 ELSE 0 END" for x in cuts)
FINAL["difficulty_score"] = f"""SELECT season_group, decile, n, {r("zero_rate", "cv", "wmape_positive", "zero_over")}, ({_band("zero_rate", 0.50, 0.65, 0.80)} + {_band("cv", 3, 5, 10)} + {_band("wmape_positive", 1, 1.5, 3)} + {_band("zero_over", 0.70, 0.85)})::INT AS difficulty,
  CASE WHEN zero_rate >= 0.80 THEN 'EXTREME' WHEN zero_rate >= 0.65 THEN 'HIGH' WHEN zero_rate >= 0.50 THEN 'MODERATE' ELSE 'LOW' END AS regime FROM (SELECT season_group, decile, count(*) AS n, avg(zero_share_26w) AS zero_rate, round(stddev_samp(y) / nullif(avg(y), 0), 9) AS cv,
  sum(CASE WHEN y_12w > 0 THEN abs(y_12w - yhat) END) / nullif(sum(CASE WHEN y_12w > 0 THEN y_12w END), 0) AS wmape_positive, {share("y_12w = 0 AND yhat > 0")} AS zero_over FROM fc WHERE split = 'VAL' GROUP BY 1, 2)"""
COARSE["byweek"] = f"SELECT season_group, week, sum(abs(y_12w - yhat)) / nullif(sum(y_12w), 0) AS wmape, {share('y_12w > q90')} AS viol, avg(event_12w) AS rate, count(*) AS skus FROM fc WHERE split = 'VAL' GROUP BY 1, 2"
FINAL["weekly_stability"] = f"""SELECT season_group, weeks, {r(*(f"{n}_{c}" for c in ("wmape", "viol", "rate") for n in ("mean", "std")))}, least_skus, most_skus, round(std_wmape / nullif(mean_wmape, 0), 6) AS cv_wmape FROM (
  SELECT season_group, count(*) AS weeks, {", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}" for c in ("wmape", "viol", "rate"))}, min(skus) AS least_skus, max(skus) AS most_skus FROM byweek GROUP BY 1)"""
FINAL["quantile_collapse"] = f"SELECT split, n, {r('mean_spread', 'std_spread', 'equal_80_90', 'equal_90_95', 'viol_80', 'viol_95')} FROM (SELECT split, count(*) AS n, avg(q95 - q80) AS mean_spread, stddev_samp(q95 - q80) AS std_spread, {share('q80 = q90')} AS equal_80_90, {share('q90 = q95')} AS equal_90_95, {share('y_12w > q80')} AS viol_80, {share('y_12w > q95')} AS viol_95 FROM fc GROUP BY 1)"
FINAL["guardrails"] = f"""SELECT season_group, n, {r("ratio_median", "ratio_90", "ratio_weighted", "over_under", "cap_rate", "viol_90")}, CASE WHEN cap_rate > 0.05 THEN 'FAIL_CAP' WHEN over_under > 3 THEN 'FAIL_OVER_UNDER' WHEN viol_90 NOT BETWEEN 0.08 AND 0.12 THEN 'FAIL_COVERAGE' WHEN ratio_median <= 3.5 THEN 'PASS_MEDIAN' WHEN ratio_weighted <= 3.5 THEN 'PASS_WEIGHTED' ELSE 'WARN_RATIO' END AS status
  FROM (SELECT season_group, count(*) AS n, {q("CASE WHEN yhat >= 5 THEN round(q90 / nullif(yhat, 0), 9) END", 50)} AS ratio_median, {q("CASE WHEN yhat >= 5 THEN round(q90 / nullif(yhat, 0), 9) END", 90)} AS ratio_90, sum(q90) / nullif(sum(yhat), 0) AS ratio_weighted,
  sum(greatest(q90 - y_12w, 0)) / nullif(sum(greatest(y_12w - q90, 0)), 0) AS over_under, {share("q90 >= cap")} AS cap_rate, {share("y_12w > q90")} AS viol_90 FROM fc WHERE split = 'VAL' GROUP BY 1)"""
COARSE["vifrows"] = "SELECT season_group, child, y_12w - yhat AS e, scale * scale AS s2 FROM resid WHERE score IS NOT NULL"
FINAL["variance_inflation"] = """SELECT k.season_group, child, k.n, CASE WHEN k.n >= 50 THEN 'CHILD' WHEN s.n >= 100 THEN 'SEASON' ELSE 'GLOBAL' END AS level, round(sqrt(greatest(1, CASE WHEN k.n >= 50 THEN k.v WHEN s.n >= 100 THEN s.v ELSE (SELECT var_pop(e) / avg(s2) FROM vifrows) END)), 6) AS inflation
  FROM (SELECT season_group, child, count(*) AS n, var_pop(e) / nullif(avg(s2), 0) AS v FROM vifrows GROUP BY 1, 2) k JOIN (SELECT season_group, count(*) AS n, var_pop(e) / nullif(avg(s2), 0) AS v FROM vifrows GROUP BY 1) s ON s.season_group = k.season_group"""
COARSE["leakone"] = """SELECT count(*) AS n, count(*) FILTER (n_future <> 12) AS inc, count(DISTINCT (sku_id, week)) AS k, count(*) FILTER (y_12w IS NULL) AS unl, max(week) FILTER (split = 'TRAIN') AS tr, min(week) FILTER (split = 'CALIB') AS c0, max(week) FILTER (split = 'CALIB') AS c1, min(week) FILTER (split = 'VAL') AS v FROM scores"""
_leaks = (("WINDOW_COMPLETE", "inc = 0"), ("LABELS_PRESENT", "unl = 0"), ("UNIQUE_ROWS", "k = n"), ("TRAIN_DATES", "tr <= DATE '1998-12-31'"), ("CALIB_DATES", "c0 > DATE '1998-12-31' AND c1 <= DATE '1999-12-31'"), ("VAL_DATES", "v >= DATE '2000-01-03'"), ("TRAIN_BEFORE_VAL", "tr < v"))
COARSE["leaks"] = " UNION ALL ".join(f"SELECT '{n}' AS name, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status FROM leakone" for n, ok in _leaks)
FINAL["leakage_checks"] = "SELECT name, status FROM leaks"
_mono = " OR ".join(f"q{b} < q{a}" for a, b in zip(LEVELS, LEVELS[1:], strict=False))
COARSE["gates"] = f"""SELECT CASE WHEN (SELECT count(*) FROM leaks WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS b1_leakage, (SELECT CASE WHEN bool_and(viol_90 BETWEEN 0.08 AND 0.12 AND n >= 50) THEN 'PASS' ELSE 'FAIL' END FROM cov WHERE scope = 'FULL_VAL' AND season_group <> 'ALL') AS b3_coverage,
  (SELECT CASE WHEN count(*) FILTER ({_mono}) = 0 THEN 'PASS' ELSE 'FAIL' END FROM fc WHERE split = 'VAL') AS b3c_order, (SELECT CASE WHEN max(c) <= 0.05 THEN 'PASS' ELSE 'WARN' END FROM (SELECT season_group, {share("q90 >= cap")} AS c FROM fc WHERE split = 'VAL' GROUP BY 1)) AS b3d_cap,
  (SELECT CASE WHEN mean_lift >= 1.5 THEN 'PASS' WHEN mean_lift >= 1.0 THEN 'CONDITIONAL' ELSE 'FAIL' END FROM best) AS b4_lift"""
COARSE["verdicts"] = "SELECT *, CASE WHEN failed = '' THEN 'DEPLOY' ELSE 'HOLD' END AS verdict FROM (SELECT *, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} = 'FAIL' THEN '{c}' END" for c in ("b1_leakage", "b3_coverage", "b3c_order", "b4_lift")) + "], lambda x: x IS NOT NULL), ',') AS failed FROM gates)"
FINAL["gate_verdict"] = "SELECT b1_leakage, b3_coverage, b3c_order, b3d_cap, b4_lift, failed, verdict FROM verdicts"
FINAL["run_summary"] = """SELECT n AS "rows", skus, weeks, val_events, round(wmape, 6) AS wmape, round(bias_pct, 6) AS bias_pct, verdict, failed, verdict || ' rows=' || n || ' skus=' || skus AS summary FROM (SELECT count(*) AS n, count(DISTINCT sku_id) AS skus, count(DISTINCT week) AS weeks, sum(event_12w) FILTER (split = 'VAL')::BIGINT AS val_events FROM fc),
  (SELECT wmape, bias_pct FROM deval WHERE season_group = 'ALL'), (SELECT verdict, failed FROM verdicts)"""
FINAL["split_weeks"] = "SELECT week, row_number() OVER (ORDER BY week)::INT AS number, CASE WHEN week <= (SELECT cut FROM tunecut) THEN 'TUNE' ELSE 'TEST' END AS part FROM (SELECT DISTINCT week FROM scores WHERE split = 'VAL')"
FINAL["split_profile"] = f"""SELECT split, n, {r("mean", "std", *(f"p{k}" for k in (5, 25, 50, 75, 95, 99)), "zero_weeks")}, round(skew, 6) AS skew, round(cv, 6) AS cv FROM (SELECT split, count(*) AS n, avg(y_12w) AS mean, stddev_samp(y_12w) AS std, sqrt(count(*)) * sum(pow(y_12w - m, 3)) / pow(sum(pow(y_12w - m, 2)), 1.5) AS skew,
  {", ".join(f"{q('y_12w', k)} AS p{k}" for k in (5, 25, 50, 75, 95, 99))}, {share("y = 0")} AS zero_weeks, stddev_samp(y_12w) / nullif(avg(y_12w), 0) AS cv FROM (SELECT *, avg(y_12w) OVER (PARTITION BY split) AS m FROM scores) GROUP BY 1)"""
_seg = f"count(*) AS n, {share('y_12w > q90')} AS viol_90, avg(scale) AS scale, avg(abs(y_12w - yhat) / scale) AS scaled_miss FROM fc WHERE split = 'VAL' AND active GROUP BY 1"
FINAL["diag_segments"] = f"SELECT segment, n, {r('viol_90', 'scale', 'scaled_miss')} FROM (" + " UNION ALL ".join(f"SELECT {c} AS segment, {_seg}" for c in ("season_group", "'decile ' || decile", "'bucket ' || bucket", "child")) + ")"
FINAL["active_scope"] = f"SELECT split, season_group, n, {r('active', 'amplitude')}, segments FROM (SELECT split, season_group, count(*) AS n, {share('active')} AS active, avg(amplitude) AS amplitude, count(DISTINCT child) AS segments FROM seg GROUP BY 1, 2)"

# studies
COARSE["sold"] = "SELECT sku_id, count(*) AS weeks, count(CASE WHEN y > 0 THEN y END) AS sales, avg(CASE WHEN y > 0 THEN y END) AS mean, round(stddev_samp(CASE WHEN y > 0 THEN y END), 9) AS std FROM panel WHERE week <= DATE '1998-12-31' GROUP BY 1"
FINAL["demand_class"] = f"""SELECT sku_id, weeks, sales, {r("mean", "std", "adi", "cv2")}, CASE WHEN sales = 0 THEN 'NO_SALES' WHEN adi < 1.32 AND coalesce(cv2, 0) < 0.49 THEN 'SMOOTH' WHEN adi < 1.32 THEN 'ERRATIC' WHEN coalesce(cv2, 0) < 0.49 THEN 'INTERMITTENT' ELSE 'LUMPY' END AS class
  FROM (SELECT *, {div("weeks", "sales")} AS adi, round(pow({div("std", "mean")}, 2), 9) AS cv2 FROM sold)"""
FINAL["target_encoding"] = f"SELECT sku_id, n, round(mean, 6) AS mean, round((mean * n + g * 30) / (n + 30), 6) AS encoded, round(least(mean, cap), 6) AS capped FROM (SELECT sku_id, count(*) AS n, avg(y_12w) AS mean FROM scores WHERE split = 'TRAIN' GROUP BY 1), (SELECT avg(y_12w) AS g, {q('y_12w', 99.5)} AS cap FROM scores WHERE split = 'TRAIN')"
FINAL["walk_forward"] = "SELECT week, count(DISTINCT sku_id) AS skus, round(avg(abs(y_12w - yhat)), 6) AS mae, round(sum(abs(y_12w - yhat)) / nullif(sum(y_12w), 0), 6) AS wmape FROM fc WHERE split = 'VAL' GROUP BY 1"
COARSE["sources3"] = "SELECT y_12w, unnest(['CONFORMAL', 'LAGGED', 'WIDE']) AS source, unnest([yhat, 12 * coalesce(lag_1, 0), yhat]) AS f, unnest([q80, q80, q85]) AS a, unnest([q90, q90, q95]) AS b, unnest([q95, q95, q99]) AS c FROM fc WHERE split = 'VAL'"
FINAL["composite_loss"] = f"""SELECT source, n, {r("v80", "v90", "v95", "wmape_positive", "zero_over", "non_monotone")}, round(2 * abs(v80 - 0.20) + 3 * abs(v90 - 0.10) + 2 * abs(v95 - 0.05) + wmape_positive + 0.5 * zero_over + 10 * non_monotone, 6) AS loss FROM (SELECT source, count(*) AS n, {share("y_12w > a")} AS v80, {share("y_12w > b")} AS v90, {share("y_12w > c")} AS v95,
  sum(CASE WHEN y_12w > 0 THEN abs(y_12w - f) END) / nullif(sum(CASE WHEN y_12w > 0 THEN y_12w END), 0) AS wmape_positive, {share("y_12w = 0 AND f > 0")} AS zero_over, {share("b < a OR c < b")} AS non_monotone FROM sources3 GROUP BY 1)"""
FINAL["newsvendor"] = f"""SELECT season_group, n, {r("stock", "served", "fill", "stock_ratio", "stock_on_zero", "cost")} FROM (SELECT season_group, count(*) AS n, sum(stock) AS stock, sum(least(y_12w, stock)) AS served, sum(least(y_12w, stock)) / nullif(sum(y_12w), 0) AS fill, sum(stock) / nullif(sum(y_12w), 0) AS stock_ratio,
  sum(CASE WHEN y_12w = 0 THEN stock ELSE 0 END) AS stock_on_zero, 10 * sum(greatest(y_12w - stock, 0)) + sum(greatest(stock - y_12w, 0)) AS cost FROM (SELECT *, greatest(yhat + 1.3351777 * scale, 0) AS stock FROM fc WHERE split = 'VAL') GROUP BY 1)"""
COARSE["flows"] = "SELECT sku_id, week, row_number() OVER (PARTITION BY sku_id ORDER BY week) AS t, y AS demand, floor(coalesce(avg(y) OVER (PARTITION BY sku_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) + 0.5) AS repl FROM panel"
FINAL["inventory"] = """SELECT * FROM (WITH RECURSIVE sim AS (SELECT sku_id, t, week, demand, least(repl, demand) AS served, repl - least(repl, demand) AS ending FROM flows WHERE t = 1
  UNION ALL SELECT f.sku_id, f.t, f.week, f.demand, least(s.ending + f.repl, f.demand), s.ending + f.repl - least(s.ending + f.repl, f.demand) FROM sim s JOIN flows f ON f.sku_id = s.sku_id AND f.t = s.t + 1)
  SELECT sku_id, sum(demand) AS demand, sum(served) AS served, round(sum(served) / nullif(sum(demand), 0), 6) AS fill, count(*) FILTER (demand > served) AS short_weeks, round(avg(ending), 6) AS mean_stock, arg_max(ending, week) AS last_stock FROM sim GROUP BY 1)"""
FINAL["smoothed_demand"] = """SELECT a.sku_id, a.week, round(sum(b.y * pow(7.0::DOUBLE / 9, a.at - b.at - 1)) / nullif(sum(CASE WHEN b.at IS NOT NULL THEN pow(7.0::DOUBLE / 9, a.at - b.at - 1) END), 0), 6) AS smoothed FROM numb a LEFT JOIN numb b ON b.sku_id = a.sku_id AND b.at < a.at GROUP BY 1, 2"""
COARSE["numb"] = "SELECT sku_id, week, y, row_number() OVER (PARTITION BY sku_id ORDER BY week) AS at FROM panel"

_FINE_NAMES = {"overlay_spreads", "overlay_forecast", "alert_lists", "version_comparison", "three_layer_alerts", "three_layer_metrics", "third_layer_what_if", "third_layer_what_if_metrics", "season_profile", "season_state", "state_summary", "offseason_gate", "breakdown_metrics", "state_calibration", "recent_sales", "oos_features", "oos_policy_eval", "oos_frozen", "oos_scores", "flag_metrics", "topk_curve", "weekly_topk", "difficult_scores", "layer_eval", "layer_frozen", "combined_alerts", "layer_metrics", "uplift_verdict", "recall_candidates", "recall_eval", "recall_verdict", "missed_events", "layer_audit", "point_eval", "residual_spreads", "overlay_eval"}
ORACLES = {name: oracle(name, FINE if name in _FINE_NAMES else COARSE, FINAL) for name in FINAL}
