"""DuckDB SQL for the catalog's queries, over the same tables."""

from __future__ import annotations

from ..sources import fixed


def r(x: str, digits: int) -> str:
    p = 10**digits
    return f"floor(({x}) * {p}.0 + 0.5) / {p}.0"


BARS = "SELECT o_orderdate::DATE AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1"
SYM = "SELECT p_brand AS sym, l_shipdate::DATE AS d, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
SECTOR = "SELECT o_orderpriority AS sym, o_orderdate::DATE AS d, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS close FROM orders GROUP BY 1, 2"
BENCH = "SELECT o_orderdate::DATE AS d, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS close FROM orders GROUP BY 1"
_WHO = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
REGION = f"SELECT r_name AS sym, 'region' AS type, o_orderdate::DATE AS d, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS close FROM {_WHO} GROUP BY ALL UNION ALL SELECT c_mktsegment, 'style', o_orderdate::DATE, sum(o_totalprice::DECIMAL(18,2))::DOUBLE FROM {_WHO} GROUP BY ALL"
QUOTES = "SELECT sym, arg_max(close, d) AS price, CASE WHEN count(*) > 1 THEN arg_min(close, d) END AS prev_close FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d DESC) AS rn FROM sym) WHERE rn <= 2 GROUP BY sym"
HEAD = f"WITH bars AS ({BARS}), sym AS ({SYM}), sector AS ({SECTOR}), bench AS ({BENCH}), region_ AS ({REGION})"
_W = "PARTITION BY sym ORDER BY d"

SCORED = """scored0 AS (SELECT s.*, p.weight, p.invert, p.win, row_number() OVER w AS rn, sum(y::DECIMAL(30,8)) OVER (PARTITION BY s.id ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM series s JOIN specs p ON s.id = p.id WINDOW w AS (PARTITION BY s.id ORDER BY d)),
scored1 AS (SELECT *, (cum - coalesce(lag(cum, win) OVER (PARTITION BY id ORDER BY d), 0))::DOUBLE / win AS ma FROM scored0),
scored2 AS (SELECT *, CASE WHEN ma = 0 THEN CASE WHEN y > 0 THEN 'inf'::DOUBLE WHEN y < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE y / ma END AS ratio FROM scored1 WHERE rn >= win),
scored3 AS (SELECT *, """ + r("100.0 * cume_dist() OVER (PARTITION BY id ORDER BY ratio)", 1) + """ AS pct FROM scored2),
scored AS (SELECT *, CASE WHEN invert THEN """ + r("100 - pct", 1) + " ELSE pct END AS score FROM scored3)"

PRICE_SERIES = "series AS (SELECT 'market' AS id, d, close AS y FROM bars UNION ALL SELECT sym, d, close FROM sector)"
PRICE_SPECS = "specs AS (SELECT * FROM (VALUES ('market', 10, true, 50), ('1-URGENT', 11, false, 50), ('2-HIGH', 12, false, 50), ('3-MEDIUM', 13, false, 50), ('4-NOT SPECIFIED', 14, false, 50), ('5-LOW', 15, false, 50)) AS t(id, weight, invert, win))"
MANUAL = "manual AS (SELECT id, DATE '1970-01-01' + ord AS d, y FROM (VALUES " + ", ".join(f"('{i}', {k}, {float(v)}::DOUBLE)" for i, _, _, _, points in fixed.MANUAL.values() for k, (_, v) in enumerate(points)) + ") AS t(id, ord, y))"
_SPECS = [(i, k, w, inv, n, charted, shown or "NULL", fixed.PERIODS.get(i, "day"), i in fixed.PERIODS) for k, (i, (w, inv, n, charted, shown)) in enumerate(fixed.FACTORS.items())]
FACTOR_SPECS = "specs AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {k}, {w}, {inv}, {n}, {c}, {shown}::INTEGER, '{label}', {exact})" for i, k, w, inv, n, c, shown, label, exact in _SPECS) + ") AS t(id, ord, weight, invert, win, charted, shown, period_label, exact))"

FLAGS = f"""flags0 AS (SELECT sym, d, close, row_number() OVER w AS rn, lag(close) OVER w AS prev, max(close) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS hi, min(close) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS lo, avg(close) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS sma,
max(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, min(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bottom FROM sym WINDOW w AS ({_W})),
flags AS (SELECT sym, d, close > prev AS up, close >= hi AS new_high, close <= lo AS new_low, CASE WHEN rn >= 200 THEN close > sma END AS above_sma, close >= top AS at_high, close <= bottom AS at_low FROM flags0 WHERE rn > 1)"""


def _share(k: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN floor({k}::DOUBLE / {n} * 1000 + 0.5) / 10.0 END"


DAYS = f"""days0 AS (SELECT d, count(*) FILTER (WHERE up) AS advances, count(*) FILTER (WHERE NOT up) AS declines, count(*) FILTER (WHERE new_high) AS new_highs, count(*) FILTER (WHERE new_low) AS new_lows, count(*) FILTER (WHERE above_sma) AS above, count(above_sma) AS covered, count(*) FILTER (WHERE at_high) AS at_highs, count(*) FILTER (WHERE at_low) AS at_lows, count(*) AS n FROM flags GROUP BY d),
days AS (SELECT d, advances, declines, new_highs, new_lows, {_share('above', 'covered')} AS pct_above_sma, at_highs, {_share('at_highs', 'n')} AS pct_at_highs, at_lows, {_share('at_lows', 'n')} AS pct_at_lows, (sum(advances - declines) OVER (ORDER BY d))::BIGINT AS ad_line FROM days0)"""

TR = "tr AS (SELECT d, close, greatest(high - low, abs(high - lag(close) OVER (ORDER BY d)), abs(low - lag(close) OVER (ORDER BY d))) AS tr, row_number() OVER (ORDER BY d) AS rn FROM bars)"
ATR = "atr AS (SELECT d, avg(tr) OVER (ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / close * 100 AS y, rn FROM tr)"
CREDIT = """credit0 AS (SELECT a.d, a.close / b.close AS y FROM (SELECT * FROM sector WHERE sym = '1-URGENT') a ASOF JOIN (SELECT * FROM sector WHERE sym = '2-HIGH') b ON a.d >= b.d WHERE b.close != 0),
credit1 AS (SELECT *, row_number() OVER (ORDER BY d DESC) AS rn, count(*) OVER () AS n FROM credit0),
credit AS (SELECT d, y / (SELECT y FROM credit1 WHERE rn = least(504, n)) * 100 AS y FROM credit1)"""
ERRORS = "errs AS (SELECT ts::DATE AS d, count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*) FILTER (WHERE event_type = 'view') AS y FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'view') > 0)"
FACTOR_SERIES = f"""{FLAGS}, {DAYS}, {TR}, {ATR}, {CREDIT}, {ERRORS}, {MANUAL},
series AS (SELECT 'breadthadline' AS id, d, ad_line::DOUBLE AS y FROM days UNION ALL SELECT 'breadthhilo', d, (new_highs - new_lows)::DOUBLE FROM days UNION ALL SELECT 'breadthpct200', d, pct_above_sma FROM days WHERE pct_above_sma IS NOT NULL
UNION ALL SELECT 'credit', d, y FROM credit UNION ALL SELECT 'vix', d, close FROM sector WHERE sym = '3-MEDIUM' UNION ALL SELECT 'realizedvol', d, y FROM atr WHERE rn >= 14 UNION ALL SELECT 'momentum', d, close FROM bars UNION ALL SELECT 'putcall', d, y FROM errs UNION ALL SELECT * FROM manual)"""
COMPONENTS = f"""last_ AS (SELECT id, arg_max(y, d) AS y, count(*) AS n FROM series GROUP BY id),
ranks AS (SELECT s.id, l.y, {r('100.0 * count(*) FILTER (WHERE s.y <= l.y) / count(*)', 0)} AS percentile FROM series s JOIN last_ l ON s.id = l.id GROUP BY s.id, l.y),
means AS (SELECT id, sum(y::DECIMAL(30,8))::DOUBLE / 90 AS m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC) AS k FROM series) WHERE k <= 90 GROUP BY id HAVING count(*) = 90),
newest AS (SELECT id, arg_max(ma, d) AS ma, arg_max(ratio, d) AS ratio, arg_max(pct, d) AS pct, arg_max(score, d) AS score FROM scored GROUP BY id),
components AS (SELECT p.ord, k.id, CASE WHEN p.shown = 90 AND m.m IS NOT NULL THEN {r('(k.y / m.m - 1) * 100', 2)} WHEN p.exact THEN k.y ELSE {r('k.y', 2)} END AS value, k.percentile, coalesce(n.score, 50.0) AS score, p.weight,
CASE WHEN n.id IS NOT NULL THEN p.win END AS calc_window, CASE WHEN n.id IS NOT NULL THEN p.period_label END AS period_label, CASE WHEN n.id IS NOT NULL THEN p.invert END AS invert, CASE WHEN n.id IS NOT NULL THEN {r('k.y', 3)} END AS calc_value,
{r('n.ma', 3)} AS ma, {r('n.ratio', 4)} AS ratio, n.pct AS ratio_percentile FROM ranks k JOIN specs p ON k.id = p.id LEFT JOIN newest n ON k.id = n.id LEFT JOIN means m ON k.id = m.id)"""

_BEFORE = lambda d, u: f"(date_trunc('{u}', {d})::DATE - 1)"


def months_back(d: str, n: int) -> str:
    return f"((date_trunc('month', {d}) - INTERVAL '{n} month')::DATE + (day({d}) - 1)::INT)"


def _horizons(source: str, where: str = "true") -> str:
    targets = {"w1": "(last - 7)", "mtd": _BEFORE("last", "month"), "m1": months_back("last", 1), "qtd": _BEFORE("last", "quarter"), "m3": months_back("last", 3), "m6": months_back("last", 6), "ytd": _BEFORE("last", "year"), "y1": months_back("last", 12)}
    bases = ", ".join(f"arg_max(close, d) FILTER (WHERE d <= {t}) AS {k}" for k, t in targets.items())
    pct = lambda k: f"CASE WHEN {k} IS NULL OR {k} = 0 THEN NULL ELSE (close / {k} - 1) * 100 END AS {k}"
    keys = ("d1", "w1", "mtd", "m1", "qtd", "m3", "m6", "ytd", "y1")
    return f"(SELECT sym, d, close, {', '.join(map(pct, keys))} FROM (SELECT sym, max(d) AS d, arg_max(close, d) AS close, max(close) FILTER (WHERE back = 2) AS d1, {bases} FROM (SELECT *, max(d) OVER (PARTITION BY sym) AS last, row_number() OVER (PARTITION BY sym ORDER BY d DESC) AS back FROM {source} WHERE {where}) GROUP BY sym))"


KEYS = ("d1", "w1", "mtd", "m1", "qtd", "m3", "m6", "ytd", "y1")
_TARGETS = {"MTD": _BEFORE("top", "month"), "QTD": _BEFORE("top", "quarter"), "YTD": _BEFORE("top", "year"), "1Y": months_back("top", 12), "3Y": months_back("top", 36), "5Y": months_back("top", 60)}
RANGES = f"""bases AS (SELECT sym, arg_max(close, d) AS close, max(close) FILTER (WHERE back = 6) AS "5D", {', '.join(f'arg_max(close, d) FILTER (WHERE d <= {t}) AS "{k}"' for k, t in _TARGETS.items())} FROM (SELECT *, (SELECT max(d) FROM sym) AS top, row_number() OVER (PARTITION BY sym ORDER BY d DESC) AS back FROM sym) GROUP BY sym),
ranges AS (SELECT range_key, sym, {r("CASE range_key WHEN '3Y' THEN (pow(close / base, 1.0 / 3) - 1) * 100 WHEN '5Y' THEN (pow(close / base, 1.0 / 5) - 1) * 100 ELSE (close / base - 1) * 100 END", 2)} AS pct FROM (UNPIVOT bases ON "5D", MTD, QTD, YTD, "1Y", "3Y", "5Y" INTO NAME range_key VALUE base) WHERE base > 0 AND NOT (range_key IN ('3Y', '5Y') AND close <= 0))"""
DAY = f"quotes AS ({QUOTES}), day_ AS (SELECT '1D' AS range_key, sym, {r('(price / prev_close - 1) * 100', 2)} AS pct FROM quotes WHERE price IS NOT NULL AND prev_close IS NOT NULL AND prev_close != 0)"
DIST = lambda t: f"SELECT range_key, count(*) AS n, {r('median(pct)', 2)} AS median, {r('sum(pct::DECIMAL(18,2))::DOUBLE / count(*)', 2)} AS mean, count(*) FILTER (WHERE pct > 0) AS up, count(*) FILTER (WHERE pct < 0) AS down, count(*) FILTER (WHERE pct = 0) AS unchanged FROM {t} GROUP BY range_key"
LATEST = lambda t: f"SELECT sym, arg_max(close, d) AS value, {r('(arg_max(close, d) - arg_min(close, d)) / arg_min(close, d) * 100', 2)} AS change_percent, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d DESC) AS rn FROM {t}) WHERE rn <= 2 GROUP BY sym"
_PERIOD = {"month": "strftime(d, '%Y-%m')", "quarter": "year(d)::VARCHAR || '-Q' || quarter(d)::VARCHAR", "year": "year(d)::VARCHAR"}


def _resampled(kind: str, cadence: str) -> str:
    return f"SELECT sym, {_PERIOD[cadence]} AS period, max(d) AS d, arg_max(close, d) AS close FROM region_ WHERE type = '{kind}' GROUP BY 1, 2"


def _returns(kind: str, cadence: str) -> str:
    return f"SELECT * FROM (SELECT sym, period, (close / lag(close) OVER (PARTITION BY sym ORDER BY period) - 1) * 100 AS ret FROM ({_resampled(kind, cadence)})) WHERE ret IS NOT NULL"


_BOARD = f"board AS (SELECT sym, {', '.join(f'{r(k, 2)} AS {k}' for k in ('d1', 'm1', 'y1'))} FROM {_horizons('sector')})"
_HEAT = lambda k: r(f"0.12 + 0.38 * least(1.0, abs({k}) / greatest(0.01, coalesce(max(abs({k})) OVER (), 0.0)))", 4)
_CHART = lambda where: f"""cal AS (SELECT DISTINCT d FROM bench WHERE {where}), every_ AS (SELECT sym, d, close FROM sector UNION ALL SELECT 'benchmark', d, close FROM bench),
names AS (SELECT 0 AS ord, 'benchmark' AS sym UNION ALL SELECT row_number() OVER (ORDER BY sym)::INTEGER, sym FROM (SELECT DISTINCT sym FROM sector)),
grid AS (SELECT n.ord, n.sym, c.d, e.close FROM cal c CROSS JOIN names n LEFT JOIN every_ e ON e.sym = n.sym AND e.d = c.d),
base AS (SELECT sym, arg_min(close, d) FILTER (WHERE close IS NOT NULL) AS b FROM grid GROUP BY sym)
SELECT ord, grid.sym, d, {r('close / b * 100', 2)} AS y FROM grid JOIN base ON grid.sym = base.sym"""  # noqa: E731
_END = "(SELECT max(d) FROM bench)"


def oracle_sql() -> dict[str, str]:
    q = {
        "relative_score": f", {PRICE_SERIES}, {PRICE_SPECS}, {SCORED} SELECT id, d, {r('ma', 3)} AS ma, {r('ratio', 6)} AS ratio, pct, score FROM scored",
        "percentile_rank": f", {PRICE_SERIES} SELECT s.id, {r('l.v', 2)} AS value, {r('100.0 * count(*) FILTER (WHERE y <= l.v) / count(*)', 0)} AS percentile FROM series s JOIN (SELECT id, arg_max(y, d) AS v FROM series GROUP BY id) l ON s.id = l.id GROUP BY s.id, l.v",
        "trailing_ma": f" SELECT sym, d, {r('ma', 4)} AS ma FROM (SELECT sym, d, avg(close) OVER (w ROWS 49 PRECEDING) AS ma, row_number() OVER w AS rn FROM sector WINDOW w AS ({_W})) WHERE rn >= 50",
        "ratio_to_ma": f" SELECT sym, d, {r('close / ma', 6)} AS ratio FROM (SELECT sym, d, close, avg(close) OVER (w ROWS 9 PRECEDING) AS ma, row_number() OVER w AS rn FROM sector WINDOW w AS ({_W})) WHERE rn >= 10",
        "momentum_vs_ma90": f" SELECT latest, {r('ma', 4)} AS ma, {r('(latest / ma - 1) * 100', 2)} AS value FROM (SELECT arg_max(close, d) AS latest, sum(close::DECIMAL(30,8))::DOUBLE / count(*) AS ma, count(*) AS n FROM (SELECT * FROM bars ORDER BY d DESC LIMIT 90)) WHERE n = 90",
        "true_range": f", {TR} SELECT d, {r('tr', 2)} AS tr FROM tr",
        "atr_percent": f", {TR}, {ATR} SELECT d, {r('y', 6)} AS atr_pct FROM atr WHERE rn >= 14",
        "realized_vol": f" SELECT d, {r('vol', 4)} AS vol FROM (SELECT d, stddev_samp(x) OVER (ORDER BY d ROWS 19 PRECEDING) * sqrt(252.0) * 100 AS vol, row_number() OVER (ORDER BY d) AS rn FROM (SELECT d, ln(close / lag(close) OVER (ORDER BY d)) AS x FROM bars)) WHERE rn > 20",
        "vol_risk_premium": f" SELECT d, {r('vol', 2)} AS realized, {r('close', 2)} AS implied, {r('close - vol', 2)} AS spread FROM (SELECT v.d, vol, s.close FROM (SELECT d, stddev_samp(x) OVER (ORDER BY d ROWS 19 PRECEDING) * sqrt(252.0) * 100 AS vol, row_number() OVER (ORDER BY d) AS rn FROM (SELECT d, ln(close / lag(close) OVER (ORDER BY d)) AS x FROM bars)) v JOIN sector s ON v.d = s.d AND s.sym = '3-MEDIUM' WHERE rn > 20 ORDER BY v.d DESC LIMIT 180)",
        "history_tail": f" SELECT sym, d, {r('close', 2)} AS close FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d DESC) AS rn FROM sector) WHERE rn <= 504",
        "rebase_100": f", n AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d DESC) AS rn, count(*) OVER (PARTITION BY sym) AS k FROM sector) SELECT n.sym, n.d, {r('n.close / b.close * 100', 4)} AS y FROM n JOIN n b ON n.sym = b.sym AND b.rn = least(504, b.k)",
        "running_high_low": f" SELECT sym, d, max(close) OVER (w ROWS 251 PRECEDING) AS hi, min(close) OVER (w ROWS 251 PRECEDING) AS lo FROM sector WINDOW w AS ({_W})",
        "asof_left": " SELECT b.d, s.close FROM bench b ASOF LEFT JOIN (SELECT * FROM sector WHERE sym = '1-URGENT') s ON b.d >= s.d",
        "asof_trades": " SELECT l.l_orderkey, l.l_linenumber, l.d, b.close FROM (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS d FROM lineitem) l ASOF LEFT JOIN bench b ON l.d >= b.d",
        "market_running": " SELECT o_orderkey, o_orderdate::DATE AS d, (sum(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE AS turnover, (max(o_totalprice) OVER w)::DOUBLE AS high, (min(o_totalprice) OVER w)::DOUBLE AS low FROM orders WINDOW w AS (ORDER BY o_orderdate::DATE, o_orderkey ROWS UNBOUNDED PRECEDING)",
        "market_trailing": " SELECT o_orderkey, o_orderdate::DATE AS d, (max(o_totalprice) OVER w)::DOUBLE AS high, (min(o_totalprice) OVER w)::DOUBLE AS low, (sum(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE AS turnover FROM orders WINDOW w AS (ORDER BY o_orderdate::DATE, o_orderkey ROWS 251 PRECEDING)",
        "asof_by_key": " SELECT l.sym, l.d, x.close FROM (SELECT *, right(sym, 1) AS k FROM sym) l ASOF JOIN (SELECT left(sym, 1) AS k, d, close FROM sector) x ON l.k = x.k AND l.d >= x.d",
        "asof_ratio_rebased": f", {CREDIT} SELECT d, {r('y', 4)} AS y FROM credit",
        "scalar_asof": " SELECT sym, arg_max(close, d) FILTER (WHERE d <= last - 100) AS base FROM (SELECT *, max(d) OVER (PARTITION BY sym) AS last FROM sector) GROUP BY sym",
        "manual_scores": f", {MANUAL}, series AS (SELECT * FROM manual), {FACTOR_SPECS}, {SCORED} SELECT id, d, {r('ma', 3)} AS ma, {r('ratio', 4)} AS ratio, pct, score FROM scored",
        "factor_components": f", {FACTOR_SERIES}, {FACTOR_SPECS}, {SCORED}, {COMPONENTS} SELECT * FROM components",
        "composite_live": f", {FACTOR_SERIES}, {FACTOR_SPECS}, {SCORED}, {COMPONENTS} SELECT {r('sum(score * weight) / sum(weight)', 0)} AS score, sum(weight)::BIGINT AS weight_seen, count(*) AS n_components FROM components",
        "composite_history": f", {FACTOR_SERIES}, {FACTOR_SPECS}, {SCORED}, by_day AS (SELECT s.d, {r('sum(s.score::DECIMAL(18,1) * s.weight)::DOUBLE / sum(s.weight)', 0)} AS score, sum(s.weight) AS w FROM scored s JOIN specs p ON s.id = p.id AND p.charted GROUP BY s.d), full_ AS (SELECT d, score FROM by_day WHERE w = (SELECT sum(weight) FROM specs WHERE charted AND id IN (SELECT id FROM series)) ORDER BY d DESC LIMIT 504) SELECT f.d, f.score, b.close FROM full_ f ASOF LEFT JOIN bars b ON f.d >= b.d",
        "name_flags": f", {FLAGS} SELECT * FROM flags",
        "breadth_internals": f", {FLAGS}, {DAYS} SELECT days.*, bench.close AS benchmark_close FROM days LEFT JOIN bench ON days.d = bench.d",
        "advance_decline_line": f", {FLAGS}, {DAYS} SELECT d, ad_line FROM days",
        "new_high_low": f", {FLAGS}, {DAYS} SELECT d, new_highs - new_lows AS net_new_highs FROM days",
        "pct_above_sma": f", {FLAGS}, {DAYS} SELECT d, pct_above_sma FROM days WHERE pct_above_sma IS NOT NULL",
        "ath_summary": f", {FLAGS} SELECT d, count(*) AS total, count(*) FILTER (WHERE at_high) AS n_high, {_share('count(*) FILTER (WHERE at_high)', 'count(*)')} AS pct, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (WHERE at_high), '') AS names FROM flags WHERE d = (SELECT max(d) FROM flags) GROUP BY d",
        "ath_tolerance": f", q AS (SELECT sym, arg_max(close, d) AS c, max(close) AS hi, min(close) AS lo FROM sector GROUP BY sym), t AS (SELECT *, c >= hi * 0.5 AS top, c <= lo * 1.5 AS bottom FROM q) SELECT count(*) AS total, count(*) FILTER (WHERE top) AS n_high, {_share('count(*) FILTER (WHERE top)', 'count(*)')} AS pct_high, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (WHERE top), '') AS highs, count(*) FILTER (WHERE bottom) AS n_low, {_share('count(*) FILTER (WHERE bottom)', 'count(*)')} AS pct_low, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (WHERE bottom), '') AS lows FROM t",
        "ath_tolerance_default": f", q AS (SELECT sym, arg_max(close, d) AS c, max(close) AS hi, min(close) AS lo FROM sector GROUP BY sym), t AS (SELECT *, c >= hi * 0.9995 AS top, c <= lo * 1.0005 AS bottom FROM q) SELECT count(*) AS total, count(*) FILTER (WHERE top) AS n_high, {_share('count(*) FILTER (WHERE top)', 'count(*)')} AS pct_high, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (WHERE top), '') AS highs, count(*) FILTER (WHERE bottom) AS n_low, {_share('count(*) FILTER (WHERE bottom)', 'count(*)')} AS pct_low, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (WHERE bottom), '') AS lows FROM t",
        "sector_returns": f" SELECT sym, d, {', '.join(f'{r(k, 2)} AS {k}' for k in KEYS)} FROM {_horizons('sector')}",
        "relative_returns": f", al AS (SELECT 'all' AS sym, d, close FROM bench), b AS (SELECT * FROM {_horizons('al')}) SELECT s.sym, {', '.join(f'{r(f's.{k} - b.{k}', 2)} AS rel_{k}' for k in KEYS)} FROM {_horizons('sector')} s, b",
        "country_returns": f" SELECT sym, {', '.join(f'{r(k, 2)} AS {k}' for k in KEYS)} FROM {_horizons('region_', chr(34) + 'type' + chr(34) + ' = ' + chr(39) + 'region' + chr(39))}",
        "range_changes": f", {RANGES} SELECT * FROM ranges",
        "range_distribution": f", {RANGES} {DIST('ranges')}",
        "day_distribution": f", {DAY} {DIST('day_')}",
        "period_returns": f" SELECT sym, period, {r('ret', 4)} AS ret FROM ({_returns('style', 'quarter')})",
        "heat_cells": f", x AS ({_returns('region', 'month')}) SELECT sym, period, {r('ret', 2)} AS ret, {r('least(abs(ret) / 10.0, 1.0) * 0.55', 4)} AS opacity FROM x WHERE period IN (SELECT DISTINCT period FROM x ORDER BY period DESC LIMIT 12)",
        "scorecard_pivot": f", x AS ({_returns('region', 'year')}), k AS (SELECT period, row_number() OVER (ORDER BY period DESC) AS place FROM (SELECT DISTINCT period FROM x)) SELECT sym, {', '.join(f'{r(f"max(ret) FILTER (WHERE place = {p})", 2)} AS p{p}' for p in range(1, 9))} FROM x JOIN k ON x.period = k.period GROUP BY sym",
        "scorecard_newest_years": f", x AS ({_returns('region', 'year')}), shown AS (SELECT sym, period, {r('ret', 2)} AS ret FROM x WHERE period IN (SELECT DISTINCT period FROM x ORDER BY period DESC LIMIT 8)) SELECT * FROM (PIVOT shown ON period USING max(ret) GROUP BY sym)",
        "leaderboard_nulls_last": f", {_BOARD} SELECT row_number() OVER (ORDER BY y1 DESC NULLS LAST, sym)::INTEGER AS place, sym, d1, m1, y1, {', '.join(f'{_HEAT(k)} AS heat_{k}' for k in ('d1', 'm1', 'y1'))} FROM board",
        "heat_intensity": f", {_BOARD} SELECT sym, {_HEAT('d1')} AS heat_d1, {_HEAT('y1')} AS heat_y1 FROM board",
        "rebased_chart": f", {_CHART(f'd >= {_END} - 365')}",
        "rebased_chart_ytd": f", {_CHART(f'd >= date_trunc({chr(39)}year{chr(39)}, {_END})')}",
        "factor_left_join": f" SELECT b.d, {r('b.close', 2)} AS mkt, {r('s.close', 2)} AS mom FROM bench b LEFT JOIN sector s ON b.d = s.d AND s.sym = '5-LOW'",
        "missing_anti_join": " SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
        "proxy_fallback": f", q AS ({LATEST('sym')}), l AS (SELECT sym, left(sym, 7) || '1' AS proxy_sym FROM q), x AS (SELECT l.sym, i.value AS iv, i.change_percent AS ic, p.value AS pv, p.change_percent AS pc FROM l LEFT JOIN (SELECT * FROM q WHERE right(sym, 1) IN ('1', '2')) i ON l.sym = i.sym LEFT JOIN q p ON l.proxy_sym = p.sym) SELECT CASE WHEN iv IS NOT NULL THEN 'index ' || sym ELSE 'proxy ' || sym END AS label, {r('coalesce(iv, pv)', 2)} AS value, {r('CASE WHEN iv IS NOT NULL THEN ic ELSE pc END', 2)} AS change_percent, false AS is_rate FROM x WHERE coalesce(iv, pv) IS NOT NULL",
        "quote_union": f", q AS ({LATEST('sym')}) SELECT 'rate' AS label, {r('(SELECT arg_max(close, d) FROM bench)', 2)} AS value, NULL::DOUBLE AS change_percent, true AS is_rate, 0 AS part UNION ALL SELECT sym, {r('value', 2)}, change_percent, false, 1 FROM q",
        "usage_report": f", c AS (SELECT ts::DATE AS d, count(*) AS calls FROM events GROUP BY 1 ORDER BY d DESC LIMIT 14) SELECT sum(calls)::BIGINT AS total, count(*) AS days, {r('sum(calls)::DOUBLE / count(*)', 1)} AS average FROM c",
        "latest_vs_previous": f" SELECT sym, {r('value', 2)} AS value, change_percent FROM ({LATEST('sector')})",
        "coverage_share": f" SELECT o_orderdate::DATE AS d, {_share(chr(99) + 'ount(*) FILTER (WHERE o_orderstatus = ' + chr(39) + 'F' + chr(39) + ')', 'count(*)')} AS pct FROM orders GROUP BY 1",
        "snapshot_upsert": f" SELECT d, {r('CASE WHEN rn <= 30 THEN close * 2 ELSE close END', 2)} AS close FROM (SELECT *, row_number() OVER (ORDER BY d DESC) AS rn FROM bench)",
        "key_merge": f", {RANGES}, {DAY} {DIST('ranges')} UNION ALL {DIST('day_')}",
        "config_upsert_delete": " SELECT n_name AS name, CASE WHEN n_nationkey >= 5 THEN 'v' || n_nationkey ELSE n_nationkey::VARCHAR END AS params, CASE WHEN n_nationkey >= 5 THEN 1 ELSE 0 END::BIGINT AS saved_at, (CASE WHEN n_nationkey < 10 THEN n_nationkey ELSE 9 + row_number() OVER (PARTITION BY n_nationkey < 10 ORDER BY n_nationkey) END)::INTEGER AS ord FROM nation WHERE NOT (n_nationkey >= 5 AND n_nationkey % 4 = 1)",
        "counter_trim": " SELECT o_orderdate::DATE AS d, count(*) AS calls FROM orders GROUP BY 1 ORDER BY d DESC LIMIT 90",
        "bars_projection": f" SELECT l_shipdate::DATE AS d, {r('max(l_extendedprice)', 1)} AS high, sum(l_quantity::BIGINT)::BIGINT AS volume FROM lineitem GROUP BY 1",
        "bars_full": f" SELECT sym, d, {r('o', 4)} AS open, {r('h', 4)} AS high, {r('l', 4)} AS low, {r('c', 4)} AS raw_close, {r('c / 3', 4)} AS adj_close, CASE WHEN n > 1 THEN n ELSE 0 END::BIGINT AS volume, CASE WHEN day(d) = 1 THEN 0.25 ELSE 0 END::DOUBLE AS dividend FROM (SELECT o_orderpriority AS sym, o_orderdate::DATE AS d, arg_min(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l, arg_max(o_totalprice, o_orderkey) AS c, count(*) AS n FROM orders GROUP BY 1, 2)",
        "symbol_validation": " SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND regexp_full_match(upper(replace(p_brand, '#', '-')), '[A-Z0-9.\\-]{1,10}') THEN upper(replace(p_brand, '#', '-')) END AS sym, CASE WHEN p_size % 2 = 0 AND regexp_full_match(upper(replace(p_brand, '#', '-')), '[A-Z0-9.\\-]{1,10}') THEN 'NYSE:' || replace(upper(replace(p_brand, '#', '-')), '-', '.') ELSE 'NYSE' END AS listed FROM part",
        "csv_preamble_parse": f" SELECT 'orders' AS name, d, {r('open', 2)} AS open, {r('close', 2)} AS close FROM bars",
        "json_closes": f" SELECT sym, d, {r('close', 2)} AS close FROM sector",
        "month_overflow": f" SELECT DISTINCT d, {', '.join(f'{months_back(chr(100), n)} AS m{n}' for n in (1, 3, 6, 12))}, {_BEFORE('d', 'month')} AS mtd, {_BEFORE('d', 'quarter')} AS qtd, {_BEFORE('d', 'year')} AS ytd, {_PERIOD['quarter']} AS quarter FROM bars",
        "js_rounding": f" SELECT c_custkey, {r('trunc(c_acctbal * 100) / 1000', 1)} AS r1, {r('trunc(c_acctbal * 100) / 1000', 0)} AS r0, NULL::DOUBLE AS none FROM customer",
    }
    live = f", {FACTOR_SERIES}, {FACTOR_SPECS}, {SCORED}, {COMPONENTS}"
    tail = lambda t, by, n: f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY d DESC) AS back FROM {t}) WHERE back <= {n}"
    state = "CASE left(sym, 1) WHEN '2' THEN 'call frequency' WHEN '3' THEN 'no answer' WHEN '4' THEN 'invalid' END"
    index_of = lambda k: f"(SELECT DISTINCT sym FROM sector {k})"
    q |= {
        "factor_histories": f", {FACTOR_SERIES} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY d) - 1)::INTEGER AS place, d, {r('y', 3)} AS value FROM {tail('series', 'id', 504)}",
        "composite_degraded": f"{live} SELECT {r('sum(score * weight) / sum(weight)', 0)} AS score, sum(weight)::BIGINT AS weight_seen, count(*) AS n_components, 'put/call: PATH_NOT_FOUND' AS warnings FROM components WHERE id != 'putcall'",
        "scorecard_newest": f", x AS ({_returns('style', 'quarter')}), shown AS (SELECT sym, period, {r('ret', 2)} AS ret FROM x WHERE period IN (SELECT DISTINCT period FROM x ORDER BY period DESC LIMIT 8)) SELECT * FROM (PIVOT shown ON period USING max(ret) GROUP BY sym)",
        "labels_and_parameters": " SELECT event_id, ny::DATE AS day, strftime(ny, '%b %-d, %Y, %-I:%M %p') || ' ET' AS label, CASE WHEN value IS NULL THEN '—' ELSE printf('%+.2f%%', value) END AS change, greatest(1, coalesce(nullif(days::INTEGER, 0), 14)) AS days, days::DOUBLE AS number FROM (SELECT event_id, value, timezone('America/New_York', timezone('UTC', ts)) AS ny, right(event_id::VARCHAR, 2) AS days FROM events)",
        "fixed_universes": f" SELECT * FROM (VALUES (0, '{fixed.BENCHMARK[0]}', '{fixed.BENCHMARK[1]}', 'benchmark'), " + ", ".join(f"({k + 1}, '{s}', '{n}', 'sector')" for k, (s, n) in enumerate(fixed.SECTORS)) + ", " + ", ".join(f"({k}, '{s}', '{n}', '{t}')" for k, (s, n, t) in enumerate(fixed.REGIONS)) + ") AS t(ord, sym, name, type)",
        "partial_feeds": f" SELECT 'sectors' AS feed, sym, {r('y1', 2)} AS y1, NULL::VARCHAR AS error FROM {_horizons('sector')} UNION ALL SELECT 'countries', NULL, NULL, 'PATH_NOT_FOUND'",
        "range_summary": f", {RANGES}, dist AS ({DIST('ranges')}) SELECT dist.*, (SELECT count(DISTINCT sym) FROM sym) AS total, range_key IN ('3Y', '5Y') AS annualized FROM dist",
        "range_change_list": f", {RANGES} SELECT range_key, row_number() OVER (PARTITION BY range_key ORDER BY pct, sym)::INTEGER AS place, sym, pct FROM ranges",
        "day_summary": f", {DAY}, dist AS ({DIST('day_')}) SELECT dist.*, (SELECT count(DISTINCT sym) FROM quotes) AS total, NULL::BOOLEAN AS annualized FROM dist",
        "rejected_quotes": f", quotes AS ({QUOTES}), torn AS (SELECT sym, right(sym, 1) AS k, CASE WHEN right(sym, 1) != '1' THEN price END AS price, CASE right(sym, 1) WHEN '2' THEN NULL WHEN '3' THEN 0.0 ELSE prev_close END::DOUBLE AS prev_close FROM quotes) SELECT sym, price, prev_close, CASE WHEN price IS NULL THEN 'no price' WHEN prev_close IS NULL THEN 'no previous close' ELSE 'previous close 0' END AS reason FROM torn WHERE price IS NULL OR prev_close IS NULL OR prev_close = 0",
        "config_changes": " SELECT n_name AS name, 'v' || n_nationkey AS params, 1::BIGINT AS saved_at, (CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE (SELECT max(n_nationkey) FROM nation WHERE n_nationkey % 2 = 0) + row_number() OVER (PARTITION BY n_nationkey % 2 ORDER BY n_nationkey) END)::INTEGER AS ord FROM nation WHERE n_nationkey % 4 != 1",
        "index_bars_read": f" SELECT 'market' AS sym, d, {', '.join(f'{r(c, 2)} AS {c}' for c in ('open', 'high', 'low', 'close'))} FROM bars",
        "point_quotes_read": f", quotes AS ({QUOTES}) SELECT sym, {r('price', 2)} AS price, {r('prev_close', 2)} AS prev_close, {r('(price / prev_close - 1) * 100', 4)} AS change_percent FROM quotes",
        "put_call_window": f", {ERRORS} SELECT d, {r('y', 6)} AS y FROM (SELECT * FROM errs ORDER BY d DESC LIMIT 18) WHERE day(d) % 7 != 0",
        "newest_readings": f", x AS (SELECT sym, {r('close', 2)} AS close, row_number() OVER (PARTITION BY sym ORDER BY d DESC) AS k FROM sector) SELECT sym AS name, max(close) FILTER (WHERE k = 2) AS value, max(close) FILTER (WHERE k = 3) AS previous FROM x GROUP BY sym",
        "ath_snapshot": f", q AS (SELECT 'X:' || sym AS sym, {r('arg_max(close, d)', 2)} AS c, {r('max(close)', 2)} AS hi, {r('min(close)', 2)} AS lo FROM sym GROUP BY sym), t AS (SELECT *, c >= hi * (1 - 0.0005) AS top, c <= lo * (1 + 0.0005) AS bottom FROM q), day_ AS (SELECT max(d) AS d FROM sym), one AS (SELECT (SELECT d FROM day_) AS d, count(*) AS total, count(*) FILTER (WHERE top) AS count, {_share('count(*) FILTER (WHERE top)', 'count(*)')} AS pct, count(*) FILTER (WHERE bottom) AS atl_count, {_share('count(*) FILTER (WHERE bottom)', 'count(*)')} AS atl_pct, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (WHERE top), '') AS tickers, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (WHERE bottom), '') AS atl_tickers, (SELECT arg_max(close, d) FROM bench WHERE d <= (SELECT d FROM day_)) AS spx_close FROM t) SELECT * FROM one UNION ALL SELECT d - 1, total, count, pct, atl_count, atl_pct, tickers, atl_tickers, spx_close FROM one",
        "factors_merged": f" SELECT b.d, {r('b.open', 2)} AS mkt_rf, {r('b.high', 2)} AS smb, {r('b.low', 2)} AS hml, {r('b.close', 2)} AS rf, {r('s.close', 2)} AS mom FROM bars b LEFT JOIN sector s ON b.d = s.d AND s.sym = '5-LOW'",
        "ingest_health": f", a AS (SELECT sym, {state} AS why FROM {index_of('')}) SELECT 1 AS pass, count(*) AS total, count(*) FILTER (WHERE why IS NULL) AS fetched, count(why) AS failed, coalesce(string_agg(DISTINCT why, '; ' ORDER BY why), '') AS messages FROM a UNION ALL SELECT 2, count(*), count(*) FILTER (WHERE left(sym, 1) != '4'), count(*) FILTER (WHERE left(sym, 1) = '4'), 'invalid' FROM a",
        "quarantine": f" SELECT sym, {state} AS message FROM {index_of('')} WHERE {state} IS NOT NULL",
        "retried_closes": f" SELECT sym, d, {r('close', 2)} AS close FROM sector WHERE left(sym, 1) != '4'",
        "sector_payload": f", al AS (SELECT 'all' AS sym, d, close FROM bench), b AS (SELECT * FROM {_horizons('al')}) SELECT 0 AS ord, sym, d, {r('close', 2)} AS close, {', '.join(f'{r(k, 2)} AS {k}' for k in KEYS)}, {', '.join(f'NULL::DOUBLE AS rel_{k}' for k in KEYS)} FROM b UNION ALL SELECT row_number() OVER (ORDER BY s.sym)::INTEGER, s.sym, s.d, {r('s.close', 2)}, {', '.join(r(f's.{k}', 2) for k in KEYS)}, {', '.join(r(f's.{k} - b.{k}', 2) for k in KEYS)} FROM {_horizons('sector')} s, b",
        "country_histories": f" SELECT type, sym, d, {r('close', 2)} AS close FROM {tail('region_', 'type, sym', 2600)}",
        "ticker_tape": f", q AS ({LATEST('sym')}), l AS (SELECT sym, left(sym, 7) || '1' AS proxy_sym FROM q WHERE substr(sym, length(sym) - 1, 1) = '1'), x AS (SELECT l.sym, i.value AS iv, i.change_percent AS ic, p.value AS pv, p.change_percent AS pc FROM l LEFT JOIN (SELECT * FROM q WHERE right(sym, 1) IN ('1', '2')) i ON l.sym = i.sym LEFT JOIN q p ON l.proxy_sym = p.sym), c AS (SELECT {r('close', 2)} AS close, row_number() OVER (ORDER BY d DESC) AS k FROM sector WHERE sym = '1-URGENT') SELECT CASE WHEN iv IS NOT NULL THEN 'index ' || sym ELSE 'proxy ' || sym END AS label, {r('coalesce(iv, pv)', 2)} AS value, {r('CASE WHEN iv IS NOT NULL THEN ic ELSE pc END', 2)} AS change_percent, false AS is_rate, 0 AS part FROM x WHERE coalesce(iv, pv) IS NOT NULL UNION ALL SELECT 'rate', {r('(SELECT arg_max(close, d) FROM bench)', 2)}, NULL, true, 1 UNION ALL SELECT 'commodity', max(close) FILTER (WHERE k = 2), {r('(max(close) FILTER (WHERE k = 2) / max(close) FILTER (WHERE k = 3) - 1) * 100', 2)}, false, 2 FROM c UNION ALL SELECT sym, {r('value', 2)}, change_percent, false, 3 FROM q",
        "stream_day_counts": " SELECT ts::DATE AS d, event_type, count(*) AS n FROM events GROUP BY ALL",
        "stream_last_event": " SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
        "stream_daily_snapshot": " SELECT ts::DATE AS d, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    }
    ends = "ts::DATE + INTERVAL 1 DAY"
    place = lambda kind, cadence, n: f", x AS ({_returns(kind, cadence)}), k AS (SELECT period, row_number() OVER (ORDER BY period DESC) AS place FROM (SELECT DISTINCT period FROM x)) SELECT sym, {', '.join(f'{r(f"max(ret) FILTER (WHERE place = {p})", 2)} AS p{p}' for p in range(1, n + 1))} FROM x JOIN k ON x.period = k.period GROUP BY sym"
    q |= {
        "scorecard_quarters": place("style", "quarter", 8),
        "scorecard_months": place("region", "month", 12),
        "ath_retried": f", q AS (SELECT right(sym, 2) AS k, {r('arg_max(close, d)', 2)} AS c, {r('max(close)', 2)} AS hi, {r('min(close)', 2)} AS lo FROM sym GROUP BY sym), l AS (SELECT *, left(k, 1) AS m, CASE WHEN left(k, 1) IN ('1', '3') THEN 'NASDAQ' ELSE 'NYSE' END || ':BRAND.' || k AS ticker FROM q), t AS (SELECT *, c >= hi * (1 - 0.0005) AS top, c <= lo * (1 + 0.0005) AS bottom FROM l WHERE m != '5' AND k != '43') SELECT (SELECT max(d) FROM sym) AS d, count(*) AS total, count(*) FILTER (WHERE top) AS n_high, {_share('count(*) FILTER (WHERE top)', 'count(*)')} AS pct_high, count(*) FILTER (WHERE bottom) AS n_low, {_share('count(*) FILTER (WHERE bottom)', 'count(*)')} AS pct_low, coalesce(string_agg(ticker, ',' ORDER BY ticker) FILTER (WHERE top), '') AS highs, coalesce(string_agg(ticker, ',' ORDER BY ticker) FILTER (WHERE bottom), '') AS lows, (SELECT count(*) FROM l WHERE m != '5' AND right(k, 1) = '3') AS retried, coalesce((SELECT string_agg(ticker, ',' ORDER BY ticker) FROM l WHERE k = '43'), '') AS unresolved, coalesce((SELECT string_agg('BRAND-' || k, ',' ORDER BY k) FROM l WHERE m = '5'), '') AS unlisted FROM t",
        "ingest_observed": f", a AS (SELECT sym, left(sym, 1) AS k, {state} AS why FROM {index_of('')}) SELECT 1 AS pass, count(*) AS total, count(*) FILTER (WHERE why IS NULL) AS fetched, count(why) AS failed, (SELECT count(*) FROM sector WHERE left(sym, 1) NOT IN ('2', '3', '4')) AS closes FROM a UNION ALL SELECT 2, count(*), count(*) FILTER (WHERE k != '4'), count(*) FILTER (WHERE k = '4'), (SELECT count(*) FROM sector WHERE left(sym, 1) IN ('2', '3')) FROM a WHERE k IN ('2', '3', '4')",
        "bars_by_parameters": " SELECT o_orderpriority AS sym, o_orderdate::DATE AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderdate::DATE BETWEEN DATE '1996-03-01' AND DATE '1998-02-28' GROUP BY ALL",
        "call_log": " SELECT o_orderdate::DATE AS d, count(*) AS calls FROM orders GROUP BY 1 ORDER BY d DESC LIMIT 90",
        "composite_damaged": q["composite_degraded"].replace("PATH_NOT_FOUND", "FAILED_READ_FILE"),
        "partial_reads": q["partial_feeds"] + " UNION ALL SELECT 'symbols', NULL, NULL, 'FAILED_READ_FILE'",
        "stream_final_days": f", b AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 2 WHEN epoch_us(ts) < (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 FROM events) THEN 0 ELSE 1 END AS file FROM events), a AS (SELECT *, coalesce({ends} <= (SELECT max(ts) FROM b WHERE b.file < x.file) - INTERVAL 1 DAY, false) AS late FROM b x) SELECT 'late' AS kind, ts::DATE AS d, event_type, count(*) AS n FROM a WHERE late GROUP BY ALL UNION ALL SELECT 'final', ts::DATE, event_type, count(*) FROM a WHERE NOT late AND {ends} <= (SELECT max(ts) FROM a WHERE NOT late) - INTERVAL 1 DAY GROUP BY ALL",
        "stream_last_state": " SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS expired FROM events GROUP BY user_id",
        "stream_first_snapshot": " SELECT d, 0::INTEGER AS run, count(*) AS n, min(event_id) AS first_id FROM (SELECT ts::DATE AS d, event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS k FROM events) WHERE (k - 1) % 3 = 0 GROUP BY d",
    }
    q |= {f"resample_{c}": f" SELECT * FROM ({_resampled('region', c)})" for c in _PERIOD}
    return {name: HEAD + sql for name, sql in q.items()}
