"""Oracle SQL, runnable by DuckDB over the driver's pre-registered table views.

The stand-in tables (FIXTURES.md section 3) are repeated as CTEs so that
each statement starts from the raw views. Array work of the Spark side
(rankings, AP@7, padding) is written here in long form with window
functions, so the two sides are independent formulations.
"""

from __future__ import annotations

from nextbuy.constants import Y_COLS

TRAIN_MONTH, TEST_MONTH, LAST_MONTH, PAD_LEN, BASE_YEAR = 78, 79, 80, 78, 1995
ORACLES: dict[str, str] = {}


def ylist(alias: str = "") -> str:
    return ", ".join(f"{alias}{c}" for c in Y_COLS)


def yarr(alias: str = "") -> str:
    return "[" + ylist(alias) + "]"


def ysum(alias: str = "") -> str:
    return " + ".join(f"{alias}{c}" for c in Y_COLS)


SNAP = "snap AS (SELECT o_custkey AS id, CAST(12 * (year(o_orderdate) - {by}) + month(o_orderdate) AS INTEGER) AS t, " \
       "CAST(month(o_orderdate) AS INTEGER) AS t_month, {flags} FROM orders JOIN lineitem ON o_orderkey = l_orderkey " \
       "JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)".format(
           by=BASE_YEAR,
           flags=", ".join(
               f"CAST(max(CASE WHEN (CAST(substr(p_brand, 7) AS INTEGER) - 1) % 24 = {i} THEN 1 ELSE 0 END) AS INTEGER) AS {c}"
               for i, c in enumerate(Y_COLS)))

# Training histories: months <= 78, 2 observed months or more; ``step`` is the 1-based position.
TRAIN = f"""tr AS (SELECT * FROM snap WHERE t <= {TRAIN_MONTH}),
trc AS (SELECT id, count(*) AS n_obs FROM tr GROUP BY id HAVING count(*) >= 2),
tro AS (SELECT tr.*, trc.n_obs, row_number() OVER (PARTITION BY tr.id ORDER BY tr.t) AS step FROM tr JOIN trc USING (id))"""

# Test histories: customers of month 79, their months <= 78 plus month 79, 2 months or more.
TEST = f"""tg AS (SELECT * FROM snap WHERE t = {TEST_MONTH}),
te AS (SELECT * FROM snap WHERE t <= {TEST_MONTH - 1} AND id IN (SELECT id FROM tg) UNION ALL SELECT * FROM tg),
tec AS (SELECT id, count(*) AS n_obs FROM te GROUP BY id HAVING count(*) >= 2),
teo AS (SELECT te.*, tec.n_obs, row_number() OVER (PARTITION BY te.id ORDER BY te.t) AS step FROM te JOIN tec USING (id))"""

# Test targets with last observed month and popularity scores, in long form (id, k, y, yl, p).
EVAL = TEST + f""",
pop AS (SELECT [{", ".join(f"avg({c})" for c in Y_COLS)}] AS p FROM snap WHERE t <= {TRAIN_MONTH}),
ev AS (SELECT a.id, a.n_obs, {yarr("a.")} AS y, {yarr("b.")} AS yl FROM teo a JOIN teo b
       ON a.id = b.id AND a.step = a.n_obs AND b.step = a.n_obs - 1),
lng AS (SELECT id, n_obs, unnest(range(1, 25)) AS k, unnest(y) AS y, unnest(yl) AS yl, unnest(pop.p) AS p FROM ev, pop),
nw AS (SELECT id, n_obs, k, greatest(0, least(1, y - yl)) AS y, yl, (1 - yl) * p AS p FROM lng)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def ap_ctes(src: str, prefix: str) -> str:
    """CTEs <prefix>rk (ranks), <prefix>ap (id, n_true, ap) over a long table (id, k, y, p)."""
    return f"""{prefix}rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, k ASC) AS r FROM {src}),
{prefix}hp AS (SELECT id, r, CASE WHEN y > 0 THEN 1 ELSE 0 END AS h FROM {prefix}rk WHERE r <= 7),
{prefix}pr AS (SELECT id, h * sum(h) OVER (PARTITION BY id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               / CAST(r AS DOUBLE) AS prec FROM {prefix}hp),
{prefix}nt AS (SELECT id, CAST(sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_true FROM {src} GROUP BY id),
{prefix}ap AS (SELECT nt.id, nt.n_true, CASE WHEN nt.n_true = 0 THEN 0.0
                 ELSE s.sp / CAST(least(nt.n_true, 7) AS DOUBLE) END AS ap
               FROM {prefix}nt nt JOIN (SELECT id, sum(prec) AS sp FROM {prefix}pr GROUP BY id) s USING (id))"""


#: Closeness of the calendar months January to December to July, the month after month index 78.
JULY = "[0.1, 0.2666666666666667, 0.4333333333333333, 0.6, 0.7666666666666667, 0.9333333333333333, " \
       "1.1, 0.9333333333333333, 0.7666666666666667, 0.6, 0.4333333333333333, 0.2666666666666667]"


def circ(col: str) -> str:
    """Circular month closeness, looked up."""
    return f"CAST(({JULY})[{col}] AS DOUBLE)"


def tscaled(col: str) -> str:
    return f"(CAST({col} AS DOUBLE) / CAST({TRAIN_MONTH} AS DOUBLE))"


# --- 2.6 -----------------------------------------------------------------------------------------

ORACLES["seq_month_filter"] = with_(SNAP) + f"SELECT * FROM snap WHERE t <= {TRAIN_MONTH}"

ORACLES["agg_nonbuyers"] = with_(SNAP, f"h AS (SELECT * FROM snap WHERE t <= {TRAIN_MONTH})",
                                 f"s AS (SELECT id, sum({ysum()}) AS y_sum FROM h GROUP BY id)") + \
    "SELECT h.id, h.t, CAST(s.y_sum AS BIGINT) AS y_sum FROM h JOIN s USING (id) WHERE s.y_sum > 0"

ORACLES["agg_counts_maxs"] = with_(SNAP) + "SELECT id, count(t) AS t_count, max(t) AS t_max FROM snap GROUP BY id"

ORACLES["join_outer"] = with_(
    SNAP,
    f"stats AS (SELECT id, count(t) AS t_count, max(t) AS t_max FROM snap WHERE t <= {TRAIN_MONTH} GROUP BY id)",
    f"tgt AS (SELECT id AS tid, t AS target_t FROM snap WHERE t = {TEST_MONTH})") + \
    "SELECT coalesce(id, tid) AS id, t_count, t_max, target_t FROM stats FULL OUTER JOIN tgt ON stats.id = tgt.tid"

ORACLES["join_latest_row"] = with_(SNAP) + f"""SELECT id, t_count, t_max, t_month, {ylist()} FROM (
  SELECT *, count(t) OVER (PARTITION BY id) AS t_count, max(t) OVER (PARTITION BY id) AS t_max FROM snap) WHERE t = t_max"""

ORACLES["join_counts_to_rows"] = with_(SNAP) + \
    "SELECT id, t, count(t) OVER (PARTITION BY id) AS t_count, max(t) OVER (PARTITION BY id) AS t_max FROM snap"

ORACLES["seq_length_buckets"] = with_(SNAP, TRAIN) + "SELECT id, n_obs FROM trc"

ORACLES["seq_build"] = with_(SNAP, TRAIN) + "SELECT id, CAST(step AS INTEGER) AS step, CAST(t AS DOUBLE) AS c_1, " \
    "CAST(t_month AS DOUBLE) AS c_2, " + ", ".join(f"CAST({c} AS DOUBLE) AS c_{i + 3}" for i, c in enumerate(Y_COLS)) + \
    " FROM tro WHERE step < n_obs"

ORACLES["seq_split_xy"] = with_(SNAP, TRAIN) + "SELECT a.id, CAST(a.n_obs - 1 AS INTEGER) AS x_len, " + \
    ", ".join(f"a.{c} AS y_{i + 1}" for i, c in enumerate(Y_COLS)) + ", " + \
    ", ".join(f"b.{c} AS last_{i + 1}" for i, c in enumerate(Y_COLS)) + \
    " FROM tro a JOIN tro b ON a.id = b.id AND a.step = a.n_obs AND b.step = a.n_obs - 1"

ORACLES["seq_left_pad"] = with_(
    SNAP, TRAIN,
    f"pad AS (SELECT id, n_obs, {PAD_LEN} - (n_obs - 1) AS npad FROM trc)",
    f"grid AS (SELECT id, n_obs, npad, unnest(range(1, {PAD_LEN + 1})) AS step FROM pad)") + \
    "SELECT g.id, CAST(g.step AS INTEGER) AS step, " + \
    f"round(CASE WHEN g.step <= g.npad THEN -1.0 ELSE {tscaled('tro.t')} END, 6) AS c_1, " + \
    f"round(CASE WHEN g.step <= g.npad THEN -1.0 ELSE {circ('tro.t_month')} END, 6) AS c_2, " + \
    ", ".join(f"CASE WHEN g.step <= g.npad THEN -1.0 ELSE CAST(tro.{c} AS DOUBLE) END AS c_{i + 3}"
              for i, c in enumerate(Y_COLS)) + \
    " FROM grid g LEFT JOIN tro ON tro.id = g.id AND tro.step = g.step - g.npad"

ORACLES["seq_test_rows"] = with_(SNAP) + f"SELECT * FROM snap WHERE t = {TEST_MONTH}"

ORACLES["join_semi_history"] = with_(SNAP) + \
    f"SELECT * FROM snap WHERE t <= {TEST_MONTH - 1} AND id IN (SELECT id FROM snap WHERE t = {TEST_MONTH})"

ORACLES["set_union_missing"] = with_(SNAP) + f"SELECT id, t, t_month, {ylist()} FROM snap WHERE t <= {TRAIN_MONTH} " \
    "UNION ALL SELECT id, t, t_month, " + ", ".join(f"CAST(NULL AS INTEGER) AS {c}" for c in Y_COLS) + \
    f" FROM snap WHERE t = {TEST_MONTH}"


def summary_sql(src: str, attrs: str, extra: str = "", has_y: bool = True) -> str:
    """Per customer of ``src`` (rows with step and n_obs): attributes of the last row and sums over the steps before."""
    x_terms = f"{tscaled('b.t')} + {circ('b.t_month')} + CAST({ysum('b.')} AS DOUBLE)"
    y_count = ysum("a.") if has_y else "CAST(NULL AS INTEGER)"
    return f"""SELECT a.id, a.n_obs, {attrs},
  CAST(a.n_obs - 1 AS INTEGER) AS x_len,
  round((SELECT sum({x_terms}) FROM {src} b WHERE b.id = a.id AND b.step < a.n_obs), 6) AS x_total,
  {y_count} AS y_count,
  (SELECT {ysum('c.')} FROM {src} c WHERE c.id = a.id AND c.step = a.n_obs - 1) AS last_count
FROM {src} a{extra} WHERE a.step = a.n_obs"""


ORACLES["seq_bucket_sizes"] = with_(SNAP, TRAIN) + \
    "SELECT n_obs, count(*) AS n_customers, CAST(max(n_obs - 1) AS INTEGER) AS n_steps, 26 AS n_channels " \
    "FROM trc GROUP BY n_obs"

# --- 2.7 -----------------------------------------------------------------------------------------

ORACLES["eval_topk"] = with_(SNAP, EVAL, "rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, k ASC) AS r FROM nw)") + \
    "SELECT id, CAST(r AS INTEGER) AS rank, CAST(k AS INTEGER) AS k FROM rk WHERE r <= 7"

ORACLES["eval_hits"] = with_(SNAP, EVAL, "rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, k ASC) AS r FROM nw)",
                             "hp AS (SELECT id, r, CASE WHEN y > 0 THEN 1 ELSE 0 END AS h FROM rk WHERE r <= 7)") + \
    "SELECT id, CAST(r AS INTEGER) AS rank, h AS hit, round(h * sum(h) OVER (PARTITION BY id ORDER BY r ROWS BETWEEN " \
    "UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(r AS DOUBLE), 6) AS prec FROM hp"

ORACLES["eval_ap7"] = with_(SNAP, EVAL, ap_ctes("lng", "a_")) + "SELECT id, n_true, round(ap, 6) AS ap FROM a_ap"

ORACLES["eval_map7"] = with_(SNAP, EVAL, ap_ctes("lng", "a_")) + "SELECT count(*) AS n, round(avg(ap), 6) AS map FROM a_ap"

ORACLES["eval_new_labels"] = with_(SNAP, EVAL) + "SELECT id, CAST(k AS INTEGER) AS k FROM nw WHERE y = 1"

ORACLES["eval_map7_new"] = with_(SNAP, EVAL, ap_ctes("nw", "n_")) + "SELECT count(*) AS n, round(avg(ap), 6) AS map FROM n_ap"

_EPS = "CAST(1e-7 AS DOUBLE)"


def _clip(x: str) -> str:
    return f"least(greatest({x}, {_EPS}), CAST(1.0 AS DOUBLE) - {_EPS})"


LOSS_ROWS = f"""lr AS (SELECT id, n_obs,
  avg(-(y * ln({_clip('p')}) + (1 - y) * ln(1 - {_clip('p')}))) AS bce,
  avg((y - p) * (y - p)) AS mse,
  -sum(y * ln({_clip('p / sp')})) AS cce,
  (1 + sum(p)) * avg(-(y * ln({_clip('y * p')}) + (1 - y) * ln(1 - {_clip('y * p')}))) AS bce_true_only
FROM (SELECT *, sum(p) OVER (PARTITION BY id) AS sp FROM lng) GROUP BY id, n_obs)"""

ORACLES["eval_losses"] = with_(SNAP, EVAL, LOSS_ROWS) + \
    "SELECT n_obs, count(*) AS n, round(avg(bce), 6) AS bce, round(avg(mse), 6) AS mse, round(avg(cce), 6) AS cce, " \
    "round(avg(bce_true_only), 6) AS bce_true_only FROM lr GROUP BY ROLLUP (n_obs)"

ORACLES["eval_bce_true_only"] = with_(SNAP, EVAL, LOSS_ROWS) + "SELECT id, round(bce_true_only, 6) AS bce_true_only FROM lr"

ORACLES["seq_length_report"] = with_(SNAP, f"n AS (SELECT id, count(*) AS n FROM snap WHERE t <= {TRAIN_MONTH} GROUP BY id)") + \
    "SELECT CASE WHEN n < 2 THEN 'too_short' ELSE 'kept' END AS status, count(*) AS n_customers FROM n GROUP BY 1"

ORACLES["seq_drop_long"] = with_(SNAP) + \
    f"SELECT id, count(*) AS n_obs FROM snap WHERE t <= {TRAIN_MONTH} GROUP BY id HAVING count(*) BETWEEN 2 AND 17"
