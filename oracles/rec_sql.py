"""Oracle SQL: recommendations, I/O round trips, training logs, activations, batches."""

from __future__ import annotations

from nextbuy.constants import P_COLS, PRODUCT_LABELS, Y_COLS

from .duckdb_sql import SNAP, TRAIN, TRAIN_MONTH, with_, ylist
from .prep_sql import ORACLES as PREP

ORACLES: dict[str, str] = {}

LABELS = "[" + ", ".join(f"'{x}'" for x in PRODUCT_LABELS) + "]"

PRED = "pred AS (SELECT id, " + ", ".join(f"avg(CAST({y} AS DOUBLE)) AS {p}" for y, p in zip(Y_COLS, P_COLS)) + \
    " FROM (SELECT *, max(t) OVER (PARTITION BY id) AS tmax FROM snap) WHERE t < tmax GROUP BY id)"
OWN = f"own AS (SELECT * FROM snap WHERE t = {TRAIN_MONTH})"
JOINED = "j AS (SELECT pred.*, " + ", ".join(f"own.{y} AS o_{i + 1}" for i, y in enumerate(Y_COLS)) + \
    " FROM pred LEFT JOIN own USING (id))"
LONG = "rl AS (SELECT id, unnest(range(1, 25)) AS k, unnest([" + ", ".join(P_COLS) + "]) AS p, unnest([" + \
    ", ".join(f"o_{i + 1}" for i in range(24)) + "]) AS o FROM j)"
CAND = "cand AS (SELECT * FROM rl WHERE p > 0 AND NOT coalesce(o >= 1, false))"
RANKED = "rnk AS (SELECT id, k, p, row_number() OVER (PARTITION BY id ORDER BY p DESC, k DESC) AS pos FROM cand)"
REC = [SNAP, PRED, OWN, JOINED, LONG, CAND, RANKED]

# --- sources and sinks ---------------------------------------------------------------------------

ORACLES["io_month_scan"] = with_(SNAP) + f"SELECT id, {ylist()} FROM snap WHERE t = {TRAIN_MONTH}"
ORACLES["io_month_scan_manifest"] = ORACLES["io_month_scan"]
ORACLES["io_month_stream"] = ORACLES["io_month_scan"]
ORACLES["io_read_raw"] = PREP["clean_select"].split("\nSELECT * FROM sc")[0].replace(
    ",\nsc AS (", ",\nunused AS (") + "\nSELECT * FROM rawsnaps"
_RAW = ORACLES["io_read_raw"].rsplit("\nSELECT * FROM rawsnaps", 1)[0]
_DAMAGED = _RAW + """,
dmg AS (SELECT fecha_dato, ncodpers % 101 = 0 AS x, ncodpers % 97 = 0 AS y, ncodpers % 89 = 0 AS z, ncodpers % 83 = 0 AS b, ncodpers AS who, indrel, cod_prov FROM rawsnaps)
"""
ORACLES["io_read_checked"] = _DAMAGED + """SELECT CASE WHEN NOT x THEN who + 9007199254740993 END AS ncodpers, fecha_dato, CASE WHEN NOT y THEN indrel END AS indrel,
  CASE WHEN NOT z AND NOT b THEN cod_prov END AS cod_prov,
  CASE WHEN z OR x OR (y AND indrel IS NOT NULL) THEN concat_ws(';', CASE WHEN z THEN 'cod_prov=1e12' END,
    CASE WHEN y THEN 'indrel=' || indrel || '.7' END, CASE WHEN x THEN 'ncodpers=nobody' END) END AS rescued FROM dmg"""
ORACLES["io_rejects"] = _DAMAGED + """SELECT field, value, reason, count(*) AS n FROM (
  SELECT 'ncodpers' AS field, 'nobody' AS value, 'not a number' AS reason FROM dmg WHERE x UNION ALL
  SELECT 'indrel', indrel || '.7', 'not an integer' FROM dmg WHERE y AND indrel IS NOT NULL UNION ALL
  SELECT 'cod_prov', '1e12', 'out of range' FROM dmg WHERE z) GROUP BY ALL"""
ORACLES["io_write_features"] = PREP["feat_table"]
ORACLES["io_read_pred"] = with_(SNAP, PRED) + "SELECT id, " + ", ".join(f"round({p}, 6) AS {p}" for p in P_COLS) + " FROM pred"

# --- recommendations -----------------------------------------------------------------------------

ORACLES["rec_join_owned"] = with_(*REC) + "SELECT id, " + ", ".join(f"round({p}, 6) AS {p}" for p in P_COLS) + ", " + \
    ", ".join(f"o_{i + 1} AS owned_{i + 1}" for i in range(24)) + " FROM j"
ORACLES["rec_product_counts"] = with_(*REC) + \
    f"SELECT CAST(k AS INTEGER) AS k, {LABELS}[k] AS label, CAST(count_if(p > 0) AS BIGINT) AS n_pos, " \
    "CAST(count_if(p > 0 AND o = 0) AS BIGINT) AS n_new FROM rl GROUP BY k"
ORACLES["rec_anti_owned"] = with_(*REC) + "SELECT id, CAST(k AS INTEGER) AS k FROM cand"
ORACLES["rec_rank"] = with_(*REC) + \
    "SELECT id, CAST(pos AS INTEGER) AS pos, CAST(k AS INTEGER) AS k, round(p, 6) AS score FROM rnk"
ORACLES["rec_top7_tally"] = with_(*REC) + \
    f"SELECT CAST(g.k AS INTEGER) AS k, {LABELS}[g.k] AS label, CAST(coalesce(c.n, 0) AS BIGINT) AS n_top " \
    "FROM (SELECT unnest(range(1, 25)) AS k) g LEFT JOIN (SELECT k, count(*) AS n FROM rnk WHERE pos <= 7 GROUP BY k) c " \
    "ON g.k = c.k"
ORACLES["rec_format"] = with_(*REC) + \
    f"SELECT j.id AS ncodpers, coalesce(string_agg({LABELS}[r.k], ' ' ORDER BY r.pos), '') AS added_products " \
    "FROM j LEFT JOIN rnk r ON r.id = j.id GROUP BY j.id"
ORACLES["io_write_submission"] = ORACLES["rec_format"]
ORACLES["io_submission_file"] = ORACLES["rec_format"]

# --- training logs ------------------------------------------------------------------------------

TLOG = "tlog AS (SELECT CAST(day(ts) - 1 AS INTEGER) AS epoch, CASE WHEN event_type = 'error' THEN 'loss' ELSE event_type END AS metric, avg(value) AS value " \
       "FROM events GROUP BY 1, 2)"


def _improvements(src: str, initial: str) -> str:
    return ("imp AS (SELECT metric, epoch, value FROM (SELECT *, coalesce(min(value) OVER (PARTITION BY metric "
            "ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), " + initial + f") AS bb FROM {src}) "
            "WHERE value < bb)")


_IMP_SELECT = "SELECT metric, epoch, round(value, 6) AS value, " \
              "CAST(epoch = max(epoch) OVER (PARTITION BY metric) AS INTEGER) AS is_best FROM imp"
ORACLES["log_best_epoch"] = with_(TLOG, "mlog AS (SELECT * FROM tlog WHERE metric <> 'loss')", _improvements("mlog", "CAST(1e6 AS DOUBLE)")) + _IMP_SELECT
ORACLES["log_periodic_best"] = with_(
    TLOG, "vlog AS (SELECT * FROM tlog WHERE metric = 'loss' AND epoch % 5 IN (2, 4))",
    _improvements("vlog", "CAST('inf' AS DOUBLE)")) + _IMP_SELECT
ORACLES["log_pivot"] = with_(TLOG) + "SELECT epoch, " + ", ".join(
    f"round(max(CASE WHEN metric = '{m}' THEN value END), 6) AS {m}"
    for m in ("click", "loss", "purchase", "signup", "view")) + " FROM tlog GROUP BY epoch"
ORACLES["log_best_last"] = with_(TLOG) + \
    "SELECT metric, min(epoch) FILTER (WHERE value = mv) AS best_epoch, round(mv, 6) AS best_value, " \
    "max(epoch) AS last_epoch, round(arg_max(value, epoch), 6) AS last_value " \
    "FROM (SELECT *, min(value) OVER (PARTITION BY metric) AS mv FROM tlog) GROUP BY metric, mv"

# --- activations ---------------------------------------------------------------------------------



def _shares(src: str, group: str) -> str:
    """CTEs st (stratum sizes), sh (whole parts of the shares, remainders) and tk (rows to take): ceil(n * 0.005) rows of each group in all."""
    by = f"PARTITION BY {group}" if group else ""
    cols = f"{group}, label" if group else "label"
    spell = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols.split(", "))
    return f"""st AS (SELECT {cols}, count(*) AS n FROM {src} GROUP BY {cols}),
sh AS (SELECT *, CAST(ceil(CAST(sum(n) OVER ({by}) AS DOUBLE) * CAST(0.005 AS DOUBLE)) AS HUGEINT) AS want, sum(n) OVER ({by}) AS total FROM st),
sq AS (SELECT *, n * want // total AS whole, n * want % total AS rest FROM sh),
tk AS (SELECT {cols}, whole + CASE WHEN row_number() OVER ({by} ORDER BY rest DESC, md5({spell})) <= want - sum(whole) OVER ({by}) THEN 1 ELSE 0 END AS take FROM sq)"""


ORACLES["an_stratified_sample"] = "WITH e AS (SELECT vec_id AS id, label FROM embeddings),\n" + _shares("e", "") + \
    "\nSELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) AS rn FROM e) " \
    "JOIN tk USING (label) WHERE rn <= take"
ORACLES["an_label_counts"] = with_(
    SNAP, TRAIN,
    f"tgt AS (SELECT id, unnest(range(1, 25)) AS k, unnest([{ylist()}]) AS label FROM tro WHERE step = n_obs)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY k, label ORDER BY md5(CAST(id AS VARCHAR)), id) AS rn FROM tgt)",
    _shares("tgt", "k"), "smp AS (SELECT k, label FROM rk JOIN tk USING (k, label) WHERE rn <= take)") + \
    "SELECT CAST(t.k AS INTEGER) AS k, CAST(coalesce(s.n_sample, 0) AS BIGINT) AS n_sample, " \
    "CAST(coalesce(s.n_pos_sample, 0) AS BIGINT) AS n_pos_sample, CAST(t.n_pos_total AS BIGINT) AS n_pos_total " \
    "FROM (SELECT k, count_if(label = 1) AS n_pos_total FROM tgt GROUP BY k) t " \
    "LEFT JOIN (SELECT k, count(*) AS n_sample, count_if(label = 1) AS n_pos_sample FROM smp GROUP BY k) s USING (k)"
ORACLES["an_topn_per_dim"] = \
    "WITH z AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS dim, unnest(embedding) AS value " \
    "FROM embeddings),\nr AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY value DESC, id ASC) AS rn FROM z),\n" \
    "top AS (SELECT * FROM r WHERE rn <= 10)\n" \
    "SELECT CAST(dim AS INTEGER) AS dim, count(*) OVER (PARTITION BY dim) - rn + 1 AS pos, id, " \
    "round(CAST(value AS DOUBLE), 6) AS value FROM top"

# --- batches ---------------------------------------------------------------------------------------

_NB = "greatest(n // 256, 1)"
_BATCH = f"least((rn - 1) // 256, {_NB} - 1)"
ORACLES["batch_assign"] = with_(
    SNAP, TRAIN,
    "b AS (SELECT id, n_obs, row_number() OVER (PARTITION BY n_obs ORDER BY md5(CAST(id AS VARCHAR)), id) AS rn, "
    "count(*) OVER (PARTITION BY n_obs) AS n FROM trc)") + \
    f"SELECT id, n_obs, CAST({_BATCH} AS INTEGER) AS batch, " \
    f"CAST(CASE WHEN {_BATCH} < {_NB} - 1 THEN 256 ELSE n - ({_NB} - 1) * 256 END AS BIGINT) AS batch_rows FROM b"
