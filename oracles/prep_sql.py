"""Oracle SQL: cleaning, imputation, features, scaling."""

from __future__ import annotations

from nextbuy.constants import (ATTR_COLS, COMMUNITIES, EU_COUNTRIES, MEAN_FILL_COLS, MODE_FILL_COLS, PRODUCT_LABELS,
                               PROVINCE_COMMUNITY, PROVINCE_POP, Y_COLS)

from .duckdb_sql import BASE_YEAR, JULY, PAD_LEN, SNAP, TEST, TEST_MONTH, TRAIN, TRAIN_MONTH, ap_ctes, circ, summary_sql, tscaled, with_, ysum

ORACLES: dict[str, str] = {}

GEO_JOIN = ("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
            "JOIN region ON n_regionkey = r_regionkey")

# FIXTURES.md 3.2, one row per order.
RAWSNAP = f"""rawsnap AS (SELECT o_orderkey, o_custkey AS ncodpers, o_orderdate AS fecha_dato,
  CASE o_orderkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'A' END AS ind_empleado,
  CASE o_orderkey % 6 WHEN 0 THEN 'ES' WHEN 1 THEN 'FR' WHEN 2 THEN 'DE' WHEN 3 THEN 'US' WHEN 4 THEN 'ES' END AS pais_residencia,
  CASE o_orderstatus WHEN 'F' THEN 'H' WHEN 'O' THEN 'V' ELSE o_orderstatus END AS sexo,
  CASE WHEN o_orderkey % 11 = 0 THEN ' NA' ELSE concat(' ', CAST(18 + o_orderkey % 80 AS VARCHAR)) END AS age,
  CAST(c_acctbal AS DOUBLE) AS antiguedad,
  CASE WHEN o_orderkey % 13 = 0 THEN 99 ELSE 1 END AS indrel,
  CASE o_orderkey % 7 WHEN 0 THEN '1' WHEN 1 THEN '1.0' WHEN 2 THEN '2.0' WHEN 3 THEN '3' WHEN 4 THEN 'P' WHEN 5 THEN '1.0' END AS indrel_1mes,
  CASE o_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'I' WHEN 2 THEN 'P' WHEN 3 THEN 'R' ELSE 'N' END AS tiprel_1mes,
  CASE o_orderkey % 9 WHEN 0 THEN 'KAT' WHEN 1 THEN 'KHE' WHEN 2 THEN 'RED' WHEN 3 THEN '007' WHEN 4 THEN '013'
                      WHEN 5 THEN '002' WHEN 6 THEN 'K00' WHEN 7 THEN 'K' END AS canal_entrada,
  c_nationkey AS cod_prov, r_name AS community, c_mktsegment AS market,
  CASE WHEN o_orderkey % 10 = 0 THEN '         NA' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS renta,
  o_orderpriority AS segmento
FROM {GEO_JOIN})"""

# Raw-file schema, one row per (customer, month): attributes of the month's first order.
RAWSNAPS = f"""ro AS (SELECT *, CAST(12 * (year(o_orderdate) - {BASE_YEAR}) + month(o_orderdate) AS INTEGER) AS t FROM orders),
fo AS (SELECT o_custkey AS fid, t AS ft, min(o_orderkey) AS fk FROM ro GROUP BY 1, 2),
rawsnaps AS (SELECT strftime(o.o_orderdate, '%Y-%m-%d') AS fecha_dato, o.o_custkey AS ncodpers,
  CASE o_orderkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'A' END AS ind_empleado,
  CASE o_orderkey % 6 WHEN 0 THEN 'ES' WHEN 1 THEN 'FR' WHEN 2 THEN 'DE' WHEN 3 THEN 'US' WHEN 4 THEN 'ES' END AS pais_residencia,
  CASE o_orderstatus WHEN 'F' THEN 'H' WHEN 'O' THEN 'V' ELSE o_orderstatus END AS sexo,
  CASE WHEN o_orderkey % 11 = 0 THEN ' NA' ELSE concat(' ', CAST(18 + o_orderkey % 80 AS VARCHAR)) END AS age,
  strftime(o.o_orderdate, '%Y-%m-%d') AS fecha_alta,
  CASE o_orderkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS ind_nuevo,
  CASE WHEN o_orderkey % 23 = 0 THEN '-999999'
       ELSE concat('     ', CAST(CAST(floor(c_acctbal / 40) AS BIGINT) AS VARCHAR)) END AS antiguedad,
  CASE WHEN o_orderkey % 13 = 0 THEN 99 ELSE 1 END AS indrel,
  CAST(NULL AS VARCHAR) AS ult_fec_cli_1t,
  CASE o_orderkey % 7 WHEN 0 THEN '1' WHEN 1 THEN '1.0' WHEN 2 THEN '2.0' WHEN 3 THEN '3' WHEN 4 THEN 'P' WHEN 5 THEN '1.0' END AS indrel_1mes,
  CASE o_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'I' WHEN 2 THEN 'P' WHEN 3 THEN 'R' ELSE 'N' END AS tiprel_1mes,
  CASE WHEN o_orderkey % 8 = 0 THEN 'N' WHEN o_orderkey % 8 = 7 THEN NULL ELSE 'S' END AS indresi,
  CASE WHEN o_orderkey % 5 = 0 THEN 'S' ELSE 'N' END AS indext,
  CAST(NULL AS VARCHAR) AS conyuemp,
  CASE o_orderkey % 9 WHEN 0 THEN 'KAT' WHEN 1 THEN 'KHE' WHEN 2 THEN 'RED' WHEN 3 THEN '007' WHEN 4 THEN '013'
                      WHEN 5 THEN '002' WHEN 6 THEN 'K00' WHEN 7 THEN 'K' END AS canal_entrada,
  CASE WHEN o_orderkey % 17 = 0 THEN 'S' ELSE 'N' END AS indfall,
  1 AS tipodom, c_nationkey AS cod_prov, n_name AS nomprov,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS VARCHAR) END AS ind_actividad_cliente,
  CASE WHEN o_orderkey % 10 = 0 THEN '         NA' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS renta,
  concat('0', substr(o_orderpriority, 1, 1), ' - ', substr(o_orderpriority, 3)) AS segmento,
  {", ".join(f"CASE WHEN fo.ft % 10 = 0 THEN NULL ELSE coalesce(snap.{y}, 0) END AS {l}" for y, l in zip(Y_COLS, PRODUCT_LABELS))}
FROM fo JOIN orders o ON o.o_orderkey = fo.fk JOIN customer ON o.o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN snap ON snap.id = fo.fid AND snap.t = fo.ft)"""


def letter(ch: str) -> str:
    return f"(CASE WHEN regexp_matches({ch}, '^[A-Z]$') THEN ascii({ch}) - 64 END)"


def strip_code(c: str) -> str:
    x = f"regexp_replace({c}, '.0', '', 'g')"
    return f"CASE WHEN {x} = 'P' THEN '0' ELSE {x} END"


def clean_select(src: str, seg_pos: int, keep: str = "", products: bool = False) -> str:
    """SELECT list of the cleaning step over a raw table ``src``."""
    ce = "canal_entrada"
    cols = [
        f"CAST(12 * (year(CAST(fecha_dato AS DATE)) - {BASE_YEAR}) + month(CAST(fecha_dato AS DATE)) AS INTEGER) AS t",
        "CAST(month(CAST(fecha_dato AS DATE)) AS INTEGER) AS t_month",
        "ncodpers AS id",
        "CASE WHEN ind_empleado IS NULL OR ind_empleado = 'S' THEN 'N' ELSE ind_empleado END AS employee",
        "pais_residencia AS country",
        "CASE sexo WHEN 'H' THEN 1 WHEN 'V' THEN 0 END AS sex",
        "TRY_CAST(age AS DOUBLE) AS age",
    ]
    if products:
        cols.append("TRY_CAST(TRY_CAST(ind_nuevo AS DOUBLE) AS INTEGER) AS seniority_new")
    cols += [
        "TRY_CAST(antiguedad AS DOUBLE) AS seniority",
        "CASE WHEN TRY_CAST(indrel AS INTEGER) = 99 THEN 0 ELSE TRY_CAST(indrel AS INTEGER) END AS is_primary",
        f"{strip_code('indrel_1mes')} AS customer_type",
        "CASE WHEN tiprel_1mes = 'N' THEN 'A' ELSE tiprel_1mes END AS customer_rel",
    ]
    if products:
        cols += [f"CASE {c} WHEN 'S' THEN 1 WHEN 'N' THEN 0 END AS {n}"
                 for c, n in (("indresi", "is_domestic"), ("indext", "is_foreigner"), ("indfall", "is_dead"))]
    cols += [
        f"CASE WHEN {ce} IS NULL THEN NULL WHEN {ce} LIKE '0%' THEN 1 WHEN {ce} = 'RED' THEN 2 ELSE 0 END AS channel_0",
        f"CASE WHEN {ce} IS NULL THEN NULL WHEN {ce} LIKE '0%' THEN "
        f"(CASE {ce} WHEN '004' THEN 0 WHEN '007' THEN 1 WHEN '013' THEN 2 WHEN '025' THEN 3 END) "
        f"WHEN substr({ce}, 1, 1) = 'K' AND substr({ce}, 2, 1) <> '0' THEN {letter(f'substr({ce}, 2, 1)')} "
        f"ELSE 0 END AS channel_1",
        f"CASE WHEN {ce} IS NULL THEN NULL "
        f"WHEN substr({ce}, 1, 1) = 'K' AND substr({ce}, 3, 1) <> '0' THEN {letter(f'substr({ce}, 3, 1)')} "
        f"ELSE 0 END AS channel_2",
        "TRY_CAST(TRY_CAST(cod_prov AS DOUBLE) AS INTEGER) AS province",
    ]
    if products:
        cols.append("TRY_CAST(TRY_CAST(ind_actividad_cliente AS DOUBLE) AS INTEGER) AS is_active")
    cols += [
        "TRY_CAST(regexp_replace(renta, 'NA', '', 'g') AS DOUBLE) AS income",
        f"TRY_CAST(substr(segmento, {seg_pos + 1}, 1) AS INTEGER) AS segment",
    ]
    if products:
        cols += [f"coalesce(CAST({l} AS INTEGER), 0) AS {y}" for l, y in zip(PRODUCT_LABELS, Y_COLS)]
    return "SELECT " + (keep + ", " if keep else "") + ", ".join(cols) + f" FROM {src}"


OCLEAN = RAWSNAP + ",\noc AS (" + clean_select("rawsnap", 0, keep="o_orderkey") + ")"
SCLEAN = SNAP + ",\n" + RAWSNAPS + ",\nsc AS (" + clean_select("rawsnaps", 1, products=True) + ")"


def on_orders(cols: str) -> str:
    return with_(OCLEAN) + f"SELECT o_orderkey, {cols} FROM oc"


ORACLES["clean_month_index"] = on_orders("t, t_month")
ORACLES["clean_select"] = "WITH " + SCLEAN + "\nSELECT * FROM sc"
ORACLES["clean_default_code"] = on_orders("employee")
ORACLES["clean_binary_map"] = "WITH " + SCLEAN + "\nSELECT id, t, sex, is_domestic, is_foreigner, is_dead FROM sc"
ORACLES["clean_try_numeric"] = "WITH " + SCLEAN + "\nSELECT id, t, age, seniority, province, is_active, seniority_new FROM sc"
ORACLES["clean_sentinel"] = on_orders("is_primary")
ORACLES["clean_regex_strip"] = on_orders("customer_type")
ORACLES["clean_merge_code"] = on_orders("customer_rel")
ORACLES["clean_substring"] = with_(RAWSNAP) + \
    "SELECT o_orderkey, substr(canal_entrada, 1, 1) AS ch_0, substr(canal_entrada, 2, 1) AS ch_1, " \
    "substr(canal_entrada, 3, 1) AS ch_2, TRY_CAST(substr(segmento, 1, 1) AS INTEGER) AS segment FROM rawsnap"
ORACLES["clean_channel"] = on_orders("channel_0, channel_1, channel_2")
ORACLES["clean_income"] = on_orders("income")
ORACLES["clean_products"] = with_(SNAP) + "SELECT id, t, " + \
    ", ".join(f"CASE WHEN t % 10 = 0 THEN 0 ELSE {y} END AS {y}" for y in Y_COLS) + " FROM snap"

_SC_COLS = ["t", "t_month", "id", "employee", "country", "sex", "age", "seniority_new", "seniority", "is_primary",
            "customer_type", "customer_rel", "is_domestic", "is_foreigner", "is_dead", "channel_0", "channel_1",
            "channel_2", "province", "is_active", "income", "segment"] + Y_COLS
ORACLES["clean_null_profile"] = "WITH " + SCLEAN + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, CAST(count(*) - count({c}) > 0 AS INTEGER) AS has_null FROM sc"
    for c in _SC_COLS)

ORACLES["scale_clamp"] = on_orders("CASE WHEN seniority < 0 THEN 0 ELSE seniority END AS seniority")


def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM sc WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)"


ORACLES["impute_mode"] = "WITH " + SCLEAN + "\nSELECT id, t, " + \
    ", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in MODE_FILL_COLS) + " FROM sc"
ORACLES["impute_mean"] = "WITH " + SCLEAN + "\nSELECT id, t, " + \
    ", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM sc)), 6) AS {c}" for c in MEAN_FILL_COLS) + " FROM sc"

_WIDE = {"lineitem": {"l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_shipdate": "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)", "l_extendedprice": "l_extendedprice",
                      "l_returnflag": "l_returnflag"},
         "orders": {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderdate": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "o_totalprice": "o_totalprice"}}
ORACLES["impute_mode_wide"] = "SELECT " + ", ".join(
    f"(SELECT {e} FROM {t} WHERE {e} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {c}" for t, cols in _WIDE.items() for c, e in cols.items())

_EU = ", ".join(f"'{c}'" for c in EU_COUNTRIES)
_COMMUNITY = "(CASE province " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PROVINCE_COMMUNITY.items()) + " END)"
_POP = "(CASE province " + " ".join(f"WHEN {k} THEN CAST({v} AS DOUBLE)" for k, v in PROVINCE_POP.items()) + " END)"

FEATURES = {
    "employee_bit_notN": "CASE WHEN employee IS NULL OR employee <> 'N' THEN 1 ELSE 0 END",
    "country_num": f"CASE WHEN country = 'ES' THEN CAST(1.0 AS DOUBLE) WHEN country IN ({_EU}) THEN CAST(0.5 AS DOUBLE) "
                   f"ELSE CAST(0.0 AS DOUBLE) END",
    "customer_type_bit_not1": "1",
    "customer_rel_I": "CASE WHEN customer_rel IN ('I', 'P') THEN 1 ELSE 0 END",
    "customer_rel_A": "CASE WHEN customer_rel IN ('A', 'R') THEN 1 ELSE 0 END",
    **{f"channel_0_{v}": f"CASE WHEN channel_0 = {v} THEN 1 ELSE 0 END" for v in range(3)},
    **{f"channel_1_{v}": f"CASE WHEN channel_1 = {v} THEN 1 ELSE 0 END" for v in range(9)},
    **{f"province_{c}": f"CASE WHEN {_COMMUNITY} = '{c}' THEN 1 ELSE 0 END" for c in COMMUNITIES},
    "province_pop": _POP,
    **{f"segment_{v}": f"CASE WHEN segment = {v} THEN 1 ELSE 0 END" for v in range(1, 4)},
}


def feat_sql(names) -> str:
    return ", ".join(f"{FEATURES[n]} AS {n}" for n in names)


ORACLES["feat_flag_ne"] = on_orders(
    "CASE WHEN employee IS NULL OR employee <> 'N' THEN 1 ELSE 0 END AS employee_bit_notN, 1 AS customer_type_bit_not1, "
    "CASE WHEN customer_type IS NULL OR customer_type <> '1' THEN 1 ELSE 0 END AS customer_type_fixed")
ORACLES["feat_tiered_in"] = on_orders(feat_sql(["country_num"]))
ORACLES["feat_group_flags"] = on_orders(feat_sql(["customer_rel_I", "customer_rel_A"]))
ORACLES["feat_onehot"] = on_orders(feat_sql([f"channel_0_{v}" for v in range(3)] + [f"channel_1_{v}" for v in range(9)]
                                            + [f"segment_{v}" for v in range(1, 4)]))
ORACLES["feat_lookup_onehot"] = on_orders(feat_sql([f"province_{c}" for c in COMMUNITIES]))
ORACLES["feat_lookup_value"] = on_orders(feat_sql(["province_pop"]))

_IMPUTED = "im AS (SELECT t, t_month, id, " + ", ".join(
    f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in MODE_FILL_COLS) + ", " + ", ".join(
    f"coalesce({c}, (SELECT avg({c}) FROM sc)) AS {c}" for c in MEAN_FILL_COLS) + ", " + ", ".join(Y_COLS) + " FROM sc)"
_BASE = ["t", "t_month", "id", "sex", "age", "seniority_new", "seniority", "is_primary", "is_domestic", "is_foreigner",
         "is_dead", "is_active", "income"]
ORACLES["feat_table"] = "WITH " + SCLEAN + ",\n" + _IMPUTED + "\nSELECT " + \
    ", ".join(f"round({c}, 6) AS {c}" if c in MEAN_FILL_COLS else c for c in _BASE) + ", " + \
    feat_sql(FEATURES) + ", " + ", ".join(Y_COLS) + " FROM im"

_Z = ["age", "seniority", "income"]
ORACLES["scale_zstats"] = with_(OCLEAN) + "SELECT " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in _Z) + " FROM oc"
_ZST = "zs AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _Z) + " FROM oc {where})"
ORACLES["scale_zscore"] = with_(OCLEAN, _ZST.format(where="")) + "SELECT o_orderkey, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _Z) + " FROM oc, zs"
ORACLES["scale_fit_apply"] = with_(OCLEAN, _ZST.format(where=f"WHERE t <= {TRAIN_MONTH}")) + \
    "SELECT o_orderkey, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _Z) + \
    f" FROM oc, zs WHERE t = {TEST_MONTH}"
ORACLES["scale_time"] = with_(SNAP) + f"SELECT id, t, round({tscaled('t')}, 6) AS t_scaled FROM snap WHERE t <= {TRAIN_MONTH}"
ORACLES["scale_month_circular"] = with_(SNAP) + f"SELECT id, t, t_month, round({circ('t_month')}, 6) AS t_month_scaled FROM snap"

# --- full-width training and test sets (2.6) over the feature table ---------------------------------

_FE = SCLEAN + ",\n" + _IMPUTED + ",\nfe AS (SELECT " + ", ".join(_BASE) + ", " + feat_sql(FEATURES) + ", " + ", ".join(Y_COLS) + " FROM im)"
_CLAMPED = "CASE WHEN {0}seniority < 0 THEN 0 ELSE {0}seniority END"


def _zs(seniority: str) -> str:
    """Means and deviations over the training months, of the given form of seniority."""
    cols = {"age": "age", "seniority": seniority, "income": "income"}
    return "zs AS (SELECT " + ", ".join(f"avg({e}) AS m_{c}, stddev_samp({e}) AS s_{c}" for c, e in cols.items()) + \
        f" FROM fe WHERE t <= {TRAIN_MONTH})"


def _attr(c: str) -> str:
    value = {"t": tscaled("a.t"), "t_month": circ("a.t_month")}.get(c, f"a.{c}")
    if c in _Z:
        value = f"(({_CLAMPED.format('a.') if c == 'seniority' else value}) - m_{c}) / s_{c}"
    return f"round(CAST({value} AS DOUBLE), 6) AS a_{c}"


_ATTRS = ", ".join(map(_attr, ATTR_COLS))
_TR, _TE = TRAIN.replace("FROM snap", "FROM fe"), TEST.replace("FROM snap", "FROM fe")
ORACLES["seq_trainset"] = "WITH " + ",\n".join((_FE, _zs(_CLAMPED.format("")), _TR)) + "\n" + summary_sql("tro", _ATTRS, ", zs")
ORACLES["seq_trainset_buyers"] = ORACLES["seq_trainset"] + \
    f" AND a.id IN (SELECT id FROM fe WHERE t <= {TRAIN_MONTH} GROUP BY id HAVING sum({ysum()}) > 0)"
ORACLES["seq_testset"] = "WITH " + ",\n".join((_FE, _zs("seniority"), _TE)) + "\n" + summary_sql("teo", _ATTRS, ", zs")
ORACLES["seq_testset_file"] = "WITH " + ",\n".join((_FE, _zs("seniority"), _TE)) + "\n" + summary_sql("teo", _ATTRS, ", zs", has_y=False)
ORACLES["seq_testset_padded"] = "WITH " + ",\n".join((
    _FE, _TE, f"grid AS (SELECT id, n_obs, {PAD_LEN} - (n_obs - 1) AS npad, unnest(range(1, {PAD_LEN + 1})) AS step FROM tec)")) + \
    "\nSELECT g.id, CAST(g.step AS INTEGER) AS step, " + \
    f"round(CASE WHEN g.step <= g.npad THEN -1.0 ELSE {tscaled('teo.t')} END, 6) AS c_1, " + \
    f"round(CASE WHEN g.step <= g.npad THEN -1.0 ELSE {circ('teo.t_month')} END, 6) AS c_2, " + \
    ", ".join(f"CASE WHEN g.step <= g.npad THEN -1.0 ELSE CAST(teo.{c} AS DOUBLE) END AS c_{i + 3}" for i, c in enumerate(Y_COLS)) + \
    " FROM grid g LEFT JOIN teo ON teo.id = g.id AND teo.step = g.step - g.npad"
ORACLES["imp_off"] = ORACLES["clean_select"]

ORACLES["seq_incremental_train"] = ORACLES["seq_trainset"]
ORACLES["seq_incremental_test"] = ORACLES["seq_testset"]


def _earlier(sql: str, by: int = 6) -> str:
    """An oracle for the months that lie ``by`` (half a year) before the usual ones."""
    months = JULY[1:-1].split(", ")
    sql = sql.replace(JULY, "[" + ", ".join(months[by:] + months[:by]) + "]")
    for month in (TEST_MONTH, TEST_MONTH - 1):
        for form in (f"t = {month}", f"t <= {month}", f"CAST({month} AS DOUBLE)"):
            sql = sql.replace(form, form.replace(str(month), f"@{month - by}@"))
    return sql.replace("@", "")


def _part(key: str, month: int, part: str, sql: str) -> str:
    return f"SELECT {month} AS test_month, '{part}' AS part, {key}.* FROM ({sql}) {key}"


ORACLES["seq_rolling_sets"] = "\nUNION ALL\n".join(
    _part(f"r{i}", m, part, sql) for i, (m, part, sql) in enumerate((m, part, turn(ORACLES[key])) for m, turn in (
        (TEST_MONTH - 6, _earlier), (TEST_MONTH, str)) for part, key in (("train", "seq_trainset"), ("test", "seq_testset"))))

# --- scores by fixed weights (2.7) -------------------------------------------------------------------


def _value(c: str) -> str:
    """An attribute of the target row as the vector holds it."""
    value = {"t": tscaled("a.t"), "t_month": circ("a.t_month"), "seniority": _CLAMPED.format("a.")}.get(c, f"a.{c}")
    return f"({value} - m_{c}) / s_{c}" if c in _Z else value


_VECTOR = "[" + ", ".join(f"coalesce(CAST({_value(c)} AS DOUBLE), 0)" for c in ATTR_COLS) + "]"
_CHANNELS = ", ".join([tscaled("teo.t"), circ("teo.t_month"), *[f"CAST(teo.{c} AS DOUBLE)" for c in Y_COLS]])
_WEIGHT = "((7 * k + 13 * (i + 1)) % 25 - 12) / 200.0::DOUBLE"
_FIXED = ",\n".join((
    _FE, _zs("seniority"), _TE,
    f"attr AS (SELECT a.id, unnest(range({len(ATTR_COLS)})) AS i, unnest({_VECTOR}) AS v FROM teo a, zs WHERE a.step = a.n_obs)",
    f"grid AS (SELECT id, n_obs, {PAD_LEN} - (n_obs - 1) AS npad, unnest(range(1, {PAD_LEN + 1})) AS step FROM tec)",
    f"""hist AS (SELECT g.id, {len(ATTR_COLS)} + (g.step - 1) * 26 + unnest(range(26)) AS i,
  unnest(CASE WHEN g.step <= g.npad THEN list_transform(range(26), lambda z: CAST(-1.0 AS DOUBLE)) ELSE [{_CHANNELS}] END) AS v
  FROM grid g LEFT JOIN teo ON teo.id = g.id AND teo.step = g.step - g.npad)""",
    "cells AS (SELECT * FROM attr UNION ALL SELECT * FROM hist)",
    f"""fixed AS (SELECT id, k + 1 AS k, 1 / (1 + exp(-(sum(v * {_WEIGHT}) + {_WEIGHT.replace('i + 1', '0')}))) AS p
  FROM cells, (SELECT unnest(range(24)) AS k) GROUP BY id, k)"""))
ORACLES["score_fixed_weights"] = "WITH " + _FIXED + "\nSELECT id, " + \
    ", ".join(f"round(max(p) FILTER (k = {i}), 6) AS p_{i}" for i in range(1, 25)) + " FROM fixed GROUP BY id"
ORACLES["eval_fixed_weights"] = "WITH " + _FIXED + f""",
lng AS (SELECT fixed.id, fixed.k, [{", ".join("a." + c for c in Y_COLS)}][fixed.k] AS y, [{", ".join("b." + c for c in Y_COLS)}][fixed.k] AS yl, fixed.p
  FROM fixed JOIN teo a ON a.id = fixed.id AND a.step = a.n_obs JOIN teo b ON b.id = fixed.id AND b.step = b.n_obs - 1),
nw AS (SELECT id, k, greatest(0, least(1, y - yl)) AS y, (1 - yl) * p AS p FROM lng),
{ap_ctes("nw", "n_")},
ls AS (SELECT id, avg(-(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))) AS loss FROM lng GROUP BY id)
SELECT count(*) AS n, round(avg(loss), 6) AS loss, round((SELECT avg(ap) FROM n_ap), 6) AS map_new FROM ls"""
# fills learnt on the training months only
_LATE = ORACLES["score_fixed_weights"].replace("FROM sc WHERE ", f"FROM sc WHERE t <= {TRAIN_MONTH} AND ")
for _c in MEAN_FILL_COLS:
    _LATE = _LATE.replace(f"avg({_c}) FROM sc)", f"avg({_c}) FROM sc WHERE t <= {TRAIN_MONTH})")
ORACLES["score_from_artifact"] = _LATE
