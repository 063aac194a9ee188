"""Names, defaults and fixed lookup values.

Everything under "FIXED VALUES" must equal the values the original
recommender used, otherwise features and written lists differ.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original model inputs / outputs exactly)
# ---------------------------------------------------------------------------

# The 24 products in their fixed order (k = 1..24).
PRODUCT_NAMES = [
    "saving", "guarantees", "current", "derivate", "payroll", "junior",
    "particular_M", "particular", "particular_P", "deposit_S", "deposit_M",
    "deposit_L", "eacc", "funds", "mortgage", "pensions", "loans",
    "taxes", "creditcard", "securities", "homeacc",
    "payroll_2", "pensions_2", "direct",
]

# Raw product flag columns / submission labels, same positions as PRODUCT_NAMES.
PRODUCT_LABELS = [
    "ind_ahor_fin_ult1", "ind_aval_fin_ult1", "ind_cco_fin_ult1", "ind_cder_fin_ult1", "ind_cno_fin_ult1", "ind_ctju_fin_ult1",
    "ind_ctma_fin_ult1", "ind_ctop_fin_ult1", "ind_ctpp_fin_ult1", "ind_deco_fin_ult1", "ind_deme_fin_ult1", "ind_dela_fin_ult1",
    "ind_ecue_fin_ult1", "ind_fond_fin_ult1", "ind_hip_fin_ult1", "ind_plan_fin_ult1", "ind_pres_fin_ult1", "ind_reca_fin_ult1",
    "ind_tjcr_fin_ult1", "ind_valo_fin_ult1", "ind_viv_fin_ult1", "ind_nomina_ult1", "ind_nom_pens_ult1", "ind_recibo_ult1",
]

# Countries scored 0.5 by country_num (Spain is 1.0, everything else 0.0).
EU_COUNTRIES = [
    "AT", "BE", "BG", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT",
    "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "SE", "GB", "HR",
]

# Province number -> autonomous community code.
PROVINCE_COMMUNITY = {
    51: "AFR", 52: "AFR",
    4: "AND", 11: "AND", 14: "AND", 18: "AND", 21: "AND", 23: "AND", 29: "AND", 41: "AND",
    22: "ARA", 44: "ARA", 50: "ARA", 33: "AST", 7: "BAL", 1: "BAS", 48: "BAS", 20: "BAS",
    35: "CAN", 38: "CAN", 5: "CAS", 9: "CAS", 24: "CAS", 34: "CAS", 37: "CAS", 40: "CAS", 42: "CAS", 47: "CAS", 49: "CAS",
    8: "CAT", 17: "CAT", 25: "CAT", 43: "CAT", 39: "CNB", 6: "EXT", 10: "EXT",
    15: "GAL", 27: "GAL", 32: "GAL", 36: "GAL", 28: "MAD", 2: "MAN", 13: "MAN", 16: "MAN", 19: "MAN", 45: "MAN",
    30: "MUR", 31: "NAV", 26: "RIO", 3: "VAL", 12: "VAL", 46: "VAL",
}

# Province number -> relative population (largest province = 1.0).
PROVINCE_POP = {
    52: 0.0128, 51: 0.0129, 42: 0.0143, 44: 0.0218, 40: 0.0248, 5: 0.0259,
    34: 0.0260, 49: 0.0289, 16: 0.0326, 22: 0.0348, 19: 0.0396, 1: 0.0494,
    26: 0.0495, 32: 0.0502, 37: 0.0531, 27: 0.0532, 9: 0.0571, 2: 0.0615, 10: 0.0631,
    25: 0.0678, 24: 0.0753, 21: 0.0801, 13: 0.0808, 47: 0.0819, 39: 0.0911,
    12: 0.0926, 31: 0.0992, 23: 0.1023, 6: 0.1068, 4: 0.1076, 45: 0.1087,
    20: 0.1098, 17: 0.1172, 14: 0.1235, 43: 0.1247, 18: 0.1415, 36: 0.1470,
    50: 0.1506, 38: 0.1562, 33: 0.1644, 35: 0.1699, 7: 0.1711, 15: 0.1752,
    48: 0.1780, 11: 0.1906, 30: 0.2266, 29: 0.2544, 41: 0.2989, 3: 0.2995, 46: 0.3951, 8: 0.8530, 28: 1.0000,
}

# Channel codes starting with "0" that get a channel_1 number.
CHANNEL_ZERO_CODES = {"004": 0, "007": 1, "013": 2, "025": 3}

# Columns filled with their mode / their mean by the imputation step.
MODE_FILL_COLS = [
    "employee", "country", "sex", "seniority_new", "is_primary", "customer_type", "customer_rel",
    "is_domestic", "is_foreigner", "is_dead", "channel_0", "channel_1", "channel_2",
    "province", "is_active", "segment",
]
MEAN_FILL_COLS = ["age", "seniority", "income"]

# Columns standardised with mean / sample standard deviation.
ZSCORE_COLS = ["age", "seniority", "income"]

# Base attribute columns of the feature table, in order.
BASE_COLS = [
    "t", "t_month", "id", "sex", "age", "seniority_new", "seniority", "is_primary",
    "is_domestic", "is_foreigner", "is_dead", "is_active", "income",
]

# Attribute vector fed to the scorer (51 names), in order.
ATTR_COLS = [
    "t", "t_month", "sex", "age", "seniority_new", "seniority", "is_primary", "is_domestic", "is_foreigner",
    "is_dead", "is_active", "income", "employee_bit_notN", "country_num", "customer_type_bit_not1",
    "customer_rel_I", "customer_rel_A", "channel_0_0", "channel_0_1", "channel_0_2", "channel_1_0",
    "channel_1_1", "channel_1_2", "channel_1_3", "channel_1_4", "channel_1_5", "channel_1_6", "channel_1_7",
    "channel_1_8", "province_AFR", "province_AND", "province_ARA", "province_AST", "province_BAL",
    "province_BAS", "province_CAN", "province_CAS", "province_CAT", "province_CNB", "province_EXT",
    "province_GAL", "province_MAD", "province_MAN", "province_MUR", "province_NAV", "province_RIO",
    "province_VAL", "province_pop", "segment_1", "segment_2", "segment_3",
]

# Defaults of the original scripts.
BASE_YEAR = 2015          # t = 1 is January of this year
LAST_FILE_MONTH = 17      # last month of the training file
MAX_SEQ_LEN = 17          # months in the original file: the bound of the optional length cut
TOP_K = 7                 # MAP@K and the recommendation tally
BATCH_SIZE = 256
NUM_EPOCHS = 20
LEARNING_RATE = 0.001
SAMPLE_FRACTION = 0.005   # stratified sample of activations
TOP_N_PER_DIM = 10        # customers listed per hidden unit
LOSS_EPS = 1e-7           # probability clip used by the cross-entropy losses
PAD_VALUE = -1.0
VALIDATE_EVERY = 5        # periodic validation: epochs with epoch % 5 in (2, 4)
VALIDATE_AT = (2, 4)

# ---------------------------------------------------------------------------
# Derived names
# ---------------------------------------------------------------------------

NUM_PRODUCTS = len(PRODUCT_NAMES)
Y_COLS = [f"y_{i}_{n}" for i, n in enumerate(PRODUCT_NAMES, start=1)]
P_COLS = [f"p_{i}" for i in range(1, NUM_PRODUCTS + 1)]
COMMUNITIES = sorted(set(PROVINCE_COMMUNITY.values()))
CHANNEL_0_VALUES = [0, 1, 2]
CHANNEL_1_VALUES = list(range(9))
SEGMENT_VALUES = [1, 2, 3]

DERIVED_COLS = (
    ["employee_bit_notN", "country_num", "customer_type_bit_not1", "customer_rel_I", "customer_rel_A"]
    + [f"channel_0_{v}" for v in CHANNEL_0_VALUES]
    + [f"channel_1_{v}" for v in CHANNEL_1_VALUES]
    + [f"province_{c}" for c in COMMUNITIES]
    + ["province_pop"]
    + [f"segment_{v}" for v in SEGMENT_VALUES]
)

# Cleaned table column order (before the products).
CLEAN_COLS = [
    "t", "t_month", "id", "employee", "country", "sex", "age", "seniority_new", "seniority",
    "is_primary", "customer_type", "customer_rel", "is_domestic", "is_foreigner", "is_dead",
    "channel_0", "channel_1", "channel_2", "province", "is_active", "income", "segment",
]

# Raw snapshot file: attribute columns, then (train only) the 24 flags.
RAW_ATTR_COLS = [
    "fecha_dato", "ncodpers", "ind_empleado", "pais_residencia", "sexo", "age", "fecha_alta",
    "ind_nuevo", "antiguedad", "indrel", "ult_fec_cli_1t", "indrel_1mes", "tiprel_1mes", "indresi",
    "indext", "conyuemp", "canal_entrada", "indfall", "tipodom", "cod_prov", "nomprov",
    "ind_actividad_cliente", "renta", "segmento",
]
