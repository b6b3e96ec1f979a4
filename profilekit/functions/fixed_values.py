"""Word lists, weights, thresholds and column lists that decide the results.

Nothing here is logic. Users with other vocabularies pass their own lists to the builders.
"""

from __future__ import annotations

# --- message vocabulary ------------------------------------------------------------------------

MENU = ["a", "b", "c", "d", "1", "2", "3", "4"]

YES_NO_SHORT = ["si", "sí", "no", "ok", "vale", "gracias", "perfecto", "listo", "entendido", "claro"]
YES_NO = YES_NO_SHORT + ["de acuerdo", "adelante", "continuar"]
YES_NO_API = YES_NO + ["np"]
YES_NO_LABELS = YES_NO_API + ["claro que sí", "por supuesto"]

JOKES = ["chiste", "te amo", "quien eres", "eres humano", "eres ia", "cántame", "gaming", "me ayudas a ligar"]
JOKES_API = JOKES + ["quién eres", "cantame", "cuéntame un chiste", "cuentame un chiste"]
JOKES_LABELS = JOKES_API + ["te quiero", "eres real", "me gustas", "eres bonito", "eres bonita"]
JOKES_AGENT = ["cuéntame un chiste", "cuentame un chiste", "te amo", "eres humano", "eres ia", "me ayudas a ligar"]

FINANCE = [
    "tarjeta", "cuenta", "saldo", "transferencia", "credito", "crédito", "pago", "banco", "inversión", "inversion",
    "spei", "cajero", "cashback", "havi", "hey", "oxxo", "dinero", "cobro", "token", "clabe",
]
FINANCE_SERVER = FINANCE + ["préstamo"]
FINANCE_API = FINANCE_SERVER + ["prestamo", "límite", "limite", "cargo", "movimiento", "gat", "msi"]
FINANCE_LABELS = FINANCE_SERVER + [
    "prestamo", "límite", "limite", "cargo", "movimiento", "estado de cuenta", "bloquear", "reposición", "nip", "pin",
    "interes", "interés", "plazo",
]

INTENTS = {
    "credito": ["crédito", "credito", "préstamo", "prestamo", "financiamiento"],
    "transferencia": ["transferencia", "spei", "clabe", "enviar", "envío"],
    "tarjeta": ["tarjeta", "bloquear", "robo", "cancelar"],
    "inversion": ["inversión", "inversion", "rendimiento", "gat", "ahorro"],
    "aclaracion": ["cobro", "cargo", "disputa", "reembolso", "no reconozco"],
    "seguridad": ["contraseña", "nip", "pin", "token", "bloqueado"],
    "negocio": ["negocio", "empresa", "terminal", "pos", "factura"],
    "seguro": ["seguro", "vida", "protección"],
}
INTENT_OTHER = "otro"

URGENCY = ["urgente", "urge", "inmediato", "rápido"]
FRUSTRATION = ["error", "no funciona", "no me deja", "problema", "falla"]

# --- noise weights and thresholds --------------------------------------------------------------

TURN_WEIGHTS = {
    "artefacto_voz": 0.20, "menu_navegacion": 0.55, "afirmacion_negacion": 0.40, "exploracion_corta": 0.65,
    "broma_offtopic": 0.85, "solo_simbolos": 0.90, "on_topic": 0.0,
}
GATE_WEIGHTS = {"simbolos": 0.90, "broma": 0.90, "menu": 0.55, "afirm": 0.40, "exploracion": 0.65, "on_topic": 0.0}
FINANCE_DAMPING = 0.45
MESSAGE_GATE = 0.55
USER_GATE = 0.40
NOISY_TURN = 0.35
VOICE_CHANNEL = 2
VOICE_SHARE = 0.30
RETRY_HOURS = 48
TREND_MIN_TURNS = 4

# --- transactions and products -----------------------------------------------------------------

DIGITAL_CHANNELS = ["app_ios", "app_android", "app_huawei", "codi"]
CASH_CHANNELS = ["cajero_banregio", "cajero_externo", "oxxo", "farmacia_ahorro"]
WEEKEND = ["Saturday", "Sunday"]
COUNTED_CATEGORIES = {
    "txn_n_viajes": "viajes", "txn_n_servicios_dig": "servicios_digitales",
    "txn_n_supermercado": "supermercado", "txn_n_restaurante": "restaurante",
}
PRODUCT_TYPES = [
    "tarjeta_credito_hey", "tarjeta_credito_garantizada", "credito_personal", "credito_nomina", "credito_auto",
    "inversion_hey", "seguro_vida", "seguro_compras", "cuenta_negocios", "tarjeta_credito_negocios",
]
MODELLED_PRODUCTS = [
    "tarjeta_credito_hey", "inversion_hey", "seguro_vida", "seguro_compras", "credito_personal", "credito_nomina",
    "credito_auto", "tarjeta_credito_garantizada", "cuenta_negocios",
]
DEFAULT_SATISFACTION = 7.5

# --- column lists ------------------------------------------------------------------------------

CUSTOMER_FLAGS = [
    "es_hey_pro", "nomina_domiciliada", "recibe_remesas", "usa_hey_shop", "tiene_seguro", "patron_uso_atipico",
]
TRANSACTION_FLAGS = ["es_internacional", "patron_uso_atipico"]
CATEGORICAL = [
    "nivel_educativo", "ocupacion", "genero", "estado", "ciudad", "preferencia_canal", "canal_apertura",
    "idioma_preferido",
]
CLUSTER_FEATURES = [
    "edad", "ingreso_mensual_mxn", "score_buro", "antiguedad_dias", "txn_monto_prom", "txn_pct_digital",
    "txn_pct_efectivo", "txn_pct_inter", "txn_n_viajes", "txn_volatilidad", "txn_frec_por_dia", "txn_pct_nocturno",
    "txn_pct_atipico", "txn_n_msi", "prod_n_activos", "prod_util_media", "prod_util_max", "prod_ratio_problematicos",
    "conv_n_total", "conv_pct_voz", "conv_input_len_med", "conv_urgencia", "conv_frustracion", "conv_noise_pct",
    "conv_noise_score", "intent_credito", "intent_inversion", "intent_negocio", "intent_aclaracion",
]
PROPENSITY_FEATURES = [
    "edad", "ingreso_mensual_mxn", "score_buro", "antiguedad_dias", "nivel_educativo", "ocupacion",
    "nomina_domiciliada", "recibe_remesas", "es_hey_pro", "usa_hey_shop", "satisfaccion_1_10",
    "dias_desde_ultimo_login", "txn_total", "txn_monto_prom", "txn_monto_total", "txn_pct_digital",
    "txn_pct_efectivo", "txn_pct_inter", "txn_n_viajes", "txn_n_servicios_dig", "txn_n_supermercado",
    "txn_n_restaurante", "txn_pct_atipico", "txn_pct_fallida", "txn_n_msi", "txn_cashback_total", "txn_volatilidad",
    "txn_frec_por_dia", "txn_hora_media", "txn_pct_finde", "txn_pct_nocturno", "prod_n_activos", "prod_util_media",
    "prod_util_max", "prod_saldo_total", "prod_limite_total", "prod_ratio_problematicos", "conv_n_total",
    "conv_pct_voz", "conv_turnos_prom", "conv_urgencia", "conv_frustracion", "conv_reintentos_48h", "conv_noise_pct",
    "conv_noise_score", "intent_credito", "intent_inversion", "intent_tarjeta", "intent_aclaracion", "intent_negocio",
    "segmento_id",
]
PROFILE_CONTEXT = [
    "ingreso_mensual_mxn", "score_buro", "antiguedad_dias", "ocupacion", "nivel_educativo", "satisfaccion_1_10",
    "dias_desde_ultimo_login", "es_hey_pro", "nomina_domiciliada", "conv_n_total", "conv_frustracion",
    "conv_urgencia", "intent_credito", "intent_inversion",
]
SEGMENT_DIMENSIONS = ["tono", "canal", "horario", "estilo", "longitud", "emojis", "urgencia"]

# --- retrieval and calibration -----------------------------------------------------------------

DENSE_MIN_SIM = 0.65
SPARSE_MIN_SIM = 0.15
TOP_K = 3
CANDIDATE_FACTOR = 3
ANSWER_PREFIX = 60
VOCABULARY_SIZE = 15000
THRESHOLD_GRID = [0.35 + 0.01 * i for i in range(41)]
DEFAULT_THRESHOLD = 0.5
MIN_POSITIVE_RATE = 0.03
MAX_POSITIVE_RATE = 0.97
MIN_RECOMMENDED = 0.10
STRESSED_UTILISATION = 0.85
CHURN_LOGIN_DAYS = 30
CHURN_SATISFACTION = 6
FRUSTRATION_ALERT = 2

# --- files ---------------------------------------------------------------------------------------

# texts that stand for a missing value in the input files
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
