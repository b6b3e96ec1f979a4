"""Declared schemas. Optional columns that a table lacks are added as typed nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUSTOMERS = (
    """user_id string, sexo string, estado string, ciudad string, ocupacion string, satisfaccion_1_10 double,
    es_hey_pro string, nomina_domiciliada string, recibe_remesas string, usa_hey_shop string, tiene_seguro string,
    patron_uso_atipico string, nivel_educativo string, preferencia_canal string, canal_apertura string,
    idioma_preferido string, edad int, ingreso_mensual_mxn double, score_buro int, antiguedad_dias int,
    dias_desde_ultimo_login int"""
)
PRODUCTS = (
    """producto_id string, user_id string, tipo_producto string, estatus string, utilizacion_pct double,
    saldo_actual double, limite_credito double, fecha_apertura string, fecha_ultimo_movimiento string"""
)
TRANSACTIONS = (
    """transaccion_id string, user_id string, fecha_hora string, monto double, categoria_mcc string, canal string,
    es_internacional string, patron_uso_atipico string, estatus string, intento_numero int, meses_diferidos int,
    cashback_generado double, hora_del_dia int, dia_semana string, ciudad_transaccion string,
    descripcion_libre string"""
)
TURNS = (
    "conv_id string, user_id string, input string, output string, date string, channel_source int"
)
METRICS = (
    "producto string, col_target string, cv_auc_mean double, cv_auc_std double, test_auc double, pct_positivos double"
)

OPTIONAL_CUSTOMER_COLUMNS = ("nivel_educativo", "preferencia_canal", "canal_apertura", "idioma_preferido")


def columns_of(schema: str) -> dict[str, str]:
    return dict(part.split() for part in schema.split(","))


def with_columns_of(df: DataFrame, schema: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """Checks that required columns exist and adds missing optional ones as typed nulls."""
    declared = columns_of(schema)
    missing = [c for c in declared if c not in df.columns and c not in optional]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    absent = {c: F.lit(None).cast(t) for c, t in declared.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df
