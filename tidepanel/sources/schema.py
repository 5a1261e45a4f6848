"""Schemas of the bank snapshot table, the experiment ledger and the prediction files."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: names and types of the snapshot columns, in table order ----
SNAPSHOT_COLUMNS = """
    numero_de_cliente int, foto_mes int, marketing_activo_ultimos90dias int, cliente_vip int, internet int,
    cliente_edad int, cliente_antiguedad int, mrentabilidad double, mrentabilidad_annual double,
    mcomisiones double, mactivos_margen double, mpasivos_margen double, marketing_coss_selling int, tpaquete1 int,
    tpaquete2 int, tpaquete3 int, tpaquete4 int, tpaquete5 int, tpaquete6 int, tpaquete7 int, tpaquete8 int,
    tpaquete9 int, tcuentas int, tcuenta_corriente int, mcuenta_corriente_Nopaquete double,
    mcuenta_corriente_Paquete double, mcuenta_corriente_dolares int, tcaja_ahorro int, mcaja_ahorro_Paquete double,
    mcaja_ahorro_Nopaquete double, mcaja_ahorro_dolares double, mdescubierto_preacordado double,
    mcuentas_saldo double, ttarjeta_debito int, ctarjeta_debito_transacciones int, mautoservicio double,
    ttarjeta_visa int, ctarjeta_visa_transacciones int, mtarjeta_visa_consumo double, ttarjeta_master int,
    ctarjeta_master_transacciones int, mtarjeta_master_consumo double, cprestamos_personales int,
    mprestamos_personales double, cprestamos_prendarios int, mprestamos_prendarios double,
    cprestamos_hipotecarios int, mprestamos_hipotecarios double, tplazo_fijo int, mplazo_fijo_dolares double,
    mplazo_fijo_pesos double, tfondos_comunes_inversion int, mfondos_comunes_inversion_pesos double,
    mfondos_comunes_inversion_dolares double, ttitulos int, mtitulos double, tseguro_vida_mercado_abierto int,
    tseguro_auto int, tseguro_vivienda int, tseguro_accidentes_personales int, tcaja_seguridad int,
    mbonos_corporativos int, mmonedas_extranjeras int, minversiones_otras int, tplan_sueldo int,
    mplan_sueldo double, mplan_sueldo_manual double, cplan_sueldo_transaccion int, tcuenta_debitos_automaticos int,
    mcuenta_debitos_automaticos double, ttarjeta_visa_debitos_automaticos int,
    mttarjeta_visa_debitos_automaticos double, ttarjeta_master_debitos_automaticos int,
    mttarjeta_master_debitos_automaticos double, tpagodeservicios int, mpagodeservicios double,
    tpagomiscuentas int, mpagomiscuentas double, ccajeros_propios_descuentos int,
    mcajeros_propios_descuentos double, ctarjeta_visa_descuentos int, mtarjeta_visa_descuentos double,
    ctarjeta_master_descuentos int, mtarjeta_master_descuentos double, ccuenta_descuentos int,
    mcuenta_descuentos int, ccomisiones_mantenimiento int, mcomisiones_mantenimiento double, ccomisiones_otras int,
    mcomisiones_otras double, tcambio_monedas int, ccambio_monedas_compra int, mcambio_monedas_compra double,
    ccambio_monedas_venta int, mcambio_monedas_venta double, ctransferencias_recibidas int,
    mtransferencias_recibidas double, ctransferencias_emitidas int, mtransferencias_emitidas double,
    cextraccion_autoservicio int, mextraccion_autoservicio double, ccheques_depositados int,
    mcheques_depositados double, ccheques_emitidos int, mcheques_emitidos double,
    ccheques_depositados_rechazados int, mcheques_depositados_rechazados double, ccheques_emitidos_rechazados int,
    mcheques_emitidos_rechazados double, tcallcenter int, ccallcenter_transacciones int, thomebanking int,
    chomebanking_transacciones int, tautoservicio int, cautoservicio_transacciones int, tcajas int,
    tcajas_consultas int, tcajas_depositos int, tcajas_extracciones int, tcajas_otras int,
    ccajeros_propio_transacciones int, mcajeros_propio double, ccajeros_ajenos_transacciones int,
    mcajeros_ajenos double, tmovimientos_ultimos90dias int
"""
# Both cards have these columns, prefixed Master_ and Visa_.
CARD_COLUMNS = """
    marca_atraso int, cuenta_estado int, mfinanciacion_limite double, Fvencimiento int, Finiciomora int,
    msaldototal double, msaldopesos double, msaldodolares double, mconsumospesos double, mconsumosdolares double,
    mlimitecompra double, madelantopesos double, madelantodolares double, fultimo_cierre int, mpagado double,
    mpagospesos double, mpagosdolares double, fechaalta int, mconsumototal double, tconsumos int,
    tadelantosefectivo int, mpagominimo double
"""
LABEL_COLUMNS = "clase_ternaria string"
# The card dates: yyyymmdd in the master file, relative days in the monthly files.
CARD_DATES = ("Fvencimiento", "Finiciomora", "fultimo_cierre", "fechaalta")
KEY, PERIOD, LABEL = "numero_de_cliente", "foto_mes", "clase_ternaria"
DATE_COLUMNS = tuple(prefix + name for prefix in ("Master_", "Visa_") for name in CARD_DATES)
# Raw columns dropped before any work.
UNUSED_COLUMNS = ("tpaquete1", "tpaquete2", "tpaquete3", "tpaquete4", "tpaquete5", "tpaquete6", "tpaquete8")
# Columns that get no trend features.
NO_TREND_COLUMNS = (
    "numero_de_cliente", "foto_mes", "marketing_activo_ultimos90dias", "cliente_vip", "internet", "cliente_edad",
    "cliente_antiguedad", "tpaquete7", "tpaquete9", "tcuenta_corriente", "tcaja_seguridad", "tcallcenter",
    "thomebanking", "Master_marca_atraso", "Master_cuenta_estado", "Master_Fvencimiento", "Master_Finiciomora",
    "Master_fultimo_cierre", "Master_fechaalta", "Visa_marca_atraso", "Visa_cuenta_estado", "Visa_Fvencimiento",
    "Visa_Finiciomora", "Visa_fultimo_cierre", "Visa_fechaalta", "clase_ternaria",
)
CATEGORICAL_COLUMNS = ("cliente_edad", "Master_cuenta_estado", "Visa_cuenta_estado")
# --- end of fixed values ------------------------------------------------------


_TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "string": T.StringType(), "timestamp": T.TimestampType(),
}


def struct_of(text: str, prefix: str = "") -> T.StructType:
    """Schema of a ``name type`` list; unlike ``fromDDL`` it needs no running session."""
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(prefix + name, _TYPES[kind]) for name, kind in fields])


def snapshot_schema() -> T.StructType:
    """The 170 columns: 95 int, 74 double, 1 string."""
    parts = [struct_of(SNAPSHOT_COLUMNS)]
    parts += [struct_of(CARD_COLUMNS, prefix) for prefix in ("Master_", "Visa_")]
    parts.append(struct_of(LABEL_COLUMNS))
    return T.StructType([field for part in parts for field in part.fields])


def subset_schema(columns: list[str]) -> T.StructType:
    """Some snapshot columns, with their types, in the given order."""
    full = snapshot_schema()
    return T.StructType([full[c] for c in columns])


PLANS = struct_of("id int, train string, test string, finished timestamp")
PLAN_EVENTS = struct_of("id int, finished timestamp")
EXPERIMENTS = struct_of(
    "id bigint, experiment_code string, minutes_taken double, profit double, profit_0025 double, "
    "auc_testing double, logloss_testing double, auc_training double, logloss_training double, "
    "perfect_profit_ratio double, perfect_profit_ratio_0025 double, cutoff double, algorithm string, "
    "estimation string, train_periods string, test_periods string, observation string, "
    "finished timestamp, plan_id int"
)
HYPERPARAMS = struct_of("experiment_id bigint, name string, value string")
PREDICTIONS = struct_of("X bigint, prob double, class int")
NEW_PREDICTIONS = struct_of("X bigint, prob double")
