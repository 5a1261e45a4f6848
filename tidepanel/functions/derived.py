"""The 63 present-month features of the bank snapshot, as a list of formulas.

Each formula names its inputs; :func:`add_present_features` turns the list into
two projections: the card totals first, then everything that divides by them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame


class Formula(NamedTuple):
    """``op`` over ``inputs``; for quotients ``over`` names the divisor's terms."""

    name: str
    op: str
    inputs: tuple[str, ...]
    over: tuple[str, ...] = ()


# --- Fixed values: which columns go into which feature -----------------------
# Both cards have the same columns, with these two prefixes.
CARDS = ("Master_", "Visa_")
CARD_LATEST = {"cuenta_estado2": "cuenta_estado", "marca_atraso": "marca_atraso", "fultimo_cierre": "fultimo_cierre", "fechaalta": "fechaalta"}
CARD_EARLIEST = ("Fvencimiento", "Finiciomora")
CARD_TOTALS = (
    "mfinanciacion_limite", "msaldototal", "msaldopesos", "msaldodolares", "mconsumospesos", "mconsumosdolares",
    "mlimitecompra", "madelantopesos", "madelantodolares", "mpagado", "mpagospesos", "mpagosdolares",
    "mconsumototal", "tconsumos", "tadelantosefectivo", "mpagominimo",
)
SHARES_OF_LIMIT = (
    "msaldototal", "msaldopesos", "msaldodolares", "mconsumospesos", "mconsumosdolares", "madelantopesos",
    "madelantodolares", "mpagado", "mpagospesos", "mpagosdolares", "mconsumototal", "mpagominimo",
)
LIMITS = ("Master_mlimitecompra", "Visa_mlimitecompra")
OTHER_FEATURES = (
    Formula("z_prom_pagodeservicios", "guarded", ("mpagodeservicios",), ("tpagodeservicios",)),
    Formula("z_prom_pagomiscuentas", "guarded", ("mpagomiscuentas",), ("tpagomiscuentas",)),
    Formula("z_pagodeserviciosypagomiscuentas", "skip_sum", ("mpagodeservicios", "mpagomiscuentas")),
    Formula("z_prom_debitos", "guarded", ("mcuenta_debitos_automaticos",), ("tcuenta_debitos_automaticos",)),
    Formula("z_ratio_debitos_sueldo", "ratio", ("mcuenta_debitos_automaticos",), ("mplan_sueldo",)),
    Formula("z_prom_sueldoporempresa", "ratio", ("mplan_sueldo",), ("tplan_sueldo",)),
    Formula("z_sueldototal", "skip_sum", ("mplan_sueldo", "mplan_sueldo_manual")),
    Formula("z_ratio_limitestarjetas_sueldo", "skip_ratio", ("mplan_sueldo", "mplan_sueldo_manual"), ("mv_mlimitecompra",)),
    Formula("z_ratio_rentabilidad", "ratio", ("mrentabilidad",), ("mrentabilidad_annual",)),
    Formula("z_total_prestamos", "skip_sum", ("mprestamos_personales", "mprestamos_prendarios", "mprestamos_hipotecarios")),
    Formula(
        "z_prom_prestamos", "skip_ratio",
        ("mprestamos_personales", "mprestamos_prendarios", "mprestamos_hipotecarios"),
        ("cprestamos_personales", "cprestamos_prendarios", "cprestamos_hipotecarios"),
    ),
    Formula("z_prom_prestamos_personales", "ratio", ("mprestamos_personales",), ("cprestamos_personales",)),
    Formula("z_prom_prestamos_prendarios", "ratio", ("mprestamos_prendarios",), ("cprestamos_prendarios",)),
    Formula("z_prom_prestamos_hipotecarios", "ratio", ("mprestamos_hipotecarios",), ("cprestamos_hipotecarios",)),
    Formula("z_prom_transaccionesdebito", "guarded", ("ctarjeta_debito_transacciones",), ("ttarjeta_debito",)),
    Formula("z_total_transaccionescchb", "skip_sum", ("ccallcenter_transacciones", "chomebanking_transacciones")),
    Formula(
        "vivi_online", "ratio",
        ("ccallcenter_transacciones", "chomebanking_transacciones", "tautoservicio", "ccajeros_propio_transacciones"),
        ("tcajas", "tcajas_consultas", "tcajas_depositos", "tcajas_extracciones", "tcajas_otras"),
    ),
    Formula("vivi_antig_ratio", "ratio", ("cliente_antiguedad",), ("cliente_edad",)),
    Formula("vivi_productos_edad", "ratio", ("marketing_coss_selling",), ("cliente_edad",)),
    Formula("vivi_movim_ratio", "ratio", ("tmovimientos_ultimos90dias",), ("marketing_coss_selling",)),
    Formula("vivi_mvr_msaldototal", "ratio", ("Master_msaldototal", "Visa_msaldototal"), LIMITS),
    Formula(
        "vivi_mvr_madelanto", "ratio",
        ("Master_madelantopesos", "Visa_madelantopesos", "Master_madelantodolares", "Visa_madelantodolares"), LIMITS,
    ),
    Formula("vivi_mvr_mpagado", "ratio", ("Master_mpagado", "Visa_mpagado"), LIMITS),
    Formula("vivi_mvr_mconsumototal", "ratio", ("Master_mconsumototal", "Visa_mconsumototal"), LIMITS),
    # The minimum-payment ratio is defined on consumption.
    Formula("vivi_mvr_mpagominimo", "ratio", ("Master_mconsumototal", "Visa_mconsumototal"), LIMITS),
)
# --- end of fixed values ------------------------------------------------------


def card_formulas() -> list[Formula]:
    """Totals over both cards (prefix ``mv_``)."""

    def both(column: str) -> tuple[str, ...]:
        return tuple(prefix + column for prefix in CARDS)

    made = [Formula("mv_" + name, "max", both(column)) for name, column in CARD_LATEST.items()]
    made += [Formula("mv_" + column, "min", both(column)) for column in CARD_EARLIEST]
    made += [Formula("mv_" + column, "skip_sum", both(column)) for column in CARD_TOTALS]
    return made


def share_formulas() -> list[Formula]:
    """Shares of the joint limit or balance (prefix ``mvr_``)."""
    limit = ("mv_mlimitecompra",)
    made = [Formula("mvr_" + column, "ratio", (column,), limit) for column in LIMITS]
    made += [Formula("mvr_" + column, "ratio", ("mv_" + column,), limit) for column in SHARES_OF_LIMIT]
    made += [
        Formula(f"mvr_{column}2", "ratio", ("mv_" + column,), ("mv_msaldototal",)) for column in ("msaldopesos", "msaldodolares")
    ]
    return made


def present_formulas() -> list[Formula]:
    return card_formulas() + share_formulas() + list(OTHER_FEATURES)


def formula_text(f: Formula) -> str:
    """The formula as expression text; NaN counts as missing where missing values are skipped."""

    def known(c: str) -> str:
        return f"nanvl(cast(`{c}` AS double), cast(NULL AS double))"

    def skip_sum(columns: tuple[str, ...]) -> str:
        return "(" + " + ".join(f"coalesce({known(c)}, 0D)" for c in columns) + ")"

    def plain_sum(columns: tuple[str, ...]) -> str:
        return "(" + " + ".join(f"cast(`{c}` AS double)" for c in columns) + ")"

    if f.op in ("max", "min"):
        return f"{'greatest' if f.op == 'max' else 'least'}({', '.join(map(known, f.inputs))})"
    if f.op == "skip_sum":
        return skip_sum(f.inputs)
    if f.op == "guarded":
        divisor = f"cast(`{f.over[0]}` AS double)"
        return f"if({divisor} IS NULL OR {divisor} = 0D, 0D, {plain_sum(f.inputs)} / nullif({divisor}, 0D))"
    if f.op == "skip_ratio":
        return f"{skip_sum(f.inputs)} / nullif({skip_sum(f.over)}, 0D)"
    if f.op == "ratio":
        return f"{plain_sum(f.inputs)} / nullif({plain_sum(f.over)}, 0D)"
    raise ValueError(f"unknown op {f.op!r} in {f.name!r}")


def add_present_features(df: DataFrame, formulas: list[Formula] | None = None) -> DataFrame:
    """Append the derived columns; a formula may use columns of an earlier step."""
    pending = present_formulas() if formulas is None else list(formulas)
    while pending:
        made = {f.name for f in pending}
        ready = [f for f in pending if not made.intersection(f.inputs + f.over)]
        if not ready:
            raise ValueError(f"formulas depend on each other: {sorted(made)}")
        df = df.selectExpr("*", *[f"{formula_text(f)} AS `{f.name}`" for f in ready])
        pending = [f for f in pending if f not in ready]
    return df
