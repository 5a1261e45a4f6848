import math

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import columns as C
from tidepanel.functions import periods as P
from tidepanel.functions.derived import Formula, add_present_features, present_formulas
from tidepanel.sources.schema import DATE_COLUMNS, NO_TREND_COLUMNS, snapshot_schema, subset_schema

NAN, INF = float("nan"), float("inf")



def one(spark, column, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_month_arithmetic_over_year_ends(spark):
    got = spark.createDataFrame([(201802,), (201701,), (201612,)], "p int").select(
        P.backward_months(F.col("p"), 3), P.shift_period(F.col("p"), 11), P.shift_period_text(F.col("p"), -2)
    ).collect()
    assert list(got[0][0]) == [201711, 201712, 201801, 201802]
    assert [r[1] for r in got] == [201901, 201712, 201711]
    assert [r[2] for r in got] == ["201712", "201611", "201610"]
    assert P.backward_month_list(201802, 3) == [201711, 201712, 201801, 201802]
    assert P.periods_needed([201802, 201801], 3) == [201710, 201711, 201712, 201801, 201802]


def test_days_to_snapshot(spark):
    rows = [(201804, 20180430), (201804, 20180501), (201804, 20180511), (201712, 20171231), (201804, 20180230), (201804, None), (201804, 0)]
    assert one(spark, P.days_to_snapshot(F.col("p"), F.col("d")), "p int, d int", rows) == [1, 0, -10, 1, None, None, None]


def test_period_lists(spark):
    rows = [("201802,201801",), ("201802, 201801 , 201712",), ("201802",)]
    got = one(spark, P.split_periods(F.col("t")), "t string", rows)
    assert [list(g) for g in got] == [[201802, 201801], [201802, 201801, 201712], [201802]]
    assert one(spark, P.join_periods(P.split_periods(F.col("t"))), "t string", rows)[1] == "201802, 201801, 201712"


def test_age_bins_are_closed_at_the_right(spark):
    ages = [(18,), (19,), (25,), (26,), (40,), (41,), (55,), (56,), (None,)]
    assert one(spark, C.bin_age(F.col("a")), "a int", ages) == [
        "(-Inf,18]", "(18,25]", "(18,25]", "(25,40]", "(25,40]", "(40,55]", "(40,55]", "(55, Inf]", None,
    ]


def test_targets(spark):
    rows = [("CONTINUA",), ("BAJA+1",), ("BAJA+2",), (None,)]
    assert one(spark, C.target_train(F.col("c")), "c string", rows) == [0, 1, 1, None]
    assert one(spark, C.target_test(F.col("c")), "c string", rows) == [0, 0, 1, None]


def test_null_skipping_arithmetic(spark):
    rows = [(1.0, 2.0), (None, 2.0), (None, None), (NAN, 3.0)]
    schema = "a double, b double"
    a, b = F.col("a"), F.col("b")
    assert one(spark, C.row_sum_nullskip(a, b), schema, rows) == [3.0, 2.0, 0.0, 3.0]
    assert one(spark, C.row_max_nullskip(a, b), schema, rows) == [2.0, 2.0, None, 3.0]
    assert one(spark, C.row_min_nullskip(a, b), schema, rows) == [1.0, 2.0, None, 3.0]
    assert one(spark, C.null_sum(a, b), schema, rows[:3]) == [3.0, None, None]
    assert one(spark, C.fill_zero(a), schema, rows + [(INF, 0.0)]) == [1.0, 0.0, 0.0, 0.0, INF]


def test_division(spark):
    rows = [(6.0, 3.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, None), (None, 2.0)]
    schema = "a double, b double"
    a, b = F.col("a"), F.col("b")
    assert one(spark, C.safe_div(a, b), schema, rows) == [2.0, None, None, None, None, None]
    ieee = one(spark, C.safe_div(a, b, ieee=True), schema, rows)
    assert ieee[:3] == [2.0, INF, -INF] and math.isnan(ieee[3]) and ieee[4:] == [None, None]
    assert one(spark, C.guarded_ratio(a, b), schema, rows) == [2.0, 0.0, 0.0, 0.0, 0.0, None]


def test_money(spark):
    rows = [(1234567.4,), (999.0,), (-1234.0,), (0.0,)]
    assert one(spark, C.format_money(F.col("x")), "x double", rows) == ["$1.234.567", "$999", "$-1.234", "$0"]


def test_snapshot_schema():
    schema = snapshot_schema()
    kinds = [f.dataType.simpleString() for f in schema]
    assert (len(schema), kinds.count("int"), kinds.count("double"), kinds.count("string")) == (170, 95, 74, 1)
    assert set(DATE_COLUMNS) | set(NO_TREND_COLUMNS) <= set(schema.names)
    assert subset_schema(["foto_mes"]).fieldNames() == ["foto_mes"]


def bank_row(spark, **values):
    schema = snapshot_schema()
    return spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)


def test_present_features(spark):
    made = add_present_features(
        bank_row(
            spark, Master_mlimitecompra=100.0, Visa_mlimitecompra=300.0, Master_msaldototal=50.0, Visa_Fvencimiento=-5, Master_Fvencimiento=-9,
            Visa_cuenta_estado=10, mpagodeservicios=90.0, tpagodeservicios=3, mpagomiscuentas=5.0, tpagomiscuentas=0,
            mplan_sueldo=800.0, tplan_sueldo=2, mprestamos_personales=600.0, cprestamos_personales=3, cprestamos_prendarios=1,
            cliente_edad=50, cliente_antiguedad=25, Master_mconsumototal=40.0, Visa_mconsumototal=60.0,
        )
    )
    row = made.first()
    assert len(made.columns) == 170 + 63 == 170 + len(present_formulas())
    assert (row.mv_cuenta_estado2, row.mv_Fvencimiento, row.mv_mlimitecompra, row.mv_msaldototal) == (10.0, -9.0, 400.0, 50.0)
    assert (row.mvr_Master_mlimitecompra, row.mvr_msaldototal, row.mvr_msaldopesos2) == (0.25, 0.125, 0.0)
    assert (row.z_prom_pagodeservicios, row.z_prom_pagomiscuentas, row.z_prom_debitos) == (30.0, 0.0, 0.0)
    assert (row.z_sueldototal, row.z_ratio_limitestarjetas_sueldo, row.z_prom_sueldoporempresa) == (800.0, 2.0, 400.0)
    assert (row.z_total_prestamos, row.z_prom_prestamos, row.z_prom_prestamos_prendarios) == (600.0, 150.0, None)
    assert (row.vivi_antig_ratio, row.vivi_online, row.vivi_mvr_msaldototal) == (0.5, None, None)
    assert row.vivi_mvr_mpagominimo == row.vivi_mvr_mconsumototal == 0.25


def test_formulas_may_not_depend_on_each_other(spark):
    loop = [Formula("x", "ratio", ("y",), ("a",)), Formula("y", "ratio", ("x",), ("a",))]
    with pytest.raises(ValueError):
        add_present_features(spark.createDataFrame([(1.0,)], "a double"), loop)
