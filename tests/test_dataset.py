from pyspark.sql import functions as F

from tidepanel.plans.dataset import DatasetSpec, labelled_for_testing, labelled_for_training, load_dataset, master_to_months
from tidepanel.sources.schema import snapshot_schema


def snapshots(spark):
    """Two clients over four months in the full schema; the second one is missing in the middle."""
    rows = []
    for client, months in ((1, (201711, 201712, 201801, 201802)), (2, (201711, 201802))):
        for i, month in enumerate(months):
            known = {
                "numero_de_cliente": client, "foto_mes": month, "cliente_edad": 20 + 30 * client, "cliente_antiguedad": 10 * client,
                "tplan_sueldo": 2 - client, "mcuentas_saldo": float(10 * (i + 1)), "Master_mlimitecompra": 100.0, "Master_msaldototal": 25.0 * i,
                "clase_ternaria": ("BAJA+1", "CONTINUA")[client - 1] if month == 201802 else None,
            }
            rows.append(tuple(known.get(f.name) for f in snapshot_schema()))
    return spark.createDataFrame(rows, snapshot_schema())


def test_every_feature_of_the_full_schema(spark):
    made = load_dataset(snapshots(spark), [201802], DatasetSpec(derived=True, drop_last=("foto_mes",)))
    # 163 kept raw columns and 63 derived ones less the period, the salary flag, and six trends of 200 columns.
    assert len(made.columns) == 163 + 63 - 1 + 1 + 6 * 200
    got = {r.numero_de_cliente: r for r in made.collect()}
    assert sorted(got) == [1, 2]
    assert (got[1].cliente_edad, got[2].cliente_edad) == ("(40,55]", "(55, Inf]")
    assert (got[1].vivi_antig_ratio, got[2].vivi_antig_ratio) == (10 / 50, 20 / 80)
    assert (got[1].dependencia_salarial, got[2].dependencia_salarial) == (1, 0)
    assert got[1]["mcuentas_saldo__ANDREU"] == (30 - 40) / 30 and got[2]["mcuentas_saldo__ANDREU"] is None
    assert got[1]["mvr_msaldototal__CREC_POLI"] == (9 * 0.25 - 18 * 0.5 + 11 * 0.75) / 6 * 0.75


def test_no_history_is_read_without_trends(spark):
    off = dict.fromkeys(("growth_poly", "growth_findiff", "accel_poly", "accel_findiff", "trend_relative"), False)
    made = load_dataset(snapshots(spark), [201802], DatasetSpec(**off))
    assert len(made.columns) == 163 and made.count() == 2
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_labels(spark):
    rows = snapshots(spark).where(F.col("foto_mes") == 201802)
    assert [r.target for r in labelled_for_training(rows).orderBy("numero_de_cliente").collect()] == [1, 0]
    tested = labelled_for_testing(rows)
    assert [r.target for r in tested.collect()] == [0, 0] and "clase_ternaria" not in tested.columns


def test_all_months_without_a_list(spark):
    assert load_dataset(snapshots(spark), None).count() == load_dataset(snapshots(spark), [201711, 201712, 201801, 201802]).count() == 6


def test_master_to_months(spark, tmp_path):
    schema = snapshot_schema()
    rows = snapshots(spark).withColumn("Visa_fechaalta", F.lit(20171130).cast(schema["Visa_fechaalta"].dataType))
    master, target = str(tmp_path / "master"), str(tmp_path / "months")
    rows.write.option("sep", "\t").option("header", "true").csv(master)
    master_to_months(spark, master, target, schema)
    back = spark.read.option("sep", "\t").option("header", "true").csv(target)
    assert {(r.foto_mes, r.Visa_fechaalta) for r in back.collect()} == {(201711, "1"), (201712, "32"), (201801, "63"), (201802, "91")}
