import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from adlens.operators import tree_model as TM


def people(spark):
    return spark.createDataFrame([(25, 70.5, 180), (40, 80.0, 175), (31, 60.0, 160)],
                                 "age int, weight double, high int")


def test_defaults_and_double_division(spark):
    out = TM.UnitScaleTransformer().transform(people(spark))
    assert out.columns == ["label", "features"]
    r = out.select("label", vector_to_array("features").alias("f")).first()
    assert r.label == 70.5
    assert r.f[0] == 25 / 12 and r.f[1] == 1.8


def test_param_overrides_take_effect(spark):
    df = people(spark).withColumnRenamed("age", "months")
    t = TM.UnitScaleTransformer(inputCol1="months", keepScaled=True, outputCol1="Age_YeArs")
    out = t.transform(df)
    assert "Age_YeArs" in out.columns
    t2 = TM.UnitScaleTransformer(keepScaled=True)
    out2 = t2.transform(df, {t2.inputCol1: "months", t2.outputCol2: "metres"})
    assert out2.columns == ["label", "features", "age_years", "metres"]
    assert out2.count() == 3


def test_null_label_fails(spark):
    df = spark.createDataFrame([(25, None, 180)], "age int, weight double, high int")
    with pytest.raises(Exception):
        TM.UnitScaleTransformer().transform(df).collect()


def test_join_and_pipeline_roundtrip(spark, tmp_table_dir):
    a = spark.createDataFrame([(1, 25), (2, 40), (3, 31), (4, 50)], "id long, age int")
    b = spark.createDataFrame([(1, 70.0, 180), (2, 80.0, 175), (3, 60.0, 160), (5, 1.0, 1)],
                              "id long, weight double, high int")
    j = TM.join_on_id(a, b)
    assert j.columns == ["age", "weight", "high"] and j.count() == 3
    model, pred = TM.fit_tree_pipeline(j)
    rows = pred.collect()
    assert all(r.prediction == r.label for r in rows)  # a deep tree memorises 3 rows
    model.write().overwrite().save(tmp_table_dir + "/pm")
    back = PipelineModel.load(tmp_table_dir + "/pm")
    assert sorted(r.prediction for r in back.transform(j).collect()) == sorted(r.prediction for r in rows)
