from adlens.__main__ import main
from adlens.sources import tables as TB
from adlens.sources import text as TX
from conftest import SF_SMALL


def test_cli_workflow(spark, tmp_table_dir):
    d = tmp_table_dir
    TX.write_lines(TX.format_keyword_lines(TB.keyword_rows(spark, SF_SMALL)), d + "/kw")
    TX.write_lines(TX.format_history_lines(TB.history_rows(spark, SF_SMALL)), d + "/hist")
    TB.table(spark, SF_SMALL, "events").write.parquet(d + "/events")
    assert main(["stats", "--keywords", d + "/kw", "--out", d + "/stats"]) == 0
    assert spark.read.parquet(d + "/stats").count() == 120          # FIXTURES: sf0.001
    assert main(["sweep", "--keywords", d + "/kw", "--ks", "1,4", "--out", d + "/sweep"]) == 0
    assert spark.read.parquet(d + "/sweep").count() == 2
    assert main(["fit", "--keywords", d + "/kw", "--k", "6", "--model", d + "/model"]) == 0
    assert main(["features", "--keywords", d + "/kw", "--history", d + "/hist", "--model", d + "/model",
                 "--k", "6", "--exclude", "naccount7", "--out", d + "/train"]) == 0
    train = spark.read.parquet(d + "/train")
    assert train.count() == 420 and "k5" in train.columns          # FIXTURES: 420 training rows
    assert main(["features", "--kind", "avg", "--keywords", d + "/kw", "--history", d + "/hist",
                 "--exclude", "naccount7", "--out", d + "/train_avg"]) == 0
    assert spark.read.parquet(d + "/train_avg").columns[-1] == "avg_of_avg"
    assert main(["regress", "--training", d + "/train", "--k", "6", "--trees", "5",
                 "--depths", "2,3", "--no-final", "--out", d + "/reg"]) == 0
    assert spark.read.parquet(d + "/reg/grid").count() == 2
    assert main(["regress", "--training", d + "/train_avg", "--trees", "5", "--depths", "2",
                 "--no-final", "--out", d + "/reg_avg"]) == 0
    assert spark.read.parquet(d + "/reg_avg/linear_weights").count() == 3
    assert main(["throughput", "--requests", d + "/events", "--out", d + "/tp"]) == 0
    assert spark.read.parquet(d + "/tp").count() > 0
