import pytest

from framewright.operators.models import Mixture
from framewright.sources import stores


def test_cut_list(spark):
    shots, behind = stores.cut_list(spark, [9, 4, 4, 30], 12)
    assert sorted(tuple(r) for r in shots.collect()) == [(0, 0, 4), (1, 5, 9), (2, 10, 11)] and behind == 1
    assert [tuple(r) for r in stores.cut_list(spark, [11], 12)[0].collect()] == [(0, 0, 11)]
    assert stores.cut_list(spark, [], 0)[0].count() == 0


def test_mixtures(spark, tmp_path):
    m = Mixture((0.2, 0.5, 0.3), ((0.0, 1.0), (2.0, 3.0), (4.0, 5.0)), ((1.0, 1.0), (2.0, 2.0), (3.0, 3.0)))
    stores.write_mixtures(spark, {"a": m, "b": Mixture((1.0,), ((7.0,),), ((1.0,),))}, str(tmp_path / "m"))
    assert stores.read_mixture(spark, str(tmp_path / "m"), "a") == m
    assert stores.heaviest_first(m).weights == (0.5, 0.3, 0.2) and stores.heaviest_first(m).means[0] == (2.0, 3.0)
    with pytest.raises(ValueError):
        stores.read_mixture(spark, str(tmp_path / "m"), "c")


def test_partitions_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, 0)], "k int, cluster int")
    stores.write_clusters(df, str(tmp_path / "c"), 0)
    stores.write_clusters(df.limit(1), str(tmp_path / "c"), 1)
    assert stores.read_clusters(spark, str(tmp_path / "c")).count() == 3
    assert stores.read_clusters(spark, str(tmp_path / "c"), 1).count() == 1
    stores.write_table(df, str(tmp_path / "t"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).columns == ["k", "cluster"]
