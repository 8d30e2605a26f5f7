from pyspark.sql import functions as F

from framewright.plans.diarize import Parameters, diarized


def test_two_speakers_take_turns(spark):
    """Four segments of two speakers, told apart by their level; a short one has no model."""
    x = [1, 1, 2, 1, 9, 10, 9, 1, 2, 1, 9, 5]
    start = [1, 0, 0, 0, 1, 0, 0, 1, 0, 0, 1, 0]
    rows = [(7, i, float(v), bool(s), i != 3) for i, (v, s) in enumerate(zip(x, start))]
    df = spark.createDataFrame(rows, "f int, fli long, x double, b boolean, speech boolean")
    out = diarized(df, F.col("b"), F.col("speech"), "x", ["f"], "fli", Parameters(least=3, stop=3.0))
    got = [r["speaker"] for r in out.orderBy("fli").collect()]
    assert got == [1, 1, 1, -1, 2, 2, 2, 1, 1, 1, -1, -1]
    assert out.limit(0).count() == 0
