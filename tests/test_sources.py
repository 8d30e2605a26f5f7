import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import annotations as A
from framewright.sources import records as C
from framewright.sources import signals as S


def test_signals(spark, tmp_path):
    x = np.arange(-50, 50, dtype="<i2")
    (tmp_path / "a.wav").write_bytes(S.make_wave(x, 8000))
    head = b"NIST_1A\n   1024\nsample_rate -i 16000\nchannel_count -i 1\nsample_byte_format -s2 10\nend_head\n"
    (tmp_path / "b.sph").write_bytes(head.ljust(1024) + x.astype(">i2").tobytes())
    (tmp_path / "c.raw").write_bytes(x.tobytes())
    (tmp_path / "d.txt").write_text("no signal")
    got = {r["format"]: r for r in S.read_signals(spark, str(tmp_path)).collect()}
    assert {k: r["sample_rate"] for k, r in got.items()} == {"wave": 8000, "nist": 16000, "raw": 8000}
    assert all(r["samples"] == x.tolist() for r in got.values())
    one = S.read_signals(spark, str(tmp_path / "a.wav"))
    assert S.slice_samples(one, 10, 19).first()["samples"] == x[10:20].tolist()
    assert S.as_rows(one).count() == 100
    assert bytes(S.wave_files(one).first()["content"]) == S.make_wave(x, 8000)


def test_stereo(spark):
    df = spark.createDataFrame([("p", "wave", 8000, 2, [30000, 30000, -3, -4])], S.SCHEMA)
    assert S.to_mono(df).first()["samples"] == [30000, -4]


def test_bad_wave():
    with pytest.raises(ValueError):
        S.parse_wave(b"nothing")


def test_mu_law():
    x = np.array([-32000, -1000, -1, 0, 1, 1000, 32000])
    back = S.mu_law_inverse(S.mu_law(x)).astype(int)
    assert np.all(np.abs(back - x) <= np.maximum(8, np.abs(x) * 0.04))


def test_annotations(spark, tmp_path):
    (tmp_path / "a.phn").write_text("0 100 h#\n150 200 aa\n200 300 b\n")
    rows = sorted(tuple(r)[1:] for r in A.read_phones(spark, str(tmp_path / "a.phn")).collect())
    assert rows == [(0, 99, "h#"), (100, 149, "h#"), (150, 199, "aa"), (200, 299, "b")]
    (tmp_path / "a.scn").write_text("# scenes\n10\n5 back\nx\n20 cut\n")
    rows = [(r["video_frame"], r["ordered"]) for r in A.read_scenes(spark, str(tmp_path / "a.scn")).collect()]
    assert rows == [(10, True), (5, False), (20, True)]
    (tmp_path / "a.seg").write_text("10 0 #ann\n20 1\n30 0 #bob\n40 0 #bob\n")
    rows = [tuple(r)[1:] for r in A.read_segments(spark, str(tmp_path / "a.seg")).collect()]
    assert rows == [(0, 10, True, "ann", True), (11, 20, False, "ann", False), (21, 30, True, "bob", True), (31, 40, True, "bob", False)]
    (tmp_path / "a.ini").write_text("# c\na=1\nb = x=y\na=2\nnothing\n")
    assert A.read_parameters(spark, str(tmp_path / "a.ini")) == {"a": "2", "b": "x=y"}
    (tmp_path / "a.cut").write_text("0\t9\t10\thard\n10\t30\t21\tfade\n")
    assert [r["end"] for r in A.read_cuts(spark, str(tmp_path / "a.cut")).collect()] == [9, 30]
    (tmp_path / "a.crp").write_text("/t/dr1/fann/x.wav\n\n/t/dr1/mbob/y.wav\n")
    assert [(r["speaker"], r["sex"]) for r in A.read_corpus(spark, str(tmp_path / "a.crp")).collect()] == [("fann", "f"), ("mbob", "m")]


def test_records(spark, tmp_path):
    rows = [(1, f, 0, t, 256, 160, [float(t), float(k)][: k + 1]) for k, f in enumerate(("zcr", "ste")) for t in range(3)]
    df = spark.createDataFrame(rows[:-1], C.SCHEMA)
    C.write_records(df, str(tmp_path / "r"))
    back = C.read_records(spark, str(tmp_path / "r"))
    assert back.count() == 5 and C.read_records(spark, str(tmp_path / "r"), "zcr").count() == 3
    assert {r["feature"]: (r["n"], r["width"]) for r in C.row_counts(back).collect()} == {"zcr": (3, 1), "ste": (2, 2)}
    wide = {r["frame"]: r["feat"] for r in C.combined(back, ["ste", "zcr"]).collect()}
    assert wide == {0: [0.0, 1.0, 0.0], 1: [1.0, 1.0, 1.0]}
    C.export_features(back.filter("feature = 'zcr'"), str(tmp_path / "csv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_video_results(spark):
    df = spark.createDataFrame([(0, 3, 1), (1, 1, 2), (2, 1, -1), (3, 5, -1)], "fli long, mask int, speaker int")
    got = [tuple(r) for r in C.video_results(df, [], "fli", 2).orderBy("video_frame").collect()]
    assert got == [(0, 1, 1), (1, 1, -1)]
    assert C.analysis_columns(df).select(F.sum("noise")).first()[0] == 4


def test_lists_and_exports(spark, tmp_path):
    (tmp_path / "models.txt").write_text("# explicit\n0 2 a.gmm\n1 0 b.gmm\n")
    assert [tuple(r) for r in A.read_models(spark, str(tmp_path / "models.txt")).collect()] == [(0, 2, "a.gmm"), (1, 0, "b.gmm")]
    (tmp_path / "music.lst").write_text("x.wav\n\ny.wav\n")
    assert [tuple(r) for r in A.read_labelled_files(spark, str(tmp_path / "music.lst")).collect()] == [("x.wav", "music"), ("y.wav", "music")]
    rows = [(1, 0, 5120, 3), (1, 0, 5120 + 2048, 3), (1, 1, 1024, 4), (1, 1, 5120, -1)]
    df = spark.createDataFrame(rows, "f int, segment int, mask int, speaker int")
    got = sorted(tuple(r) for r in C.segment_statistics(df, "segment", 4096, ["f"], step=10).collect())
    assert got == [(1, 0, 20, 20), (1, 1, 20, 10)]
    C.export_by_speaker(df, str(tmp_path / "by"))
    assert [r["speaker"] for r in spark.read.parquet(str(tmp_path / "by")).collect()] == [3]
    C.write_report(df.groupBy("f").count(), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 1
