import math

import pytest
from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.functions import mathx, strings, timeaxis
from framewright.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_labels(spark):
    m = F.lit(L.MASK["speech"] | L.MASK["voiced"])
    assert one(spark, L.matches(m, L.NO_TYPE))
    assert one(spark, L.matches(m, L.MASK["music"] | L.MASK["voiced"]))
    assert not one(spark, L.matches(m, L.MASK["music"] | L.MASK["voiced"], unite=True))
    assert not one(spark, L.matches(m, L.MASK["speech"], without=L.MASK["voiced"]))
    assert one(spark, L.add_exclusive(m, "silence")) == L.MASK["silence"]
    assert one(spark, L.names(m)) == "speech,voiced"
    assert one(spark, L.conflicts(m)) == 0
    assert L.is_subtype("voiced", "speech") and not L.is_subtype("speech", "voiced")


@pytest.mark.parametrize("name", sorted(L.EXCLUSIVE))
def test_adding_twice_is_adding_once(spark, name):
    once = L.add_exclusive(F.lit(L.MASK["speech"]), name)
    assert one(spark, L.add_exclusive(once, name)) == one(spark, once)
    assert one(spark, L.remove(L.add(F.lit(0), L.MASK[name]), L.MASK[name])) == 0


def test_time(spark):
    assert one(spark, timeaxis.sample_to_frame(F.lit(255), 256, 160, end=True)) == 0
    assert one(spark, timeaxis.sample_to_frame(F.lit(416), 256, 160, end=True)) == 2
    assert one(spark, timeaxis.row_count(F.lit(255), 256, 160)) == 0
    assert one(spark, timeaxis.row_count(F.lit(256), 256, 160)) == 1
    assert one(spark, timeaxis.ms_to_sample(F.lit(10), 44100)) == 440


def test_math(spark):
    assert one(spark, mathx.sigmoid(F.lit(5.0), 0.0, 5.0, 20.0)) == 0.5
    # by hand: exactly 0 and 1 outside, eps / (1 + eps) at the lower end, half the exponent half-way
    assert one(spark, mathx.sigmoid(F.lit(-0.1), 0.0, 5.0, 20.0)) == 0 and one(spark, mathx.sigmoid(F.lit(20.0), 0.0, 5.0, 20.0)) == 1
    assert math.isclose(one(spark, mathx.sigmoid(F.lit(0.0), 0.0, 5.0, 20.0, eps=0.01)), 1 / 101)
    assert math.isclose(one(spark, mathx.sigmoid(F.lit(2.5), 0.0, 5.0, 20.0, eps=0.01)), 1 / 11)
    assert math.isclose(one(spark, mathx.sigmoid(F.lit(2.5), 0.0, 5.0, 20.0, eps=0.01, p=2.0)), 1 / 101)
    assert one(spark, mathx.sigmoid(F.lit(-1.0), 20.0, 5.0, 0.0)) == 1 and one(spark, mathx.sigmoid(F.lit(21.0), 20.0, 5.0, 0.0)) == 0
    assert math.isclose(one(spark, mathx.inverse_sigmoid(F.lit(0.99), 0.0, 5.0, 20.0, eps=0.01)), 20.0)
    assert one(spark, mathx.inverse_sigmoid(F.lit(0.75), 0.0, 5.0, 20.0, p=0.0)) == 12.5
    assert math.isclose(one(spark, mathx.binomial(F.lit(100), F.lit(80))), math.comb(100, 80))
    assert one(spark, mathx.safe_log(F.lit(0.0))) == -705
    assert math.isclose(one(spark, mathx.log_add(F.lit(-1000.0), F.lit(-1000.0))), -1000 + math.log(2))
    assert one(spark, mathx.binomial(F.lit(10), F.lit(3))) == 120
    assert one(spark, mathx.binomial(F.lit(10), F.lit(0))) == 1
    assert one(spark, mathx.intersect(F.lit(1), F.lit(5), F.lit(6), F.lit(9))) == 0
    assert one(spark, mathx.intersect(F.lit(1), F.lit(6), F.lit(6), F.lit(9))) == 1


@pytest.mark.parametrize(
    "text,pattern,hit",
    [("abc", "a%", True), ("abc", "_b_", True), ("abc", "[x-z]%", False), ("abc", "[^x-z]bc", True), ("a%c", "a\\%c", True), ("abc", "a\\%c", False), ("a.c", "a.c", True), ("abc", "a.c", False)],
)
def test_like(spark, text, pattern, hit):
    assert one(spark, strings.like(F.lit(text), pattern)) is hit


def test_strings(spark):
    assert one(spark, strings.file_name(F.lit("/a/b/c.wav"))) == "c.wav"
    assert one(spark, strings.with_extension(F.lit("/a.b/c.wav"), "phn")) == "/a.b/c.phn"
    assert tuple(one(spark, strings.key_value(F.lit("a = b=c")))) == ("a", "b=c")
    assert one(spark, strings.key_value(F.lit("none"))) is None
    assert one(spark, strings.token(F.lit(" a, b"), " ,", 2)) == "b"
    assert one(spark, strings.token(F.lit("a"), " ,", 2)) is None


def test_vectors(spark):
    x = F.array(*[F.lit(float(v)) for v in (1, -2, 3, 4)])
    assert one(spark, V.sign_changes(x)) == 2
    assert math.isclose(one(spark, V.energy_db(x)), 10 * math.log10(4 + 9 + 16))
    assert one(spark, V.energy_db(F.array(F.lit(1.0)))) == -873
    back = one(spark, V.idct(V.dct(x, 4), 4))
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(back, (1, -2, 3, 4)))
    assert one(spark, V.rotate(x, 1)) == [-2.0, 3.0, 4.0, 1.0]
