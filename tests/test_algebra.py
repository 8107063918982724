import math

import pytest
from pyspark.sql import functions as F

from cellforge.functions.algebra import AlgebraError, compile_expression


def value(spark, text, **bands):
    names = list(bands)
    df = spark.createDataFrame([tuple(bands.values())], ", ".join(f"{n} float" for n in names)) if names else spark.range(1)
    return df.select(compile_expression(text, {n: F.col(n) for n in names}).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("b1 + b2", 14.0), ("B1 - b2 * 2", 2.0), ("(b1 - b2) / (b1 + b2)", pytest.approx(6 / 14)), ("-b1 + +b2", -6.0), ("2 > 1", 1.0),
        ("b1 == b2", 0.0), ("iif(b1 > b2, 1, 0)", 1.0), ("pow(2, 10)", 1024.0), ("min(b1, b2)", 4.0), ("max(b1, b2)", 10.0), ("sqrt(16) + abs(-2)", 6.0),
        ("pi", pytest.approx(math.pi, rel=1e-6)), ("log(e)", pytest.approx(1.0)), ("log10(100)", 2.0), ("1 / 0", math.inf), ("-1 / 0", -math.inf), ("1 / (0 * -1)", -math.inf),
        ("log(0)", -math.inf), ("0 / 0", None), ("sqrt(-1)", None), ("0/0 != 0/0", 1.0), ("0/0 == 0/0", 0.0), ("0/0 > 1", 0.0), ("iif(0/0, 5, 6)", 5.0), ("1.5e2", 150.0),
    ],
)
def test_values(spark, text, want):
    assert value(spark, text, b1=10.0, b2=4.0) == want


def test_missing_bands(spark):
    assert value(spark, "b1 / b2", b1=None, b2=4.0) is None
    assert value(spark, "b1 * 2", b1=10.0, b2=None) == 20.0
    assert value(spark, "iif(1, b1, b2)", b1=10.0, b2=None) is None


@pytest.mark.parametrize("text", ["", "b1 +", "(b1", "b3", "foo(1)", "min(1)", "1 < 2 < 3", "b1 $ 2", "1.2.3", "sqrt()", "b1 b1", "iif(1, 2)", "sin(1)", "floor(1)"])
def test_errors(spark, text):
    with pytest.raises(AlgebraError):
        compile_expression(text, {"b1": F.col("b1"), "b2": F.col("b2")})
