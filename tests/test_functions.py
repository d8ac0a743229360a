import math

import pytest
from pyspark.sql import functions as F

from framewise.domain import FIELD_DOMAIN, ordinal
from framewise.functions import nulls, tails, text


def one(make, ddl, row, column):
    return make(ddl, row).select(column.alias("x")).first()["x"]


def test_unknown_condition_gives_null(make, values):
    df = make("a int", (1,), (0,), (None,))
    out = df.select("a", nulls.if_known(F.col("a") == 1, F.lit("y"), F.lit("n")).alias("x"))
    assert values(out) == [(0, "n"), (1, "y"), (None, None)]


def test_blank_where_reason_is_set(make, values):
    df = make("reason string, item string", (None, "cup"), ("None", "cup"))
    out = df.select(nulls.blank_where_set(F.col("reason"), F.col("item")).alias("item"))
    assert values(out) == [("cup",), (None,)]


def test_null_aware_aggregates(make):
    df = make("g int, x double", (1, None), (1, None), (1, 2.0))
    empty = df.where("x is null").agg(nulls.sum_or_zero(F.col("x")).alias("s")).first()["s"]
    assert empty == 0
    assert df.agg(nulls.count_values(F.col("x")).alias("n")).first()["n"] == 2


def test_share_of_zero_is_null(make):
    assert one(make, "a int, b int", (1, 0), nulls.share(F.col("a"), F.col("b"))) is None
    assert one(make, "a int, b int", (1, 4), nulls.share(F.col("a"), F.col("b"))) == 0.25


@pytest.mark.parametrize("value, digits, expected", [(0.125, 2, 0.12), (2.5, 0, 2.0), (3.5, 0, 4.0)])
def test_half_even(make, value, digits, expected):
    assert one(make, "x double", (value,), nulls.half_even(F.col("x"), digits)) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("knife-M-W", "knife-W"),
        ("empty drink box", "box"),
        ("cup", "cup"),
        ("a\nb-M", "a\nb"),
        (None, None),
    ],
)
def test_strip_first_only(make, value, expected):
    assert one(make, "x string", (value,), text.strip_first(F.col("x"), FIELD_DOMAIN.strip)) == expected


@pytest.mark.parametrize("value, expected", [("plastic BAG here", "Plastic bag here"), ("", ""), (None, None)])
def test_sentence_case(make, value, expected):
    assert one(make, "x string", (value,), text.sentence_case(F.col("x"))) == expected


def test_lists(make):
    assert one(make, "x string", ("a, b,c",), text.list_length(F.col("x"))) == 3
    assert one(make, "x string", (None,), text.list_length(F.col("x"))) is None
    assert one(make, "x string", (" a , b,c , d",), text.split_capped(F.col("x"), 3)) == ["a", "b", "c"]


@pytest.mark.parametrize("p, expected", [(0.0001, "< 0.001"), (0.01, "= 0.01"), (0.12345, "= 0.123"), (1.0, "= 1"), (None, None)])
def test_p_text(make, p, expected):
    assert one(make, "p double", (p,), text.p_text(F.col("p"))) == expected


def test_ordinal_and_label(make, values):
    df = make("c string", ("Toy",), ("Work Tool",), ("other",), (None,))
    out = df.select(
        "c",
        ordinal(F.col("c"), FIELD_DOMAIN.categories).alias("n"),
        FIELD_DOMAIN.label(F.col("c")).alias("l"),
        FIELD_DOMAIN.label(F.col("c"), short=True).alias("s"),
    )
    assert values(out) == [
        ("Toy", 4, "Toy", "T"),
        ("Work Tool", 8, "Tool-W", "W"),
        ("other", None, None, None),
        (None, None, None, None),
    ]


def simpson(f, low, high, n=20000):
    h = (high - low) / n
    total = f(low) + f(high) + sum((4 if i % 2 else 2) * f(low + i * h) for i in range(1, n))
    return total * h / 3


@pytest.mark.parametrize("t, df", [(0.0, 5), (0.3, 3), (2.0, 10), (-2.5, 40), (1.96, 500)])
def test_t_tail_against_integration(t, df):
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    inside = simpson(lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2), 0.0, abs(t)) if t else 0.0
    assert tails.t_two_sided(t, df) == pytest.approx(1 - 2 * inside, abs=1e-10)


@pytest.mark.parametrize("f, d1, d2", [(1.0, 10, 10), (2.3, 12, 30), (0.4, 35, 41)])
def test_f_tail_against_integration(f, d1, d2):
    log_scale = (
        math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2)
        + d1 / 2 * math.log(d1 / d2)
    )

    def density(x):
        return math.exp(log_scale) * x ** (d1 / 2 - 1) * (1 + d1 * x / d2) ** (-(d1 + d2) / 2)

    lower = simpson(density, 0.0, f)
    assert tails.f_two_sided(f, d1, d2) == pytest.approx(2 * min(lower, 1 - lower), abs=1e-9)


def test_normal_tail():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
