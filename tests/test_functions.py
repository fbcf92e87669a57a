"""Micro cases of the column helpers, transcribed as behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import clock, labels, protocol, rational, slide_text, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_clock_never_rolls_into_hours(spark):
    assert one(spark, clock.minutes_seconds(F.lit(3_661_000))) == "61:01"
    assert one(spark, clock.minutes_seconds(F.lit(-5))) == "00:00"
    assert one(spark, clock.minutes_seconds(F.lit(6_000_000 * 1000))) == "100000:00"


def test_integers(spark):
    for raw, want in ((" 12 ", 12), ("0x1F", 31), ("-0x10", -16), ("1.5", None), ("", None), ("9007199254740992", None)):
        assert one(spark, clock.int_or_null(F.lit(raw))) == want, raw


def test_strict_dates(spark):
    assert str(one(spark, clock.strict_date(F.lit("2024-02-29")))) == "2024-02-29"
    assert one(spark, clock.strict_date(F.lit("2024-02-30"))) is None
    assert one(spark, clock.strict_date(F.lit("2024-2-3"))) is None


def test_rationals(spark):
    def value(raw):
        v = one(spark, rational.parse_rational(F.lit(raw)))
        return None if v is None else (int(v.num), int(v.den), v.unit)

    assert value("1/2") == (1, 2, "")
    assert value("50%") == (50, 100, "")
    assert value("0.5") == (5, 10, "")
    assert value("1,000 kg") == (1000, 1, "kg")
    assert value("-3") == (-3, 1, "")
    assert value("3.5e3") == (3500, 1, "")
    assert value("3.5×10^3") is None
    assert value("abc") is None
    assert value("1/0") is None

    def same(a, b):
        return one(spark, rational.equivalent(rational.parse_rational(F.lit(a)), rational.parse_rational(F.lit(b))))

    assert same("1/2", "0.5") and same("1/2", "50%")
    assert not same("1/3", "0.333")
    assert not same("50 n", "50 j")


def test_option_keys(spark):
    def key(raw):
        return one(spark, text.option_key(F.lit(raw)))

    assert key("0.5") != key("5")
    assert key("A. potential") == key("Potential。")
    assert key("20 m") == key("20m")
    assert key("Ａ．ｘ") == "x"


def test_blanks_take_the_largest_marker(spark):
    assert one(spark, text.blank_count(F.lit("____ and ____ or ()"))) == 2
    assert one(spark, text.blank_count(F.lit("none"))) == 0


def test_cleaning(spark):
    assert one(spark, slide_text.clean_line(F.lit("• 1. **Index**  Generator"))) == "Index Generator"
    assert one(spark, slide_text.clean_line(F.lit("|---|---|"))) == ""
    assert one(spark, text.strip_fences(F.lit("```json\n{}\n```"))) == "{}"


def test_guarded_edit(spark):
    near = one(spark, text.guarded_edit(F.lit("abcdefghij"), F.lit("abcdefghix")))
    assert (near.text, near.distance, near.rejected) == ("abcdefghix", 1, False)
    far = one(spark, text.guarded_edit(F.lit("abcde"), F.lit("vwxyz")))
    assert (far.text, far.distance, far.rejected) == ("abcde", 0, True)


def test_preview(spark):
    t = "x" * 100 + "needle" + "y" * 100
    got = one(spark, text.preview(F.lit(t), text.find_literal(F.lit(t), F.lit("NEEDLE")), F.lit(6)))
    assert got == "…" + "x" * 60 + "needle" + "y" * 60 + "…"


def test_many_sections_and_lines_take_one_pass(spark):
    """Six thousand headings and numbered lines, each twice: the last of equals stands, in its place."""
    twice = [(k, v) for v in ("old", "new") for k in range(3000)]
    found = one(spark, protocol.sections(F.lit("\n".join(f"## {k}\n{v} {k}" for k, v in twice))))
    assert found == {str(k): f"new {k}" for k in range(3000)}
    lines = one(spark, protocol.numbered_lines(F.lit("\n".join(f"{k + 1}. {v}" for k, v in twice + [(0, "last")]))))
    assert [(x.n, x.text) for x in lines] == [(k + 1, "new") for k in range(1, 3000)] + [(1, "last")]


def test_a_tidied_line_is_cleaned_once(spark):
    assert labels.tidy_written(F.lit("x"))._jc.toString().count("页面中央|页面顶部") == 1


def test_plain_numbers_and_keys_are_read_as_all_others(spark):
    raws = ["17", "17 kg", "17kg", "17\n", "17 kg\n", "007", "", " ", "5/", "1/2", "12e5", "1e", "12x", "12x10", "9" * 15, "9" * 16, "17  kg", " 17", "17 KG", "3µω°·", "a b", "1.5", "1,000", "1. x", "kg", "１７", "50%", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").orderBy("i")
    r = F.col("r")
    got = rows.select(rational.parse_rational(r), rational._any_rational(r), text.option_key(r), text._any_option_key(r)).collect()
    assert [(g[0], g[2]) for g in got] == [(g[1], g[3]) for g in got]
    plan = rows.select(text.option_key(r).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "^[0-9a-z ]*" in plan
