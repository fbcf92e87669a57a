"""Three-valued rule checks: pass, fail or undecided; a check that cannot decide never passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.rational import equal_value, parse_rational
from lectern.functions.text import blank_count, option_key

PASS, FAIL, UNDECIDED = "pass", "fail", "undecided"
MIN_OPTIONS, MAX_OPTIONS, MAX_BLANKS = 3, 6, 2
MAX_SPREAD, MAX_OVER_MEDIAN = 3.0, 2.5
ANCHOR_TOLERANCE = 0.001


def verdict(ok: Column, known: Column | None = None) -> Column:
    out = F.when(ok, PASS).otherwise(FAIL)
    return out if known is None else F.when(known, out).otherwise(UNDECIDED)


def schema_violations(stem: Column, answer: Column, page: Column, options: Column) -> Column:
    """Names of everything wrong with an item, in order; empty when it is well formed."""
    labels = F.transform(options, lambda o: o["label"])
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim(stem), F.lit("")) == "", "empty stem"), F.when(F.coalesce(F.trim(answer), F.lit("")) == "", "empty answer"),
        F.when(page < 1, "bad page"), F.when(F.size(options) < 2, "too few options"), F.when(F.size(F.array_distinct(labels)) != F.size(labels), "repeated labels"),
    ))


def option_count(options: Column) -> Column:
    """3 to 6 options; none at all is not applicable and passes."""
    return verdict((F.size(options) == 0) | F.size(options).between(MIN_OPTIONS, MAX_OPTIONS))


def duplicate_options(options: Column) -> Column:
    keys = F.transform(options, lambda o: option_key(o["text"]))
    return verdict(F.size(F.array_distinct(keys)) == F.size(options))


def single_correct(options: Column, answer: Column) -> Column:
    """Exactly one option is right by label, by text or as the same number."""
    wanted = F.transform(F.array(answer), lambda a: F.struct(a.alias("label"), option_key(a).alias("key"), parse_rational(a).alias("value")))[0]
    keyed = F.transform(options, lambda o: F.struct(o["label"].alias("label"), option_key(o["text"]).alias("key"), parse_rational(o["text"]).alias("value")))

    def right(o: Column, w: Column) -> Column:
        return (o["label"] == w["label"]) | (o["key"] == w["key"]) | F.coalesce(equal_value(o["value"], w["value"]), F.lit(False))

    return verdict(F.transform(F.array(wanted), lambda w: F.size(F.filter(keyed, lambda o: right(o, w))))[0] == 1)


def blank_marker(stem: Column) -> Column:
    return verdict(blank_count(stem) >= 1)


def blank_limit(stem: Column) -> Column:
    return verdict(blank_count(stem) <= MAX_BLANKS)


def length_spread(options: Column) -> Column:
    """Longest over shortest at most 3, longest over upper median at most 2.5."""
    lens = F.array_sort(F.transform(options, lambda o: F.length(o["text"])))
    low, high, middle = F.element_at(lens, 1), F.element_at(lens, -1), F.element_at(lens, (F.floor(F.size(lens) / 2) + 1).cast("int"))
    return F.when(F.size(lens) < 2, PASS).otherwise(verdict((high <= MAX_SPREAD * low) & (high <= MAX_OVER_MEDIAN * middle), low > 0))


def unit_consistency(options: Column) -> Column:
    units = F.array_distinct(F.filter(F.transform(options, lambda o: parse_rational(o["text"])["unit"]), lambda u: u.isNotNull() & (u != "")))
    return verdict(F.size(units) <= 1)


def answer_in_source(answer: Column, source: Column) -> Column:
    """The answer occurs in its source text; without a source the check is undecided."""
    def squash(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, r"\s+", ""))

    return verdict(F.coalesce(F.contains(squash(source), squash(answer)), F.lit(False)), source.isNotNull())


def squashed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "")


QUOTE_RUN = 24


def quoted_in(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str, min_chars: int = 8, text: str = "text") -> DataFrame:
    """(quote, text) ids where a whole quote occurs in a text, white space and case aside.

    A quote's first QUOTE_RUN characters (all of a shorter one) are looked up among the runs of that length of each text, which
    gives the pairs to check as an equi-join; the check compares whole quotes. Quotes of one length up to QUOTE_RUN share a pass.
    """
    q = quotes.select(F.col(quote_id).alias("_q"), squashed(F.col(text)).alias("_quote")).filter(F.length("_quote") >= min_chars)
    q = q.withColumn("_n", F.least(F.length("_quote"), F.lit(QUOTE_RUN))).withColumn("_run", F.xxhash64(F.expr("substr(_quote, 1, _n)")))
    lengths = sorted(r[0] for r in q.select("_n").distinct().collect())  # QUOTE_RUN numbers at most
    t = texts.select(F.col(text_id).alias("_t"), squashed(F.col(text)).alias("_text"))

    def runs_of(n: int) -> Column:
        """Every run of n characters, by a look ahead at each place."""
        return F.transform(F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda run: F.xxhash64(run))

    runs = [runs_of(n) for n in lengths]
    met = t.select("_t", F.explode(F.array_distinct(F.concat(*runs) if runs else F.array().cast("array<bigint>"))).alias("_run")).join(q.select("_q", "_run"), "_run").select("_t", "_q").distinct()
    pairs = met.join(q.select("_q", "_quote"), "_q").join(t, "_t").filter(F.contains("_text", "_quote"))
    return pairs.select(F.col("_q").alias(quote_id), F.col("_t").alias(text_id))


def anchor_backlink(page: Column, at: Column, source_page: Column, source_at: Column) -> Column:
    return verdict((page == source_page) & (F.abs(at - source_at) <= ANCHOR_TOLERANCE), source_page.isNotNull())


def report(checks: DataFrame, item: str, verdict_col: str = "verdict", name: str = "check") -> DataFrame:
    """One row per item: all_pass, any_fail, any_undecided and the sorted names of failed checks."""
    v = F.col(verdict_col)
    return checks.groupBy(item).agg(
        F.every(v == PASS).alias("all_pass"), F.some(v == FAIL).alias("any_fail"), F.some(v == UNDECIDED).alias("any_undecided"),
        F.array_join(F.array_sort(F.collect_list(F.when(v == FAIL, F.col(name)))), "|").alias("failed"),
    )


def pipeline_status(hard: Column, answerable: Column, judge: Column) -> Column:
    """The first stage that does not pass decides: hard checks, answerability, judge, then a person."""
    return (
        F.when(hard == FAIL, "dropped").when(hard == UNDECIDED, "human").when(F.coalesce(answerable, F.lit(UNDECIDED)) != PASS, "human")
        .when(F.coalesce(judge, F.lit(UNDECIDED)) == FAIL, "dropped").when(F.coalesce(judge, F.lit(UNDECIDED)) != PASS, "human").otherwise("proposed")
    )
