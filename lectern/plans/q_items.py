"""Checks of quiz items: every part is an item by one of the samples below, whose verdicts are stated beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import item_checks as ic
from lectern.plans.registry import query
from lectern.session import dealt, table

AB = (("A", "0.5"), ("B", "2/3"), ("C", "3"))
TEXTS = (("A", "energy"), ("B", "force"), ("C", "mass"))
NAMES = ("content", "labels", "numeric", "in_source", "blanks", "forbidden", "length", "rounding", "leak")
P, X, U = "pass", "fail", "undecided"
#: kind, stem, answer, options, source, and by NAMES what is expected.
SAMPLES = (
    ("mcq", "Half of one?", "A", AB, "it is 1/2 here", ("0.5", "A", P, P, P, P, P, P, P)),
    ("mcq", "Half of one?", "A. 0.5", AB, "nothing", ("0.5", "A", P, X, P, P, P, P, P)),
    ("mcq", "Half of one?", "1/2", AB, None, ("1/2", "A", P, U, P, P, P, U, P)),
    ("mcq", "Which?", "4", AB, "4 and 5", ("4", "", X, P, P, P, P, P, P)),
    ("mcq", "Which?", "C", (("A", "1/2"), ("B", "0.5"), ("C", "3")), "3", ("3", "C", X, P, P, P, P, P, P)),
    ("mcq", "Which?", "A、C", TEXTS, "energy", ("C", "A|C", P, X, P, P, P, P, P)),
    ("mcq", "What is energy?", "A", TEXTS, "ENERGY  here", ("energy", "A", P, P, P, P, P, P, X)),
    ("mcq", "Which?", "force", TEXTS, "the for ce", ("force", "B", P, P, P, P, P, P, P)),
    ("mcq", "Which?", "B", (("A", "x1"), ("B", "y2")), "y2", ("y2", "B", U, P, P, P, P, P, P)),
    ("cloze", "{{the}} theorem", "the", (), "the theorem", ("the", "", P, P, P, X, P, P, P)),
    ("cloze", "the {{theorem}} holds", "theorem", (), "the theorem", ("theorem", "", P, P, P, P, P, P, P)),
    ("cloze", "theorem ____ and ____ and ____", "lemma", (), "lemma", ("lemma", "", P, P, X, P, P, P, P)),
    ("cloze", "an ____ holds", "熵", (), "熵", ("熵", "", P, P, P, P, P, P, P)),
    ("cloze", "an____ holds", "熵", (), "熵", ("熵", "", P, P, P, X, P, P, P)),
    ("cloze", "[[牛顿第二定律]] 说的是力", "牛顿第二定律", (), "牛顿第二定律", ("牛顿第二定律", "", P, P, P, P, P, P, P)),
    ("shortAnswer", "牛顿第二定律是什么", "牛顿第二定律", (), " ", ("牛顿第二定律", "", P, U, P, P, P, P, X)),
    ("shortAnswer", "g?", "9.8", (), "g = 9.80665", ("9.8", "", P, P, P, P, P, X, P)),
    ("shortAnswer", "g, 保留一位小数?", "9.8", (), "g = 9.80665", ("9.8", "", P, P, P, P, P, P, P)),
    ("shortAnswer", "share?", "50%", (), "one half, 0.5", ("50%", "", P, P, P, P, P, P, P)),
    ("shortAnswer", "pi?", "3", (), "3.14159", ("3", "", P, P, P, P, P, P, P)),
    ("shortAnswer", "What?", " ", (), "x", ("", "", P, X, P, P, P, P, U)),
)
_OPTIONS = "array<struct<label:string,text:string>>"
_SCHEMA = f"kind string, stem string, answer string, options {_OPTIONS}, source string"


def _items(spark, d):
    """p_partkey with a sample; every part's name is behind the stem, where it changes nothing."""
    samples = spark.createDataFrame([(i, *s[:5]) for i, s in enumerate(SAMPLES)], f"i int, {_SCHEMA}")
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(SAMPLES)).cast("int").alias("i"), "p_name")
    return dealt(parts, "p_partkey").join(F.broadcast(samples), "i").withColumn("stem", F.concat_ws(" ; ", "stem", "p_name"))


def _expected() -> str:
    rows = ", ".join("(" + ", ".join([str(i), *("'" + x + "'" for x in s[5])]) + ")" for i, s in enumerate(SAMPLES))
    return f"SELECT p_partkey, {', '.join(f'e.{n}' for n in NAMES)} FROM part JOIN (VALUES {rows}) e(i, {', '.join(NAMES)}) ON p_partkey % {len(SAMPLES)} = e.i"


@query("quiz_item_checks", _expected())
def item_checks(spark, d):
    kind, stem, answer, options, source = (F.col(c) for c in ("kind", "stem", "answer", "options", "source"))
    return _items(spark, d).select(
        "p_partkey", ic.answer_content(answer, options).alias("content"), F.array_join(F.array_sort(ic.possible_labels(answer, options)), "|").alias("labels"),
        ic.numeric_equivalence(answer, options).alias("numeric"), ic.answer_in_source(answer, options, source).alias("in_source"), ic.blank_limit(kind, stem).alias("blanks"),
        ic.forbidden_target(kind, stem, answer).alias("forbidden"), ic.target_length(kind, stem, answer).alias("length"),
        ic.rounding_note(stem, answer, options, source).alias("rounding"), ic.answer_not_in_stem(stem, answer, options).alias("leak"),
    )


@query("quiz_json_round_trip", "SELECT p_partkey, 'pass' AS verdict FROM part")
def json_round_trip(spark, d):
    x = _items(spark, d)
    return x.select("p_partkey", ic.json_round_trip(F.struct("kind", "stem", "answer", "options", "source"), _SCHEMA).alias("verdict"))


@query("quiz_numbers_in_text", r"""
WITH t AS (SELECT p_partkey, p_name || ' costs ' || CAST(p_size AS VARCHAR) || '/4 or ' || CAST(p_size * 25 AS VARCHAR) || '%, not x7y' AS s FROM part)
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(s, '[+\-]?\d+(?:\.\d+)?(?:\s*/\s*\d+)?(?:[eE][+\-]?\d+)?\s*%?'), lambda x: trim(x)), '|') AS numbers FROM t
""")
def numbers_in_text(spark, d):
    size = F.col("p_size")
    s = F.concat("p_name", F.lit(" costs "), size.cast("string"), F.lit("/4 or "), (size * 25).cast("string"), F.lit("%, not x7y"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(ic.numbers_in(s), lambda x: F.trim(x["raw"])), "|").alias("numbers"))
