"""Checks of one quiz item beyond its form: targets, leaks, exact numbers, rounding and its way through JSON.

``item`` columns: kind (cloze, mcq or shortAnswer), stem, answer, options (array of label and text) and source (the
text it rests on, null where there is none). Every check is pass, fail or undecided.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.rational import _let, equal_value, equivalent, parse_rational
from lectern.functions.text import blank_count, fold_width
from lectern.operators.quality import FAIL, MAX_BLANKS, PASS, UNDECIDED, verdict

CLOZE, CHOICE, SHORT = "cloze", "mcq", "shortAnswer"
#: Answers that carry nothing, the hints of rounding, the patterns of blanks and numbers, and limits.
FORBIDDEN = ("the", "a", "an", "yes", "no", "none", "none of the above", "all of the above", "以上都不对", "以上都对", "都不是", "都对", "都是", "无", "没有", "是", "否")
ROUNDING_HINT = "[≈~～约]|保留|四舍五入|取整|进一|两位小数|三位小数|有效数字|精确到"
BRACE_BLANK, BRACKET_BLANK, LINE_BLANK = r"\{\{([^}]*)\}\}", r"\[\[([^\]]*)\]\]", "_{3,}"
WORD_BEFORE_BLANK = r"([A-Za-z一-鿿]+)_{3,}"
LABELLED = r"^(?:([A-Za-z])\s*[.)、:．]|([0-9]{1,2})\s*[.)、:．](?!\d))\s*(.+)$"
NUMBER = r"[+\-]?\d+(?:\.\d+)?(?:\s*/\s*\d+)?(?:[eE][+\-]?\d+)?\s*%?"
NUMBER_WITH_UNIT = r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+|/\d+)?\s*%?[A-Za-zµΩ°·/]*"
SEGMENT = r"[、,，;；/\s]+"
MIN_TARGET, LEAK_LATIN, LEAK_CHINESE, TOLERANCE = 1, 4, 2, 0.02


def _squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(fold_width(c)), r"\s+", "")


def option_text(options: Column, label: Column) -> Column:
    """The text of the option with a label, case aside; null without."""
    return F.get(F.filter(options, lambda o: F.upper(F.trim(o["label"])) == F.upper(label)), F.lit(0))["text"]


def answer_content(answer: Column, options: Column) -> Column:
    """The answer without its label; a bare label stands for its option's text."""
    raw = F.trim(answer)
    rest = F.trim(F.regexp_extract(raw, LABELLED, 3))
    named = F.trim(option_text(options, raw))
    return F.when(raw.rlike(LABELLED), rest).when(raw.rlike("^[A-Za-z]$") & (F.coalesce(named, F.lit("")) != ""), named).otherwise(raw)


def blank_targets(stem: Column, answer: Column) -> Column:
    """What the templates of a stem hold, else the answer."""
    held = F.concat(F.regexp_extract_all(stem, F.lit(BRACE_BLANK), F.lit(1)), F.regexp_extract_all(stem, F.lit(BRACKET_BLANK), F.lit(1)))
    return F.when(F.size(held) > 0, held).when(F.trim(answer) != "", F.array(F.trim(answer))).otherwise(F.array().cast("array<string>"))


def blank_words(stem: Column) -> Column:
    """The words in front of blanks."""
    return F.regexp_extract_all(stem, F.lit(WORD_BEFORE_BLANK), F.lit(1))


def rendered_stem(stem: Column) -> Column:
    """The stem as it is shown: templates and blanks are open."""
    return reduce(lambda s, p: F.regexp_replace(s, p, " "), (BRACE_BLANK, BRACKET_BLANK, LINE_BLANK), stem)


def numbers_in(text: Column) -> Column:
    """array of struct(raw, value): every number of a text that can be kept exactly."""
    each = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda r: F.struct(r.alias("raw"), parse_rational(r).alias("value")))
    return F.filter(each, lambda e: e["value"].isNotNull())


def label_hits(answer: Column, options: Column) -> Column:
    """Labels that the answer names: several of them, or one with or without a text, else those of options with its very text."""
    a = F.upper(F.trim(answer))
    labels = F.filter(F.transform(options, lambda o: F.trim(o["label"])), lambda x: x != "")
    parts = F.filter(F.split(a, SEGMENT), lambda s: s != "")
    upper = F.transform(labels, F.upper)
    several = (F.size(parts) > 1) & F.forall(parts, lambda s: F.array_contains(upper, s))
    one = F.filter(labels, lambda x: (a == F.upper(x)) | reduce(lambda p, q: p | q, [a.startswith(F.concat(F.upper(x), F.lit(m))) for m in (".", "、", ")", "．")]))
    same = F.transform(F.filter(options, lambda o: F.upper(F.trim(o["text"])) == a), lambda o: F.trim(o["label"]))
    return F.when(a == "", F.array().cast("array<string>")).when(several, parts).when(F.size(one) > 0, one).otherwise(same)


def _valued(options: Column) -> Column:
    each = F.transform(options, lambda o: F.struct(o["label"].alias("label"), parse_rational(o["text"]).alias("value")))
    return F.filter(each, lambda o: o["value"].isNotNull())


def possible_labels(answer: Column, options: Column) -> Column:
    """Labels named by the answer and those of options with its value."""
    value = parse_rational(answer_content(answer, options))
    numeric = _let(value, lambda v: F.transform(F.filter(_valued(options), lambda o: F.coalesce(equivalent(o["value"], v), F.lit(False))), lambda o: o["label"]))
    return F.array_union(label_hits(answer, options), F.when(value.isNotNull(), numeric).otherwise(F.array().cast("array<string>")))


def numeric_equivalence(answer: Column, options: Column) -> Column:
    """By value, exactly one option is right and no two wrong ones are equal; undecided where digits stand in no exact number."""
    some = F.size(options) > 0
    content = answer_content(answer, options)
    texts = F.when(some, F.transform(options, lambda o: o["text"])).otherwise(F.filter(F.array(content), lambda c: F.trim(c) != ""))
    exact = F.filter(texts, lambda t: parse_rational(t).isNotNull())
    digits = F.exists(texts, lambda t: parse_rational(t).isNull() & t.rlike("[0-9]"))
    valued, right = _valued(options), possible_labels(answer, options)
    hits = _let(parse_rational(content), lambda v: F.when(v.isNotNull(), F.size(F.filter(valued, lambda o: equivalent(o["value"], v)))))
    wrong = F.filter(valued, lambda o: ~F.array_contains(right, o["label"]))
    twins = _let(wrong, lambda w: F.exists(w, lambda a: F.size(F.filter(w, lambda b: equivalent(a["value"], b["value"]))) > 1))
    bad = some & (F.coalesce(hits != 1, F.lit(False)) | twins)
    return F.when(F.size(exact) == 0, F.when(digits, UNDECIDED).otherwise(PASS)).otherwise(verdict(~bad))


def answer_in_source(answer: Column, options: Column, source: Column) -> Column:
    """The answer stands in its source, as text or as a number of the same value."""
    content, passage = answer_content(answer, options), _squash(source)
    value = parse_rational(content)
    literal = F.contains(passage, _squash(content)) & (_squash(content) != "")
    numeric = _let(value, lambda v: F.exists(numbers_in(source), lambda t: F.coalesce(equivalent(t["value"], v), F.lit(False))))
    return F.when(F.coalesce(passage, F.lit("")) == "", UNDECIDED).otherwise(verdict(F.coalesce(literal | (value.isNotNull() & numeric), F.lit(False))))


def blank_limit(kind: Column, stem: Column) -> Column:
    return F.when(kind != CLOZE, PASS).otherwise(verdict(blank_count(stem) <= MAX_BLANKS))


def _targets(kind: Column, stem: Column, answer: Column) -> Column:
    return F.filter(F.transform(F.when(kind == CLOZE, F.concat(blank_targets(stem, answer), blank_words(stem))).otherwise(F.array(answer)), lambda t: F.trim(t)), lambda t: t.isNotNull())


def forbidden_target(kind: Column, stem: Column, answer: Column) -> Column:
    """No target is a word that carries nothing, as a whole or as one of its Latin words."""
    targets = _targets(kind, stem, answer)
    banned = F.array(*map(F.lit, FORBIDDEN))
    hit = F.exists(F.transform(targets, F.lower), lambda t: F.array_contains(banned, t) | F.arrays_overlap(F.filter(F.split(t, "[^a-z]+"), lambda w: w != ""), banned))
    return F.when(kind != CLOZE, PASS).when(F.size(targets) == 0, UNDECIDED).otherwise(verdict(~hit))


def target_length(kind: Column, stem: Column, answer: Column) -> Column:
    """Targets have a character at least; empty ones do not count."""
    targets = _targets(kind, stem, answer)
    short = F.exists(targets, lambda t: (t != "") & (F.length(t) < MIN_TARGET))
    return F.when(~kind.isin(CLOZE, SHORT), PASS).when(F.size(targets) == 0, UNDECIDED).otherwise(verdict(~short))


def rounding_note(stem: Column, answer: Column, options: Column, source: Column) -> Column:
    """A number close to a longer one of the source has to say that it is rounded."""
    content = F.trim(answer_content(answer, options))
    raws = F.regexp_extract_all(source, F.lit(NUMBER_WITH_UNIT), F.lit(0))

    def closer(v: Column) -> Column:
        def near(raw: Column) -> Column:
            def fits(x: Column) -> Column:
                size, other = v["num"].cast("double") / v["den"].cast("double"), x["num"].cast("double") / x["den"].cast("double")
                units = (x["unit"] == v["unit"]) | (x["unit"] == "") | (v["unit"] == "")
                bound = TOLERANCE * F.when(F.abs(size) < 1, 1.0).otherwise(F.abs(size))
                return F.coalesce(units & ~equal_value(x, v) & (F.abs(other - size) <= bound), F.lit(False))

            return (F.trim(raw) != content) & (F.length(raw) > F.length(content)) & _let(parse_rational(raw), fits)

        return F.exists(raws, near)

    value = parse_rational(content)
    hinted = F.concat_ws(" ", stem, answer).rlike(ROUNDING_HINT)
    return F.when(value.isNull(), PASS).when(F.trim(F.coalesce(source, F.lit(""))) == "", UNDECIDED).otherwise(verdict(~_let(value, closer) | hinted))


def answer_not_in_stem(stem: Column, answer: Column, options: Column) -> Column:
    """The answer is not printed in the stem: two Chinese characters or four others count."""
    content = answer_content(answer, options)
    shown, a = _squash(rendered_stem(stem)), _squash(content)
    enough = F.when(a.rlike("^[一-鿿]+$"), F.length(a) >= LEAK_CHINESE).otherwise(F.length(a) >= LEAK_LATIN)
    return F.when(F.trim(content) == "", UNDECIDED).when((shown == "") | ~enough, PASS).otherwise(verdict(~F.contains(shown, a)))


def json_round_trip(item: Column, schema: str) -> Column:
    """The item as JSON and back is the item."""
    back = F.from_json(F.to_json(item), schema)
    return F.when(back.isNull(), FAIL).otherwise(verdict(F.to_json(back) == F.to_json(item)))
