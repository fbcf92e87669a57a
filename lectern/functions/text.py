"""String expressions: literal search, cleaning, option and stem keys, guards and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the transcript and rewriting guards.
MAX_EDITS, MAX_EDIT_RATIO = 80, 0.8
LENGTH_RATIO, LENGTH_SLACK, MIN_KEPT, MAX_FILLER_KEPT = 1.6, 60, 0.3, 0.34
PREVIEW_AROUND, PREVIEW_WITHOUT = 60, 120
BLANK_MARKERS = ("____", "（　）", "()", "[ ]")
#: A trailing run of these is dropped from an option's key.
TRAILING_MARKS = "。．.,，;；:：!！?？、"


def find_literal(haystack: Column, needle: Column) -> Column:
    """0-based position of a literal, ignoring case; -1 where it does not occur."""
    return F.instr(F.lower(haystack), F.lower(needle)) - 1


def preview(text: Column, start: Column, length: Column) -> Column:
    """The match with up to 60 characters on each side; without a match the first 120 characters."""
    lo = F.greatest(F.lit(0), start - PREVIEW_AROUND)
    hi = F.least(F.length(text), start + length + PREVIEW_AROUND)
    cut = F.concat(F.when(lo > 0, F.lit("…")).otherwise(F.lit("")), F.substr(text, lo + 1, hi - lo), F.when(hi < F.length(text), F.lit("…")).otherwise(F.lit("")))
    return F.when(start >= 0, cut).otherwise(F.substr(text, F.lit(1), F.lit(PREVIEW_WITHOUT)))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def filler_hits(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (occurrences(text, w) for w in words))


def content_characters(text: Column) -> Column:
    """Letters and other wide characters; digits, punctuation and white space do not count."""
    return F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F\u2000-\u206F\u3000-\u303F\uFF00-\uFFEF]", ""))


def edit_limit(length: Column) -> Column:
    return F.least(F.lit(MAX_EDITS), F.greatest(F.lit(1), F.floor(length * MAX_EDIT_RATIO))).cast("int")


def guarded_edit(original: Column, attempted: Column) -> Column:
    """struct(text, distance, rejected): the edit where it stays within its limit, else the original."""
    limit = F.least(F.lit(MAX_EDITS), F.greatest(F.lit(1), F.floor(F.length(original) * MAX_EDIT_RATIO))).cast("int")
    far = F.abs(F.length(original) - F.length(attempted)) > limit
    # levenshtein takes a constant limit: the largest possible one bounds its work, the row's own decides
    distance = F.when(far, F.lit(-1)).otherwise(F.levenshtein(original, attempted, MAX_EDITS))
    fine = (distance >= 0) & (distance <= limit)
    return F.struct(F.when(fine, attempted).otherwise(original).alias("text"), F.when(fine, distance).otherwise(F.lit(0)).alias("distance"), (~fine).alias("rejected"))


def stem_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def fold_width(text: Column) -> Column:
    """Full-width forms to ASCII, the wide space to a space."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(text, wide, "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def option_key(text: Column) -> Column:
    """Key under which two options are the same: width, case, white space, closing marks and label do not count.

    A digit label is no label when a digit follows, so that 0.5 stays different from 5.
    """
    plain = r"^[0-9a-z ]*\z"  # nothing but blanks to take away
    return F.when(text.rlike(plain), F.replace(text, F.lit(" "), F.lit(""))).otherwise(_any_option_key(text))


def _any_option_key(text: Column) -> Column:
    marks = "[" + TRAILING_MARKS.replace("]", "\\]") + "]+$"
    bare = F.regexp_replace(F.lower(F.regexp_replace(fold_width(text), r"\s+", "")), marks, "")
    return F.regexp_replace(bare, r"^(?:[a-z][.)、:：]|[0-9]{1,2}[.)、:：](?![0-9]))", "")


def blank_count(stem: Column) -> Column:
    """The largest count over the blank markers: mixed markers are one blank written differently."""
    return F.greatest(*[occurrences(stem, m) for m in BLANK_MARKERS])


def normal_lecture_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "[，。！？、；：,.!?;]", "")


def strip_fences(raw: Column) -> Column:
    text = F.trim(F.replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    return F.trim(F.regexp_replace(text, r"^```[a-zA-Z]*\n([\s\S]*?)\n?```$", "$1"))
