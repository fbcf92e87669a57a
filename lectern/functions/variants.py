"""Tolerant readers of model answers in JSON, by the type that each value has.

An answer is parsed to a VARIANT; what a value is read as follows from its own type (text, array or object), so that
one expression reads every shape that an answer may take. Numbers of chapters and topics stay strict: a text "3" is no
number. Each reader gives what it read and, in ``problem``, a code of what kept it from reading the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern.functions.labels import BLOCK_KINDS, block_kind

#: Names of fields with their other names, of question types, kinds of evidence and words for yes.
TYPE, STEM, ANSWER = ("type", "题型", "类型"), ("stem", "题干", "问题", "题目"), ("answer", "答案", "答")
PASS, AUDIT, EVIDENCE, CHOICES = ("pass", "自审", "通过"), ("audit", "核对", "说明", "自审说明"), ("evidence", "依据"), ("choices", "选项")
QUOTE, SOURCE, LABEL, TEXT = ("quote", "原文", "text", "内容"), ("kind", "类型", "来源"), ("label", "标签"), ("text", "内容")
QUESTION_TYPES = {"mcq": ("mcq", "选择", "选择题", "单选"), "cloze": ("cloze", "填空", "填空题"), "shortAnswer": ("shortAnswer", "简答", "简答题", "问答", "")}
EVIDENCE_KINDS = {"web": ("web", "网上", "课外", "网络"), "knowledge": ("knowledge", "知识库", "课程", "")}
YES = ("true", "yes", "1", "通过", "是")
TOOLS = ("search_course", "web_search")
BLANKS = " \t\n\x0b\f\r\u00a0\u3000\ufeff"

PASSAGE = "struct<label: string, text: string>"
BLOCK = "struct<kind: string, title: string, text: string, stem: string, solution: string, map: string>"
TOPIC = f"struct<chapter: bigint, topic: bigint, passages: array<{PASSAGE}>, blocks: array<{BLOCK}>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def bare(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def unfenced(raw: Column) -> Column:
    """The answer without the fence that may surround all of it."""
    text = bare(F.regexp_replace(raw, "\r\n?", "\n"))
    return bare(F.regexp_replace(text, r"^```[a-zA-Z]*\n([\s\S]*?)\n?```$", "$1"))


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null where there is no value."""

    def name(s: Column) -> Column:
        named = F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
        return named.when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNotNull(), "number")

    return let(F.schema_of_variant(v), name)


def member(v: Column, *names: str) -> Column:
    """The first of these fields that is there and not null."""

    def first(o: Column) -> Column:
        found = [F.try_variant_get(o, F.lit(f"$['{n}']"), "variant") for n in names]
        return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in found])

    return let(v, first)


def elements(v: Column) -> Column:
    """The elements of an array, null for any other value."""
    return let(v, lambda x: F.when(kind(x) == "array", F.try_variant_get(x, "$", "array<variant>")))


def scalar(v: Column) -> Column:
    """Text of a string, number or boolean."""
    return let(v, lambda x: F.when(kind(x).isin("string", "number", "boolean"), F.try_variant_get(x, "$", "string")))


def string(v: Column) -> Column:
    return let(v, lambda x: F.when(kind(x) == "string", F.try_variant_get(x, "$", "string")))


def whole(v: Column) -> Column:
    """A whole number that is written as a number; 3.0 is one, "3" is not."""

    def read(x: Column) -> Column:
        n = F.try_variant_get(x, "$", "double")
        return F.when((kind(x) == "number") & (n == F.floor(n)), F.try_variant_get(x, "$", "bigint"))

    return let(v, read)


def picked(v: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(scalar(member(v, *names)), F.lit(""))


def aliased(value: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """The name that a value is an alias of, else the value."""
    known = F.create_map(*[F.lit(x) for name, aliases in names.items() for a in aliases for x in (a, name)])
    return let(value, lambda x: F.coalesce(F.try_element_at(known, x), x))


def parsed(text: Column) -> Column:
    """The text as JSON, null where it is none or where anything stands behind the value.

    The built-in parser ends with the first value. Here the text is read as the only element of an array and as a field: what
    would close one early (``1] x``) breaks the other, and a comma makes a second element.
    """

    def read(t: Column) -> Column:
        listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        field = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        return let(F.try_variant_get(listed, "$", "array<variant>"), lambda x: F.when((F.size(x) == 1) & field.isNotNull(), F.get(x, F.lit(0))))

    return let(text, read)


def decoded(raw: Column) -> Column:
    """The whole text as JSON, else the object between its first and last brace."""
    text = bare(raw)
    lo, hi = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = parsed(F.when((lo > 0) & (F.instr(text, "}") > 0) & (hi > lo), F.substr(text, lo, hi - lo + 1)))
    return F.coalesce(parsed(text), F.when(kind(inner) == "object", inner))


# --- objects within prose

_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.IGNORECASE)
_STOPS = re.compile(r'[{}"\n]')
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"?')


def balanced(text: str) -> list[str]:
    """The outermost stretches between braces that match, in one pass; braces in strings do not count, nor do quotes outside braces.

    A brace that never closes hides nothing of what is balanced behind it; no string goes over a line's end.
    """
    open_at: list[int] = []
    found: list[tuple[int, int]] = []
    at = 0
    while m := _STOPS.search(text, at):
        at = m.end()
        if m.group() == "{":
            open_at.append(m.start())
        elif m.group() == "}" and open_at:
            start = open_at.pop()
            while found and found[-1][0] > start:
                found.pop()
            found.append((start, at))
        elif m.group() == '"' and open_at:
            at = _STRING.match(text, m.start()).end()
    return [text[a:b] for a, b in found]


@F.pandas_udf(ArrayType(StringType()))
def json_candidates(raw: pd.Series) -> pd.Series:
    """Texts that may be objects, in order: those in fences, or without any fence those of the whole answer."""

    def of(text: str | None) -> list[str] | None:
        if text is None:
            return None
        chunks = [m[1] for m in _FENCE.finditer(text)] or [text]
        return [c for chunk in chunks for c in balanced(chunk)]

    return raw.map(of)


def objects(candidates: Column) -> Column:
    """array<variant>: the candidates that are JSON objects."""
    return F.filter(F.transform(candidates, parsed), lambda v: F.coalesce(kind(v) == "object", F.lit(False)))


# --- written lectures


def _block(item: Column) -> Column:
    fields = {"text": ("text", "body"), "stem": ("stem",), "solution": ("solution",)}

    def of(wire: Column) -> Column:
        label = F.try_element_at(F.create_map(*[F.lit(x) for pair in BLOCK_KINDS for x in pair]), wire)
        return F.struct(
            wire.alias("kind"), F.coalesce(string(member(item, "title")), label).alias("title"), *[picked(item, names).alias(n) for n, names in fields.items()],
            F.coalesce(string(member(item, "map")), F.lit("")).alias("map"), label.alias("name"),
        )

    return let(let(scalar(member(item, "kind", "label")), block_kind), of)


def shown(kind_: Column, text: Column, stem: Column, solution: Column) -> Column:
    """What a block reads as: an example is its stem and its solution."""
    parts = F.filter(F.array(bare(stem), bare(solution)), lambda s: s != "")
    return F.when(kind_ == "example", F.array_join(parts, "\n\n")).otherwise(bare(text))


def slots(topic: Column) -> Column:
    """array of blocks (with ``name``, the label of the kind), a null kind where it is not known; null without slots."""
    items = F.filter(elements(member(topic, "slots")), lambda i: F.coalesce(kind(i) == "object", F.lit(False)))
    return F.filter(F.transform(items, _block), lambda b: b["kind"].isNull() | (shown(b["kind"], b["text"], b["stem"], b["solution"]) != ""))


def passages(topic: Column) -> Column:
    """array<struct(label, text)> of paragraphs: texts or objects, or one text for all."""

    def one(label: Column, text: Column) -> Column:
        return F.struct(bare(label).alias("label"), bare(text).alias("text"))

    def of(p: Column) -> Column:
        return F.when(kind(p) == "string", one(F.lit(""), string(p))).when(kind(p) == "object", one(scalar(member(p, "label")), scalar(member(p, "text", "body"))))

    listed = elements(member(topic, "passages", "paragraphs"))
    single = F.array(one(scalar(member(topic, "label")), string(member(topic, "body", "text"))))
    return F.filter(F.coalesce(F.transform(listed, of), single), lambda p: F.coalesce(p["text"] != "", F.lit(False)))


def _topic(chapter: Column, t: Column) -> Column:
    """One topic as read, with what is wrong about it."""

    def read(b: Column) -> Column:
        spoken = F.transform(b, lambda x: F.struct(F.when(bare(x["title"]) != "", bare(x["title"])).otherwise(x["name"]).alias("label"), shown(x["kind"], x["text"], x["stem"], x["solution"]).alias("text")))
        plain = F.coalesce(F.transform(b, lambda x: F.struct(*[x[n].alias(n) for n in ("kind", "title", "text", "stem", "solution", "map")])), F.array().cast(f"array<{BLOCK}>"))
        unknown = F.coalesce(F.exists(b, lambda x: x["kind"].isNull()), F.lit(False))

        def judged(x: Column) -> Column:
            problem = F.when(x["number"].isNull(), "TOPIC_NUMBER").when(unknown, "BLOCK_KIND").when(F.size(x["texts"]) == 0, "NO_BODY")
            return F.struct(F.struct(chapter.alias("chapter"), x["number"].alias("topic"), x["texts"].alias("passages"), plain.alias("blocks")).alias("topic"), problem.alias("problem"))

        return let(F.struct(whole(member(t, "t", "i")).alias("number"), F.coalesce(spoken, passages(t)).alias("texts")), judged)

    return let(slots(t), read)


def _chapter(c: Column) -> Column:
    """The entries of one chapter: its topics, or what is wrong about it."""
    wrong = F.array(F.struct(F.lit(None).cast(TOPIC).alias("topic"), F.lit("CHAPTER_NUMBER").alias("problem")))
    topics = F.filter(c["topics"], lambda t: F.coalesce(kind(t) == "object", F.lit(False)))
    return let(whole(c["c"]), lambda n: F.when(n.isNull(), wrong).otherwise(F.coalesce(F.transform(topics, lambda t: _topic(n, t)), F.slice(wrong, 1, 0))))


def _chapters(root: Column) -> Column:
    """array<struct(c, topics)> of an answer's root, whatever holds the chapters; null where nothing does."""

    def listed(chapters: Column) -> Column:
        items = F.filter(elements(chapters), lambda c: F.coalesce(kind(c) == "object", F.lit(False)))
        return F.transform(items, lambda c: F.struct(member(c, "c").alias("c"), elements(member(c, "topics", "items")).alias("topics")))

    def within(v: Column) -> Column:
        number = let(member(v, "c"), lambda c: F.when(kind(c) == "number", c).otherwise(F.parse_json(F.lit("1"))))
        lone = F.array(F.struct(number.alias("c"), F.array(v).alias("topics")))
        return F.when(member(v, "chapters").isNotNull(), listed(member(v, "chapters"))).when(kind(member(v, "slots")) == "array", lone)

    inner = F.filter(F.map_values(F.try_variant_get(root, "$", "map<string,variant>")), lambda v: F.coalesce((kind(v) == "object") & member(v, "chapters").isNotNull(), F.lit(False)))
    wrapped = F.when((kind(root) == "object") & member(root, "chapters").isNull(), F.get(inner, F.lit(0)))
    return F.when(kind(root) == "array", listed(root)).otherwise(let(F.coalesce(wrapped, root), within))


def written_answer(raw: Column) -> Column:
    """struct(problem, topics) of an answer that fills topics with text; with a problem there are no topics.

    Accepted: a fence around all, a wrapper around ``chapters`` (of several, the first by name), chapters alone, one topic
    alone, other names of fields, paragraphs as texts. Refused, by the first that occurs: EMPTY, NOT_JSON, NOT_OBJECT,
    NO_CHAPTERS, CHAPTER_NUMBER, TOPIC_NUMBER, BLOCK_KIND, NO_BODY, NO_TOPIC. A repeated name in one object is no JSON.
    """

    def read(v: Column) -> Column:
        none = F.array().cast(f"array<struct<topic: {TOPIC}, problem: string>>")

        def judge(entries: Column) -> Column:
            first = F.get(F.filter(entries, lambda e: e["problem"].isNotNull()), F.lit(0))["problem"]
            problem = (
                F.when(bare(raw) == "", "EMPTY").when(v.isNull(), "NOT_JSON").when(~kind(v).isin("object", "array"), "NOT_OBJECT")
                .when(entries.isNull(), "NO_CHAPTERS").when(first.isNotNull(), first).when(F.size(entries) == 0, "NO_TOPIC")
            )
            topics = F.transform(F.coalesce(entries, none), lambda e: e["topic"])
            return F.struct(problem.alias("problem"), F.when(problem.isNull(), topics).otherwise(F.slice(topics, 1, 0)).alias("topics"))

        return let(F.flatten(F.transform(_chapters(v), _chapter)), judge)

    return let(parsed(unfenced(raw)), read)


# --- questions


def evidence(v: Column) -> Column:
    """array<struct(kind, quote)> of a text (lines ``kind｜quote``), of an object, or of an array of both."""

    def line(t: Column) -> Column:
        mark = F.when(t.contains("｜"), "｜").when(t.contains("|"), "|")
        at = F.locate("｜", t)
        at = F.when(at > 0, at).otherwise(F.locate("|", t))
        quote = F.when(mark.isNull(), t).otherwise(bare(F.substr(t, at + 1)))
        name = F.when(mark.isNull(), "knowledge").otherwise(bare(F.substr(t, F.lit(1), at - 1)))
        return F.struct(_evidence_kind(name).alias("kind"), quote.alias("quote"))

    def lines(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, "[\n；;]"), bare), lambda t: t != "")
        return F.filter(F.transform(parts, line), lambda e: e["quote"] != "")

    def item(o: Column) -> Column:
        one = F.array(F.struct(_evidence_kind(bare(picked(o, SOURCE))).alias("kind"), picked(o, QUOTE).alias("quote")))
        return F.filter(one, lambda e: bare(e["quote"]) != "")

    def either(x: Column) -> Column:
        return F.when(kind(x) == "string", lines(string(x))).when(kind(x) == "object", item(x)).otherwise(none)

    none = F.array().cast("array<struct<kind: string, quote: string>>")
    return F.coalesce(F.flatten(F.transform(F.coalesce(elements(v), F.array(v)), either)), none)


def _evidence_kind(name: Column) -> Column:
    return let(name, lambda n: let(aliased(F.lower(n), EVIDENCE_KINDS), lambda known: F.when(known.isin(*EVIDENCE_KINDS), known).otherwise(n)))


def choices(v: Column) -> Column:
    """array<struct(label, text)> of lines ``A. text``, as one text or an array, or of objects."""
    pattern = r"(?s)^\s*([A-Za-z])\s*[.、．)]\s*(.+)$"

    def line(x: Column) -> Column:
        named = let(F.struct(bare(picked(x, LABEL)).alias("label"), bare(picked(x, TEXT)).alias("text")), lambda c: F.when((c["label"] != "") & (c["text"] != ""), F.concat(c["label"], F.lit(". "), c["text"])))
        return F.when(kind(x) == "string", string(x)).when(kind(x) == "object", named)

    lines = F.when(kind(v) == "string", F.split(string(v), "\n")).otherwise(F.transform(elements(v), line))
    fit = F.filter(F.transform(lines, lambda s: F.regexp_replace(bare(s), "\n", " ")), lambda s: s.rlike(pattern))
    read = F.transform(fit, lambda s: F.struct(F.upper(F.regexp_extract(s, pattern, 1)).alias("label"), bare(F.regexp_extract(s, pattern, 2)).alias("text")))
    return F.coalesce(F.filter(read, lambda c: c["text"] != ""), F.array().cast("array<struct<label: string, text: string>>"))


def drafts(questions: Column) -> Column:
    """array of question drafts of an array of objects; elements that are no object are passed over."""

    def draft(q: Column) -> Column:
        return F.struct(
            aliased(bare(picked(q, TYPE)), QUESTION_TYPES).alias("type"), picked(q, STEM).alias("stem"), picked(q, ANSWER).alias("answer"),
            F.lower(bare(picked(q, PASS))).isin(*YES).alias("pass"), picked(q, AUDIT).alias("audit"), evidence(member(q, *EVIDENCE)).alias("evidence"), choices(member(q, *CHOICES)).alias("choices"),
        )

    return F.transform(F.filter(elements(questions), lambda q: F.coalesce(kind(q) == "object", F.lit(False))), draft)


def submitted(raw: Column) -> Column:
    """Drafts of a tool's arguments: a list, an object with a list (also as text), or one question; null where there are none."""

    def inside(v: Column) -> Column:
        q = member(v, "questions", "items")
        lone = F.when(member(v, "stem", "题干").isNotNull(), drafts(F.parse_json(F.concat(F.lit("["), F.to_json(v), F.lit("]")))))
        return F.coalesce(F.when(kind(q) == "array", drafts(q)), let(F.when(kind(q) == "string", decoded(string(q))), lambda t: F.when(kind(t) == "array", drafts(t)).when(kind(t) == "object", drafts(member(t, "questions", "items")))), lone)

    return let(decoded(raw), lambda v: F.when(kind(v) == "array", drafts(v)).when(kind(v) == "object", inside(v)))


def question_turn(candidates: Column) -> Column:
    """struct(tool, query, questions, problem) of a model's turn: its last object that calls a tool or gives questions.

    ``candidates``: of ``json_candidates``. Problems: NO_JSON, TOOL_NOT_ALLOWED, NO_QUERY, NEITHER.
    """

    def read(found: Column) -> Column:
        telling = F.filter(found, lambda o: F.coalesce((bare(string(member(o, "tool"))) != "") | (kind(member(o, "questions")) == "array"), F.lit(False)))
        return let(F.try_element_at(telling, F.lit(-1)), lambda o: _turn(F.size(found), o))

    return let(objects(F.coalesce(candidates, F.array().cast("array<string>"))), read)


def _turn(n: Column, o: Column) -> Column:
    def judged(x: Column) -> Column:
        tool, query = x["tool"], x["query"]
        called = tool != ""
        problem = F.when(n == 0, "NO_JSON").when(o.isNull(), "NEITHER").when(called & ~tool.isin(*TOOLS), "TOOL_NOT_ALLOWED").when(called & (query == ""), "NO_QUERY")
        ok = problem.isNull() & called
        return F.struct(F.when(ok, tool).alias("tool"), F.when(ok, query).alias("query"), F.when(problem.isNull() & ~called, drafts(member(o, "questions"))).alias("questions"), problem.alias("problem"))

    return let(F.struct(bare(string(member(o, "tool"))).alias("tool"), bare(scalar(member(member(o, "args"), "query"))).alias("query")), judged)


def duplicate_indexes(raw: Column, count: Column) -> Column:
    """struct(indexes, problem): which of ``count`` questions are repeats. With a problem nothing is one: unreadable is not "no repeats"."""

    def read(v: Column) -> Column:
        listed = elements(member(v, "duplicateIndexes", "duplicates"))
        numbers = F.transform(listed, lambda x: F.try_to_number(F.nullif(F.regexp_extract(scalar(x), r"^\s*\+?([0-9]{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int"))
        problem = F.when(v.isNull(), "NOT_JSON").when(kind(v) != "object", "NOT_OBJECT").when(listed.isNull(), "NO_LIST")
        fit = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: F.coalesce(n < count, F.lit(False)))))
        return F.struct(F.coalesce(fit, F.array().cast("array<int>")).alias("indexes"), problem.alias("problem"))

    return let(parsed(raw), read)


def vocabulary(raw: Column, seed: tuple[str, ...]) -> Column:
    """struct(terms, issues) of a stored vocabulary in any shape: null, JSON text, a list, or an object with ``terms``.

    Terms of the seed that are missing go in front. Issues: NOT_JSON, NO_TERMS, NO_NAME:n (from 1), SEED:k (missing ones).
    """
    term = "struct<name: string, aliases: array<string>>"
    none = F.array().cast(f"array<{term}>")
    sown = F.array(*[F.struct(F.lit(s).alias("name"), F.array().cast("array<string>").alias("aliases")) for s in seed])

    def entry(x: Column) -> Column:
        names = F.filter(F.transform(elements(member(x, "aliases")), lambda a: bare(string(a))), lambda a: a != "")
        return F.struct(bare(string(member(x, "name"))).alias("name"), F.coalesce(names, F.array().cast("array<string>")).alias("aliases"))

    def read(v: Column) -> Column:
        listed = F.transform(F.coalesce(elements(v), elements(member(v, "terms"))), entry)

        def filled(rows: Column) -> Column:
            named = F.filter(rows, lambda t: t["name"] != "")
            lost = F.filter(sown, lambda s: ~F.exists(named, lambda t: t["name"] == s["name"]))
            unnamed = F.transform(F.filter(F.transform(rows, lambda t, i: F.struct(t["name"].alias("name"), (i + 1).alias("i"))), lambda t: t["name"] == ""), lambda t: F.concat(F.lit("NO_NAME:"), t["i"].cast("string")))
            missing = F.when(F.size(lost) > 0, F.array(F.concat(F.lit("SEED:"), F.size(lost).cast("string")))).otherwise(F.array().cast("array<string>"))
            ok = F.struct(F.concat(lost, named).alias("terms"), F.concat(unnamed, missing).alias("issues"))
            why = F.when(F.is_variant_null(v), F.array().cast("array<string>")).when(v.isNull(), F.array(F.lit("NOT_JSON"))).otherwise(F.array(F.lit("NO_TERMS")))
            bad = F.struct(F.concat(sown, none).alias("terms"), why.alias("issues"))
            return F.when(rows.isNull(), bad).otherwise(ok)

        return let(listed, filled)

    fresh = F.struct(F.concat(sown, none).alias("terms"), F.array().cast("array<string>").alias("issues"))
    return F.when(raw.isNull(), fresh).otherwise(let(parsed(raw), read))
