"""A lecture as one text to edit: a writer and a reader of its line protocol, and the checks of an edited lecture against the original.

Text lines stand under ``##!topic`` and ``>>> BLOCK`` marks. A line that only looks like a mark is written behind a
backslash, so that reading what was written gives the units back as they were. An edited text may rename, split, merge and move
units freely; but each block names the units it carries on (``ref``) and the sources it rests on (``src``), and these
are joined with the original's: nothing may be invented, go beyond its units' sources, or be lost.
A text is read by splits at its marks, and the original's references stand beside it as short arrays: no windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import variants as va
from lectern.functions.labels import BLOCK_KINDS, block_kind, subtitle

# Marks of the protocol.
SECTION, PROTOCOL, TOPIC, BLOCK, SOLUTION = "#!section ", "#!protocol 2", "##!topic ", ">>> BLOCK ", ">>> SOLUTION"
OUTLINE, SOURCE, CHAPTER, UNNAMED_TOPIC, UNNAMED_CHAPTER = "#!outline ", "#!source ", "章=", "未命名知识点", "未命名章"
MARK = r"(?:#!|##!topic |>>> BLOCK |>>> SOLUTION$)"
TOPIC_LINE = rf"^##!topic ([0-9]+) ([0-9]+)\s*\|\s*([^|]+?)\s*\|\s*{CHAPTER}(.+)$"
WIRES = {wire: label for wire, label in BLOCK_KINDS}


def one_line(text: Column) -> Column:
    return va.bare(F.translate(F.coalesce(text, F.lit("")), "\r\n|", "   "))


def _unix(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def _where(found: Callable[[Column], Column], then: Callable[[Column], Column], text: Column) -> Column:
    """``then(text)`` for the texts that hold a mark, so that a pattern runs over few of them; the others as they are."""
    return va.let(text, lambda t: F.when(found(t), then(t)).otherwise(t))


def body(text: Column) -> Column:
    """A unit's text as the protocol keeps it: plain line ends, nothing blank around."""
    return va.bare(F.replace(_unix(F.coalesce(text, F.lit(""))), F.lit("\r"), F.lit("\n")))


def written(text: Column) -> Column:
    return _where(lambda t: t.contains("#!") | t.contains(">>> "), lambda t: F.regexp_replace(t, rf"(?dm)^(\\*)(?={MARK})", r"$1\\"), body(text))


def unwritten(text: Column) -> Column:
    return _where(lambda t: t.contains("\\"), lambda t: F.regexp_replace(t, rf"(?dm)^\\(\\*)(?={MARK})", "$1"), text)


def effective_blocks(blocks: Column, passages: Column) -> Column:
    """array<struct(kind, title, text, stem, solution)>: a topic's blocks, or its passages as blocks of the kind that they are labelled with."""
    names = ("kind", "title", "text", "stem", "solution")
    own = F.transform(blocks, lambda b: F.struct(*[b[n].alias(n) for n in names]))
    empty = F.lit("")
    plain = F.transform(passages, lambda p: F.struct(F.coalesce(block_kind(p["label"]), F.lit("elaboration")).alias("kind"), empty.alias("title"), p["text"].alias("text"), empty.alias("stem"), empty.alias("solution")))
    return F.when(F.size(blocks) > 0, own).otherwise(plain)


def review_units(topics: DataFrame) -> DataFrame:
    """The units of a lecture that say something: deck, chapter, topic, unit, ref and the block's fields, with its sources.

    ``topics``: deck, chapter, chapter_title, topic, title, sources (array<int>), blocks (with ``sources`` of their own, which
    may be null or empty). Units are numbered within their topic, blank ones left out.
    """
    fields = ("text", "stem", "solution")
    tidy = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["title"].alias("title"), *[body(b[f]).alias(f) for f in fields], b["sources"].alias("sources")))
    said = F.filter(tidy, lambda b: va.shown(b["kind"], *[b[f] for f in fields]) != "")
    rows = topics.select("deck", "chapter", "chapter_title", "topic", F.col("title").alias("topic_title"), F.col("sources").alias("topic_sources"), F.posexplode_outer(said).alias("i", "b"))
    rows = rows.filter("i IS NOT NULL")  # an inner explode would first filter by its array, and compute that twice
    example = F.col("b.kind") == "example"
    return rows.select(
        "deck", "chapter", "chapter_title", "topic", "topic_title", (F.col("i") + 1).alias("unit"), F.format_string("c%dt%db%d", "chapter", "topic", F.col("i") + 1).alias("ref"), F.col("b.kind").alias("kind"), F.col("b.title").alias("title"),
        F.when(example, "").otherwise(F.col("b.text")).alias("text"), F.when(example, F.col("b.stem")).otherwise("").alias("stem"), F.when(example, F.col("b.solution")).otherwise("").alias("solution"),
        F.when(F.size(F.coalesce("b.sources", F.array().cast("array<int>"))) > 0, F.col("b.sources")).otherwise(F.col("topic_sources")).alias("sources"),
    )


def write_lecture(units: DataFrame, decks: DataFrame, sources: DataFrame) -> DataFrame:
    """deck, text. ``units`` of ``review_units``; ``decks``: deck, title, outline (JSON text); ``sources``: deck, source, page, start_ms, summary."""
    label = F.try_element_at(F.create_map(*[F.lit(x) for pair in WIRES.items() for x in pair]), F.col("kind"))
    named = one_line("title")
    named = F.when(named.rlike("^(ref|src)="), "").otherwise(named)  # a title that reads as a field can't be kept
    mark = F.concat(F.lit(BLOCK), label, F.lit(" | "), named, F.lit(" | ref="), "ref", F.lit(" | src="), F.array_join(F.col("sources").cast("array<string>"), ","))
    words = F.when(F.col("kind") == "example", F.concat(written("stem"), F.lit("\n" + SOLUTION + "\n"), written("solution"))).otherwise(written("text"))
    topic = F.concat(
        F.lit(TOPIC), F.col("chapter").cast("string"), F.lit(" "), F.col("topic").cast("string"), F.lit(" | "), F.coalesce(F.nullif(one_line("topic_title"), F.lit("")), F.lit(UNNAMED_TOPIC)),
        F.lit(f" | {CHAPTER}"), F.coalesce(F.nullif(one_line("chapter_title"), F.lit("")), F.lit(UNNAMED_CHAPTER)), F.lit("\n"),
    )
    chunk = F.concat(F.when(F.col("unit") == 1, topic).otherwise(""), mark, F.lit("\n"), words)
    texts = units.select("deck", F.struct("chapter", "topic", "unit", chunk.alias("chunk")).alias("c")).groupBy("deck").agg(F.array_sort(F.collect_list("c")).alias("c"))  # one lecture
    named_sources = F.concat(F.lit(SOURCE), F.col("source").cast("string"), F.lit(" | P"), F.coalesce("page", F.lit(0)).cast("string"), F.lit(" | "), one_line("summary"))
    listed = sources.groupBy("deck").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", named_sources.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.array(F.concat(F.lit(SECTION), F.col("deck").cast("string"), F.lit(" "), one_line("title")), F.lit(PROTOCOL), F.concat(F.lit(OUTLINE), F.coalesce("outline", F.lit("[]"))))
    none = F.array().cast("array<string>")
    all_ = decks.join(listed, "deck", "left").join(texts, "deck", "left")
    return all_.select("deck", F.array_join(F.concat(head, F.coalesce("lines", none), F.coalesce(F.transform("c", lambda x: x["chunk"]), none)), "\n").alias("text"))


def _block(piece: Column) -> Column:
    def read(f: Column) -> Column:
        def listed(name: str) -> Column:
            raw = F.get(F.filter(f["parts"], lambda p: p.startswith(name)), F.lit(0))
            return F.filter(F.transform(F.split(F.substr(raw, F.lit(len(name) + 1)), ","), va.bare), lambda x: x != "")

        none = F.array().cast("array<string>")
        title, srcs = F.get(f["parts"], F.lit(1)), F.coalesce(listed("src="), none)
        return F.struct(
            block_kind(F.get(f["parts"], F.lit(0))).alias("kind"), F.when(title.rlike("^(ref|src)="), "").otherwise(F.coalesce(title, F.lit(""))).alias("title"), F.coalesce(listed("ref="), none).alias("refs"),
            F.array_distinct(F.filter(F.transform(srcs, lambda s: s.try_cast("int")), lambda s: s.isNotNull())).alias("sources"), F.exists(srcs, lambda s: ~s.rlike("^[0-9]+$")).alias("odd_source"),
            unwritten(va.bare(F.get(f["halves"], F.lit(0)))).alias("text"), unwritten(va.bare(F.array_join(_behind(f["halves"]), ""))).alias("solution"), (F.size(f["halves"]) > 1).alias("solved"),
        )

    def split(line: Column) -> Column:
        parts = F.transform(F.split(F.substr(line, F.lit(len(BLOCK) + 1)), r"\|"), va.bare)
        rest = _where(lambda t: t.contains("#!"), lambda t: F.regexp_replace(t, r"(?dm)^#!.*\n?", ""), F.substr(piece, F.length(line) + 2))
        halves = va.let(rest, lambda t: F.when(t.contains(SOLUTION), F.split(t, r"(?dm)^>>> SOLUTION$\n?")).otherwise(F.array(t)))
        return F.struct(parts.alias("parts"), halves.alias("halves"))

    return va.let(va.let(F.substring_index(piece, "\n", 1), split), read)


def _behind(parts: Column) -> Column:
    """All but the first."""
    return F.slice(parts, F.lit(2), F.lit(1 << 30))


def read_lecture(raw: Column) -> Column:
    """struct(sections, stray, topics) of an edited text: the names of its section lines, whether a block stands before any topic, and topics with their blocks."""

    def topic(part: Column) -> Column:
        def named(line: Column) -> Column:
            ok = line.rlike(TOPIC_LINE)
            got = [F.when(ok, F.regexp_extract(line, TOPIC_LINE, i)) for i in (1, 2, 3, 4)]
            return F.struct(
                got[0].try_cast("int").alias("chapter"), got[1].try_cast("int").alias("topic"), va.bare(got[2]).alias("title"), va.bare(got[3]).alias("chapter_title"),
                F.transform(_behind(F.split(part, r"\n(?=>>> BLOCK )")), _block).alias("blocks"),
            )

        return va.let(F.substring_index(part, "\n", 1), named)

    def read(parts: Column) -> Column:
        front = F.get(parts, F.lit(0))
        return F.struct(
            F.regexp_extract_all(front, F.lit(r"(?dm)^#!section (\S+) "), F.lit(1)).alias("sections"), front.contains("\n" + BLOCK).alias("stray"),
            F.transform(_behind(parts), topic).alias("topics"),
        )

    return va.let(F.split(F.concat(F.lit("\n"), _unix(raw)), r"\n(?=##!topic )"), read)


def merge_lecture(edits: DataFrame, units: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks of the edited lectures that may be kept, problems of the others).

    ``edits``: deck, text; ``units`` of ``review_units``; ``sources``: deck, source, page, start_ms. Problems: deck, code, n (how often): SECTION,
    NO_TOPIC, TOPIC_FORMAT, TOPIC_REPEATED, CHAPTER_SPLIT, STRAY_BLOCK, EMPTY_TOPIC, BLOCK_KIND, SOLUTION_PLACE, SRC_FORMAT, EMPTY_BLOCK,
    REF_UNKNOWN, SRC_UNKNOWN, SRC_OUTSIDE, UNIT_LOST, SOURCE_LOST, EXAMPLE_LOST. A deck with any problem is left as it was. Chapters and
    topics of kept decks are numbered anew; each block has the pages and the first place of its sources.

    A lecture's references are a short array beside its text: two joins by deck, and no other shuffle.
    """
    known = units.groupBy("deck").agg(F.collect_list(F.struct("ref", "kind", (F.col("solution") != "").alias("solved"), "sources")).alias("u"))
    places = sources.groupBy("deck").agg(F.collect_list(F.struct("source", "page", "start_ms")).alias("s"))
    none_u, none_s = (F.array().cast(x.schema[c].dataType) for x, c in ((known, "u"), (places, "s")))
    read = edits.select("deck", read_lecture(F.col("text")).alias("x"))  # before the joins, so that it is not repeated behind them
    met = read.join(known, "deck", "left").join(places, "deck", "left").select("deck", "x", F.coalesce("u", none_u).alias("u"), F.coalesce("s", none_s).alias("s"))
    checked = met.select("deck", "x.topics", "s", _problems(F.col("deck"), F.col("x"), F.col("u"), F.col("s")).alias("found"))
    # outer explodes: an inner one would first filter by its array, and compute that twice
    problems = checked.select("deck", F.explode_outer("found").alias("p")).select("deck", "p.code", "p.n").filter("n > 0")

    fine = checked.select("deck", "s", F.when(~F.exists("found", lambda p: p["n"] > 0), F.col("topics")).alias("topics")).withColumn("numbers", _numbers(F.col("topics")))
    ordered = fine.select("deck", "s", "numbers", F.posexplode_outer("topics").alias("i", "t")).filter("t IS NOT NULL")
    # numbers without gaps: a chapter's number is that of the different chapters up to it, a topic's its place among those of its chapter
    here = F.slice("numbers", F.lit(1), F.col("i") + 1)
    chapter_no, topic_no = F.size(F.array_distinct(F.transform(here, lambda n: n["c"]))), F.size(F.filter(here, lambda n: n["c"] == F.col("t.chapter")))
    flat = ordered.select("deck", "s", chapter_no.alias("chapter_no"), F.col("t.chapter_title").alias("chapter_title"), topic_no.alias("topic_no"), F.col("t.title").alias("topic_title"), F.posexplode("t.blocks").alias("b", "v"))
    example = F.col("v.kind") == "example"
    out = flat.withColumn("own", F.filter("s", lambda p: F.array_contains(F.col("v.sources"), p["source"]))).select(
        "deck", "chapter_no", "chapter_title", "topic_no", "topic_title", (F.col("b") + 1).alias("block_no"), F.col("v.kind").alias("kind"), subtitle(F.col("v.title"), F.col("v.kind"), F.col("v.text")).alias("title"),
        F.when(example, "").otherwise(F.col("v.text")).alias("text"), F.when(example, F.col("v.text")).otherwise("").alias("stem"), F.when(example, F.col("v.solution")).otherwise("").alias("solution"), "v.refs", "v.sources",
        F.array_min(F.transform("own", lambda p: p["page"])).alias("from_page"), F.array_max(F.transform("own", lambda p: p["page"])).alias("to_page"), F.array_min(F.transform("own", lambda p: p["start_ms"])).alias("start_ms"),
        F.array_min(F.transform("own", lambda p: p["source"])).alias("first_source"),
    )
    return out, problems


def _numbers(topics: Column) -> Column:
    return F.transform(F.filter(topics, lambda t: t["chapter"].isNotNull()), lambda t: F.struct(t["chapter"].alias("c"), t["topic"].alias("t"), t["chapter_title"].alias("title")))


def _many(items: Column, wrong) -> Column:
    return F.size(F.filter(items, wrong))


def _order_problems(numbers: Column) -> dict[str, Column]:
    """Topics named twice; chapters that begin again after others, or go on under another title."""
    again = _many(numbers, lambda n, i: (i > 0) & F.coalesce(F.get(numbers, i - 1)["c"] != n["c"], F.lit(False)) & F.exists(F.slice(numbers, F.lit(1), i), lambda m: m["c"] == n["c"]))
    renamed = _many(numbers, lambda n, i: (i > 0) & F.coalesce((F.get(numbers, i - 1)["c"] == n["c"]) & (F.get(numbers, i - 1)["title"] != n["title"]), F.lit(False)))
    keys = F.transform(numbers, lambda n: F.struct(n["c"], n["t"]))
    twice = F.array_distinct(F.filter(keys, lambda k, i: F.array_contains(F.slice(keys, F.lit(1), i), k)))
    return {"TOPIC_REPEATED": F.size(twice), "CHAPTER_SPLIT": again + renamed}


def _reference_problems(k: Column, u: Column) -> dict[str, Column]:
    """``k``: struct(blocks, refs, named, there, carried, rested) of one lecture."""
    blocks, named = k["blocks"], k["named"]

    def lacks(b: Column) -> Column:
        return (F.size(b["refs"]) == 0) | (F.size(F.array_except(b["refs"], k["refs"])) > 0)

    def groundless(b: Column) -> Column:
        return (F.size(b["sources"]) == 0) | (F.size(F.array_except(b["sources"], k["there"])) > 0)

    def outside(b: Column) -> Column:
        allowed = F.flatten(F.transform(b["refs"], lambda r: F.try_element_at(named, r)))
        return ~lacks(b) & ~groundless(b) & (F.size(F.array_except(b["sources"], allowed)) > 0)

    def broken(v: Column) -> Column:
        own = F.filter(blocks, lambda b: F.array_contains(b["refs"], v["ref"]))
        kept = va.let(own, lambda o: (F.size(o) == 0) | F.exists(o, lambda b: b["kind"] == "example") & (~v["solved"] | F.exists(o, lambda b: b["solution"] != "")))
        return (v["kind"] == "example") & ~F.coalesce(kept, F.lit(False))

    return {
        "REF_UNKNOWN": _many(blocks, lacks), "SRC_UNKNOWN": _many(blocks, groundless), "SRC_OUTSIDE": _many(blocks, outside), "UNIT_LOST": F.size(F.array_except(k["refs"], k["carried"])),
        "SOURCE_LOST": F.size(F.array_except(F.array_distinct(F.flatten(F.map_values(named))), k["rested"])), "EXAMPLE_LOST": _many(u, broken),
    }


def _problems(deck: Column, x: Column, u: Column, s: Column) -> Column:
    """array<struct(code, n)> of every check of one lecture, with n = 0 for those that pass."""
    topics = x["topics"]

    def listed(k: Column) -> Column:
        blocks = k["blocks"]
        found = {
            "SECTION": (~F.array_contains(x["sections"], deck.cast("string"))).cast("int"), "NO_TOPIC": (F.size(topics) == 0).cast("int"), "STRAY_BLOCK": x["stray"].cast("int"),
            "TOPIC_FORMAT": _many(topics, lambda t: t["chapter"].isNull()), "EMPTY_TOPIC": _many(topics, lambda t: F.size(t["blocks"]) == 0), "BLOCK_KIND": _many(blocks, lambda b: b["kind"].isNull()),
            "SOLUTION_PLACE": _many(blocks, lambda b: b["solved"] & F.coalesce(b["kind"] != "example", F.lit(True))), "SRC_FORMAT": _many(blocks, lambda b: b["odd_source"]), "EMPTY_BLOCK": _many(blocks, lambda b: b["text"] == ""),
        } | _order_problems(k["numbers"]) | _reference_problems(k, u)
        return F.array(*[F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")) for code, n in found.items()])

    def bound(blocks: Column) -> Column:
        k = {
            "blocks": blocks, "refs": F.transform(u, lambda v: v["ref"]), "named": F.map_from_entries(F.transform(u, lambda v: F.struct(v["ref"], v["sources"]))), "there": F.transform(s, lambda p: p["source"]),
            "carried": F.array_distinct(F.flatten(F.transform(blocks, lambda b: b["refs"]))), "rested": F.array_distinct(F.flatten(F.transform(blocks, lambda b: b["sources"]))), "numbers": _numbers(topics),
        }
        return va.let(F.struct(*[c.alias(n) for n, c in k.items()]), listed)

    return va.let(F.flatten(F.transform(topics, lambda t: t["blocks"])), bound)
