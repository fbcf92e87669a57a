"""Written lectures: drafts of topics, requests in bins, answers joined back under guards, chapters. No topic is lost.

The tree's topics get the words of their blocks as a draft. Drafts go out in requests that hold so many topics and
characters; answers come back as rows, one per request and attempt, and are read by shape. What an answer says
about a topic of its own request is cleaned and guarded: too much or broken text leaves the draft in place, short or
colloquial text is kept and reported. A topic without an answer keeps its draft too, so every draft that goes in is a row
that comes out. Requests know their topics by small rows; texts move once, by topic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import variants as va
from lectern.functions.labels import tidy_written
from lectern.operators.transcript import greedy_bins

# Labels of a request that an answer must not echo, spoken words, forms of address, ends of a cut sentence, limits.
ECHOES = ("类型：", "知识点：", "老师讲的话", "课件上的要点", "课件线索")
FILLERS = ("呃", "嗯", "啊", "就是说", "对吧", "对不对", "然后呢", "我们来看", "我们讲", "大家", "同学们", "听懂了吗", "逻辑上", "这个", "那个")
ADDRESSES = ("同学们", "各位同学", "我们来看", "大家看", "听懂了吗")
CUT_ENDS = "的了啊呢吧吗呃呀哇，、："
ECHO_LENGTH, LARGE_SOURCE, TINY_ANSWER = 40, 200, 20
PART_TOPICS, PART_CHARS, NO_LIMIT = 1, 12_000, 1 << 30
TOPIC = ["deck", "chapter", "topic"]


def draft_bodies(topics: DataFrame, blocks: DataFrame) -> DataFrame:
    """Topics with ``text`` (their blocks' words in order, a block without any gives its summary), the blocks and the place where they begin.

    ``topics``: deck, chapter, topic, title, from_page, to_page; ``blocks``: deck, chapter, topic, block, page, start_ms, text,
    summary. ``blocks`` of the result lists block numbers, ``silent`` those that have nothing to say. A topic without blocks keeps a null list.
    """
    words = F.coalesce(F.nullif(va.bare("text"), F.lit("")), va.bare("summary"))
    said = blocks.select(*TOPIC, F.struct("block", F.coalesce(words, F.lit("")).alias("words"), "page", "start_ms").alias("b"))
    per = said.groupBy(*TOPIC).agg(F.array_sort(F.collect_list("b")).alias("own"))  # the blocks of one topic
    spoken = F.filter("own", lambda b: b["words"] != "")
    per = per.select(
        *TOPIC, F.array_join(F.transform(spoken, lambda b: b["words"]), "\n\n").alias("text"), F.transform("own", lambda b: b["block"]).alias("blocks"),
        F.transform(F.filter("own", lambda b: b["words"] == ""), lambda b: b["block"]).alias("silent"),
        F.col("own")[0]["page"].alias("first_page"), F.floor(F.coalesce(F.col("own")[0]["start_ms"], F.lit(0)) / 1000).cast("long").alias("anchor_sec"),
    )
    out = topics.join(per, TOPIC, "left")
    return out.withColumns({"text": F.coalesce("text", F.lit("")), "anchor_page": F.coalesce("first_page", "from_page"), "anchor_sec": F.coalesce("anchor_sec", F.lit(0))}).drop("first_page")


def parts_of(bodies: DataFrame, max_topics: int = PART_TOPICS, max_chars: int = PART_CHARS) -> DataFrame:
    """deck, chapter, topic, part: drafts in turn, a new request (from 1) where a limit would be passed; a limit of 0 or less is none.

    A deck's drafts are one array of small rows.
    """
    size = F.struct("chapter", "topic", F.length("text").alias("size"))
    decks = bodies.filter("text <> ''").select("deck", size.alias("u")).groupBy("deck").agg(F.array_sort(F.collect_list("u")).alias("u"))
    limits = [x if x > 0 else NO_LIMIT for x in (max_topics, max_chars)]
    bins = greedy_bins(F.transform("u", lambda x: x["size"]), *limits)
    return decks.select("deck", F.explode(F.arrays_zip(F.col("u").alias("u"), bins.alias("part"))).alias("x")).select("deck", "x.u.chapter", "x.u.topic", "x.part")


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (tx.occurrences(text, w) for w in words))


def guarded(source: Column, body: Column) -> Column:
    """struct(refused, notes, register) of a written text beside its source.

    Refused: EMPTY, TOO_LONG, BROKEN, the first that holds. Notes: SAME, ADDRESS:word, CUT keep a text from being a finished
    one, as does FILLER; SHRUNK is only told.
    """

    def judge(x: Column) -> Column:
        s, d, n, m = x["s"], x["d"], x["n"], x["m"]
        echo = reduce(lambda a, b: a | b, (d.contains(w) for w in ECHOES)) & (F.length(d) <= ECHO_LENGTH)
        refused = (
            F.when(d == "", "EMPTY").when((n > 0) & (m > F.ceil(n * tx.LENGTH_RATIO) + tx.LENGTH_SLACK), "TOO_LONG")
            .when(echo | ((n >= LARGE_SOURCE) & (m <= TINY_ANSWER)), "BROKEN")
        )
        same = (tx.normal_lecture_text(s) == tx.normal_lecture_text(d)) & (tx.normal_lecture_text(s) != "")
        address = [F.when(d.contains(w), f"ADDRESS:{w}") for w in ADDRESSES]
        cut = F.when(F.substr(d, F.length(d)).isin(*CUT_ENDS), "CUT")
        held = F.array_compact(F.array(F.when(same, "SAME"), *address, cut))
        filler = F.when((_hits(s, FILLERS) > 0) & (_hits(d, FILLERS) > _hits(s, FILLERS) * tx.MAX_FILLER_KEPT), "FILLER")
        shrunk = F.when((n > 0) & (m > 0) & (m / n < tx.MIN_KEPT), "SHRUNK")
        notes = F.array_compact(F.concat(held, F.array(filler, shrunk)))
        return F.struct(refused.alias("refused"), notes.alias("notes"), F.when((F.size(held) == 0) & filler.isNull(), "written").otherwise("draft").alias("register"))

    texts = F.struct(va.bare(source).alias("s"), va.bare(body).alias("d"))
    return va.let(va.let(texts, lambda t: F.struct(t["s"].alias("s"), t["d"].alias("d"), tx.content_characters(t["s"]).alias("n"), tx.content_characters(t["d"]).alias("m"))), judge)


def cleaned(passages: Column) -> Column:
    """Passages without spoken words and picture lines; where nothing would be left, as they were."""
    tidy = F.filter(F.transform(passages, lambda p: F.struct(p["label"].alias("label"), va.bare(tidy_written(p["text"])).alias("text"))), lambda p: p["text"] != "")
    return va.let(tidy, lambda t: F.when(F.size(t) > 0, t).otherwise(passages))


def _outcomes(own: Column, tries: Column) -> Column:
    """array<struct(chapter, topic, passages, slots, own, code)> of one request with its topics ``own`` and ``tries``, array<struct(attempt, w)> or null.

    Its own topics come first, each once (``own`` is true) with what the first useful attempt says of it, else no passages; then what that
    attempt says of others or again; then the request itself (no topic) where no attempt is useful, which is told instead of its topics.
    """

    def key(t: Column) -> Column:
        return F.struct(*[t[c].alias(c) for c in TOPIC[1:]])

    def row(t: Column | None, said: Column | None, is_own: bool, code: Column) -> Column:
        values = {c: F.lit(None).cast("long") if t is None else t[c] for c in TOPIC[1:]}
        values |= {n: (F.lit(None) if said is None else said[f]).cast(f"array<{kind}>") for n, f, kind in (("passages", "passages", va.PASSAGE), ("slots", "blocks", va.BLOCK))}
        return F.struct(*[v.alias(n) for n, v in values.items()], F.lit(is_own).alias("own"), code.cast("string").alias("code"))

    def listed(k: Column) -> Column:
        topics, problem = k["topics"], k["problem"]

        def first(o: Column) -> Column:
            return va.let(F.get(F.filter(topics, lambda t: key(t) == o), F.lit(0)), lambda f: row(o, f, True, F.when(problem.isNull() & f.isNull(), "NOT_RETURNED")))

        def other(t: Column, i: Column) -> Column:
            again = F.exists(F.slice(topics, F.lit(1), i), lambda x: key(x) == key(t))
            return row(t, None, False, F.when(~F.array_contains(own, key(t)), "FOREIGN").when(again, "REPEATED"))

        odd = F.filter(F.transform(topics, other), lambda e: e["code"].isNotNull())
        return F.concat(F.transform(own, first), odd, F.filter(F.array(row(None, None, False, problem)), lambda e: e["code"].isNotNull()))

    def chosen(x: Column) -> Column:
        topics = F.flatten(F.transform(F.filter(tries, lambda a: a["attempt"] == x["useful"]), lambda a: a["w"]["topics"]))
        code = F.coalesce(F.get(F.filter(tries, lambda a: a["attempt"] == x["last"]), F.lit(0))["w"]["problem"], F.lit("NO_OWN_TOPIC"))
        problem = F.when(x["useful"].isNull(), F.when(x["last"].isNull(), "NO_ANSWER").otherwise(code))
        return F.struct(F.coalesce(topics, F.array().cast(f"array<{va.TOPIC}>")).alias("topics"), problem.alias("problem"))

    useful = F.filter(tries, lambda a: F.exists(a["w"]["topics"], lambda t: F.array_contains(own, key(t))))
    numbers = [F.array_min(F.transform(useful, lambda a: a["attempt"])).alias("useful"), F.array_max(F.transform(tries, lambda a: a["attempt"])).alias("last")]
    return va.let(va.let(F.struct(*numbers), chosen), listed)


def assemble(topics: DataFrame, blocks: DataFrame, answers: DataFrame, max_topics: int = PART_TOPICS, max_chars: int = PART_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lecture, failures, warnings).

    ``topics`` and ``blocks`` as for ``draft_bodies``; ``answers``: deck, part, attempt, raw. Of a request's attempts the first that
    can be read and has one of its own topics counts. ``lecture``: a row per topic with a draft, with its chapter renumbered
    without gaps, passages, blocks, register (written, draft, or failed where the draft stands), notes and the place where it begins.
    ``failures``: deck, part, chapter, topic, code, where code is why a request or a topic was not taken, or what was noted about one that was.
    ``warnings``: deck, code, n of topics and blocks that had nothing to write from.
    """
    bodies = draft_bodies(topics, blocks)
    parts = parts_of(bodies, max_topics, max_chars)
    own = F.struct(*[F.col(c).cast("long").alias(c) for c in TOPIC[1:]])
    asked = parts.groupBy("deck", "part").agg(F.collect_list(own).alias("own"))
    tries = answers.select("deck", "part", F.struct("attempt", va.written_answer(F.col("raw")).alias("w")).alias("a")).groupBy("deck", "part").agg(F.collect_list("a").alias("tries"))
    # an answer is read in one place of each plan: all that it says about a request leaves here, each row once
    told = asked.join(tries, ["deck", "part"], "left").select("deck", "part", F.explode_outer(_outcomes(F.col("own"), F.col("tries"))).alias("e")).select("deck", "part", "e.*")
    drafts = bodies.filter("text <> ''").withColumns({c: F.col(c).cast("long") for c in TOPIC[1:]})
    met = told.withColumn("passages", F.when(F.col("passages").isNotNull(), cleaned(F.col("passages")))).join(drafts, TOPIC, "left")
    body = F.array_join(F.transform("passages", lambda p: p["text"]), "\n\n")
    met = met.withColumn("g", F.when(F.col("passages").isNotNull(), guarded(F.col("text"), body)))
    taken = F.col("g").isNotNull() & F.col("g.refused").isNull()
    codes = F.when(taken, F.col("g.notes")).otherwise(F.array(F.coalesce("g.refused", "code")))
    failures = met.select("deck", "part", "chapter", "topic", F.explode_outer(codes).alias("code")).filter("code IS NOT NULL")

    whole = F.array(F.struct(F.lit("").alias("label"), F.col("text")))
    chapters = parts.select("deck", F.col("chapter").cast("long").alias("chapter")).distinct().withColumn("chapter_no", F.row_number().over(W.partitionBy("deck").orderBy("chapter")))
    lecture = met.filter("own").join(chapters, ["deck", "chapter"]).select(
        "deck", "chapter", "topic", "chapter_no", "title", "from_page", "to_page", "blocks", F.col("text").alias("draft"),
        F.when(taken, F.col("passages")).otherwise(whole).alias("passages"), F.when(taken, F.col("slots")).otherwise(F.array().cast(f"array<{va.BLOCK}>")).alias("slots"),
        F.when(taken, F.col("g.register")).otherwise("failed").alias("register"), F.when(taken, F.col("g.notes")).otherwise(F.array().cast("array<string>")).alias("notes"),
        "anchor_page", "anchor_sec",
    )
    silent = bodies.groupBy("deck").agg(
        F.count_if(F.col("blocks").isNull()).alias("NO_BLOCKS"), F.count_if(F.col("blocks").isNotNull() & (F.col("text") == "")).alias("NO_TEXT"), F.sum(F.coalesce(F.size("silent"), F.lit(0))).alias("SILENT_BLOCK")
    )
    warnings = silent.unpivot("deck", ["NO_BLOCKS", "NO_TEXT", "SILENT_BLOCK"], "code", "n").filter("n > 0")
    return lecture, failures, warnings


def titled_chapters(lecture: DataFrame, chapters: DataFrame) -> DataFrame:
    """``lecture`` with ``chapter_title``: the chapter's own, or its new number where that is blank. ``chapters``: deck, chapter, chapter_title."""
    named = lecture.join(chapters.withColumn("chapter", F.col("chapter").cast("long")), ["deck", "chapter"], "left")
    own = va.bare("chapter_title")
    return named.withColumn("chapter_title", F.when(own == "", F.concat(F.lit("第 "), F.col("chapter_no").cast("string"), F.lit(" 部分"))).otherwise(own))
