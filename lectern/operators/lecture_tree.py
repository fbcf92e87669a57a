"""The knowledge tree of a lecture: from pages of slide text and timed blocks to topics, chapters and votes.

One plan of windows and aggregates over decks. A page's head is its title where its first usable line looks like one;
runs of pages under one head are topics; every block goes to the topic that holds its page, or to the
nearest; topics gather into chapters at divider pages or, in decks without any, where the outline's segment changes.
Nothing is dropped: topics without blocks stay, blocks outside all pages are attached and marked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import slide_text as st
from lectern.operators.tree import expanded_outline, template_class
from lectern.session import dealt

#: When a line that many pages share is their header.
HEADER_MIN_PAGES, HEADER_PAGE_RATIO, HEADER_FIRST_RATIO = 3, 0.4, 0.8
HEADER_SPAN, HEADER_DENSITY = 11, 0.6


def page_lines(slides: DataFrame) -> DataFrame:
    """deck, page, ord, line, noise of each cleaned line that is not empty; ``slides``: deck, page, text."""
    cleaned = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), st.clean_line), lambda c: c != "")
    # dealt out before cleaning, which is most of the work, for a deck's pages come numbered in one task; and after it, so that both readers of the lines share one shuffle
    dealt_pages = dealt(slides.select("deck", "page", "text"), "deck", "page")
    lines = dealt_pages.select("deck", "page", F.posexplode_outer(cleaned).alias("o", "line")).filter("line IS NOT NULL").select("deck", "page", (F.col("o") + 1).alias("ord"), "line")
    return dealt(lines.withColumn("noise", st.is_noise(F.col("line"))), "deck", "page")


def page_heads(slides: DataFrame) -> DataFrame:
    """deck, page, head ('' without), body (lines below it), window, header, shell of every page."""
    lines = page_lines(slides)
    page = W.partitionBy("deck", "page")
    lines = lines.withColumn("first_usable", F.min(F.when(~F.col("noise"), F.col("ord"))).over(page))
    once = lines.groupBy("deck", "line", "page").agg(F.max((F.col("ord") == F.col("first_usable")).cast("int")).alias("first"))
    size = slides.groupBy("deck").agg(F.countDistinct("page").alias("deck_pages"))
    spread = once.groupBy("deck", "line").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("first", F.lit(0))).alias("firsts"), F.min("page").alias("lo"), F.max("page").alias("hi"))
    span = F.col("hi") - F.col("lo") + 1
    whole, part = F.col("pages") >= F.col("deck_pages") * HEADER_PAGE_RATIO, (span >= HEADER_SPAN) & (F.col("pages") / span >= HEADER_DENSITY)
    is_header = (F.col("pages") >= HEADER_MIN_PAGES) & (F.col("firsts") / F.col("pages") >= HEADER_FIRST_RATIO) & (whole | part)
    spread = spread.join(size, "deck").select("deck", "line", "pages", is_header.alias("is_header"))

    marked = lines.join(spread, ["deck", "line"])
    usable = ~F.col("is_header") & ~F.col("noise")
    entry = F.struct("ord", "line", "pages")
    per = marked.groupBy("deck", "page").agg(  # arrays hold the lines of one page
        F.array_sort(F.collect_list(F.when(usable, entry))).alias("usable"), F.min_by("line", "ord").alias("top"),
        F.min_by(F.when(~F.col("noise"), F.col("line")), F.when(~F.col("noise"), F.col("ord"))).alias("plain"),
        F.max("is_header").alias("header"),
    )
    pages = slides.select("deck", "page").distinct().join(per, ["deck", "page"], "left")
    pages = pages.withColumns({"window": st.app_window(F.col("top")), "header": F.coalesce("header", F.lit(False)), "usable": F.coalesce("usable", F.array().cast("array<struct<ord:int,line:string,pages:bigint>>"))})
    shell = F.col("window") | (F.size("usable") == 0)
    top = F.get("usable", F.lit(0))
    others = F.filter("usable", lambda l: (l["line"] != top["line"]) & ~l["line"].contains("|"))
    short = F.filter("usable", lambda l: (l["line"] != top["line"]) & ~l["line"].contains("|") & (F.length(l["line"]) <= st.SHORT_LINE))
    titled = ~shell & ~st.rejected_as_title(top["line"]) & st.title_evidence(top["line"], top["pages"], F.size(others), F.size(short))
    pages = pages.withColumns({"shell": shell & F.col("top").isNotNull(), "head": F.when(titled, top["line"]).otherwise(""), "body": F.when(shell, 0).otherwise(F.size("usable") - titled.cast("int"))})

    # a cover page: of the pages before the first title, the first that could have one
    so_far = W.partitionBy("deck").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    open_ = (F.max(F.col("head") != "").over(so_far) == F.lit(False)) & ~F.col("window") & ~F.col("header") & F.col("plain").isNotNull()
    pages = pages.withColumn("open", F.coalesce(open_, F.lit(False)))
    first_open = (F.count_if("open").over(so_far) == 1) & F.col("open")
    cover = pages.withColumn("first_open", first_open).filter("first_open").select("deck", "page", F.col("plain").alias("cover"))
    used = pages.filter("head <> ''").select("deck", F.col("head").alias("cover")).distinct()
    cover = cover.filter(~st.rejected_as_title(F.col("cover"))).join(used, ["deck", "cover"], "left_anti")
    pages = pages.join(cover, ["deck", "page"], "left")
    return pages.select(
        "deck", "page", F.coalesce("cover", "head").alias("head"), F.when(F.col("cover").isNotNull(), F.col("body") - 1).otherwise(F.col("body")).alias("body"), "window", "header", "shell"
    )


def topics_of(heads: DataFrame) -> DataFrame:
    """deck, topic (from 1), title, from_page, to_page, lines, divided (the deck has divider pages): a page without a head goes on, a window's picture begins anew."""
    w = W.partitionBy("deck").orderBy("page")
    up = w.rowsBetween(W.unboundedPreceding, 0)
    own = F.when(F.col("head") != "", F.col("head")).when(F.col("window"), F.lit(""))
    named = heads.withColumn("title", F.coalesce(F.last(own, ignorenulls=True).over(up), F.lit("")))
    new = (F.row_number().over(w) == 1) | (F.col("title") != F.lag("title").over(w))
    runs = named.withColumn("new", new.cast("int")).withColumn("topic", F.sum("new").over(up))
    topics = runs.groupBy("deck", "topic", "title").agg(F.min("page").alias("from_page"), F.max("page").alias("to_page"), F.sum("body").alias("lines"))
    return topics.withColumn("divided", F.max(st.looks_like_divider(F.col("title"))).over(W.partitionBy("deck")))


def placed_blocks(topics: DataFrame, blocks: DataFrame) -> DataFrame:
    """deck, block, page, topic, orphan, divided: by one sort of topics and blocks by page; ``blocks``: deck, block, page."""
    span = F.struct("topic", "from_page", "to_page", "divided")
    a = topics.select("deck", F.col("from_page").cast("long").alias("at"), F.lit(0).alias("kind"), span.alias("span"), F.lit(None).cast("long").alias("block"))
    b = blocks.select("deck", F.coalesce("page", F.lit(0)).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(a.schema["span"].dataType).alias("span"), F.col("block").cast("long").alias("block"))
    w, back = W.partitionBy("deck").orderBy("at", "kind"), W.partitionBy("deck").orderBy(F.desc("at"), F.desc("kind"))
    # both frames grow with the rows; one that ends with the partition would be read again for every row
    both = a.unionByName(b).withColumns({
        "before": F.last("span", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "after": F.last("span", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)),
    }).filter("kind = 1 AND (before IS NOT NULL OR after IS NOT NULL)")
    inside = F.coalesce(F.col("at") <= F.col("before.to_page"), F.lit(False))
    nearer = F.col("before").isNull() | F.coalesce(F.col("after.from_page") - F.col("at") < F.col("at") - F.col("before.to_page"), F.lit(False))
    topic = F.when(inside, F.col("before.topic")).when(nearer, F.col("after.topic")).otherwise(F.col("before.topic"))
    return both.select("deck", "block", F.col("at").alias("page"), topic.alias("topic"), (~inside).alias("orphan"), F.coalesce("before.divided", "after.divided").alias("divided"))


def build_tree(slides: DataFrame, blocks: DataFrame, outline: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics with their chapters, blocks with their topic, one row per deck).

    ``slides``: deck, page, text; ``blocks``: deck, block, page; ``outline``: deck, segment, title, from, to (of blocks).
    """
    heads = page_heads(slides).persist()  # a short row a page, which three results read; a lost part is computed again
    topics = topics_of(heads)
    placed = placed_blocks(topics, blocks)
    covered = expanded_outline(outline, ["deck"], "from", "to", "segment").select("deck", F.col("block").cast("long").alias("block"), "segment")
    votes = placed.filter("NOT divided").join(covered, ["deck", "block"]).groupBy("deck", "topic", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("orphan", "page", "block")).alias("first")
    )
    won = votes.groupBy("deck", "topic").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "segment")).alias("b")).select("deck", "topic", F.col("b.segment").alias("segment"))
    counts = placed.groupBy("deck", "topic").agg(F.count(F.lit(1)).alias("blocks"))
    full = topics.join(counts, ["deck", "topic"], "left").join(won, ["deck", "topic"], "left")
    full = full.join(outline.select("deck", "segment", F.col("title").alias("segment_title")), ["deck", "segment"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))

    w = W.partitionBy("deck").orderBy("topic")
    up = w.rowsBetween(W.unboundedPreceding, 0)
    known = F.last("segment", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    divider = st.looks_like_divider(F.col("title"))
    full = full.withColumn("begins", divider | F.coalesce(F.col("segment") != known, F.col("segment").isNotNull()))
    name = F.when(divider, F.col("title")).when(F.col("begins"), F.col("segment_title"))
    chapter = F.sum(F.col("begins").cast("int")).over(up) + F.when(F.first("begins").over(up), 0).otherwise(1)
    full = full.withColumns({"chapter": chapter.cast("int"), "chapter_title": F.coalesce(F.last(name, ignorenulls=True).over(up), F.lit(""))})
    full = full.select("deck", "topic", "title", "from_page", "to_page", "lines", "blocks", "chapter", "chapter_title")

    decks = heads.groupBy("deck").agg(F.count(F.lit(1)).alias("pages"), F.count_if("header").alias("header_pages"), F.count_if("shell").alias("shell_pages"))
    sums = full.groupBy("deck").agg(F.count(F.lit(1)).alias("topics"), F.count_if(F.col("blocks") > 0).alias("covered_topics"), F.max("chapter").alias("chapters"), F.sum("blocks").alias("blocks"))
    decks = decks.join(sums, "deck").withColumn("template", template_class(F.col("pages"), F.col("header_pages"), F.col("shell_pages")))
    return full, placed.drop("divided"), decks
