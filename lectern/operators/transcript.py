"""Transcript operators: slide assignment, coverage, stitching, outlines, bins and guarded edits.

Every operator keeps its input rows: what cannot be placed or is refused is a row with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STITCH_GAP_MS = 15_000
BIN_BLOCKS, BIN_CHARS = 24, 50_000


def slide_bounds(slides: DataFrame, lesson: str = "lesson", page: str = "page", anchor_ms: str = "anchor_ms") -> DataFrame:
    """Adds ``bound``: the running maximum of each slide's end, null where a line of any later time belongs.

    A slide starts at the last known anchor up to it and ends at the next known one behind it.
    """
    w = W.partitionBy(lesson).orderBy(page)
    start = F.last(anchor_ms, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    back = W.partitionBy(lesson).orderBy(F.desc(page))  # a frame that ends with its partition would be read again for every row
    end = F.last(anchor_ms, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))
    bound = F.when(end.isNotNull(), F.greatest(F.coalesce(start, F.lit(-1)), end))
    marked = slides.withColumns({"raw_bound": bound})
    top = F.max("raw_bound").over(w.rowsBetween(W.unboundedPreceding, 0))
    ever_open = F.max(F.col("raw_bound").isNull()).over(w.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("bound", F.when(~ever_open, top)).drop("raw_bound")


def assign_lines(slides: DataFrame, lines: DataFrame, lesson: str = "lesson", page: str = "page", anchor_ms: str = "anchor_ms", start_ms: str = "start_ms") -> DataFrame:
    """``lines`` with the page of their slide.

    A line goes to the first slide whose bound lies behind it. Bounds are made monotone, so that the
    page is a count of the bounds passed: one sort of slides and lines together, no join. A lesson
    without slides leaves its lines with a null page.
    """
    bounds = slide_bounds(slides, lesson, page, anchor_ms)
    a = bounds.select(F.col(lesson).alias("_lesson"), F.col("bound").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(lines.schema.simpleString()).alias("_row"), F.col(page).alias("_page"))
    b = lines.select(F.col(lesson).alias("_lesson"), F.col(start_ms).alias("_t"), F.lit(1).alias("_kind"), F.struct(*lines.columns).alias("_row"), F.lit(None).cast(bounds.schema[page].dataType).alias("_page"))
    w = W.partitionBy("_lesson").orderBy(F.col("_t").asc_nulls_last(), "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_passed", F.count_if(F.col("_kind") == 0).over(w))
    pages = F.count_if(F.col("_kind") == 0).over(W.partitionBy("_lesson"))
    both = both.withColumn("_pages", pages)
    return both.filter("_kind = 1").select("_row.*", F.when(F.col("_pages") > 0, F.least(F.col("_passed") + 1, F.col("_pages"))).cast("int").alias("page"))


def even_split(lines: DataFrame, pages: Column, lesson: str, *order: str) -> DataFrame:
    """Without any anchor the i-th of N lines goes to page floor(i * pages / N) + 1."""
    rn = F.row_number().over(W.partitionBy(lesson).orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(W.partitionBy(lesson))
    return lines.withColumn("page", (F.floor(rn * pages / n) + 1).cast("int"))


def coverage_issues(spans: DataFrame, count: Column, lesson: str, ordinal: str, start: str = "from", end: str = "to", lessons: DataFrame | None = None) -> DataFrame:
    """Rows where spans fail to cover 1..count in turn, with what is wrong; a last row where the end is missing.

    A span without an end covers nothing: it is an issue, and the next one is still expected where it was.
    ``lessons`` (lesson, n): lessons of n sentences; one without any span has its end missing from 1 on.
    """
    w = W.partitionBy(lesson).orderBy(ordinal)
    done = F.last(end, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    s = spans.withColumns({"count": count, "expected": F.coalesce(done, F.lit(0)) + 1, "_last": F.row_number().over(w) == F.count(F.lit(1)).over(W.partitionBy(lesson))})
    s = s.withColumn("_done", F.last(end, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    f, t, e, n = F.col(start), F.col(end), F.col("expected"), F.col("count")
    kind = F.when(f.isNull() | t.isNull(), "open").when(t < f, "reversed").when(f < 1, "below").when(t > n, "beyond").when(f > e, "gap").when(f < e, "overlap")
    bad = s.withColumn("issue", kind).filter(F.col("issue").isNotNull()).select(lesson, ordinal, e.alias("expected"), f.alias("from"), t.alias("to"), "issue")
    left = F.coalesce("_done", F.lit(0)) + 1
    none = F.lit(None).cast("int")
    tail = s.filter(F.col("_last") & (left != n + 1)).select(lesson, ordinal, left.alias("expected"), none.alias("from"), none.alias("to"), F.lit("missing end").alias("issue"))
    out = bad.unionByName(tail)
    if lessons is not None:
        bare = lessons.filter("n > 0").join(spans.select(lesson).distinct(), lesson, "left_anti")
        out = out.unionByName(bare.select(lesson, F.lit(None).cast(spans.schema[ordinal].dataType).alias(ordinal), F.lit(1).alias("expected"), none.alias("from"), none.alias("to"), F.lit("missing end").alias("issue")))
    return out


def folded_outline(spans: Column, count: Column) -> Column:
    """Keeps spans inside 1..count that start behind the last kept one; adds ``kept`` to each.

    ``spans``: array of struct(from, to, ...) in order. A refused span does not move the limit on.
    """
    start = F.struct(F.lit(0).alias("last"), F.filter(F.transform(spans, lambda s: F.struct(s.alias("span"), F.lit(True).alias("kept"))), lambda x: F.lit(False)).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ok = (s["from"] >= 1) & (s["to"] <= count) & (s["from"] <= s["to"]) & (s["from"] > acc["last"])
        return F.struct(F.when(ok, s["to"]).otherwise(acc["last"]).alias("last"), F.array_append(acc["out"], F.struct(s.alias("span"), ok.alias("kept"))).alias("out"))

    return F.aggregate(spans, start, step)["out"]


def greedy_bins(sizes: Column, blocks: int = BIN_BLOCKS, chars: int = BIN_CHARS) -> Column:
    """Bin number (from 1) of each size in turn: a new bin when the block or character limit would be passed."""
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        new = (acc["n"] == 0) | (acc["n"] >= blocks) | (acc["c"] + size > chars)
        b = F.when(new, acc["bin"] + 1).otherwise(acc["bin"])
        return F.struct(
            b.alias("bin"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"),
            F.when(new, size).otherwise(acc["c"] + size).cast("long").alias("c"), F.array_append(acc["out"], b).alias("out"),
        )

    return F.aggregate(sizes, start, step)["out"]


def stitched(blocks: Column, gap_ms: int = STITCH_GAP_MS, opens: bool = False) -> Column:
    """Group number (from 1) of each block: contiguous sentences on different pages within the gap join.

    ``blocks``: array of struct(from, to, first_page, last_page, start_ms, end_ms, joinable) in order; with ``opens`` they
    have such a field too, and a block that opens begins a group whatever stands before it. The gap is measured to the latest end in the group.
    """
    last = {"g": F.lit(0), "to": F.lit(None).cast("int"), "page": F.lit(None).cast("int"), "end": F.lit(None).cast("long"), "j": F.lit(False)}
    start = F.struct(*[c.alias(n) for n, c in last.items()], F.array().cast("array<int>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        join = F.coalesce(
            (acc["to"] + 1 == b["from"]) & (acc["page"] != b["first_page"]) & acc["j"] & b["joinable"] & (b["start_ms"] - acc["end"] <= gap_ms), F.lit(False)
        )
        join = join & ~b["opens"] if opens else join
        g = F.when(join, acc["g"]).otherwise(acc["g"] + 1)
        return F.struct(
            g.alias("g"), b["to"].alias("to"), b["last_page"].alias("page"), F.when(join, F.greatest(acc["end"], b["end_ms"])).otherwise(b["end_ms"]).alias("end"),
            F.when(join, acc["j"]).otherwise(b["joinable"]).alias("j"), F.array_append(acc["out"], g).alias("out"),
        )

    return F.aggregate(blocks, start, step)["out"]


def merge_tags(blocks: DataFrame, tags: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Left join by key; a tag's field wins where it is not null."""
    t = tags.select(*key, *[F.col(f).alias(f"_{f}") for f in fields])
    return blocks.join(t, key, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def glossary(texts: DataFrame, text: str, page: str, min_count: int = 2, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Terms of 2 to 32 characters with their count and number of pages; plain numbers and stop words do not count.

    ``texts`` has a row a page. A page's terms are sorted in place, so that the first of equals is known and one
    aggregate counts both.
    """
    fit = F.filter(F.split(text, r"[^㐀-鿿A-Za-z0-9]+"), lambda t: F.length(t).between(2, 32) & ~t.rlike("^[0-9]+$") & ~t.isin(*stop_words, ""))
    marked = F.transform(F.array(F.array_sort(fit)), lambda a: F.transform(a, lambda t, i: F.struct(t.alias("term"), F.coalesce(F.get(a, i - 1) != t, F.lit(True)).alias("first"))))[0]
    terms = texts.select(F.explode(marked).alias("x")).select("x.term", "x.first")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("pages")).filter(F.col("n") >= min_count)


def page_gate(page_text: Column, visual: Column, hints: tuple[str, ...]) -> Column:
    """A page is a screenshot when its picture text has a hint and its own text is short."""
    some = F.lit(False)
    for h in hints:
        some = some | visual.contains(h)
    return F.coalesce((F.length(F.trim(visual)) > 0) & (F.length(F.trim(page_text)) < 200) & some, F.lit(False))
