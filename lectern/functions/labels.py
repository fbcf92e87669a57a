"""Names, links, labels and small decisions on records: string builders and closed code lists."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.slide_text import clean_line, is_noise

# Schemes of links, code lists, words and phrases.
SECTION_SCHEME, ASSET_SCHEME, ASSET_ALT = "zy://section/", "zy-asset://", "插图"
BLOCK_KINDS = (("elaboration", "讲解"), ("definition", "定义"), ("procedure", "步骤"), ("example", "例题"), ("note", "说明"))
BLOCK_ALIASES = (
    ("概念", "definition"), ("法则", "definition"), ("公式", "definition"), ("定理", "definition"), ("作业", "note"), ("教学安排", "note"), ("补充", "note"),
    ("案例", "elaboration"), ("讨论", "elaboration"), ("实验", "procedure"),
)
RUBRIC_PHRASES = ("评分标准", "打分标准", "打分表", "评分细则", "评分量表", "评分维度", "满分", "及格线", "按以下标准", "按下列标准", "rubric", "scoring guide")
AUTO_VERDICTS, SELF_RECALLS = ("correct", "incorrect", "unknown"), ("again", "hard", "good", "easy")
READ_FINE = ("ok", "noFile")
#: By precedence: what a read status asks of the user.
REMEDIES = (("corrupt", "repair"), ("pathBlocked", "move"), ("ioError", "retry"))
STRIP_WORDS = ("我们来看", "听懂了吗", "就是说", "对不对", "然后呢", "对吧", "同学们", "各位同学", "呃", "嗯", "啊")
VISION_BEGIN = "^(标题栏|窗口标题|右上角|左上角|椭圆|示意图|页眉|页脚)"
SUBTITLE_LIMIT, CLUES, ANCHOR_SECONDS = 20, 12, 0.5


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def note_key(course: Column, section: Column) -> Column:
    return F.concat(course, F.lit("/"), section)


def note_route(course: Column, section: Column) -> Column:
    return F.concat(F.lit("/note?course="), course, F.lit("&section="), section)


def clock_of(seconds: Column) -> Column:
    """mm:ss of whole seconds, at least 0; minutes go beyond 59."""
    s = F.greatest(F.lit(0), F.when(seconds < 0, 0).otherwise(F.floor(seconds))).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def time_link(course: Column, section: Column, seconds: Column) -> Column:
    return F.concat(F.lit("["), clock_of(seconds), F.lit(f"]({SECTION_SCHEME}"), course, F.lit("/"), section, F.lit("?t="), seconds.cast("string"), F.lit(")"))


def page_link(course: Column, section: Column, page: Column) -> Column:
    return F.concat(F.lit("[第 "), page.cast("string"), F.lit(f" 页]({SECTION_SCHEME}"), course, F.lit("/"), section, F.lit("?page="), page.cast("string"), F.lit(")"))


def asset_link(ident: Column, alt: Column) -> Column:
    """An empty alt is kept; only a missing one takes the default."""
    return F.concat(F.lit("!["), F.coalesce(alt, F.lit(ASSET_ALT)), F.lit(f"]({ASSET_SCHEME}"), ident, F.lit(")"))


def player_route(course: Column, section: Column, page: Column, seconds: Column) -> Column:
    parts = F.array_compact(F.array(F.when(page > 0, F.concat(F.lit("page="), page.cast("string"))), F.when(seconds >= 0, F.concat(F.lit("t="), seconds.cast("string")))))
    query = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.concat(F.lit("/courses/"), course, F.lit("/section/"), section, query)


def material_id(section: Column, block: Column, revision: Column) -> Column:
    return F.concat(_text(section), F.lit("#b"), block.cast("string"), F.lit("@"), _text(revision))


def resource_url(url: Column, host: str) -> Column:
    """http becomes https for the given media host alone; what follows stays as it is."""
    return F.when(url.rlike(rf"(?i)^http://([^/?#@]*@)?{re.escape(host)}(:[0-9]*)?([/?#]|$)"), F.regexp_replace(url, "(?i)^http:", "https:")).otherwise(url)


def relative_label(at_ms: Column, now_ms: Column) -> Column:
    """How long ago within a week, then the day in China; nothing for an unknown time."""
    minutes = F.floor((now_ms - at_ms) / 60000)
    hours, day = F.floor(minutes / 60), F.from_utc_timestamp(F.timestamp_millis(at_ms.cast("long")), "Asia/Shanghai")
    return (
        F.when(F.coalesce(at_ms, F.lit(0)) == 0, "").when(minutes < 1, "刚刚").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" 分钟前")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" 小时前"))).when(hours < 168, F.concat(F.floor(hours / 24).cast("string"), F.lit(" 天前")))
        .otherwise(F.concat(F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日")))
    )


def has_content(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\s+", "") != "", F.lit(False))


def block_kind(raw: Column) -> Column:
    """The wire name of a kind by wire name, label or alias; null for any other."""
    names = [*BLOCK_ALIASES, *((label, wire) for wire, label in BLOCK_KINDS), *((wire, wire) for wire, _ in BLOCK_KINDS)]
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names for x in pair]), F.trim(_text(raw)))


def subtitle(raw: Column, kind: Column, body: Column) -> Column:
    """A block's title, empty where it is long, a sentence, its kind or its body again."""
    title = F.regexp_replace(F.regexp_replace(F.trim(_text(raw)), r"\s+", " "), r"^[，、；：\s]+|[。！？；：，、\s]+$", "")

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"[\s。！？；：，、]", "")

    again = (_text(body) != "") & ((bare(_text(body)) == bare(title)) | (bare(F.get(F.split(_text(body), "[。！？]"), F.lit(0))) == bare(title)))
    refused = (F.length(title) > SUBTITLE_LIMIT) | title.rlike("[。！？]") | F.coalesce(block_kind(title) == kind, F.lit(False)) | again
    return F.when(refused, "").otherwise(title)


def rubric_phrase(instruction: Column) -> Column:
    """The first banned phrase that an instruction holds, ignoring case."""
    low = F.lower(instruction)
    return F.coalesce(*[F.when(low.contains(p), p) for p in RUBRIC_PHRASES])


def attempt_problem(ident: Column, auto: Column, recall: Column, at: Column) -> Column:
    """Why an attempt cannot be read, null where it can."""
    return (
        F.when(F.trim(_text(ident)) == "", "no id").when(~F.coalesce(auto.isin(*AUTO_VERDICTS), F.lit(False)), "unknown verdict")
        .when(recall.isNotNull() & ~recall.isin(*SELF_RECALLS), "unknown recall").when(F.try_to_timestamp(at).isNull(), "bad time")
    )


def store_writable(items: Column, attempts: Column) -> Column:
    return F.coalesce(items.isin(*READ_FINE) & attempts.isin(*READ_FINE), F.lit(False))


def store_remedy(items: Column, attempts: Column) -> Column:
    """What to do about two read statuses, the graver one first; null when both are fine."""
    return F.coalesce(*[F.when((items == code) | (attempts == code), what) for code, what in REMEDIES])


def anchor_warnings(block: Column, page: Column, seconds: Column, claimed_block: Column, claimed_page: Column, claimed_seconds: Column) -> Column:
    """Which claims differ from the material that anchors an item; a missing claim does not."""
    far = F.abs(claimed_seconds - seconds) > ANCHOR_SECONDS
    return F.array_compact(F.array(F.when(F.floor(claimed_block) != block, "block"), F.when(F.floor(claimed_page) != page, "page"), F.when(far, "time")))


def tidy_written(raw: Column) -> Column:
    """Text without filler words, doubled marks and lines that describe pictures."""
    text = reduce(lambda s, w: F.replace(s, F.lit(w), F.lit("")), STRIP_WORDS, F.replace(_text(raw), F.lit("\r\n"), F.lit("\n")))

    def squashed(line: Column) -> Column:
        t = F.regexp_replace(F.trim(line), r"[ \t]{2,}", " ")
        t = F.regexp_replace(F.regexp_replace(t, r"^[，、；：\s]+", ""), r"([，、；])\1+", "$1")
        return F.trim(F.regexp_replace(t, "([。！？])[，、；]+", "$1"))

    lines = F.transform(F.split(text, "\n"), squashed)
    def says(line: Column) -> Column:
        # the cleaned line is bound to a name: the rules of noise ask for it some forty times
        return F.exists(F.array(clean_line(line)), lambda c: (c != "") & ~is_noise(c))

    kept = F.filter(lines, lambda t: (t != "") & ~t.rlike(VISION_BEGIN) & says(t))
    return F.array_join(kept, "\n")


def slide_clues(lines: Column) -> Column:
    """The headings of a slide's first lines, each once."""
    tidied = F.filter(F.transform(F.slice(lines, 1, CLUES), clean_line), lambda c: (c != "") & ~is_noise(c))
    return F.array_distinct(tidied)
