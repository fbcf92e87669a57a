"""What a line of slide text is: noise, notation, a diagram's note, a window's frame, a title or none of these.

Lines come from pictures of slides, cleaned by ``clean_line``. Each rule is a pattern or a word list, given once
as a fixed value; Spark expressions and the DuckDB texts of the queries are both built from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words of slide pictures, and limits in characters.
FENCE = "```"
TABLE_RULE = r"^\|?[\s\-:|]+\|?$"
PLACE_WORDS = (
    "右上角", "左上角", "右下角", "左下角", "中上", "中下", "中部", "中央", "页面中央", "页面顶部", "页面底部", "顶部", "底部", "左侧", "右侧", "幻灯片",
    "页眉", "页脚", "标题", "小标题", "标题栏", "标题行", "窗口", "屏幕", "方框", "矩形框", "框内", "正文区", "树状图", "示意图", "文字", "内容", "页码",
)
CLEAN_STEPS = (
    (r"\*\*|__|`|~~", ""),
    (r"(^|\s)[*_](\S)", "$1$2"),
    (r"(^|\s)[*_]+", "$1"),
    (r"[*_]+(\s|$)", "$1"),
    (r"^(?:(?:" + "|".join(PLACE_WORDS) + r")\s*(?:[（(][^）)]{0,60}[）)])?\s*){1,3}[：:]\s*", ""),
    (r"^[☞✂·•▪◦●○◆◇■□★☆→>\-–—+*]+\s*", ""),
    (r"^[0-9]+[.)、]\s*", ""),
    (r"[ \t　]+", " "),
    (r"^\s+|\s+$", ""),
    (r"\.{3,}|…+", "……"),
)
CLEAN_ROUNDS = 8
#: What a step could change: a trimmed line without any of it stays as it is, and most lines of prose have none.
CLEANABLE = r"[*_`\t　…：:]|~~|  |\.{3}|^[☞✂·•▪◦●○◆◇■□★☆→>\-–—+]|^[0-9]+[.)、]"
FORMULAS = (r"^\$\$[^$]*\$\$$", r"^\$[^$]*\$$")
INLINE_FORMULA = r"\$[^$]{0,80}\$"
#: A literal bracket followed by this very text, as the rule has it.
BRACKET_QUIRK = r"\[a-zA-Z\]+"
NOTATION_CHARACTERS = r"^[\sA-Za-z0-9_^{}().,\-+=<>/|*…]*\$?$"
TWO_LETTERS = "[A-Za-z]{2,}"
DIAGRAM_NOTES = (
    "(椭圆|方框|矩形|矩形框|箭头|连线|圆圈|曲线|虚线|树状图|示意图)[^：:]{0,12}[：:]",
    "^(根|叶|父|子|中间)?节点[^。]{0,20}(内文字|标注|上方|下方)",
    "^(从|由)[^。]{0,20}(引出|连出|指向)",
    "^(旋转指示|颜色说明|图例|示意图|树状图|左侧|右侧|上方|下方)[：:]",
    "^(蓝色|红色|绿色|黄色|橙色|黑色|灰色|紫色)(粗|细)?(箭头|文字|线条|圆圈|框|曲线|虚线)",
)
PAGE_NUMBER = r"^[0-9\s/\-–—.]+$"
CLOCK = r"^[0-9]{1,2}\s*[:：]\s*[0-9]{2}(\s*[:：]\s*[0-9]{2})?$"
DATE = r"^[0-9]{4}\s*[-/年]\s*[0-9]{1,2}\s*[-/月]\s*[0-9]{1,2}\s*日?$"
NOTHING_BEGINS, NOTHING_SAYS = r"^[（(\[【]?(无|空|整页|这一页)", "(无可见文字|无任何可见文字|无|空|纯黑)"
SHELL_WORDS = (
    "窗口标题栏", "标题栏", "菜单栏", "工具栏", "功能区", "选项卡", "任务栏", "状态栏", "标签栏", "地址栏", "书签栏", "通知栏", "开始菜单", "系统托盘",
    "任务视图", "桌面壁纸", "桌面图标", "鼠标指针", "鼠标光标", "登录", "共享", "PowerPoint", "Excel", "Word", "浏览器", "正在关机", "温馨提示",
    ".ppt", ".pptx", ".xlsx", ".docx", ".doc", ".pdf",
)
WEAK_SHELL_WORDS, WEAK_LIMIT = ("登录", "共享", "选项卡", "工具栏", "标题栏", "状态栏", "地址栏", "窗口"), 20
LAYOUT_WORDS = ("右上角", "左上角", "右下角", "左下角", "中上", "中下", "幻灯片", "页面", "窗口", "屏幕", "方框", "矩形框", "框内", "正文区")
ENDS_WITH_COLON = r"[：:]\s*$"
APP_WORDS = (
    "Excel", "PowerPoint", "Word", "Acrobat", "WPS", "Chrome", "Edge", "Firefox", "浏览器", "微信", "钉钉", "腾讯会议", "Zoom", "Teams", "资源管理器", "记事本",
    "画图", "设置", "正在关机", "窗口标题栏", "标题栏", "标签栏", "地址栏", "书签栏", "菜单栏", "工具栏", "功能区", "状态栏", "任务栏", "窗口控制按钮",
    "右键快捷菜单", "兼容模式", ".ppt", ".pptx", ".xlsx", ".docx", ".doc", ".pdf",
)
CODE_BEGIN = r"^(while|if|for|return|Get|Insert|Write)\b"
CUT_OFF_CHINESE = r"[的了和与或但而是就在有都也还把被对从]\s*$"
CUT_OFF_ENGLISH = r"(?i)\b(and|or|but|the|of|to|in|is|are|that|which|with|for)\s*$"
SENTENCE_END, WIDE_COLON_END = r"[。！？；]\s*$", r"：\s*$"
TITLE_BEGIN = r"(?i)^(Solution|Discussion|Definition|Example|Theorem|Proof|Lemma|Exercise|Problem|Algorithm|Chapter|Part)\b"
TITLE_LIMIT, SHORT_LINE = 90, 30
DIVIDERS = (r"(?i)^(Chapter|Part)\s+[0-9]+", r"^第\s*[0-9]+\s*[章节讲部]", r"^第\s*[一二三四五六七八九十百零]+\s*[章节讲部]")


def _any(line: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [line.rlike(p) for p in patterns])


def _holds(line: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [line.contains(w) for w in words])


def clean_line(raw: Column) -> Column:
    """The line without markers, places, bullets and list numbers, until nothing changes (eight rounds at most)."""

    def once(s: Column) -> Column:
        for pattern, to in CLEAN_STEPS:
            s = F.regexp_replace(s, pattern, to)
        return s

    def cleaned(trimmed: Column) -> Column:
        # a fold over the rounds keeps the plan small; a round that finds the text as it was before does nothing
        start = F.struct(trimmed.alias("s"), F.lit(None).cast("string").alias("before"))
        rounds = F.aggregate(
            F.array_repeat(F.lit(0), CLEAN_ROUNDS), start, lambda acc, _: F.when(acc["s"].eqNullSafe(acc["before"]), acc).otherwise(F.struct(once(acc["s"]).alias("s"), acc["s"].alias("before")))
        )
        return F.when(trimmed.startswith(FENCE) | trimmed.rlike(TABLE_RULE), F.lit("")).when(~trimmed.rlike(CLEANABLE), trimmed).otherwise(rounds["s"])

    return F.transform(F.array(F.regexp_replace(raw, r"^\s+|\s+$", "")), cleaned)[0]


def notation_only(line: Column) -> Column:
    """A formula or single symbols and no word."""
    t = F.trim(line)
    rest = F.regexp_replace(F.regexp_replace(t, INLINE_FORMULA, ""), BRACKET_QUIRK, "")
    return (t == "") | _any(t, FORMULAS) | (rest.rlike(NOTATION_CHARACTERS) & ~rest.rlike(TWO_LETTERS))


def diagram_note(line: Column) -> Column:
    return _any(F.trim(line), DIAGRAM_NOTES)


def app_window(first_line: Column) -> Column:
    """Whether a page that begins with this line is a picture of another program's window."""
    return F.coalesce(_holds(F.trim(first_line), APP_WORDS), F.lit(False))


def is_noise(line: Column) -> Column:
    t = F.trim(line)
    strong = tuple(w for w in SHELL_WORDS if w not in WEAK_SHELL_WORDS)
    weak = tuple(w for w in SHELL_WORDS if w in WEAK_SHELL_WORDS)
    return (
        (F.length(t) <= 1) | notation_only(t) | diagram_note(t) | _any(t, (PAGE_NUMBER, CLOCK, DATE)) | (t.rlike(NOTHING_BEGINS) & t.rlike(NOTHING_SAYS))
        | _holds(t, strong) | ((F.length(t) <= WEAK_LIMIT) & _holds(t, weak)) | (t.rlike(ENDS_WITH_COLON) & _holds(t, LAYOUT_WORDS))
    )


def tidy_heading(raw: Column) -> Column:
    """The cleaned line, empty where it is noise."""
    s = clean_line(raw)
    return F.transform(F.array(s), lambda c: F.when(is_noise(c), F.lit("")).otherwise(c))[0]


def rejected_as_title(line: Column) -> Column:
    return (
        line.contains("|") | notation_only(line) | diagram_note(line)
        | _any(line, (CODE_BEGIN, CUT_OFF_CHINESE, CUT_OFF_ENGLISH, SENTENCE_END, WIDE_COLON_END)) | (F.length(line) > TITLE_LIMIT)
    )


def title_evidence(line: Column, pages: Column, others: Column, short_others: Column) -> Column:
    """On several pages, or begun like a title, or the only short one among the ``others`` of its page."""
    return (pages >= 2) | line.rlike(TITLE_BEGIN) | ((F.length(line) <= SHORT_LINE) & ((others == 0) | (short_others == 0)))


def looks_like_divider(title: Column) -> Column:
    return _any(F.trim(title), DIVIDERS)


# the same rules as DuckDB texts ------------------------------------------------------------------


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_any(col: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {_quoted(p)})" for p in patterns) + ")"


def _sql_holds(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_quoted(w)})" for w in words) + ")"


def clean_line_sql(col: str) -> str:
    trimmed = rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"
    out = trimmed
    for _ in range(CLEAN_ROUNDS):
        for pattern, to in CLEAN_STEPS:
            out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return f"CASE WHEN starts_with({trimmed}, '{FENCE}') OR regexp_matches({trimmed}, {_quoted(TABLE_RULE)}) THEN '' ELSE {out} END"


def notation_only_sql(col: str) -> str:
    rest = f"regexp_replace(regexp_replace(trim({col}), {_quoted(INLINE_FORMULA)}, '', 'g'), {_quoted(BRACKET_QUIRK)}, '', 'g')"
    return f"(trim({col}) = '' OR {_sql_any(f'trim({col})', FORMULAS)} OR (regexp_matches({rest}, {_quoted(NOTATION_CHARACTERS)}) AND NOT regexp_matches({rest}, {_quoted(TWO_LETTERS)})))"


def is_noise_sql(col: str) -> str:
    t = f"trim({col})"
    strong = tuple(w for w in SHELL_WORDS if w not in WEAK_SHELL_WORDS)
    weak = tuple(w for w in SHELL_WORDS if w in WEAK_SHELL_WORDS)
    return (
        f"(length({t}) <= 1 OR {notation_only_sql(col)} OR {_sql_any(t, DIAGRAM_NOTES)} OR {_sql_any(t, (PAGE_NUMBER, CLOCK, DATE))}"
        f" OR (regexp_matches({t}, {_quoted(NOTHING_BEGINS)}) AND regexp_matches({t}, {_quoted(NOTHING_SAYS)})) OR {_sql_holds(t, strong)}"
        f" OR (length({t}) <= {WEAK_LIMIT} AND {_sql_holds(t, weak)}) OR (regexp_matches({t}, {_quoted(ENDS_WITH_COLON)}) AND {_sql_holds(t, LAYOUT_WORDS)}))"
    )


def rejected_as_title_sql(col: str) -> str:
    ends = (CODE_BEGIN, CUT_OFF_CHINESE, CUT_OFF_ENGLISH, SENTENCE_END, WIDE_COLON_END)
    return f"(contains({col}, '|') OR {notation_only_sql(col)} OR {_sql_any(f'trim({col})', DIAGRAM_NOTES)} OR {_sql_any(col, ends)} OR length({col}) > {TITLE_LIMIT})"


def app_window_sql(col: str) -> str:
    return f"coalesce({_sql_holds(f'trim({col})', APP_WORDS)}, false)"


def looks_like_divider_sql(col: str) -> str:
    return _sql_any(f"trim({col})", DIVIDERS)
