"""Personal data in texts: e-mail addresses, IPv4 addresses, payment cards and telephone numbers.

Plain identifiers are found in the text as it stands. Disguised ones go through transducers that keep
offsets: each rewrites the text (look-alike characters, invisible ones, ``(at)`` and ``dot``, digits
written as words, letters that stand for digits) and remembers which stretch of its input each stretch of
its output came from. The same recognisers then read the rewritten text, and what they find is mapped back
through the transducers, last to first, to code points of the source. A task reads its texts in a stream of
small Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import durable, settings, table

KINDS = ("email", "ip", "card", "phone")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
SPAN = "array<struct<kind: string, start: int, end: int, base: boolean, value: string>>"

# --- recognisers; possessive, so that they read each character a bounded number of times

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By their ``@``: the local part is the run before it, which no earlier match has taken."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def recognised(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and without overlaps; matches that fail their check are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if "." in text:
        found["ip"] = [m.span() for m in DOTTED.finditer(text) if m.group(1) and all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGITS.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15]
    return found


# --- transducers


class Tape:
    """A rewritten text with the way back: sorted replacements of stretches of the text it was made of."""

    def __init__(self, source: str, pieces: list[tuple[int, int, str]]):
        out, self.at, self.src, self.end, copied, length = [], [], [], [], 0, 0
        for a, b, to in pieces:
            for lo, hi, new in ((copied, a, None), (a, b, to)):
                text = source[lo:hi] if new is None else new
                if text:  # a stretch deleted leaves no character that could begin or end a span
                    out.append(text)
                    self.at.append(length)
                    self.src.append(lo)
                    self.end.append(-1 if new is None else hi)  # -1: copied character by character
                    length += len(text)
            copied = b
        if copied < len(source):
            out.append(source[copied:])
            self.at.append(length)
            self.src.append(copied)
            self.end.append(-1)
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.src[i] + (start - self.at[i] if self.end[i] < 0 else 0)
        b = self.src[j] + end - self.at[j] if self.end[j] < 0 else self.end[j]
        return a, b


#: Cyrillic and Greek letters that look like a Latin one, and other signs of one shape.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "ɡ": "g", "ı": "i", "。": ".", "｡": ".", "−": "-", "⁺": "+",
}
#: Ranges whose compatibility forms are ASCII signs in another dress: dashes and spaces, letter-like signs, enclosed, small, wide and mathematical forms.
DRESSED = ((0x2000, 0x206F), (0x2100, 0x214F), (0x2460, 0x24FF), (0xFE50, 0xFE6F), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF))
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\ufeff"


def _folding() -> dict[int, str]:
    out = {}
    for lo, hi in DRESSED:
        for c in map(chr, range(lo, hi + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if unicodedata.category(c) in ("Pd", "Zs"):
                plain = "-" if unicodedata.category(c) == "Pd" else " "
            if len(plain) == 1 and " " <= plain <= "~":
                out[ord(c)] = plain
    for n in range(0x80, 0x1FBFA):  # decimal digits of every script
        if unicodedata.category(chr(n)) == "Nd":
            out[n] = str(unicodedata.decimal(chr(n)))
    return out | {ord(a): b for a, b in LOOK_ALIKE.items()} | {0xA0: " "}


FOLDING = _folding()
FOLDED = frozenset(map(chr, FOLDING))
UNSEEN = re.compile(f"[{INVISIBLE}]+")

DOT_WORD = r"(?:dot|punto|punkt|point)"
AT_WORD = r"(?:at|arroba|arobase)"
_OPEN, _SHUT = r"[ \t]{0,3}[(\[{<]{1,2}[ \t]{0,2}", r"[ \t]{0,2}[)\]}>]{1,2}[ \t]{0,3}"
MARKED = re.compile(
    rf"(?i)(?<=[A-Za-z0-9_%+-])(?:(?P<at>&#0{{0,4}}64;|&#x0{{0,4}}40;|&commat;|%40|{_OPEN}(?:{AT_WORD}|@){_SHUT})"
    rf"|(?P<dot>&#0{{0,4}}46;|&#x0{{0,4}}2e;|&period;|%2e|{_OPEN}(?:{DOT_WORD}|\.){_SHUT}))(?=[A-Za-z0-9])"
)
_BARE_DOT = rf"(?:\.|[ \t]{{1,3}}{DOT_WORD}[ \t]{{1,3}})"
BARE = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])(?P<at>[ \t]{{1,3}}{AT_WORD}[ \t]{{1,3}}|[ \t]{{0,3}}@[ \t]{{0,3}})(?P<host>[A-Za-z0-9-]+(?:{_BARE_DOT}[A-Za-z0-9-]+)+)")
BARE_DOT = re.compile(rf"(?i){_BARE_DOT}")
JOINED = re.compile(r"(?i)(?<=[A-Za-z0-9_%+-])[ \t]{1,3}(dot|punto|punkt|point|underscore|dash|hyphen)[ \t]{1,3}(?=[A-Za-z0-9_%+.-]+$)")
IDENTIFIER = re.compile(r"[A-Za-z0-9]+(?:[._%+-][A-Za-z0-9]+)+$|[A-Za-z]+[0-9][A-Za-z0-9]*$")
#: The longest local part of an address.
LOCAL_LENGTH = 64
#: Last labels that make a host of words joined by "dot". Those that are common words of the same language are left out.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro io dev app xyz online site co ai tv cc eu uk de fr es ch nl pl pt se dk fi cz gr ie ca au nz br mx ar cl ru ua cn jp kr hk sg za tr".split()
)


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Replacements that make addresses of words: ``ann dot lee at mail dot example dot com``.

    A bare ``at`` or a spaced ``@`` with a host of literal dots is one only behind something that looks like a name of
    an account (``ann.lee at example.com``), for "at example.com" is plain English.
    """
    pieces, free = [], 0
    for m in BARE.finditer(text):
        dots = list(BARE_DOT.finditer(m["host"]))
        ends = [d.start() for d in dots[1:]] + [len(m["host"])]
        kept = [k for k, (d, e) in enumerate(zip(dots, ends, strict=True)) if m["host"][d.end() : e].lower() in ENDINGS]
        if not kept:
            continue
        dots = [d for d in dots[: kept[-1] + 1] if d.group() != "."]
        if not dots:
            if m["at"] == "@":
                continue
            near = re.search(r"[A-Za-z0-9._%+-]+$", text[max(free, m.start() - LOCAL_LENGTH) : m.start()])
            if not near or not IDENTIFIER.match(near.group()) or not re.search("[A-Za-z]", near.group()):
                continue
        lo = max(free, m.start() - LOCAL_LENGTH)
        left, joins = m.start(), []
        while j := _last_join(text, lo, left):
            joins.append(j)
            left = j[0]
        pieces += reversed(joins)
        pieces.append((*m.span("at"), "@"))
        pieces += [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in dots]
        free = m.end()
    return pieces


def _last_join(text: str, lo: int, hi: int) -> tuple[int, int, str] | None:
    m = None
    for m in JOINED.finditer(text[lo:hi]):  # noqa: B007  the last is wanted
        pass
    if not m:
        return None
    word = m.group(1).lower()
    return lo + m.start(), lo + m.end(), {"underscore": "_", "dash": "-", "hyphen": "-"}.get(word, ".")


#: Digits as words in English, French, German and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
TIMES = {"double": 2, "triple": 3}
_WORD = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
_TOKEN = rf"(?:(?:(?:double|triple)[ \t-]{{1,2}})?(?:{_WORD})(?![^\W_])|[0-9]+)"
_BETWEEN = rf"(?:[ \t]{{1,2}}(?:{DOT_WORD}|dash|hyphen)[ \t]{{1,2}}|[ \t]?[-,/()][ \t]?|[ \t]{{1,2}}|\.)"
#: Three digits as words at least, which a quick search finds before the whole sequence is read.
SPELLED = re.compile(rf"(?i)(?:\bplus[ \t]{{1,2}}|\+[ \t]?)?\b{_TOKEN}(?:{_BETWEEN}{_TOKEN})++")
SPELLED_HINT = re.compile(rf"\b(?:{_WORD})(?:[ \t,-]|[ \t](?:dot|dash|hyphen|point|punto|punkt)[ \t]){{1,3}}(?:double[ \t-]|triple[ \t-])?(?:{_WORD}|[0-9]+)(?![^\W_])")
PARTS = re.compile(rf"(?i)(?P<plus>plus[ \t]{{1,2}}|\+[ \t]?)|(?P<times>double|triple)[ \t-]{{1,2}}|(?P<word>{_WORD})(?![^\W_])|(?P<digits>[0-9]+)|(?P<between>{_BETWEEN})")
LEAST_WORDS, PHONE_WORDS = 3, 9


def _spelled(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Replacements that turn digits as words into digits, and the sequences (spans of the text) that are a number by themselves."""
    pieces, alone = [], []
    for m in SPELLED.finditer(text):
        parts = list(PARTS.finditer(text, m.start(), m.end()))
        words = sum(p.lastgroup == "word" for p in parts)
        if words < LEAST_WORDS:
            continue
        dotted = plus = False
        for i, p in enumerate(parts):
            a, b = p.span()
            if p.lastgroup == "plus":
                plus = True
                pieces.append((a, b, "+"))
            elif p.lastgroup == "word":
                times = TIMES[parts[i - 1]["times"].lower()] if i and parts[i - 1].lastgroup == "times" else 1
                pieces.append((a, b, DIGIT_WORDS[p.group().lower()] * times))
            elif p.lastgroup == "times":
                pieces.append((a, b, ""))
            elif p.lastgroup == "between":
                sides = {parts[i - 1].lastgroup, parts[i + 1].lastgroup} if 0 < i < len(parts) - 1 else set()
                if sides == {"digits"}:
                    continue
                inner = p.group().strip().lower()
                dotted |= (dot := inner == "." or re.fullmatch(DOT_WORD, inner) is not None)
                pieces.append((a, b, "." if dot else ""))
        if words >= PHONE_WORDS and not dotted and not plus:
            alone.append(m.span())
    return pieces, alone


LETTERED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[ .()-]{0,2}[0-9OoIl])++")
LETTERED_HINT = re.compile(r"[0-9][ .()-]{0,2}[OoIl]|[OoIl][0-9]")
AS_DIGITS = str.maketrans("OoIl", "0011")


def _lettered(text: str) -> str:
    """Letters O and l in numbers of seven or more signs, three quarters of which are digits, become digits; no offset moves."""
    out, copied = [], 0
    for m in LETTERED.finditer(text):
        signs = [c for c in m.group() if c.isalnum()]
        digits = sum(c.isdigit() for c in signs)
        if digits < len(signs) >= 7 and 4 * digits >= 3 * len(signs) and not text[m.end() : m.end() + 1].isalnum():
            out += [text[copied : m.start()], m.group().translate(AS_DIGITS)]
            copied = m.end()
    return "".join(out) + text[copied:] if out else text


_MARKED_HINTS = ("(", "[", "{", "<", "&#", "&commat;", "&period;", "%40", "%2e")
_BARE_HINTS = (" at ", "\tat", "at\t", "@", "arroba", "arobase")


def clear_text(text: str) -> tuple[str, list[Tape], list[tuple[int, int]]]:
    """The text without disguises, the tapes that lead back, and numbers in words (spans of the result)."""
    tapes: list[Tape] = []

    def through(now: str, pieces: list[tuple[int, int, str]]) -> str:
        if pieces:
            tapes.append(Tape(now, pieces))
            return tapes[-1].text
        return now

    now, alone = text, []
    if not now.isascii():
        signs = set(now)
        if not signs.isdisjoint(INVISIBLE):
            now = through(now, [(*m.span(), "") for m in UNSEEN.finditer(now)])
        if not signs.isdisjoint(FOLDED):
            now = now.translate(FOLDING)
    lower = now.lower()
    if any(h in lower for h in _MARKED_HINTS):
        now = through(now, [(*m.span(), "@" if m["at"] else ".") for m in MARKED.finditer(now)])
        lower = now.lower()
    if any(h in lower for h in _BARE_HINTS):
        now = through(now, _addresses(now))
        lower = now.lower()
    if SPELLED_HINT.search(lower):
        pieces, runs = _spelled(now)
        before = now
        now = through(now, pieces)
        if now is not before:
            shift, k, moved = 0, 0, []
            for a, b in runs:
                while k < len(pieces) and pieces[k][0] < a:
                    shift += len(pieces[k][2]) - (pieces[k][1] - pieces[k][0])
                    k += 1
                start = a + shift
                while k < len(pieces) and pieces[k][1] <= b:
                    shift += len(pieces[k][2]) - (pieces[k][1] - pieces[k][0])
                    k += 1
                moved.append((start, b + shift))
            alone = moved
    if LETTERED_HINT.search(now):
        now = _lettered(now)
    return now, tapes, alone


def private_spans(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, found as it stands, identifier without disguise), by kind, start and end."""
    base = recognised(text)
    out = {k: [(a, b, True, text[a:b]) for a, b in spans] for k, spans in base.items()}
    clear, tapes, alone = clear_text(text)
    if clear != text:
        seen = recognised(clear)
        cards = seen["card"]
        numbers = [(a, b) for a, b in alone if 9 <= b - a <= 15 and not any(c < b and a < d for c, d in cards)]
        seen["phone"] = sorted({*seen["phone"], *numbers})
        for kind, spans in seen.items():
            starts = [a for a, _ in base[kind]]
            for a, b in spans:
                value = clear[a:b]
                for tape in reversed(tapes):
                    a, b = tape.back(a, b)
                i = bisect_right(starts, a) - 1
                if value != text[a:b] and not (i >= 0 and b <= base[kind][i][1]):
                    out[kind].append((a, b, False, value))
    return [(kind, *s) for kind in KINDS for s in sorted(set(out[kind]), key=lambda s: (s[0], s[1], not s[2]))]


def redacted_text(text: str, spans: list[tuple[str, int, int, bool, str]]) -> str:
    """The text with every span replaced by its kind's mark; of spans that overlap, one mark of the first to begin stands for all."""
    out, copied = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= copied:
            out += [text[copied:a], MARKS[kind]]
        copied = max(copied, b)
    return "".join(out) + text[copied:]


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per input row: id, ``spans`` (kind, start, end, base, value) and, with ``redact``, the text with marks in their place.

    Offsets are code points, ends exclusive; ``base`` tells spans found in the text as it stands from those that
    only show when disguises are undone, and ``value`` is the identifier without disguise. A null text counts as
    empty and has no spans. Repeated rows and null ids give rows like any other; an empty table gives none; texts
    are read whole, in time linear in their length. Other columns are ignored.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())])
        for batch in batches:
            spans, texts = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = private_spans(text)
                spans.append([{"kind": k, "start": a, "end": b, "base": base, "value": v} for k, a, b, base, v in found])
                if redact:
                    texts.append(redacted_text(text, found))
            columns, names = [batch.column(0), pa.array(spans, pa.list_(kind))], ["id", "spans"]
            if redact:
                columns.append(pa.array(texts, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    given = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {dict(given.dtypes)['id']}, spans {SPAN}" + ", text string" * redact
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000", spark__sql__execution__arrow__maxBytesPerBatch=str(8 << 20)):
        out = durable(given.mapInArrow(run, schema), "private")
    out = out.withColumnRenamed("id", id_col)
    return out.withColumnRenamed("text", text_col) if redact else out


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(_of_kind(base, k)).cast("long").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"), added)


QUERIES = {"op11_pii": op11_pii}
ORACLE: dict = {}
