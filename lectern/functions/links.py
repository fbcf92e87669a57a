"""Inline links of notes with their offsets, and why a link that looks like one of ours can't be followed.

A scanner reads a text once for each kind. It looks at each ``](``: the label begins at the first open bracket since the last closing one (or
since the link before), for a label holds no closing bracket; the target ends at white space or a closing parenthesis. Stops
are remembered, so that a text of nothing but brackets still takes linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

# Schemes, and white space as links see it.
SECTION, ASSET = "zy://section/", "zy-asset://"
BLANK = "\t\n\x0b\x0c\r    -     　﻿"
UNSUPPORTED, EMPTY, SHAPE, BAD_SECTION, BAD_ASSET = "UNSUPPORTED_SCHEME", "EMPTY_TARGET", "BAD_SCHEME_SHAPE", "BAD_SECTION_LINK", "BAD_ASSET_LINK"
LARGEST_INT = (1 << 53) - 1

_CLOSE = re.compile(rf"\]\([{BLANK}]*")
_END = re.compile(rf"[{BLANK}]*\)")
_TARGET_END = re.compile(rf"[){BLANK}]|$")
_BARE = re.compile(rf"{SECTION}[^{BLANK})]+"), re.compile(rf"{ASSET}[^{BLANK})]+")
_ADDRESS = re.compile(r"zy://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.IGNORECASE)
_NUMBER = re.compile(r"[ ]*([+-]?)(?:0[xX]([0-9a-fA-F]+)|([0-9]+))[ ]*")

LINK = (
    StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("href", StringType()).add("label", StringType()).add("image", BooleanType()).add("bare", BooleanType())
    .add("course", StringType()).add("section", StringType()).add("page", LongType()).add("at_sec", LongType()).add("asset", StringType()).add("code", StringType())
)


def _part(raw: str) -> str:
    """A piece of an address without its percent signs; one that can't be read stays as it is."""
    try:
        return unquote(raw, errors="strict") if not re.search("%(?![0-9a-fA-F]{2})", raw) else raw
    except UnicodeDecodeError:
        return raw


def _number(raw: str) -> int | None:
    m = _NUMBER.fullmatch(raw)
    if not m:
        return None
    digits = (m[2] or m[3]).lstrip("0") or "0"
    n = (int(digits, 16) if m[2] else int(digits)) if len(digits) < 20 else LARGEST_INT + 1
    return None if n > LARGEST_INT else -n if m[1] == "-" else n


def section_address(raw: str) -> dict | None:
    """course, section, page and at_sec of ``zy://section/course/section?page=..&t=..``; of repeated fields the last counts."""
    m = _ADDRESS.match(raw.strip())
    if not m or m[1].lower() != "section":
        return None
    parts = [p for p in m[2].split("/") if p]
    if len(parts) < 2:
        return None
    fields = dict(p.partition("=")[::2] for p in (m[3] or "").split("&"))
    page, at = (_number(_part(fields.get(k, "").replace("+", " "))) for k in ("page", "t"))
    return {"course": _part(parts[0]), "section": _part(parts[1]), "page": page, "at_sec": at}


def _entry(kind: str, start: int, end: int, href: str, label: str | None = None, image: bool = False, code: str | None = None) -> dict:
    out = dict.fromkeys(LINK.names) | {"kind": kind, "start": start, "end": end, "href": href, "label": label, "image": image, "bare": label is None, "code": code}
    if kind == "section":
        out |= section_address(href) or {"code": BAD_SECTION}
    elif kind == "asset":
        out |= {"asset": href[len(ASSET) :]} if len(href) > len(ASSET) else {"asset": "", "code": BAD_ASSET}
    return out


def _shapes(text: str, wanted: Callable[[str, bool], bool]) -> Iterator[tuple[int, int, int, int, str]]:
    """(first open bracket, first one behind an exclamation mark or -1, close, end, target) of every ``[label](target)`` that is wanted.

    Others take no room: a wanted one may begin inside them. ``wanted``: by target, and whether there is an exclamation mark.
    """
    free = stop = 0
    close = text.find("](")
    last = -1  # the closing bracket before
    while close >= 0:
        last = max(last, text.rfind("]", max(free, last + 1), close))
        lo = max(free, last + 1)
        opened = text.find("[", lo, close)
        at = _CLOSE.match(text, close).end()
        end = None
        if opened >= 0:
            if stop < at:
                stop = _TARGET_END.search(text, at).start()
            end = _END.match(text, stop)
        pictured = text.find("![", max(lo - 1, free), close) if end else -1
        if end and wanted(text[at:stop], pictured >= 0):
            yield opened, pictured, close, end.end(), text[at:stop]
            free = end.end()
            close = text.find("](", free)
        else:
            last = close
            close = text.find("](", close + 1)


def inline_links(text: str) -> list[dict]:
    """Every link in order of its place. Kinds: section, asset, other; ``bare`` ones stand without a label.

    Codes: BAD_SECTION_LINK, BAD_ASSET_LINK for ours that lack a part; EMPTY_TARGET, BAD_SCHEME_SHAPE, UNSUPPORTED_SCHEME for others.
    """
    ours, others = [], []
    for opened, _, close, end, target in _shapes(text, lambda t, _: t.lower().startswith(SECTION)):
        ours.append(_entry("section", opened, end, target, text[opened + 1 : close]))
    for _, pictured, close, end, target in _shapes(text, lambda t, p: p and t.lower().startswith(ASSET)):
        ours.append(_entry("asset", pictured, end, target, text[pictured + 2 : close], True))
    for opened, _, close, end, target in _shapes(text, lambda t, _: True):
        image = opened > 0 and text[opened - 1] == "!"
        code = EMPTY if target == "" else SHAPE if re.match("z[ya]-|zy:", target) else UNSUPPORTED
        others.append(_entry("other", opened - image, end, target, text[opened + 1 : close], image, code))
    for kind, pattern in zip(("section", "asset"), _BARE, strict=True):
        taken = [(e["start"], e["end"]) for e in ours if e["kind"] == kind and not e["bare"]]
        k = 0
        for m in pattern.finditer(text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or m.start() < taken[k][0]:
                ours.append(_entry(kind, *m.span(), m.group()))
    ours.sort(key=lambda e: (e["start"], e["end"]))
    kept, k, far = [], 0, -1
    for e in others:  # a shape that overlaps one of ours is part of it
        while k < len(ours) and ours[k]["start"] < e["end"]:
            far = max(far, ours[k]["end"])
            k += 1
        if far <= e["start"]:
            kept.append(e)
    return sorted(ours + kept, key=lambda e: (e["start"], e["end"]))


def links_udf():
    """The scanner as a column function of a text, by Arrow batches."""
    from pyspark.sql import functions as F

    @F.pandas_udf(ArrayType(LINK))
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: inline_links(t) if t else [])

    return scan
