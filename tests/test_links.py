"""The link scanner against patterns read literally, and on stated notes."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from lectern.functions import links

B = links.BLANK
SECTION = re.compile(rf"\[([^\]]*)\]\([{B}]*(zy://section/[^){B}]*)[{B}]*\)", re.I)
ASSET = re.compile(rf"!\[([^\]]*)\]\([{B}]*(zy-asset://[^){B}]*)[{B}]*\)", re.I)
OTHER = re.compile(rf"(!?)\[([^\]]*)\]\([{B}]*([^){B}]*)[{B}]*\)")
BARE = {"section": re.compile(rf"zy://section/[^{B})]+"), "asset": re.compile(rf"zy-asset://[^{B})]+")}


def brute(text):
    ours = [("section", *m.span(), m[2]) for m in SECTION.finditer(text)] + [("asset", *m.span(), m[2]) for m in ASSET.finditer(text)]
    for kind, pattern in BARE.items():
        found = [o for o in ours if o[0] == kind]
        ours += [(kind, *m.span(), m.group()) for m in pattern.finditer(text) if not any(s <= m.start() < e for _, s, e, _ in found)]
    more = [("other", *m.span(), m[3]) for m in OTHER.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e, _ in ours)]
    return sorted(ours + more, key=lambda o: (o[1], o[2]))


def seen(text):
    return [(e["kind"], e["start"], e["end"], e["href"]) for e in links.inline_links(text)]


def test_against_patterns():
    rng = random.Random(3)
    parts = ["[", "]", "(", ")", "!", "](", "![", "a", " ", "é😀", "\n", "zy://section/1/2", "zy://section/", "ZY://Section/3/4?t=5", "zy-asset://", "zy-asset://i", "zy-ink:", "http://x", "[l](zy://section/1/2)", "![p](zy-asset://q)", "[l]( )", "[o](/p)"]
    for _ in range(30000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert seen(text) == brute(text), text


def test_stated():
    text = "见 [03:21](zy://section/1/2?t=201) 与 [第 14 页](zy://section/1/2?page=14)，图 ![插图](zy-asset://img1)。"
    a, b, c = links.inline_links(text)
    assert (a["kind"], a["course"], a["section"], a["at_sec"], a["page"], a["label"], a["code"]) == ("section", "1", "2", 201, None, "03:21", None)
    assert (b["page"], c["kind"], c["asset"], c["label"], c["image"]) == (14, "asset", "img1", "插图", True)
    assert text[a["start"] : a["end"]] == "[03:21](zy://section/1/2?t=201)"
    codes = [(e["kind"], e["code"], e["at_sec"]) for e in links.inline_links("[x](zy://section/1)\n[y](zy://section//2)\n[z](zy://section/1/2?t=abc)\n![e](zy-asset://)\n[o](https://e.com) [p]() ![q](zy-ink://1) [r](zy:x)")]
    assert codes == [("section", "BAD_SECTION_LINK", None)] * 2 + [("section", None, None), ("asset", "BAD_ASSET_LINK", None), ("other", "UNSUPPORTED_SCHEME", None), ("other", "EMPTY_TARGET", None), ("other", "BAD_SCHEME_SHAPE", None), ("other", "BAD_SCHEME_SHAPE", None)]
    assert links.section_address("zy://SECTION/a%20b/c%/?t=1&page=0x10&t=+2#f") == {"course": "a b", "section": "c%", "page": 16, "at_sec": 2}
    assert links.section_address("/courses/1") is None and links.section_address("zy://asset/1/2") is None and links.inline_links("") == []


def test_linear():
    began = time.time()
    for unit in ("[", "]", "](", "[](", "[a](b", "![", "[](a[]", "](a ", "[a](zy://section/1/2)", "zy://section/1", "(", "[x](zy-asset://", "]( "):
        links.inline_links(unit * 60_000)
    assert time.time() - began < 40


def test_column(spark):
    df = spark.createDataFrame([(1, "😀 [a](zy://section/1/2?t=3)"), (2, None), (3, "")], "i int, t string").select("i", links.links_udf()(F.col("t")).alias("x"))
    assert [(r.i, [(e.start, e.end, e.at_sec) for e in r.x]) for r in df.orderBy("i").collect()] == [(1, [(2, 27, 3)]), (2, []), (3, [])]
