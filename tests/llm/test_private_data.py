"""Personal data against the plain patterns, and disguised identifiers against the places where they were put."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.llm import private_data as pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def checksum(d):
    odd, even = [int(c) for c in d[::-1][0::2]], [int(c) for c in d[::-1][1::2]]
    return (sum(odd) + sum(sum(divmod(2 * n, 10)) for n in even)) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and checksum(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [s[:3] for s in pii.private_spans(text) if s[3]]


def added(text):
    return [(k, text[a:b], v) for k, a, b, b0, v in pii.private_spans(text) if not b0]


def test_base_is_the_plain_patterns():
    rng = random.Random(5)
    parts = ["a", "Z9", ".", "@", "-", "+", "_", " ", "1", "25", "255", "256", "0001", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713", "x@y.z", "10.0.0.1", "é", "𝟙", "(", ")", "\n", "%", "0", "٣", "at", "dot", "one two three"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        assert base(text) == brute(text), text
    for text in ("a@b.c_d@e.f", "a@b.c..d", "1.2.3.4.5.6.7.8", "1.2.3.4.", "999.1.1.1.1", "+1234567", "+123456789", "++12345678901", "a@@b.c", "@b.c", "a@b", "4111 1111  1111 1111"):
        assert base(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to ann (at) mail (dot) example (dot) com today", [("email", "ann (at) mail (dot) example (dot) com", "ann@mail.example.com")]),
        ("write to ann.lee[at]mail[dot]com, or", [("email", "ann.lee[at]mail[dot]com", "ann.lee@mail.com")]),
        ("mail ann dot lee at example dot org. Then", [("email", "ann dot lee at example dot org", "ann.lee@example.org")]),
        ("mail ann_7 AT example.com. Then", [("email", "ann_7 AT example.com", "ann_7@example.com")]),
        ("joe&#64;mail&#46;example.com", [("email", "joe&#64;mail&#46;example.com", "joe@mail.example.com")]),
        ("q=joe%40mail.com&x", [("email", "joe%40mail.com", "joe@mail.com")]),
        ("joe arroba correo punto es", [("email", "joe arroba correo punto es", "joe@correo.es")]),
        ("joe@mail dot example dot com", [("email", "joe@mail dot example dot com", "joe@mail.example.com")]),
        ("jое@mail.example.com", [("email", "jое@mail.example.com", "joe@mail.example.com")]),  # Cyrillic о and е
        ("joe＠mail．example．com", [("email", "joe＠mail．example．com", "joe@mail.example.com")]),
        ("j\u200boe@ma\u00adil.com", [("email", "j\u200boe@ma\u00adil.com", "joe@mail.com")]),
        ("ip １９２.168.0.１ ok", [("ip", "１９２.168.0.１", "192.168.0.1")]),
        ("host one nine two dot one six eight dot one dot two five up", [("ip", "one nine two dot one six eight dot one dot two five", "192.168.1.25")]),
        ("call plus one four one five five five five oh one nine nine now", [("phone", "plus one four one five five five five oh one nine nine", "+14155550199")]),
        ("call four one five, five five five, oh one double nine now", [("phone", "four one five, five five five, oh one double nine", "4155550199")]),
        ("+1 (4l5) 555-O199", [("phone", "+1 (4l5) 555-O199", "+1 (415) 555-0199")]),
        ("card 4111\u00a01111\u00a01111\u00a01111.", [("card", "4111\u00a01111\u00a01111\u00a01111", "4111 1111 1111 1111")]),
        ("four one one one " + "one " * 11 + "one.", [("card", "four one one one " + "one " * 11 + "one", "4" + "1" * 15)]),
        ("٤١١١ ١١١١ ١١١١ ١١١١", [("card", "٤١١١ ١١١١ ١١١١ ١١١١", "4111 1111 1111 1111")]),
        ("ann <at> example <dot> com und null eins sieben", [("email", "ann <at> example <dot> com", "ann@example.com")]),
    ],
)
def test_disguises(text, want):
    assert added(text) == want


@pytest.mark.parametrize(
    "text",
    [
        "", "Look at the dot in the corner.", "We met at example.com offices, e.g. at example.com or at version 2.0 at example.com.", "one two three four five six seven", "She arrived (at) last. On time",
        "Page one of two, three or four; 2019–2023 and 5 – 7", "l'été, où à l'œuvre; Größe und Maße", "Привет, мир. Это почта@пример.рф", "call at noon dot", "Il faut un point de vue (point) et un autre", "f(at) = g[dot]",
        "version 1.2.3 and 10 O'Clock", "IO 1O10 lO", "joe at the company", "lunch @ cafe.com", "the numbers 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11",
    ],
)
def test_clean_texts_stay(text):
    assert pii.private_spans(text) == []


def test_disguised_spans_map_back_to_their_place():
    rng = random.Random(9)
    digits = "zero one two three four five six seven eight nine".split()
    filler = ["é", "…", "the ", "a (b) ", "im Haus. ", "\n", "😀", "\u200b", "three ", "Σ "]
    for _ in range(1500):
        kind = rng.choice(["email", "phone", "ip"])
        if kind == "email":
            value = f"u{rng.randrange(100)}.{rng.choice(['ann', 'bo'])}@mail{rng.randrange(9)}.example.com"
            at, dot = rng.choice([("(at)", "(dot)"), (" at ", " dot "), ("[AT]", " [dot] "), ("＠", "．"), (" {at} ", ".")])
            seen = value.replace(".", dot).replace("@", at)
        elif kind == "phone":
            value = "+" + "".join(rng.choice("123456789") for _ in range(11))
            seen = rng.choice([value.translate({48 + i: chr(0xFF10 + i) for i in range(10)}), "plus " + " ".join(digits[int(c)] for c in value[1:])])
        else:
            value = ".".join(str(rng.randrange(256)) for _ in range(4))
            seen = " dot ".join(" ".join(digits[int(c)] for c in p) for p in value.split("."))
            if rng.random() < 0.4:
                seen = value.translate({48 + i: chr(0x1D7CE + i) for i in range(10)})
        before, after = "".join(rng.choice(filler) for _ in range(rng.randrange(8))) + "; ", " ; " + "".join(rng.choice(filler) for _ in range(rng.randrange(8)))
        text = before + seen + after
        assert (kind, len(before), len(before) + len(seen), False, value) in pii.private_spans(text), text


def test_time_is_linear():
    began = time.time()
    for unit in ("a", "1", "1.", "a@", "+1", "1 ", "(at)", " at a dot", "one ", "O1 ", "+1(", "@a.", "éа", "<[", "dot dot ", "a-"):
        pii.private_spans(unit * 100_000)
    assert time.time() - began < 60


def test_operator(spark, tmp_path):
    rows = [(1, "mail a@b.cd and 10.0.0.1"), (2, None), (3, ""), (1, "mail a@b.cd and 10.0.0.1"), (None, "ann (at) b (dot) com"), (5, "😀 a@b.cd"), (6, "x " * 200_000 + "+1 (017) 555-7713")]
    docs = spark.createDataFrame([(i, t, "k", 1, [2]) for i, t in rows], "doc_id long, text string, kind string, start int, spans array<int>").repartition(3)
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans], r.text) for r in pii.find_private(docs, redact=True).collect()), key=str)
    want = [(i, [s[:4] for s in pii.private_spans(t or "")], pii.redacted_text(t or "", pii.private_spans(t or ""))) for i, t in rows]
    assert got == sorted(want, key=str)
    assert [g[2] for g in got if g[0] == 1] == ["mail [EMAIL] and [IP]"] * 2 and [g[2] for g in got if g[0] is None] == ["[EMAIL]"]
    assert [g[1] for g in got if g[0] == 5] == [[("email", 2, 8, True)]]
    assert pii.find_private(docs.limit(0)).count() == 0
    path = str(tmp_path)
    docs.drop("spans").write.parquet(f"{path}/documents.parquet")
    out = pii.op11_pii(spark, path)
    assert out.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert [t for _, t in out.dtypes[1:5]] == ["bigint"] * 4
    for r in out.filter(F.col("doc_id").isNotNull()).collect():
        spans = brute(dict(rows)[r.doc_id] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.base_sha256, r.spans) == (hashlib.sha256(text.encode()).hexdigest(), text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]


def test_whole_table_against_plain_patterns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op11_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert sum(r.n_added for r in rows) == 0  # no disguises there
