"""Collocations against counting by hand, with few and many counter bits."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lectern.llm import collocations as col
from lectern.llm.collocations import BLOCK, Cells, add_cells, collocations

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and 2 * b >= a and p in (q[:2], q[1:]) for q, b in counts.items() if b >= least):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 4))) for _ in range(40)] + ["the", "The", "of"] * 4
    fixed = [["new", "york", "city"], ["as", "well", "as"], ["aa", "aa"], ["q", "q", "q", "q"]]
    rows = []
    for _ in range(150):
        out = []
        for _ in range(rng.randrange(0, 60)):
            out += rng.choice(fixed) if rng.random() < 0.15 else [rng.choice(words)]
            out.append(rng.choice(["", "", "", "", ".", ",", "\n", " ;", "\t", "  ", "!", "\x0b", "\r\n"]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), " ".join(out)))
    return [*rows, ("en", None), ("fr", ""), (None, None), ("en", rows[0][1]), ("en", rows[0][1]), ("de", "lone " * 30), ("en", "... ,, \n")]


@pytest.mark.parametrize(("bits", "least", "top"), [(26, 10, 2000), (4, 3, 7), (10, 10, 2000)])
def test_against_counting(spark, bits, least, top):
    rows = rows_of(bits)
    docs = spark.createDataFrame([(t, la, 1, "x", 2) for la, t in rows], "text string, lang string, n int, phrase string, block int").repartition(5)
    got = sorted(tuple(r) for r in collocations(docs, least=least, top=top, bits=bits).collect())
    assert got == brute(rows, least, top)


def test_sql():
    rows = rows_of(5)
    con = duckdb.connect()
    con.register("documents", col.pa.table({"lang": col.pa.array([la for la, _ in rows], col.pa.string()), "text": col.pa.array([t for _, t in rows], col.pa.string())}))
    assert sorted(con.execute(col.SQL).fetchall()) == brute(rows)


def test_small_memory_gives_the_same(spark, monkeypatch):
    rows = rows_of(3)
    for name, value in (("WORDS", 5), ("PHRASES", 8), ("CHUNK", 50)):
        monkeypatch.setattr(col, name, value)
    task_rows = Counter()
    for words, bits in ((1, 12),):
        task = col._Task(words, bits, None, None, 3)
        for lang, text in rows:
            for part in col._chunks(col.pa.array([(text or "").encode()], col.pa.binary())):
                task.read(lang or "und", part)
                if task.full():
                    for b in task.counted():
                        for la, p, n in zip(b["lang"].to_pylist(), b["phrase"].to_pylist(), b["n"].to_pylist(), strict=True):
                            task_rows[la, p] += n
        for b in task.counted():
            for la, p, n in zip(b["lang"].to_pylist(), b["phrase"].to_pylist(), b["n"].to_pylist(), strict=True):
                task_rows[la, p] += n
    want = Counter()
    for lang, text in rows:
        want.update((lang or "und", w) for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", (text or "").translate(ASCII)))
    assert task_rows == want


def test_no_rows_and_one_language(spark):
    docs = spark.createDataFrame([("a b " * 20, 1)], "text string, lang int")
    assert collocations(docs.limit(0), bits=12).count() == 0
    assert [tuple(r) for r in collocations(docs, lang_col=None, least=5, bits=12).collect()] == brute([(None, "a b " * 20)], 5)
    with pytest.raises(ValueError, match="least"):
        collocations(docs, least=300)


def test_long_text(spark):
    text = "one two three four. " * 150_000 + "no break " * 400_000
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    assert sorted(tuple(r) for r in collocations(docs, bits=20).collect()) == brute([("en", text)])


def test_counters():
    rng = np.random.default_rng(1)
    total = np.zeros(1 << 18, np.int64)
    sums: dict = {}
    for size in (10, 5000, 400_000):
        h = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2)
        cells = Cells(18)
        cells.add(h)
        cells.add(h[:100])
        for x in (h, h[:100]):
            np.add.at(total, (x >> np.uint64(46)).astype(np.int64), 1)
        for block, row in cells.rows():
            add_cells(sums.setdefault(block, np.zeros(BLOCK, np.uint8)), row)
    assert (np.concatenate([sums[b] for b in range(4)]) == np.minimum(total, 255)).all()


def test_wide_keys():
    keys = np.array([[1, 1 << 40], [0, 5], [1, 1 << 40]])
    k, n = col._distinct(keys, np.array([1, 2, 3]))
    assert sorted(map(tuple, np.column_stack([k, n]).tolist())) == [(0, 5, 2), (1, 1 << 40, 4)]


def test_exact_scores(spark):
    a, left, right = 99_999_999_999_999, 123_456_789_012_345, 99_999_999_999_999
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(col._score(df.a, df.l, df.r)).first()[0] == 1_000_000 * a * a // (left * right)
