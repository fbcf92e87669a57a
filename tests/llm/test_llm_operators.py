"""The training-data operators against brute force on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import textwrap
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import (
    decontaminate,
    exact_dedup,
    license_scan,
    ngram_join,
    quality_lm,
    source_mix,
    suffix_dedup,
    token_count,
    url_filter,
    warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, sid long, h long, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """documents with extra columns whose names the operators use inside; rows: (doc_id, text[, source[, lang]])."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None, "x", 1, 2, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Base texts with near copies at many distances, exact copies, a passage many share, and odd texts."""
    rng = random.Random(11)
    vocab = vocabulary(rng)
    passage = " ".join(rng.choice(vocab) for _ in range(55))
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 160))]
        add(" ".join(base))
        add("  " + "\t".join(w.upper() if rng.random() < 0.3 else w for w in base) + "\n")
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 25 + 2))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(0, 2)] = [rng.choice(vocab)] * rng.randrange(0, 2)
            add(" ".join(copy))
    for _ in range(25):
        add(" ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60))) + " " + passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60))))
    for odd in (None, "", " \t\n", "one", "One", "a b c d", "a b c d", "A b c d", "a b c d e", "x " * 300, "y " * 200, "word" * 5000, " ".join(rng.choice(vocab) for _ in range(6000))):
        add(odd)
    return rows


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, corpus)).collect()}
    assert got == brute_components(corpus)
    assert len({c for _, c in got.values()}) < len(got) - 20


def test_ngram_join_blocks_and_trees(spark, monkeypatch):
    """One group whose members drift apart, so that stars leave links to the trees, and blocks split its buckets."""
    rng = random.Random(5)
    vocab = vocabulary(rng, 900)
    base = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(70):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_ngram_join_repeated_rows_and_empty_tables(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (9, None)]
    base = [f"w{i}" for i in range(40)]
    rows += [(20, " ".join(base)), (None, " ".join([*base[:39], "new"])), (None, " ".join([*base[:38], "newer", "new"])), (1, " ".join([*base[1:38], "newer", "new"])), *[(None, "x y z " * 9)] * 30]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, rows)).collect()), key=str)
    tail = [(20, 36, 1), (None, 36, 1), (None, 36, 1), (1, 35, 1), *[(None, 3, None)] * 30]
    assert got == sorted(tail + [(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 2, 3), (None, 2, None), (9, 0, 9)], key=str)
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0


def test_exact_dedup(spark, corpus):
    rows = [*corpus, (500, "one "), (501, "o ne"), (502, "ONE"), (500, "one ")]
    norm = {}
    for i, t in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = Counter()
    for k, group in norm.items():
        keep = min(group)[1]
        for _, i in group:
            want[i, keep, len(group), i == keep, hashlib.sha256(k.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect())
    assert got == want
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_exact_dedup_tells_clashing_texts_apart(spark, monkeypatch):
    """With a digest of one bit, byte verification alone keeps groups apart."""
    monkeypatch.setattr(exact_dedup, "digest_of", lambda norm: F.substring(F.unhex(F.sha2(norm, 256)), 1, 0))
    rows = [(i, t) for i, t in enumerate(["a", "b", "a ", "c", "b", "a"])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()}
    assert got == {0: (2, 3), 2: (2, 3), 5: (2, 3), 1: (1, 2), 4: (1, 2), 3: (3, 1)}


def test_digest_index_is_incremental(spark, tmp_path):
    def batch(lo, hi, of=7):
        digest = exact_dedup.digest_of((F.col("id") % of).cast("string"))
        return spark.range(lo, hi).select(digest.alias("digest"), "id", F.lit(1).cast("long").alias("chars"))

    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    assert index.runs() == [] and index.probe(batch(0, 3)).count() == 0
    assert index.flush(batch(0, 5)).count() == 0
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))  # another session opens it by its log
    assert again.flush(batch(10, 20)).count() == 5
    (tmp_path / "index" / "run-of-a-failed-flush").mkdir()
    asked = spark.range(3).select(exact_dedup.digest_of((F.col("id") + 5).cast("string")).alias("digest"))
    for known in (None, batch(0, 5).select("digest")):
        level = exact_dedup.DigestIndex(spark, str(tmp_path / "index")).compact(known)
        assert {(r.id, r.n) for r in level.collect()} == {(0, 2), (1, 2), (2, 2), (3, 3), (4, 3), (12, 2), (13, 1)}
        assert [r.level for r in index.runs()] == [1 if known is None else 2]
        assert index.probe(asked).count() == 2


def test_run_filters_let_few_others_pass(spark, tmp_path):
    def digests(lo, hi):
        return spark.range(lo, hi).select(exact_dedup.digest_of(F.col("id").cast("string")).alias("digest"), "id", F.lit(1).cast("long").alias("chars"))

    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    index.flush(digests(0, 20_000))
    run = index.runs()[0]
    assert sum(bin(b).count("1") for r in spark.read.parquet(f"{index.path}/{run.run}-filter").collect() for b in r.bitmap) / run.bits < 0.07
    assert index.probe(digests(19_000, 60_000)).count() == 1000


def test_source_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "b", "c", "é", None])) for i in range(3000)]
    rows += [(3000, None, "a"), (3001, "x y", "empty"), (3002, "", "none at all")]
    got = source_mix.mix_sources(frame(spark, rows))
    table = got.collect()
    assert len(table) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = [*sorted([s for s in sizes if s is not None], key=lambda s: s.encode()), None]
    weight = dict(zip(names, [5, 2, 1] * 9, strict=False))
    target, left = {}, 1.5 * sum(sizes.values())
    open_ = set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    taken = Counter()
    for r in table:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 40
    again = {(r.doc_id, r.taken) for r in source_mix.mix_sources(frame(spark, rows).repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in table}
    assert source_mix.mix_sources(frame(spark, [])).count() == 0


def test_source_mix_of_equal_rows_and_missing_ids(spark, monkeypatch):
    """Rows of one source, id and size, in many tasks, are taken together as their share says."""
    monkeypatch.setattr(source_mix, "BLOCK", 8)
    rows = [(None, "a b c", "s")] * 300 + [(7, "x y", "s")] * 41 + [(i, "w " * (1 + i % 9), "t") for i in range(200)] + [(None, None, "s")] * 5
    got = source_mix.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 10
    again = source_mix.mix_sources(frame(spark, rows).repartition(2)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_token_counts(spark, corpus):
    scores = token_count.piece_scores(token_count.read_vocabulary())
    longest = max(map(len, scores))

    def tokens(w):
        best = [(0.0, 0)]
        for d in range(1, len(w) + 1):
            options = [(best[d - k][0] + scores[w[d - k : d]], -best[d - k][1] - 1) for k in range(1, min(d, longest) + 1) if w[d - k : d] in scores]
            score, n = max(options)
            best.append((score, -n))
        return best[-1][1]

    rng = random.Random(6)
    rows = [*corpus, (900, "naïve 漢字 \U0001f600 x"), (901, "A a A"), (902, "".join(rng.choice("abcdeABC+/019") for _ in range(70_000))), (903, "=" * 3000 + " a"), (904, "é" * 40_000)]
    want = {i: sum(tokens(b" " + w.encode()) for w in WORD.findall(t or "")) for i, t in rows}
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(frame(spark, rows)).collect()}
    assert got == want
    assert token_count.count_tokens(frame(spark, [])).count() == 0


def test_a_long_unbroken_word_takes_seconds():
    import time

    import numpy as np

    pieces = token_count.Pieces(token_count.piece_scores(token_count.read_vocabulary()))
    word = np.frombuffer((" " + "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/", k=1_000_000))).encode(), np.uint8)
    began = time.monotonic()
    assert 300_000 < token_count.path_count(word, pieces) < 1_000_000
    assert time.monotonic() - began < 120
    short = word[:2000]
    assert token_count.path_count(short, pieces) == token_count.trie_counts(short, np.array([1]), np.array([2000]), pieces)[0]


def wrapped(*paragraphs, mark="", width=70, end="\n"):
    return end.join(mark + line for x in paragraphs for line in [*textwrap.wrap(x, width), ""])


def plain_rules(sentence_ids):
    """Licences and what is left over, by walking lists: longest rule first, each place once, left to right."""
    left, found = sentence_ids.split(",") if sentence_ids else [], []
    rules = sorted(((licence, ids[1:-1].split(",,")) for licence, ids in license_scan.ordered_rules()), key=lambda r: (-len(r[1]), r[0], r[1]))
    for licence, ids in rules:
        i = 0
        while i + len(ids) <= len(left):
            if left[i : i + len(ids)] == ids:
                left[i : i + len(ids)] = [None]
                found.append(licence)
            i += 1
    return "|".join(sorted(set(found))), sum(x is not None for x in left)


def test_licences(spark):
    known = dict(license_scan.SENTENCES)
    mit = [known[k] for k in ("mit-grant", "mit-condition")] + [known["mit-asis"] + " " + known["mit-liability"]]
    apache = [known["apache2-header"] + " " + known["apache2-obtain"], "    " + known["apache2-url"], known["apache2-asis"] + " " + known["apache2-see"]]
    gpl = " ".join(known[k] for k in ("gpl-free", "gpl-hope", "gpl-see"))
    bsd = [known["bsd-grant"], "1. " + known["bsd-source"], "2. " + known["bsd-binary"]]
    rows = [
        (0, "\n".join(mit)), (1, "Some text.\nReleased under the MIT License.\nMore. Licensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, "no licence here"),
        (5, known["mit-condition"]), (6, "released UNDER the mit license."), (6, "released UNDER the mit license."), (7, "We are released under the MIT License."),
        (8, "MIT License\n\nCopyright (c) 2020 X\n\n" + wrapped(*mit)), (9, wrapped("Copyright 2020 X", *apache, mark="# ")), (10, "/*\r\n" + wrapped(gpl, mark=" * ", end="\r\n")),
        (11, wrapped(*bsd)), (12, "MIT"), (13, "She studied at MIT.\nMIT."), (14, "// SPDX-License-Identifier: MIT"), (15, "# SPDX-License-Identifier: Apache-2.0"),
        (16, "=" * 900 + "\nMIT License\ncode"), (17, "MIT License\nISC License"), (18, "word " * 100_000 + "\n\n" + wrapped(*mit) + "\n\n" + "word " * 100_000), (19, "SPDX-License-Identifier:\nMIT"), (None, "\x01MIT License"),
        (20, "Released under the MIT License.\n" * 2), (21, "Released under the MIT License.\n" * 3), (22, "MIT License\nMIT License"), (23, "// SPDX-License-Identifier: MIT OR Apache-2.0"), (24, "# SPDX-License-Identifier: GPL-2.0"),
        (25, "SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) AND BSD-3-Clause AND ISC\nx"), (26, known["isc-grant-and"]), (27, "SPDX-License-Identifier: (MIT)"), (28, "MIT License\n\n" + known["mit-condition"] + "\nMIT License"),
    ]
    got = sorted(((r.doc_id, r.licences, r.unmatched > 0) for r in license_scan.scan_licences(frame(spark, rows)).collect()), key=str)
    want = {0: "MIT", 1: "CC-BY-NC-4.0|MIT", 6: "MIT", 8: "MIT", 9: "Apache-2.0", 10: "GPL-3.0-or-later", 11: "BSD-2-Clause", 14: "MIT", 15: "Apache-2.0", 16: "MIT", 17: "ISC|MIT", 18: "MIT", 19: "MIT", None: "MIT"}
    want |= {20: "MIT", 21: "MIT", 22: "MIT", 23: "Apache-2.0|MIT", 24: "GPL-2.0-only", 25: "BSD-3-Clause|GPL-2.0-or-later|ISC", 26: "ISC", 27: "MIT", 28: "MIT"}
    assert got == sorted([(i, want.get(i, ""), i in (5, 28)) for i, _ in rows], key=str)
    by_rules = sorted([plain_rules(r.sentence_ids) for r in license_scan.scan_licences(frame(spark, rows)).collect()], key=str)
    assert by_rules == sorted([(r.licences, r.unmatched) for r in license_scan.scan_licences(frame(spark, rows)).collect()], key=str)
    assert license_scan.scan_licences(frame(spark, [])).count() == 0
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    theirs = con.execute(license_scan.ORACLE["op5_license_scan"]).fetchall()
    ours = [tuple(r) for r in license_scan.scan_licences(frame(spark, rows)).collect()]
    assert sorted(theirs, key=str) == sorted(ours, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 80 + "</p>"
    rows = [(5, "http://a/", long), (2, "http://b/\r\nx y", long), (9, None, long), (1, "http://c/", "short"), (3, "http://d/", "short"), (4, "", None), (None, "http://e/", long), (6, "http://f/", "z" * 300_000)]
    got = {r.page_id: r for r in warc.archive_pages(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha256(raw).hexdigest()
        again = h == long and i != 2
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 2) if again else ("response", None))
        assert again or bytes(got[i].payload) == raw
    assert got[5].target_uri == "http://a/" and got[9].target_uri is None
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_warc_revisits_name_the_record_they_refer_to(spark, tmp_path):
    long = "<p>" + "x" * 200
    rows = [(5, "http://a/", long), (2, "http://b/", long), (2, "http://b/", long), (8, None, long), (None, None, long)]
    warc.archive_pages(pages(spark, rows).coalesce(1), str(tmp_path / "w")).collect()
    heads = []
    for path in (tmp_path / "w").glob("*.warc.zst"):
        with path.open("rb") as f:
            heads += [warc.parse_record(raw)[0] for raw in warc.read_frames(f)]
    ids = [h["warc-record-id"] for h in heads]
    responses = {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    assert len(heads) == 5 and len(set(ids)) == 5
    assert {h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"} < responses


def test_warc_refuses_broken_archives():
    import io

    import zstandard

    good = warc.record_bytes(1, "http://a/", b"body" * 50, hashlib.sha256(b"body" * 50).hexdigest(), None, False)
    assert warc.decode_record(good)[0] == 1
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"body", b"BODY"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Type: app", b"Content-Type app")):
        with pytest.raises(warc.WarcError):
            warc.decode_record(bad)
    frame_ = zstandard.ZstdCompressor().compress(good)
    archive = warc.dictionary_frame(b"") + frame_ + frame_
    assert list(warc.read_frames(io.BytesIO(archive))) == [good, good]
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(archive[:-3])))
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(frame_)))


def brute_leaks(rows, items):
    def grams(w):
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]

    out = {}
    for i, t in rows:
        w = words(t)
        for j, b in items:
            q = words(b)
            if not w or not q:
                continue
            n, ref, best = len(q), Counter(grams(q)), 0
            for s in range(max(1, len(w) - n + 1)):
                win = w[s : s + n]
                c = Counter(grams(win) if len(q) >= 5 or len(win) == len(q) else [])
                if len(q) >= 5 and len(win) < 5:
                    continue
                k = sum((c & ref).values())
                best = max(best, k / (sum(c.values()) + sum(ref.values()) - k))
            if best >= 0.75:
                out[i, j] = best
    return out


def test_decontamination(spark, corpus):
    rng = random.Random(2)
    vocab = vocabulary(rng)
    items = [(j, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12, 60)))) for j in range(12)] + [(50, None), (51, ""), (52, "tiny item"), (53, "re re re re re re re re")]
    rows = [r for r in corpus if len(r[1] or "") < 4000]
    for k, (j, b) in enumerate(items[:12]):
        w = b.split()
        for cut in range(0, 4):
            copy = list(w)
            for _ in range(cut):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            pad = [rng.choice(vocab) for _ in range(rng.randrange(0, 30))]
            rows.append((1000 + 10 * k + cut, " ".join(pad + copy + pad[: rng.randrange(0, 20)])))
    rows += [(2000, "a tiny item here"), (2001, "re " * 30), (None, items[0][1]), (2002, items[1][1][: len(items[1][1]) // 3])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    want = brute_leaks([r for r in rows if r[0] is not None], items)
    assert got == pytest.approx(want) and len(got) > 20
    long = [f"w{k % 50_000}" for k in range(100_000)]  # an item of 100,000 words, most of them twice, and a text that holds it
    wide = spark.createDataFrame([(9, " ".join(long))], "item_id long, text string")
    texts = [(1, " ".join(["x"] * 50 + long)), (2, " ".join(long[:40_000])), (3, "re " * 200_000), (3, None), (1, " ".join(long[:90_000])), (4, " ".join(long[:90_000])), (4, " ".join(long[:90_000]))]
    told = sorted((r.doc_id, r.start, round(r.similarity, 3)) for r in decontaminate.contaminated(frame(spark, texts), wide).collect())
    assert told == [(1, 50, 1.0), (4, 0, 0.9)]
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, rows[:3]), bench.limit(0)).count() == 0


def test_simhash_blocks_cover_64_bits(spark):
    got = spark.range(1).select(decontaminate.blocks(F.lit(-1).cast("long"), decontaminate.RADIUS).alias("b")).first().b
    assert len(got) == decontaminate.RADIUS + 1 and sum(bin(x).count("1") for x in got) == 64
    hashes = [3, 3, 5, -1]
    want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))
    for bits in (16, 32):
        fp = spark.range(1).select(decontaminate.simhash(F.array(*[F.lit(h).cast("long") for h in hashes]), bits)).first()[0]
        assert fp % (1 << 64) == want


def brute_repeats(rows):
    seen, texts = Counter(), {}
    for i, t in rows:
        texts[i] = w = words(t)
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])] += 1
    out = set()
    for i, w in texts.items():
        run = None
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] > 1:
                if run and k <= run[1]:
                    run[1] = k + 50
                else:
                    if run:
                        out.add((i, *run))
                    run = [k, k + 50]
        if run:
            out.add((i, *run))
    return out


def test_repeated_passages(spark, corpus):
    rows = [*corpus, (700, "z " * 55), (701, "p q " * 40), (702, "one " * 49), (703, "a b c d e f g h i j k l m n " * 4), (704, "once " * 50)]
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows) and len(got) > 30
    twice = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(frame(spark, [*rows, rows[0], rows[-1]])).collect()}
    assert twice == got
    assert suffix_dedup.repeated_passages(frame(spark, [])).count() == 0
    assert suffix_dedup.repeated_passages(frame(spark, [(None, "a " * 80), (1, None), (2, "b")])).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        lang = ["en", "fr", None][i % 3]
        junk = i % 8 == 0
        text = " ".join(rng.choice(vocab) for _ in range(rng.randrange(30, 80)))
        rows.append((i, " | ".join(text.upper().split()) + "%%$$" if junk else text + ".", "s", lang))
        if i < 300:
            labels.append((i, 0 if junk else 1, 0))
    rows += [(1000, None, "s", "en"), (1001, "", "s", "en"), (1002, vocab[0] * 400, "s", "xx"), (None, rows[1][1], "s", "en"), (1, rows[1][1], "s", "fr")]
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.accepted) for r in quality_lm.classify(frame(spark, rows), lab).collect()]
    assert len(got) == len(rows)
    held = {i: a for i, a in got if i is not None and 300 <= i < 400}
    assert all(not a for i, a in held.items() if i % 8 == 0)
    assert sum(a for i, a in held.items() if i % 8) >= 0.95 * sum(1 for i in held if i % 8)
    byid = dict(got)
    assert not byid[1000] and not byid[1001]
    assert quality_lm.classify(frame(spark, []), lab).count() == 0
    assert all(r.accepted for r in quality_lm.classify(frame(spark, rows[:5]), lab.limit(0)).collect())


def test_urls(spark):
    urls = [
        "http://a.org/x", "HTTP://Sub.EXAMPLE.org/es/1?q", "https://example.org/en/15#f", "https://m.example.com/fr/2", "http://example.com/de/3", "http://notorg/x",
        "no scheme", None, "http://b.net", "ftp://user@H.net:80/p#x?y", "://", "http://example.org", "x://y.com/fr", "http://bad.net/1", "http://bad.net/2", "http://é.ORG/É",
    ]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(13, "http://bad.net/1", None), (None, "http://b.net/", None)] + [(100 + i, f"http://bad.net/{i}", None) for i in range(40)] + [(200 + i, f"http://good.com/{i}", None) for i in range(80)]
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(200 + i, 0) for i in range(80)] + [(None, 1), (3, None)], "page_id long, bad int")
    table = url_filter.filter_urls(pages(spark, rows), outcomes).collect()
    assert len(table) == len(rows)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in table}
    assert got[0] == ("a.org", "/x", "org/", "allow")
    assert got[1] == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/15", "example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5][:3] == ("notorg", "/x", None)
    assert got[6][:3] == got[7][:3] == got[10][:3] == ("", "", None)
    assert got[9][:2] == ("user@h.net:80", "/p")
    assert got[11] == ("example.org", "", None, got[11][3]) and got[12][2] is None
    assert got[13][3] == "block" and got[200][3] == "allow"
    assert got[15][:3] == ("é.org", "/É", "org/")
    assert url_filter.filter_urls(pages(spark, []), outcomes).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages(spark, rows[-3:]), outcomes.limit(0)).collect()} == {"allow"}


def test_registered_domains_and_addresses(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com": ("y.com", "com"), "10.0.0.1": ("10.0.0.1", "[]"), "u@h.org:80": ("h.org", "org"), "com": ("com", "com"), "": ("", ""), "[::1]:80": ("[::1]", "[]")}
    domain, suffix = url_filter.domain_and_suffix(F.col("h"))
    got = {r.h: (r.d, r.s) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == hosts


def test_beta_mass(spark):
    """For whole parameters the mass beyond x is a binomial sum."""
    cases = [(1, 1), (2, 3), (30, 20), (400, 600), (600, 400), (5000, 5100), (1, 9)]
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in cases] + [(0.0, 5.0), (3.0, 0.0), (0.02, 0.9)], "a double, b double")
    got = {(r.a, r.b): r.m for r in rows.select("a", "b", url_filter.mass_beyond(F.col("a"), F.col("b")).alias("m")).collect()}
    for a, b in cases:
        n = a + b - 1
        assert got[a, b] == pytest.approx(sum(math.comb(n, k) for k in range(a)) / 2**n, abs=2e-3)
    assert got[0, 5] == 0 and got[3, 0] == 1 and 0 < got[0.02, 0.9] < 0.05
