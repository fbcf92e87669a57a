"""The quality classifier's word model against a direct Kneser-Ney computation."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import quality_lm


def direct(train, text):
    """Negative log-probability of a text under interpolated modified Kneser-Ney word bigrams."""
    two, one = Counter(), Counter()
    for t in train:
        x = ["<s>", *t.split(), "</s>"]
        two.update(zip(x, x[1:], strict=False))
    one.update((c,) for _, c in two)

    def table(counts):
        n = [sum(v == k for v in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [0.0] + [max(0.05, min(k - 0.05, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else k * 0.6 for k in (1, 2, 3)]
        total, taken = defaultdict(float), defaultdict(float)
        for g, v in counts.items():
            total[g[:-1]] += v
            taken[g[:-1]] += d[min(v, 3)]
        return lambda g: (max(counts[g] - d[min(counts[g], 3)], 0) / total[g[:-1]], taken[g[:-1]] / total[g[:-1]]) if g[:-1] in total else (0.0, 1.0)

    tables = [table(one), table(two)]
    out, x = 0.0, ["<s>", *text.split(), "</s>"]
    for i in range(1, len(x)):
        p = 1 / (len(one) + 1)
        for k in range(2):
            own, back = tables[k](tuple(x[i - k : i + 1]))
            p = own + back * p
        out -= math.log(p)
    return out


@pytest.mark.parametrize("head", [0, 20, 1 << 20])
def test_scores_are_those_of_word_bigrams(spark, monkeypatch, head):
    """Whether all weights are joined, some or none."""
    monkeypatch.setattr(quality_lm, "HEAD", head)
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(12)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 15))) for _ in range(60)]
    train, odd = texts[:40], ["", None, "new words only", "w1 new w2", texts[0], texts[0], "long " * 200_000 + "w1 w2"]
    model = quality_lm.WordModel(spark.createDataFrame([("en", t) for t in train], "lang string, text string").repartition(4))
    assert model.has_rest == (head < 1 << 20)
    rows = [(i, "en", "en", t) for i, t in enumerate(texts + odd)] + [(7, "en", "en", texts[7])]
    docs = spark.createDataFrame(rows, "id long, lang string, model string, text string").withColumn("row", F.xxhash64("id", "lang", "text"))
    got = quality_lm.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.id][3]
        if text:
            assert r.symbols == len(text.split()) + 1
            assert r.nll == pytest.approx(direct(train, text), rel=1e-9)
        else:
            assert r.symbols == 0


def test_words_in_an_unseen_order_cost_more(spark):
    """Bytes of shuffled words are alike; only a word model, by its order of words, tells them apart."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(200)]
    follows = {v: rng.sample(vocab, 2) for v in vocab}

    def text():
        out = [rng.choice(vocab)]
        while len(out) < 60:
            out.append(rng.choice(follows[out[-1]]))
        return out

    good = [text() for _ in range(400)]
    rows = [(i, " ".join(t), "en") for i, t in enumerate(good)]
    rows += [(1000 + i, " ".join(rng.sample(t, len(t))), "en") for i, t in enumerate(good[300:])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.accepted for r in quality_lm.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), labels).collect()}
    assert not any(got[i] for i in range(1000, 1100))
    assert sum(got[i] for i in range(400)) >= 380


def test_every_language_has_its_own_model_and_limits(spark):
    """Seventeen languages of few documents, and one that nobody labelled, beside a large one."""
    rng = random.Random(5)
    rows, labels = [], []

    def add(lang, letters, n, labelled, wide):
        vocab = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(wide)]
        for _ in range(n):
            labels.extend([(len(rows), 1, 0)] * labelled)
            rows.append((len(rows), " ".join(rng.choice(vocab) for _ in range(40)), lang))

    add("en", "etaoinshr", 400, 1, 20)
    for k in range(17):
        add(f"x{k}", "абвгдежзик", 30, 1, 60)
    add("yy", "λμνξοπρστυ", 10, 0, 60)
    judged = quality_lm.classify(
        spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).collect()
    assert len(judged) == len(rows)
    kept = Counter(r.lang for r in judged if r.accepted)
    assert kept["yy"] == 10
    assert all(kept[f"x{k}"] >= 27 for k in range(17))
    assert kept["en"] >= 380
    assert len({r.high for r in judged if r.lang.startswith("x")}) == 17


def test_texts_are_hashed_together(monkeypatch):
    """Some hundred texts pass through the word model in a few array steps, with the same sums as each by itself."""
    import numpy as np
    import pyarrow as pa

    texts = ["w1 w2 w3 w1 w2", "", None, "  ", "w4", "w1 w2 w3 w9"] * 40
    langs = ["en", "de", "en", "en", "fr", "de"] * 40
    counts = next(quality_lm._bigrams(0)(iter([pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts, pa.string())], ["lang", "text"])])))
    k = quality_lm._key(*[c.to_numpy().view(np.uint64) for c in counts.columns[1:3]])

    class Sent:
        value = quality_lm._Head(pa.table({"k": k.view(np.int64), "v": np.arange(1.0, len(k) + 1), "u": np.ones(len(k), np.int32)}))

    def heads(lo, hi):
        ids = pa.array(range(lo, hi))
        batch = pa.RecordBatch.from_arrays([ids, pa.array(langs[lo:hi]), ids, pa.array(langs[lo:hi]), pa.array(texts[lo:hi], pa.string())], ["id", "lang", "row", "model", "text"])
        return pa.Table.from_batches(list(quality_lm._heads(Sent)(iter([batch])))).to_pylist()

    each = [r for i in range(len(texts)) for r in heads(i, i + 1)]
    steps, mix = [], quality_lm.shingles.mix
    monkeypatch.setattr(quality_lm.shingles, "mix", lambda x: steps.append(1) or mix(x))
    assert heads(0, len(texts)) == each and any(r["s0"] for r in each)
    assert len(steps) < 10
