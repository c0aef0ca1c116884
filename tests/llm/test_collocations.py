"""Operator 13 against a plain count of all phrases."""

import re
from collections import Counter

import pytest

from zonelens.llm import collocations as co

FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def model(rows, least, top, most=5):
    """rows: (doc_id, text, lang)."""
    counts, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            for m in range(1, most + 1):
                for i in range(len(ws) - m + 1):
                    counts[lang, tuple(ws[i:i + m])] += 1
    frequent = {k: f for k, f in counts.items() if f >= least}
    inside = set()
    for (lang, w), f in frequent.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * f >= 100 * counts[lang, w[i:i + m]]:
                    inside.add((lang, w[i:i + m]))
    out = {}
    for (lang, w), a in frequent.items():
        if len(w) > 1 and (lang, w) not in inside:
            cuts = [(1000 * a * n[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]])
                    for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, left, right, n[lang], score))
    return [(lang, i + 1, x[2].decode(), *x[3:]) for lang in sorted(out) for i, x in enumerate(sorted(out[lang])[:top])]


def check(docs, rows, least, top, **more):
    got = co.collocations(docs, least=least, top=top, **more)
    assert got.columns == FIELDS
    assert sorted(tuple(r) for r in got.collect()) == sorted(model([r[:3] if len(r) > 2 else (*r, None) for r in rows], least, top, more.get("most_words", 5)))


@pytest.fixture()
def texts(rng):
    """Zipf words with planted phrases, some of them always in one longer phrase."""
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "New\tYork", "a.b", "\x85x"]
    weights = [1 / (i + 1) for i in range(len(words))]
    planted = ["San Jose del Cabo", "of the Rare Bird", "rare1 the rare2", "x1 x2 x3 x4 x5 x6 x7"]
    rows = []
    for i in range(250):
        ws = rng.choices(words, weights, k=rng.randint(0, 60))
        for p in planted:
            if rng.random() < 0.3:
                ws.insert(rng.randint(0, len(ws)), p)
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for w in ws), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("least, top, shares", [(5, 2000, (0.1, 1)), (4, 40, (0.05, 0.3, 1))])
def test_equals_plain_count(make_docs, texts, least, top, shares):
    check(make_docs(texts), texts, least, top, shares=shares)


def test_shorter_phrases(make_docs, texts):
    check(make_docs(texts[:120]), texts[:120], 6, 25, most_words=3, shares=(1,))


def test_settles_before_all_is_expanded(make_docs, texts, monkeypatch):
    """With a high enough score of the last place, frequent first words stay out."""
    grown = []
    plain = co._Frontier.grow

    def grow(self, share):
        out = plain(self, share)
        grown.append((self.lang, self.cut > self.first))
        return out

    monkeypatch.setattr(co._Frontier, "grow", grow)
    rows = [r for r in texts if r[2] == "en"]
    check(make_docs(rows), rows, 4, 3, shares=(0.05, 0.3, 1))
    assert grown[-1][1]


def test_ties_overlaps_and_repeats(make_docs):
    rows = [(i, f"a{k} b{k}. c d", "en") for k in range(9) for i in range(5)]
    rows += [(1, "na " * 40 + "batman", "de")] * 3 + [(2, "ha ha ha ha", "de")] * 4
    check(make_docs(rows), rows, 5, 4)


def test_odd_rows(make_docs, odd_rows, clashing):
    check(make_docs(odd_rows, clashing + ("block", "word", "w")), odd_rows, 2, 2000)
    check(make_docs([]), [], 100, 2000)


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    found = spark.createDataFrame([([0, 1], 3_000_000_000)], "w array<long>, f long")
    vocabulary = spark.createDataFrame([("en", "x", 4_000_000_000, 0), ("en", "y", 5_000_000_000, 1)], "lang string, word string, f long, id long")
    langs = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    got = co._scored(found, vocabulary.select(F.array("id").alias("w"), "f"), langs, vocabulary).first()
    assert got["score"] == 1000 * 3_000_000_000 * 10**14 // (4_000_000_000 * 5_000_000_000)


def test_plans_do_not_grow_with_rounds(make_docs, texts, monkeypatch):
    """The phrases of all rounds are read from one table."""
    read = []
    plain = co._scored

    def scored(found, *others):
        read.append(len({f.rsplit("/", 1)[0] for f in found.inputFiles()}))
        return plain(found, *others)

    monkeypatch.setattr(co, "_scored", scored)
    check(make_docs(texts), texts, 5, 2000, shares=(0.05, 0.3, 1))
    assert len(read) > 1 and len(set(read)) == 1


def test_few_false_hits(spark):
    """Hardly any place that holds none of the phrases is counted."""
    import numpy as np
    phrases = spark.range(4000).selectExpr("array(id, id + 1, id + 2) AS w")
    bits = co._bit_array(phrases)
    inside = [np.arange(4000) + k for k in range(3)]
    outside = [np.arange(200_000) + 10_000 + 7 * k for k in range(3)]
    assert co._in_bits(inside, bits).all()
    assert co._in_bits(outside, bits).mean() < 0.01
