"""Operators 2, 3, 4 and 5."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from zonelens.llm import decontaminate, language_id, mixing, toxicity
from zonelens.llm.words import LETTERS, Words


def ppm_by_hand(texts, text, order):
    """Code length of text by context trees of plain dictionaries (method C)."""
    counts = defaultdict(Counter)
    for t in texts:
        raw = b"\0" * order + t.lower().encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                counts[raw[i - k:i]][raw[i]] += 1
    bits, raw = 0.0, b"\0" * order + text.lower().encode()
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            seen = counts.get(raw[i - k:i])
            if seen:
                total, distinct = sum(seen.values()), len(seen)
                if raw[i] in seen:
                    bits -= math.log2(seen[raw[i]] / (total + distinct))
                    break
                bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(monkeypatch):
    texts = {"en": ["the cat sat on the mat", "that is the thing"], "fr": ["le chat était là", "c'est la vie"]}
    tables = language_id.Tables(language_id.count_contexts(texts))
    for piece in (1 << 20, 16):
        monkeypatch.setattr(language_id, "PIECE", piece)
        for t in ("the chat is here, là", "zzz", "a", "The CAT sat là " * 9, "ünseen ß bytes"):
            (lang, score, bits), = language_id.score_texts(tables, [t])
            hand = {x: ppm_by_hand(texts[x], t, 3) for x in texts}
            assert lang == min(hand, key=hand.get)
            assert bits * len(t.lower().encode()) == pytest.approx(min(hand.values()), rel=1e-4)
            assert score == pytest.approx(1 / sum(2.0 ** (min(hand.values()) - x) for x in hand.values()), abs=1e-2)


def test_language_rows(make_docs, odd_rows, clashing, rng):
    words = {"en": "the of and that with from this".split(), "de": "der die und das nicht mit sich".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(20)), x) for i, x in enumerate(["en", "de"] * 100)]
    docs = make_docs([*rows, *[(1000 + (r[0] or 0), *r[1:]) if r[0] else r for r in odd_rows]], clashing)
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) + len(odd_rows)
    held = {r["doc_id"]: r for r in got}
    for i, t, x in rows:
        assert held[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert held[i]["lang_pred"] == x and 0 <= held[i]["score"] <= 1
    assert [held[1000 + i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4
    kept = language_id.drop_unknown_language(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["lang_pred"] != "und" and r["bits_per_byte"] <= language_id.MOST_BITS for r in got)
    assert language_id.identify(make_docs([])).count() == 0
    assert language_id.identify(make_docs([(2, "no label at all")])).first()["lang_pred"] == "und"


def test_all_byte_values_and_many_languages():
    """Texts with all byte values that UTF-8 has, in more languages than a dense table holds."""
    blocks = ["".join(chr(c) for c in range(0x20 + 97 * i, 0x20 + 97 * i + 97) if not 0xD800 <= c < 0xE000) for i in range(100)]
    texts = {f"l{i:03d}": [b, b[::-1]] for i, b in enumerate(blocks)}
    assert len({x for b in blocks for x in b.encode()}) > 126
    tables = language_id.Tables(language_id.count_contexts(texts))
    assert sum(x.nbytes for tree in tables.trees for level in tree for x in level) < 20_000_000
    for i in (0, 3, 60, 99):
        (lang, _, bits), = language_id.score_texts(tables, ["a" + blocks[i][10:60]])
        t = "a" + blocks[i][10:60]
        hand = ppm_by_hand(texts[f"l{i:03d}"], t, 3)
        assert lang == f"l{i:03d}" and bits * len(t.lower().encode()) == pytest.approx(hand, rel=1e-4)


def test_language_filter_uses_the_model(make_docs, rng):
    words = "the of and that with from this".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(20)), "en") for i in range(60)]
    strange = [(1000, "日本語の文章です 漢字仮名交じり文", None), (1001, "12 34", "en"), (1002, "the of and", None)]
    kept = {r["doc_id"] for r in language_id.drop_unknown_language(make_docs(rows + strange)).collect()}
    assert kept == set(range(60)) | {1002}
    without = {r["doc_id"] for r in language_id.drop_unknown_language(make_docs([(i, t) for i, t, *_ in strange])).collect()}
    assert without == {1000, 1002}  # nothing learned: whatever has a letter stays
    long = [(i, "the of and " * 3000, "en") for i in range(400)] + [(5000 + i, "der die das", "de") for i in range(9)] + [(6000 + i, "the of and", "en") for i in range(9)]
    assert {r["lang"] for r in language_id.learning_sample(make_docs(long)).collect()} == {"en", "de"}  # too long ones are out before the pick


@pytest.mark.parametrize("n", [0, 1, 5000, 100_000])
def test_every_feature_is_found(n):
    keys = np.unique(np.random.RandomState(n).randint(1, 1 << 62, n + n // 10, np.int64).astype(np.uint64) * np.uint64(3))[:n]
    np.random.RandomState(1).shuffle(keys)
    table = toxicity.FeatureTable(keys)
    assert np.array_equal(table.numbers(keys), np.arange(1, len(keys) + 1))
    strange = np.setdiff1d(np.random.RandomState(7).randint(1, 1 << 62, 50_000, np.int64).astype(np.uint64), keys)
    assert not table.numbers(strange).any() and not table.numbers(np.zeros((3, 4), np.uint64)).any()
    crowded = toxicity.FeatureTable(np.arange(1, 200, dtype=np.uint64))  # all in the first slot
    assert np.array_equal(crowded.numbers(np.arange(0, 210, dtype=np.uint64).reshape(3, 70)).ravel(),
                          [*range(200), *[0] * 10])


def test_smith_waterman_equals_the_plain_recurrence(rng):
    for _ in range(60):
        a = np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 15))], np.uint64)
        b = np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 40))], np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, s, e = decontaminate.align(a, b)
        assert score == h.max() and 0 <= s <= e <= len(b)
        if score:
            assert decontaminate.align(a, b[s:e])[0] == score


def test_leaks_found_and_clean_documents_left(spark, make_docs, rng, clashing):
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randint(15, 50))) for i in range(20)]
    rows, expected = [], set()
    for d in range(120):
        words = text(rng.randint(5, 300))
        if d % 3 == 0:
            i, item = rng.choice(items)
            copy = list(item)
            for _ in range(len(copy) // 8 if d % 2 else 0):  # edited copies
                j = rng.randrange(len(copy))
                copy[j:j + 1] = rng.choice([[], ["edit"], [copy[j], "more"]])
            at = rng.randint(0, len(words))
            words[at:at] = copy
            expected.add((d, i))
        rows.append((d, (", " if d % 5 == 0 else " ").join(words).title()))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (92, "w1"), (None, "w1 w2")], "item_id long, text string")
    docs = make_docs([*rows, (500, None), (501, "")], clashing)
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in expected} | {500, 501}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(make_docs([]), bench).count() == 0


def test_leaks_against_aligning_every_item_with_every_document(spark, make_docs, rng):
    """Recall of the seeds: the same rule on the whole document, for items of all lengths."""
    vocabulary = [f"w{i}" for i in range(900)] + ["the", "of"] * 40
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate([1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 20, 30, 45, 60] * 2)}
    docs = []
    for d in range(260):
        item = list(items[rng.randrange(len(items))])
        for _ in range(rng.randint(0, max(1, len(item) // 5))):
            j = rng.randrange(len(item))
            item[j:j + 1] = rng.choice([["edit"], [], [item[j], "more"]]) if len(item) > 1 else item
        before, after = (text(rng.randint(0, 60)), text(rng.randint(0, 60))) if d % 5 else ([], [])
        docs.append((d, [*before, *item, *after]))
    hashes = lambda words: Words([" ".join(words).encode()], LETTERS).hash
    want = set()
    for d, words in docs:
        for i, item in items.items():
            m, there = len(item), hashes(words)
            if m < decontaminate.SEED:
                if words == item:
                    want.add((d, i))
                continue
            score, s, e = decontaminate.align(hashes(item), there)
            matched = sum((Counter(words[s:e]) & Counter(item)).values())
            if score >= decontaminate.LEAST * 2 * m and matched >= decontaminate.needed(m):
                want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(make_docs([(d, " ".join(t)) for d, t in docs]), bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 150
    assert [decontaminate.needed(m) for m in (3, 5, 6, 8, 9, 12, 15, 20)] == [3, 5, 5, 7, 8, 8, 8, 10]


def test_leaks_in_blocks_of_items(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 12)
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i}") for i in range(4)], "item_id long, text string")
    docs = make_docs([(i, f"x y a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i} z") for i in range(4)])
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.find_leaks(docs, bench).collect()) == [
        (i, i, 1.0) for i in range(4)]


def filled_by_rounds(sizes, weights, epochs):
    """Capped water-filling as a loop: share, clamp, share the rest again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = (total - sum(t for i, t in enumerate(target) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if share * weights[i] > epochs * sizes[i]}
        if not over:
            for i in open_:
                target[i] = share * weights[i]
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
        open_ -= over
    return target


def test_mix(make_docs, rng, odd_rows, clashing):
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 400]), None, rng.choice(["a"] * 30 + ["b", "B", "c", None, "é"])) for i in range(300)]
    rows += [(900, "tiny", None, "zz"), (901, "", None, "zero"), *odd_rows]
    got = mixing.mix(make_docs(rows, clashing)).collect()
    assert len(got) == len(rows)
    words = Counter()
    for r in rows:
        words[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in words if s is not None)) + ([None] if None in words else [])
    sizes = [words[s] for s in names]
    wanted = dict(zip(names, filled_by_rounds(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == words[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in names:
        assert abs(taken[s] - wanted[s]) <= 1
    again = mixing.mix(make_docs(rows, clashing).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(make_docs([])).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    move, begin = np.array([[1.5, 0.3], [0.7, 2.0]]), np.array([0.6, 0.4])
    lengths = [1, 2, 7, 3, 1, 9]
    emit, first, expected = [], [], []
    for n in lengths:
        e = rng.normal(0, 2, n)
        weight = np.zeros((2 ** n,))
        tags = np.array([[s >> i & 1 for i in range(n)] for s in range(2 ** n)])
        for s, y in enumerate(tags):
            w = begin[y[0]] * math.exp(e[y == 1].sum())
            for x, z in zip(y, y[1:]):
                w *= move[x, z]
            weight[s] = w
        expected.append((weight[:, None] * tags).sum(0) / weight.sum())
        emit.append(e)
        first += [True] + [False] * (n - 1)
    for copies in (1, 30):  # 30: several lanes
        p, _ = toxicity.marginals(np.tile(np.concatenate(emit), copies), np.tile(first, copies), move, begin)
        assert p == pytest.approx(np.tile(np.concatenate(expected), copies), abs=1e-9)


def test_toxicity_learns_words_and_prefixes(spark, make_docs, rng, odd_rows, clashing):
    plain = [f"plain{i}" for i in range(40)] + ["the", "of", "and"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        toxic = i % 5 == 1
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "scum", "loser", f"loweie{rng.randint(0, 99)}"]))
        rows.append((i, " ".join(words).capitalize() + "."))
        if i % 4 != 3:
            labels.append((i, int(toxic)))
    more = [(1000 + r[0] if r[0] else None, *r[1:]) for r in odd_rows]
    docs = make_docs([*rows, *more, (2000, "what an\nIDIOT and é loser, scum")], clashing)
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (1, None)], "doc_id long, toxic int")
    got = {}
    for r in toxicity.tag_toxic(docs, marks).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows) + len(more) + 1
    for i, t in rows:
        r, = got[i]
        assert r["predicted"] == int(i % 5 == 1) == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    text = "what an\nIDIOT and é loser, scum"
    assert [text[s["start"]:s["end"]] for s in got[2000][0]["spans"]] in (["IDIOT", "loser, scum"], ["IDIOT", "loser", "scum"])
    assert got[1001][0]["predicted"] == 0 and 0 <= got[1001][0]["score"] <= 1
    assert toxicity.tag_toxic(make_docs([]), marks).count() == 0
    assert toxicity.tag_toxic(make_docs(rows[:3]), marks.limit(0)).first()["score"] == 0


def test_words_and_grams():
    raws = ["One  two\tthree".encode(), b"", "été É, two".encode(), b"one two three"]
    w = Words(raws)
    assert w.count.tolist() == [3, 0, 3, 3]
    assert w.hash[0] == w.hash[6] and w.hash[1] == w.hash[5] == w.hash[7]
    g, at = w.grams(3)
    assert at.tolist() == [0, 3, 6] and g[0] == g[2] != g[1]
    assert Words(raws, LETTERS).count.tolist() == [3, 0, 3, 3]


def test_crf_learns_from_the_whole_sample(rng):
    plain = [f"plain{i}" for i in range(300)]
    words = lambda: [rng.choice(plain) for _ in range(30)]
    texts = [" ".join([*words(), "idiot" if i < 650 else "scum"]) for i in range(750)] + [" ".join(words()) for _ in range(750)]
    model = toxicity.Model(texts, np.array([1] * 750 + [0] * 750))
    text = " ".join([*plain[:20], "scum", *plain[20:30]])
    scores, spans = model.score([text.encode(), " ".join(plain[:30]).encode()])
    assert scores[0] >= 0.5 > scores[1]
    assert [text[a:b] for a, b in spans[0]] == ["scum"]
