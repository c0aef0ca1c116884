"""Operators 1, 6 and 8 against brute force."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonelens.llm import exact_dedup, ngram_join, suffix_dedup
from zonelens.llm.components import components


def removed_by_hand(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if s in seen:
                mask[p:p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, m in zip(b, mask) if not m)
        spans = len(re.findall(rb"\x01+", bytes(mask)))
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(rng, n):
    passages = ["".join(rng.choice("ab cdefé") for _ in range(rng.randint(90, 400))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            r = rng.random()
            if r < .5:
                p = rng.choice(passages)
                p = p[rng.randint(0, 20):len(p) - rng.randint(0, 60)]
                if p and rng.random() < .3:
                    j = rng.randrange(len(p))
                    p = p[:j] + "X" + p[j + 1:]
                parts.append(p)
            elif r < .6:
                parts.append("a" * rng.randint(50, 500))
            elif r < .65:
                parts.append("ab" * rng.randint(50, 300))
            else:
                parts.append("".join(rng.choice("xyz uvw") for _ in range(rng.randint(5, 300))))
        rows.append((i * 3 - 50, "".join(parts)))
    return rows


def op1_rows(df):
    return sorted(tuple(r) for r in suffix_dedup.remove_repeats(df).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect())


@pytest.mark.parametrize("hot", [200, 2])
def test_repeats_equal_brute_force(make_docs, rng, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 2: most open phrases are dealt out string by string
    rows = texts_with_repeats(rng, 80)
    expected = removed_by_hand(rows)
    assert sum(r[2] for r in expected) > 1000
    assert op1_rows(make_docs(rows)) == sorted(expected)


@pytest.mark.parametrize("hot", [200, 2])
def test_repeats_in_several_rounds(make_docs, rng, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "ROUND", 1)
    rounds, found = [], suffix_dedup._rounds
    monkeypatch.setattr(suffix_dedup, "_rounds", lambda *a: rounds.extend(found(*a)) or rounds)
    rows = texts_with_repeats(rng, 20)
    passages = [rng.choice(rows)[1] for _ in range(3)]
    rows += [(500 + i, p[rng.randint(0, 9):] + str(i)) for i in range(40) for p in passages]
    assert op1_rows(make_docs(rows)) == sorted(removed_by_hand(rows))
    assert len(rounds) > (1 if hot == 2 else 0)


def test_repeats_leave_no_exchange_behind(spark, make_docs, rng):
    docs = make_docs(texts_with_repeats(rng, 40)).cache()
    docs.count()
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = lambda: {b for b in str(manager.getAllBlocks().mkString(" ")).split() if b.startswith("shuffle_")}
    before = blocks()
    found = suffix_dedup.remove_repeats(docs)
    deadline = time.time() + 20
    while blocks() - before and time.time() < deadline:  # files go in the background
        time.sleep(0.2)
    assert not blocks() - before
    assert found.count() == 40


def test_runs_are_packed_by_bucket(spark):
    rng = np.random.default_rng(1)
    doc = np.concatenate([rng.integers(-50, 4000, 5000), [suffix_dedup.LAST, -(1 << 62)]])
    at = rng.integers(0, 30_000, len(doc)) | (rng.integers(0, 2, len(doc)) << suffix_dedup.START_BITS)
    n = rng.integers(1, suffix_dedup.MOST_RUN + 1, len(doc))
    bucket, packed = suffix_dedup.by_bucket(doc, at, n, 7)
    assert sorted(bucket) == list(range(7))
    got = [(b, *r) for b, p in zip(bucket, packed) for r in zip(*suffix_dedup.unpack_runs(p))]
    assert sorted(r[1:] for r in got) == sorted(zip(doc, at, n))
    assert [r[1:3] for r in got if r[0] == 3] == sorted(r[1:3] for r in got if r[0] == 3)
    rows = [(int(b), int(d), int(a) >> suffix_dedup.START_BITS) for b, d, a, _ in got]
    frame = spark.createDataFrame(rows, "b int, doc long, sub long")
    assert frame.where("b != pmod(xxhash64(doc, sub), 7)").count() == 0
    few = suffix_dedup.by_bucket(np.repeat(np.arange(1000), 110), np.tile(np.arange(110) * 30, 1000), np.full(110_000, 33), 7)[1]
    assert sum(map(len, few)) < 6 * 110_000


@pytest.mark.parametrize("times", [1, 3])
def test_single_strings_are_compared_by_bytes(times):
    strings = [bytes([i % 3]) * 99 + bytes([j]) for i in range(6) for j in (0, 1)] * times
    doc, at = np.arange(len(strings))[::-1].copy(), np.arange(len(strings)) % 2
    first = {s: (d, a) for s, d, a in sorted(zip(strings, doc, at), key=lambda r: r[1:], reverse=True)}
    d, a, n = suffix_dedup.repeated_whole(doc, at, strings)
    assert sorted(zip(d, a)) == sorted((x, y) for s, x, y in zip(strings, doc, at) if (x, y) != first[s])
    assert (n == 1).all()


def test_parse_does_not_depend_on_segments(rng, monkeypatch):
    raws = [t.encode() for _, t in texts_with_repeats(rng, 30)]
    key = lambda: sorted(zip(*[x.tolist() for x in suffix_dedup.parse_texts(raws)]))
    whole = key()
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    assert key() == whole


def test_spans_and_kept_bytes_fit(make_docs, rng):
    rows = texts_with_repeats(rng, 30)
    by_id = dict(rows)
    for r in suffix_dedup.remove_repeats(make_docs(rows)).collect():
        raw = by_id[r["doc_id"]].encode()
        for s in reversed(r["spans"]):
            raw = raw[:s["start"]] + raw[s["end"]:]
        assert bytes(r["kept"]) == raw


def test_repeats_of_odd_rows(make_docs, odd_rows, clashing):
    long = hashlib.sha512(b"1").hexdigest() + hashlib.sha512(b"2").hexdigest()[:22]
    rows = [*odd_rows, (20, long), (21, long), (21, long), (None, long + "!")]
    got = suffix_dedup.remove_repeats(make_docs(rows, clashing)).select("doc_id", "n_removed", "n_bytes").collect()
    assert len(got) == len(rows)
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got if r[2] in (150, 151)) == [
        (False, 20, 0), (False, 21, 150), (False, 21, 150), (True, 0, 150)]
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


def op6_rows(df):
    return sorted((tuple(r) for r in exact_dedup.exact_groups(df).collect()), key=str)


def exact_by_hand(rows):
    groups = {}
    for r in rows:
        text = r[1] or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), r[0] is None, r[0]))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for i, m in enumerate(members):
            out.append((m[2], members[0][2], len(members), i == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [1000, 3])
def test_exact_groups(make_docs, rng, monkeypatch, odd_rows, clashing, split):
    monkeypatch.setattr(exact_dedup, "SPLIT", split)  # 3: groups are sorted in parts
    rows = [(100 + i, rng.choice(["a b", "ab", " ab", "abc", "É é", "Éé\n", ""])) for i in range(60)] + odd_rows
    assert op6_rows(make_docs(rows, clashing)) == exact_by_hand(rows)
    assert op6_rows(make_docs([])) == []


def test_exact_stage_keeps_one_row_and_all_columns(make_docs):
    docs = make_docs([(1, "x y", "en", "s"), (1, "x y", "en", "s"), (2, "xy", "fr", "t"), (3, "z", "de", None)], ("kept",))
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "x y"), (3, "z")]


def components_by_hand(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def texts_with_near_copies(rng, n, words=60):
    seeds = [[rng.choice("the of and to in is was on".split()) + str(rng.randint(0, 300)) for _ in range(rng.randint(6, words))]
             for _ in range(6)]
    line = "this very common line stands in most of the texts of this table".split()
    rows = []
    for i in range(n):
        w = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            j = rng.randrange(len(w))
            w[j:j + 1] = rng.choice([[], ["new%d" % rng.randint(0, 9)], [w[j], "in%d" % rng.randint(0, 9)]])
        if rng.random() < .5:
            w += line
        if rng.random() < .2:
            w = [str(rng.random()) for _ in range(rng.randint(1, 40))] + line
        rows.append((i, (" " if rng.random() < .8 else "\n").join(w).title() if rng.random() < .3 else " ".join(w)))
    return rows


@pytest.mark.parametrize("common,group", [(100, 256), (3, 4)])
def test_near_copies_equal_brute_force(make_docs, rng, monkeypatch, common, group):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rows = texts_with_near_copies(rng, 150)
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(make_docs(rows)).collect()), key=str)
    assert got == components_by_hand(rows)


def test_near_copies_of_odd_rows(make_docs, odd_rows, clashing):
    rows = [r[:2] for r in odd_rows]
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(make_docs(rows, clashing)).collect()), key=str)
    assert got == components_by_hand(rows)
    assert ngram_join.near_duplicates(make_docs([])).count() == 0
    out = ngram_join.drop_near_copies(make_docs([(1, "a b c d e f"), (2, "A b c  d e f"), (2, "A b c  d e f"), (3, None)]))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_bounds_never_lie_below_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 2500))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert ngram_join.overlap_bound(ngram_join.sketch(a), ngram_join.sketch(b)) >= both
        skewed = np.full(600, 5 << 20, np.uint64) + np.arange(600, dtype=np.uint64)  # all in one bucket
        assert ngram_join.overlap_bound(ngram_join.sketch(skewed), ngram_join.sketch(skewed)) >= 600


def test_components_of_chains_and_stars(spark, rng):
    n = 500
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (150, 149), (149, 150)]
    edges += [(rng.randrange(200, 500), rng.randrange(200, 500)) for _ in range(200)]
    rng.shuffle(edges)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for e in edges for x in e if e[0] != e[1]}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_near_copies_without_ids_and_with_few(make_docs, rng):
    """Null and repeated ids: sets are found by their content, whatever the ids."""
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=60)
        texts += [" ".join(base), " ".join([*base, "end"]), " ".join(base[:-1])]
    by_place = {r[0]: r[2] for r in components_by_hand(list(enumerate(texts)))}
    want = {t: by_place[i] for i, t in enumerate(texts)}
    for ids in (lambda i: None, lambda i: i % 3):
        docs = make_docs([(ids(i), t) for i, t in enumerate(texts)])
        rows = ngram_join._classes(ngram_join.with_row(docs.select("doc_id", "text")))
        cls = {r["__row"]: r["cls"] for r in rows.collect()}
        named = {r["__row"]: r["text"] for r in ngram_join.with_row(docs).collect()}
        pairs = {(cls[k], want[t]) for k, t in named.items()}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_sets_that_share_an_id_go_by_the_second(rng):
    grams, bounds = ngram_join.shingle_sets([b"a b c d e f", b"a b c d e f", b"u v w x y z", b""])
    ids, second = ngram_join.set_ids(grams, bounds)
    assert ids[0] == ids[1] and second[0] == second[1] and ids[0] != ids[2] and second[0] != second[2] and ids[3] == second[3] == 0
    settled = ngram_join._settled(ids, second, ids[:1])
    assert settled.tolist() == [second[0], second[0], ids[2], 0]


def test_suffix_ranks_are_the_order_of_the_bytes(rng):
    """The dictionary's ranks against sorting the strings themselves."""
    for alphabet in (b"ab", b"a", bytes(range(256))):
        parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(100, 260))) for _ in range(6)]
        data = b"".join([*parts, parts[0], parts[2][7:180]]) + b"\xff" * 120
        ranks = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8))
        strings = [data[i:i + suffix_dedup.LENGTH] for i in range(len(data) - suffix_dedup.LENGTH + 1)]
        place = {x: i for i, x in enumerate(sorted(set(strings)))}
        order = np.unique(ranks[:len(strings)], return_inverse=True)[1]
        assert order.tolist() == [place[x] for x in strings]
    assert len(suffix_dedup.suffix_ranks(np.zeros(0, np.uint8))) == 0
