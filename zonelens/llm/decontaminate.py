"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Method: words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
A first pass counts in how many documents each ``SEED``-word n-gram of the test items
occurs; an item's seeds are its rare ones, of at most twice its median frequency plus
``SLACK`` (so an item that many documents copy keeps its seeds, whatever the size of
the corpus).  A second pass joins every whole document to the items by these seeds.
For each document and item, seeds on near diagonals mark a passage, which is aligned
word by word with the item (Smith-Waterman: match 2, mismatch -1, gap -1).  The score
is the best alignment's share of the perfect score, and a pair is a leak if the score
and the share of matching words reach ``LEAST``.

Seeds are rarer than their document frequency suggests only for chance hits, so before
an alignment a bound is taken: words of the passage that occur in the item at all.

The test items are the query set.  They are handled in blocks of at most
``BLOCK_WORDS`` words, so what is broadcast has a fixed bound, and each block reads the
documents twice without any shuffle of texts.

Of an item's m words, ``needed(m)`` must match in one alignment: all of up to five; all but
one of six to nine (one edit leaves a seed whole); ``SURE`` of ten to fifteen; half of longer ones.

Defined results: null or empty texts match nothing; an item of fewer than ``SEED`` words is
found only in a document that has no other words, as within a text it cannot be told from
chance; equal items are reported each; a null
item_id or doc_id is carried; repeated documents are reported each; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import ROW, table, with_row, without_rows
from zonelens.llm.words import LETTERS, Words, pieces
from zonelens.session import prepare_workers

SEED, SLACK, LEAST, SURE = 3, 10, 0.5, 8
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, 1, 1


def needed(m: int) -> float:
    """Words of an item of m words that must match."""
    return max(LEAST * m, min(m if m <= 2 * SEED - 1 else m - 1, SURE))


class Items:
    """A block of test items: word hashes, n-grams and where they stand."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        self.ids = ids
        w = Words([(t or "").encode("utf-8", "replace") for t in texts], LETTERS)
        self.words = [w.hash[a:a + n] for a, n in zip(w.first, w.count)]
        self.whole: dict[bytes, list[int]] = {}  # items without a seed
        for i, words in enumerate(self.words):
            if 0 < len(words) < SEED:
                self.whole.setdefault(words.tobytes(), []).append(i)
        grams, at = w.grams(SEED)
        self.keys, self.gram = np.unique(grams, return_inverse=True)
        self.item = w.doc[at].astype(np.int64)
        self.place = at - w.first[self.item]
        self.seed = np.ones(len(grams), bool)
        self._index()

    def _index(self) -> None:
        """Seeds by n-gram, and a bit per hash prefix that says which hashes cannot be one."""
        order = np.argsort(self.gram, kind="stable")
        self.order = order[self.seed[order]]
        live = np.bincount(self.gram[self.order], minlength=len(self.keys))
        self.upto = np.concatenate([[0], np.cumsum(live)])
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys[live > 0] >> np.uint64(42)).astype(np.int64)] = True

    def choose(self, frequency: np.ndarray) -> None:
        """Keeps each item's rare n-grams as seeds."""
        f = frequency[self.gram]
        for i in np.unique(self.item):
            of = self.item == i if len(self.ids) < 64 else slice(*np.searchsorted(self.item, [i, i + 1]))
            self.seed[of] = f[of] <= 2 * np.median(f[of]) + SLACK
        self._index()

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``grams`` of seeds, and the n-gram each is."""
        pos = np.flatnonzero(self.maybe[(grams >> np.uint64(42)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, grams[pos]), max(0, len(self.keys) - 1))
        same = self.keys[key] == grams[pos] if len(self.keys) else np.zeros(0, bool)
        return pos[same], key[same]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and first and last + 1 word of the passage.

    One row of the matrix per item word; gaps along the row are a running maximum.
    Each cell carries where its alignment began."""
    m = len(passage)
    ramp = np.arange(m + 1, dtype=np.int64) * GAP
    here = np.arange(m + 1, dtype=np.int64)
    row, began = np.zeros(m + 1, np.int64), here.copy()
    best = (0, 0, 0)
    for word in item:
        step = np.where(passage == word, MATCH, -MISMATCH)
        new, start = np.zeros(m + 1, np.int64), here.copy()
        new[1:] = row[:-1] + step
        start[1:] = began[:-1]
        up = row - GAP
        better = up > new
        new[better], start[better] = up[better], began[better]
        dead = new <= 0
        new[dead], start[dead] = 0, here[dead]
        run = np.maximum.accumulate(new + ramp)
        from_ = np.maximum.accumulate(np.where(new + ramp >= run, here, 0))
        row, began = run - ramp, start[from_]
        dead = row <= 0
        row[dead], began[dead] = 0, here[dead]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = int(row[j]), int(began[j]), j
    return best


def _passages(places: np.ndarray, diagonals: np.ndarray, m: int, n: int) -> list[tuple[int, int]]:
    """Word ranges of a document around seeds of near diagonals, not overlapping."""
    pad = m // 4 + SEED
    spans = sorted({(max(0, int(d) - pad), min(n, int(d) + m + pad)) for d in diagonals})
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def match_piece(items: Items, raws: list[bytes]) -> list[tuple]:
    """(text number, item number, score, matched words, item words, first, last + 1 word)."""
    w = Words(raws, LETTERS)
    grams, at = w.grams(SEED)
    pos, key = items.hits(grams)
    out = []
    if items.whole:
        for d in np.flatnonzero((w.count > 0) & (w.count < SEED)):
            m = int(w.count[d])
            for i in items.whole.get(w.hash[w.first[d]:w.first[d] + m].tobytes(), ()):
                out.append((int(d), i, 1.0, m, m, 0, m))
    if not len(pos):
        return out
    n = items.upto[key + 1] - items.upto[key]
    rows = np.repeat(np.arange(len(pos)), n)
    slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.upto[key], n)
    entry = items.order[slot]
    word = at[pos[rows]]
    doc, item = w.doc[word].astype(np.int64), items.item[entry]
    place = word - w.first[doc]
    order = np.lexsort((place, item, doc))
    doc, item, place, diagonal = doc[order], item[order], place[order], (place - items.place[entry])[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0)]))
    for a, b in zip(first, np.append(first[1:], len(doc))):
        d, i = int(doc[a]), int(item[a])
        text, test = w.hash[w.first[d]:w.first[d] + w.count[d]], items.words[i]
        m, best = len(test), (0.0, 0, 0, 0)
        need = needed(m)
        ordered = np.sort(test)
        for lo, hi in _passages(place[a:b], diagonal[a:b], m, len(text)):
            passage = text[lo:hi]
            near = np.minimum(np.searchsorted(ordered, passage), m - 1)
            if np.count_nonzero(ordered[near] == passage) < need:
                continue
            score, s, e = align(test, passage)
            share = score / (MATCH * m)
            if share >= LEAST and share > best[0]:
                both, times = np.unique(passage[s:e], return_counts=True)
                mine, wanted = np.unique(test, return_counts=True)
                _, x, y = np.intersect1d(both, mine, assume_unique=True, return_indices=True)
                matched = int(np.minimum(times[x], wanted[y]).sum())
                if matched >= need:
                    best = share, matched, lo + s, lo + e
        if best[0]:
            out.append((d, i, best[0], best[1], m, best[2], best[3]))
    return out


def _blocks(benchmark: DataFrame):
    """Blocks of items, each of at most BLOCK_WORDS words (or one item)."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len((r["text"] or "").split())
        if ids and size + n > BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += n
    if ids:
        yield Items(ids, texts)


def _text_pieces(batches):
    for batch in batches:
        texts = [t if isinstance(t, str) else None for t in batch["text"]]
        for first, raws in pieces(texts):
            yield batch.iloc[first:first + len(raws)], raws


def gram_frequency(docs: DataFrame, items: Items) -> np.ndarray:
    """Documents that hold each n-gram of the items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches):
        import pandas as pd

        total = np.zeros(len(shared.value.keys), np.int64)
        for _, raws in _text_pieces(batches):
            w = Words(raws, LETTERS)
            grams, at = w.grams(SEED)
            pos, key = shared.value.hits(grams)
            pairs = np.unique(w.doc[at[pos]].astype(np.int64) * len(total) + key)
            total += np.bincount(pairs % max(1, len(total)), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen, "n": total[seen]})

    out = np.zeros(len(items.keys), np.int64)
    counted = docs.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most one row per n-gram of the block
        out[r["gram"]] = r["n"]
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, matched_words, item_words, first_word, end_word: one
    row per document and test item that it holds (best passage)."""
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = (f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, matched_words int, item_words int, "
              "first_word int, end_word int")
    spark, found = docs.sparkSession, None
    prepare_workers(spark)
    for items in _blocks(benchmark):
        items.choose(gram_frequency(docs, items))
        shared = spark.sparkContext.broadcast(items)

        def match(batches, shared=shared):
            import pandas as pd

            ids = shared.value.ids
            for rows, raws in _text_pieces(batches):
                got = match_piece(shared.value, raws)
                doc_ids = rows["doc_id"].to_numpy()
                yield pd.DataFrame([(doc_ids[d], ids[i], *rest) for d, i, *rest in got],
                                   columns=["doc_id", "item_id", "score", "matched_words", "item_words", "first_word", "end_word"])

        part = docs.select("doc_id", "text").mapInPandas(match, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a test item."""
    keyed = with_row(docs)
    leaks = find_leaks(keyed.select(F.col(ROW).alias("doc_id"), "text"), benchmark)
    return without_rows(keyed, leaks.select(F.col("doc_id").alias(ROW)))


def op3_rare_seeds(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
