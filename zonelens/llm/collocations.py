"""Phrases whose words stand together more often than chance, by best-first branch and bound.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and into words
at blanks and tabs.  Per language, a phrase of 2 to ``MOST_WORDS`` words that occurs a >=
``LEAST`` times within pieces is a candidate; its score is the least of
1000 * a * n / (l * r) over its cuts into a first part (l) and a rest (r).  Candidates that
occur only inside one longer candidate are dropped; the best ``TOP`` of a language stay.

* **Corpus.**  Tasks turn texts into blocks of word numbers with the block's own word list.
  Lists are summed to the vocabulary of frequent words, numbered by language and falling
  count (``common.numbered``), and joined back to the blocks, a row per block and word; no
  vocabulary is broadcast.  Rare words end a phrase, as piece ends do: no candidate has one.
* **Bound.**  Cut after its first word, a phrase has a <= r, so it scores at most
  1000 * n / f(first word), and so does every phrase that grows from it.  Words are numbered
  by count, so the frontier's best entries, the rarest first words, are a range of numbers.
* **Growth.**  A round expands the best part of the frontier: words that make up a growing
  share of the language's text, but none whose bound is below the ``TOP``-th score known.
  Level by level, tasks count the one-word extensions of the prefixes that survived, in
  their blocks first; Spark sums them.  A prefix is looked up in a bit array of its hash:
  a false hit only counts a phrase in vain, as sums below ``LEAST`` go, so its size
  (at most ``MOST_BITS`` bits, the only data that is broadcast) never changes the result.
* **Dropping** needs no longer phrase: with each count go the least and greatest word
  before and after the phrase; if they are equal, every occurrence has that neighbour.
* **Rests** that begin with a word not yet expanded are counted by themselves.
* The phrases of all rounds are one table, written anew each round: the plans that score
  them, which the driver holds, are no longer in a later round.
* A language is settled when no word outside has a bound as high as its ``TOP``-th score
  (so ties are found too), or when all its words are expanded.

Scores are computed in decimals of 38 digits.  One row per language and count class, and one
per language, come to the driver.

Defined results: null texts have no words; a null language is ``und`` (together with
documents of that name); repeated rows and ids count as often as they are there; pieces
never reach across documents; an empty table, or one without candidates, gives no rows;
further columns take no part.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonelens.llm.common import numbered, stored, table, slices
from zonelens.session import prepare_workers

LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Piece ends: [.,;:!?\x0A-\x0D]; words have none of them and no blank or tab.
ENDS = r"[.,;:!?\n\x0b\x0c\r]+"
#: Words of a block, of blocks counted together in a task, and rows of a batch of counts.
BLOCK_WORDS, COUNT_WORDS, BATCH = 1 << 18, 1 << 21, 100_000
#: Of a language's frequent words, the share expanded up to each round.
SHARES = (1 / 16, 1 / 4, 1)
#: Bits per frequent word and per phrase, and of the whole array.  Every place of the corpus
#: is looked up among the phrases: of those that miss, one in ``PHRASE_BITS`` is a false hit.
BITS, PHRASE_BITS, LEAST_BITS, MOST_BITS = 16, 256, 1 << 16, 1 << 27


# ---------------------------------------------------------------- corpus

def _words(texts):
    """The words of the texts (Arrow strings) in a row; ``.`` where a piece ends."""
    import pyarrow.compute as pc

    low = pc.ascii_lower(pc.fill_null(texts, ""))
    cut = pc.replace_substring_regex(low, ENDS, " . ")
    cut = pc.binary_join_element_wise(pc.replace_substring(cut, "\t", " "), " .", "")
    words = pc.list_flatten(pc.split_pattern(cut, " "))
    return words.filter(pc.not_equal(words, ""))


def blocks_of(docs: DataFrame) -> DataFrame:
    """block, lang, n (words), words, counts, ids (32-bit numbers into words; -1: end)."""

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("block", pa.string()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())),
                            ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def made(lang):
            coded = pa.chunked_array(held.pop(lang), pa.string()).combine_chunks().dictionary_encode()
            del sizes[lang]
            words, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            end = words.index(".")
            ids = np.where(ids == end, -1, ids - (ids > end)).astype("<i4")
            del words[end]
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            return pa.RecordBatch.from_pylist([{"block": uuid.uuid4().hex, "lang": lang, "n": int(counts.sum()), "words": words,
                                                "counts": counts, "ids": ids.tobytes()}], schema=schema)

        for batch in slices(batches):
            langs = batch["lang"].to_pylist()
            for lang in dict.fromkeys(langs):
                found = _words(batch["text"].filter(pa.array([x == lang for x in langs])))
                held.setdefault(lang, []).append(found)
                sizes[lang] = sizes.get(lang, 0) + len(found)
                if sizes[lang] >= BLOCK_WORDS:
                    yield made(lang)
            while sum(sizes.values()) >= 4 * BLOCK_WORDS or len(sizes) > 1000:
                yield made(max(sizes, key=sizes.get))
        for lang in list(held):
            yield made(lang)

    prepare_workers(docs.sparkSession)
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))
    return stored(rows.mapInArrow(read, "block string, lang string, n long, words array<string>, counts array<long>, ids binary"), "phrase-blocks")


def _recoded(blocks: DataFrame, vocabulary: DataFrame, width: str) -> DataFrame:
    """lang and ids (numbers of the vocabulary, -1 for the end of a phrase) of each block."""
    bits = _bits(vocabulary.select(F.xxhash64("word").alias("h")))

    def listed(batches):
        import pyarrow as pa
        import xxhash

        for batch in slices(batches, 1):
            words = batch["words"][0].values
            h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
            local = np.flatnonzero(_set(h, bits))
            for a in range(0, len(local), BATCH):
                here = pa.array(local[a:a + BATCH].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.repeat(batch["block"][0], len(here)), pa.repeat(batch["lang"][0], len(here)), here, words.take(here)],
                                                 names=["block", "lang", "local", "word"])

    of = blocks.select("block", "lang", "words").mapInArrow(listed, "block string, lang string, local int, word string")
    known = of.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(
        F.collect_list(F.struct("local", "id")).alias("known"))  # the words of one block

    def recode(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            local = np.frombuffer(batch["ids"][0].as_py(), "<i4")
            pairs = batch["known"][0].values
            code = np.full(batch["size"][0].as_py() + 1, -1, width)
            code[pairs.field("local").to_numpy()] = pairs.field("id").to_numpy()
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array([code[local].tobytes()], pa.binary())], names=["lang", "ids"])

    rows = blocks.select("block", "lang", F.size("words").alias("size"), "ids").join(known, "block").select("lang", "size", "ids", "known")
    return stored(rows.mapInArrow(recode, "lang string, ids binary"), "phrase-corpus")


# ---------------------------------------------------------------- counting

def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _set(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    h = h & np.uint64(64 * len(bits) - 1)
    return bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1) == 1


def _in_bits(columns: list[np.ndarray], bits: np.ndarray) -> np.ndarray:
    return _set(_hash(columns), bits)


def _bits(hashes: DataFrame, each: int = BITS) -> np.ndarray:
    """The bit array of ``hashes`` (h long), put together by Spark."""
    count = hashes.count()
    size = LEAST_BITS
    while size < min(MOST_BITS, each * count):
        size *= 2
    spot = F.col("h").bitwiseAND(size - 1)
    rows = hashes.groupBy(F.shiftright(spot, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(h & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _bit_array(phrases: DataFrame) -> np.ndarray:
    """Bits of the hashes of ``phrases`` (w, all of one length)."""

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                w = batch["w"].flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(_hash(list(w.T)).view(np.int64))], names=["h"])

    return _bits(phrases.select("w").mapInArrow(hashed, "h long"), PHRASE_BITS)


def _grouped(x: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """Of the phrases of ``length`` words at the places ``at`` of ``x``: their words, count,
    and the least and greatest word before and after."""
    columns = [x[at + k].astype(np.int64) for k in range(length)]
    if max((int(c.max()) for c in columns if len(c)), default=0) >= 1 << 31:
        dense = np.unique(np.concatenate(columns), return_inverse=True)[1].reshape(length, -1)
    else:
        dense = columns
    code = dense[0]
    for k in range(1, length):
        if k > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = (code << 31) | dense[k]
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order], prepend=-1))
    at = at[order]
    before, after = x[at - 1].astype(np.int64), x[at + length].astype(np.int64)
    return [*(c[order][edges] for c in columns), np.diff(np.append(edges, len(at))), np.minimum.reduceat(before, edges),
            np.maximum.reduceat(before, edges), np.minimum.reduceat(after, edges), np.maximum.reduceat(after, edges)]


STATS = ("f", "before0", "before1", "after0", "after1")


def _count(corpus: DataFrame, width: str, lengths: list[int], wanted) -> DataFrame:
    """w, f, inside (every occurrence has one and the same neighbour) of phrases of the
    lengths; ``wanted(lang, x, at, length)`` chooses among places where enough words follow."""
    most = max(lengths)
    names = [*(f"w{k}" for k in range(most)), *STATS]

    def count(batches):
        import pyarrow as pa

        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def counted(lang):
            x = np.concatenate([np.full(1, -1, width), *held.pop(lang), np.full(most + 1, -1, width)])
            del sizes[lang]
            at = np.flatnonzero(x[:-most] >= 0)
            for length in range(2, most + 1):
                at = at[x[at + length - 1] >= 0]
                if length not in lengths:
                    continue
                here = wanted(lang, x, at, length)
                if not len(here):
                    continue
                got = _grouped(x, here, length)
                got[length:length] = [np.full(len(got[0]), -1)] * (most - length)
                for a in range(0, len(got[0]), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a:a + BATCH], pa.int64()) for c in got], names=names)

        for batch in batches:
            for lang, ids in zip(batch["lang"].to_pylist(), batch["ids"]):
                held.setdefault(lang, []).append(np.append(np.frombuffer(ids.as_buffer(), width), np.full(1, -1, width)))
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                if sizes[lang] >= COUNT_WORDS:
                    yield from counted(lang)
            while sum(sizes.values()) >= 2 * COUNT_WORDS:
                yield from counted(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from counted(lang)

    rows = corpus.mapInArrow(count, ", ".join(f"{c} long" for c in names))
    sums = rows.groupBy(*names[:most]).agg(F.sum("f").alias("f"), *(
        (F.min if c.endswith("0") else F.max)(c).alias(c) for c in STATS[1:]))
    words = F.filter(F.array(*names[:most]), lambda w: w >= 0)
    one = lambda c: (F.col(f"{c}0") == F.col(f"{c}1")) & (F.col(f"{c}0") >= 0)
    return sums.select(words.alias("w"), "f", (one("before") | one("after")).alias("inside"))


# ---------------------------------------------------------------- scores

def _scored(found: DataFrame, counts: DataFrame, langs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """lang, n, w, a, l, r, score of the phrases ``found`` (w, f); ``counts`` (w, f) has all parts."""
    first = vocabulary.select("lang", F.col("id").alias("__first"))
    of = found.withColumn("__first", F.col("w")[0]).join(first, "__first").join(langs.select("lang", "n"), "lang")
    cuts = of.select("lang", "n", "w", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("slice(w, 1, k)")).withColumn("rest", F.expr("slice(w, k + 1, size(w) - k)"))
    part = lambda name, f: counts.select(F.col("w").alias(name), F.col("f").alias(f))
    whole = lambda a, b: f"CAST({a} AS DECIMAL(18, 0)) * CAST({b} AS DECIMAL(18, 0))"
    score = F.expr(f"({whole('1000 * a', 'n')}) div ({whole('l', 'r')})")
    each = cuts.join(part("first", "l"), "first").join(part("rest", "r"), "rest").withColumn("score", score)
    least = each.groupBy("lang", "n", "w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "n", "w", "a", "cut.l", "cut.r", "cut.score")


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The best of each language, with all that tie in score and count."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    return scored.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= top)


def _spelled(best: DataFrame, vocabulary: DataFrame, top: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    words = best.select("w", F.posexplode("w").alias("k", "id")).join(vocabulary.select("id", "word"), "id")
    phrase = words.groupBy("w").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(k, word))), x -> x.word)"), " ").alias("phrase"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return best.drop("rank").join(phrase, "w").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


class _Frontier:
    """Of one language: its words by class of count, and how far it is expanded."""

    def __init__(self, lang: str, n: int, first: int, classes: list) -> None:
        self.lang, self.n, self.first = lang, n, first
        self.classes = sorted(classes)  # (class, words, occurrences, least count), rarest first
        self.end = first + sum(c[1] for c in classes)
        self.cut, self.done, self.known = self.end, 0, 0  # ids from ``cut`` are expanded; least score of the best

    def bound(self, f: int) -> int:
        return 1000 * self.n // f

    def open(self) -> bool:
        """Some word outside may begin a phrase as good as the best."""
        return self.done < len(self.classes) and self.bound(self.classes[self.done][3]) >= self.known

    def grow(self, share: float) -> tuple[int, int]:
        """Takes in classes up to the share; returns the new ids [from, to)."""
        to, total = self.cut, sum(c[2] for c in self.classes)
        taken = sum(c[2] for c in self.classes[:self.done])
        while self.open():
            _, words, occurrences, _ = self.classes[self.done]
            if self.cut < to and taken + occurrences > share * total:
                break
            self.cut, self.done, taken = self.cut - words, self.done + 1, taken + occurrences
        return self.cut, to


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, shares=SHARES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language of ``docs``
    (lang, text)."""
    spark = docs.sparkSession
    blocks = blocks_of(docs)
    counted = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(
        F.sum("x.counts").alias("f")).where(F.col("f") >= least).withColumn("falling", -F.col("f"))
    vocabulary = numbered(counted, "lang", "falling", "word", name="phrase-words").select("lang", "word", "f", F.col("position").alias("id"))
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    langs = stored(vocabulary.groupBy("lang").agg(F.min("id").alias("first"), F.max("id").alias("last")).join(sizes, "lang"), "phrase-langs")
    classes = vocabulary.groupBy("lang", F.floor(F.log2("f") * 4).alias("c")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("f").alias("occurrences"), F.min("f").alias("least"))
    by_lang: dict[str, list] = {}
    for r in classes.collect():  # some hundred rows a language
        by_lang.setdefault(r["lang"], []).append((r["c"], r["words"], r["occurrences"], r["least"]))
    open_ = {r["lang"]: _Frontier(r["lang"], r["n"], r["first"], by_lang[r["lang"]]) for r in langs.collect()}
    shape = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if not open_:
        return spark.createDataFrame([], shape)
    width = "<i4" if max(x.end for x in open_.values()) < 1 << 31 else "<i8"
    corpus = _recoded(blocks, vocabulary, width)
    single = vocabulary.select(F.array("id").alias("w"), "f")
    found, results = None, []  # found: the phrases of all rounds, one table
    for turn in range(1000):
        share = shares[min(turn, len(shares) - 1)]
        ranges = {x.lang: (*x.grow(share), x.end) for x in open_.values()}
        here = corpus.where(F.col("lang").isin(list(ranges)))
        bits: dict[int, np.ndarray] = {}
        levels = []
        for length in range(2, most_words + 1):
            new = stored(_count(here, width, [length], _Extensions(ranges, bits)).where(F.col("f") >= least), f"phrases-{length}")
            levels.append(new)
            if new.isEmpty() or length == most_words:
                break
            bits[length] = _bit_array(new if found is None else new.unionByName(found.where(F.size("w") == length)))
        found = stored(reduce(DataFrame.unionByName, [*levels, *([found] if found is not None else [])]), "phrases")
        settled = _settle(open_, found, single, langs, vocabulary, here, width, ranges, most_words, top)
        if settled is not None:
            results.append(settled)
        open_ = {k: x for k, x in open_.items() if x.open()}
        if not open_:
            return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], shape)


class _Extensions:
    """Chooses the places where a phrase may be frequent: its first word is new in the
    frontier, its prefix has survived, and so have its suffixes that begin with a word
    that is expanded (``bits`` by length)."""

    def __init__(self, ranges, bits: dict) -> None:
        self.ranges, self.bits = ranges, dict(bits)

    def __call__(self, lang, x, at, length):
        low, high, _ = self.ranges[lang]
        at = at[(x[at] >= low) & (x[at] < high)]
        if length == 2:
            return at
        at = at[_in_bits([x[at + k] for k in range(length - 1)], self.bits[length - 1])]
        for skip in range(1, length - 1):
            at = at[(x[at + skip] < low) | _in_bits([x[at + k] for k in range(skip, length)], self.bits[length - skip])]
        return at


class _Listed:
    """Chooses the places of listed phrases (by their bits) whose first word is outside."""

    def __init__(self, ranges, bits: dict) -> None:
        self.ranges, self.bits = ranges, bits

    def __call__(self, lang, x, at, length):
        at = at[x[at] < self.ranges[lang][0]]
        return at[_in_bits([x[at + k] for k in range(length)], self.bits[length])]


def _settle(open_, found, single, langs, vocabulary, corpus, width, ranges, most_words, top) -> DataFrame | None:
    """Scores all that the open languages have so far, notes each one's least good score,
    and returns the results of those that it settles."""
    known = single.unionByName(found.select("w", "f"))
    mine = vocabulary.where(F.col("lang").isin(list(open_))).select(F.col("id").alias("__id"))
    kept = found.where(~F.col("inside") | (F.size("w") == most_words)).select("w", "f")
    candidates = kept.withColumn("__id", F.col("w")[0]).join(mine, "__id").drop("__id")
    if any(x.cut > x.first for x in open_.values()):  # rests may begin with a word outside
        rests = candidates.select(F.explode(F.expr("transform(sequence(1, size(w) - 1), k -> slice(w, k + 1, size(w) - k))")).alias("w")).where("size(w) > 1").distinct()
        wanted = stored(rests.join(known, "w", "left_anti"), "phrase-rests")
        lengths = [r["m"] for r in wanted.select(F.size("w").alias("m")).distinct().collect()]  # at most ``most_words``
        bits = {m: _bit_array(wanted.where(F.size("w") == m)) for m in sorted(lengths)}
        if bits:
            more = _count(corpus, width, sorted(bits), _Listed(ranges, bits)).select("w", "f").join(wanted, "w", "left_semi")
            known = known.unionByName(stored(more, "phrase-counts"))
    best = stored(_best(_scored(candidates, known, langs, vocabulary), top), "phrase-best")
    for r in best.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect():
        if r["n"] >= top:
            open_[r["lang"]].known = max(open_[r["lang"]].known, r["least"])
    done = [k for k, x in open_.items() if not x.open()]
    return _spelled(best.where(F.col("lang").isin(done)), vocabulary, top) if done else None


def op13_branch_and_bound(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
spots AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) AS r(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM spots GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE m >= 2),
sub AS (
  SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS longer
  FROM c, range(1, 6) AS x(i), range(1, 6) AS y(j) WHERE j <= m AND j > i AND j - i + 1 < m GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN sub USING (lang, phrase) WHERE sub.longer IS NULL OR 100 * sub.longer < 100 * c.a),
cuts AS (
  SELECT lang, phrase, a, n, k, l.f AS l, r.f AS r, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) x JOIN n USING (lang)
  JOIN (SELECT lang, phrase AS first, f FROM f) l ON l.lang = x.lang AND l.first = array_to_string(ws[1:k], ' ')
  JOIN (SELECT lang, phrase AS rest, f FROM f) r ON r.lang = x.lang AND r.rest = array_to_string(ws[k + 1:m], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored QUALIFY rank <= 2000
"""
