"""Language identification by prediction by partial matching (PPM).

Method: per language, a tree of byte contexts of order 0 to ``ORDER`` holds frozen
counts.  A byte costs -log2(count / (total + distinct)) bits in the longest context
that has seen it; each longer known context that has not costs its escape,
-log2(distinct / (total + distinct)) (method C); below order 0 a byte costs 8 bits.
A text's code length under a language is the exact sum over all its bytes; the
shortest code wins, and the score is the posterior 2^-length over the languages.

A tree is kept sparse, as sorted arrays of the contexts and of the byte strings (context
and next byte) that its language has, all 256 byte values alike: some 12 bytes for each
distinct string, so a worker's memory grows with the sum over the languages and not with
their product.  A piece of text is reduced to its distinct strings of ``ORDER`` + 1 bytes
first; these are looked up in each tree, from the longest context down.

Training is on a bounded sample: of the documents of the learning fold with 1 to
``MOST_CHARS`` characters, per language the ``PER_LANGUAGE`` of least hash of doc_id.
Texts are lower-cased.

As a filter (``drop_unknown_language``) a text stays if it has a letter and its best code
is no longer than the text itself, ``MOST_BITS`` bits a byte; where no language was learned,
every text with a letter stays.

Defined results: null text, or text with no letter, is ``und`` with score 0; a null
doc_id is never learned from and not held out; equal code lengths go to the least
language name; without any learned language every text is ``und``; repeated rows are
scored one by one; an empty table gives no rows; other columns are ignored.
"""

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import least_by_hash, table, with_ids
from zonelens.session import prepare_workers

ORDER, PER_LANGUAGE, MOST_CHARS = 3, 300, 20_000
#: Bits a byte beyond which no tree explains a text: plain bytes are as short.
MOST_BITS = 8.0
#: Bytes of text that are scored at a time.
PIECE = 1 << 18
UND = "und"
_LETTERLIKE = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, m[0])) for m in _LETTERLIKE.finditer(text))


def learning_sample(docs: DataFrame) -> DataFrame:
    """lang, text of the bounded sample of the learning fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    fits = docs.where(F.col("lang").isNotNull() & (fold != 2) & F.length("text").between(1, MOST_CHARS))
    ids = least_by_hash(fits.select("doc_id", "lang"), "lang", PER_LANGUAGE)
    return with_ids(fits.select("doc_id", "lang", "text"), ids).select("lang", "text")


def count_contexts(texts: dict[str, list[str]], order: int = ORDER) -> dict:
    """Per language and length n, the strings of n bytes (as numbers, the last byte
    lowest) and their counts; zero bytes stand before a text and are not counted."""
    names, grams = sorted(texts), []
    for name in names:
        raw = b"".join(b"\0" * order + t.lower().encode("utf-8", "replace").replace(b"\0", b"\1") for t in texts[name])
        c = np.frombuffer(raw, np.uint8).astype(np.uint64)
        of_lang, code = [], c.copy()
        for n in range(1, order + 2):
            if n > 1:
                code = code[1:] | (c[:len(c) - n + 1] << np.uint64(8 * (n - 1)))
            of_lang.append(np.unique(code[c[n - 1:] != 0], return_counts=True))
        grams.append(of_lang)
    return {"names": names, "grams": grams, "order": order}


def _found(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each sought key in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


class Tables:
    """The languages' trees: per language and order the strings with their costs and the
    contexts with their escapes, each sorted."""

    def __init__(self, model: dict) -> None:
        self.names, self.order, self.trees = model["names"], model["order"], []
        for of_lang in model["grams"]:
            tree = []
            for code, count in of_lang:
                context, first, distinct = np.unique(code >> np.uint64(8), return_index=True, return_counts=True)
                total = np.add.reduceat(count, first) if len(first) else count
                cost = np.log2(np.repeat(total + distinct, distinct) / count)
                tree.append((code, cost.astype(np.float32), context, np.log2((total + distinct) / distinct).astype(np.float32)))
            self.trees.append(tree)

    def costs(self, strings: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string of ``order`` + 1 bytes, by language."""
        out = np.zeros((len(strings), len(self.names)))
        real = np.flatnonzero(strings & np.uint64(255))  # the padding before a text costs nothing
        for j, tree in enumerate(self.trees):
            open_ = real
            for k in range(self.order, -1, -1):
                code, cost, context, escape = tree[k]
                here = strings[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
                at, there = _found(code, here)
                out[open_[there], j] += cost[at[there]]
                open_, here = open_[~there], here[~there]
                at, there = _found(context, here >> np.uint64(8))
                out[open_[there], j] += escape[at[there]]
            out[open_, j] += 8
        return out

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length in bits of each padded text, by language."""
        code = data.astype(np.uint32 if self.order < 4 else np.uint64)
        for k in range(1, self.order + 1):
            code[k:] |= data[:-k].astype(code.dtype) << code.dtype.type(8 * k)
        distinct, at = np.unique(code, return_inverse=True)
        costs = self.costs(distinct.astype(np.uint64))
        return np.stack([np.add.reduceat(costs[at, j], starts) for j in range(len(self.names))], axis=1) if len(self.names) else np.zeros((len(starts), 0))


_held: dict = {}


def _tables(shared) -> Tables:
    """Built once a worker process."""
    if _held.get("id") != shared.value["id"]:
        _held.clear()
        _held.update(id=shared.value["id"], tables=Tables(shared.value))
    return _held["tables"]


def score_texts(tables: Tables, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language, score, bits per byte) of each text."""
    langs = len(tables.names)
    bits, sizes = np.zeros((len(texts), langs)), np.zeros(len(texts), np.int64)
    pad = b"\0" * tables.order
    batch, owner, held = [], [], 0

    def flush() -> None:
        nonlocal batch, owner, held
        if batch:
            lens = np.array([len(x) for x in batch])
            np.add.at(bits, np.array(owner), tables.lengths(np.frombuffer(b"".join(batch), np.uint8), np.cumsum(lens) - lens))
        batch, owner, held = [], [], 0

    for i, t in enumerate(texts):
        if t is None or not langs or not has_letter(t):
            continue
        raw = t.lower().encode("utf-8", "replace").replace(b"\0", b"\1")
        sizes[i] = len(raw)
        for at in range(0, len(raw), PIECE):
            # a later piece begins with the context before it, which is not counted twice
            if at:
                flush()
                whole = pad + raw[at - tables.order:at + PIECE]
                a = np.frombuffer(whole, np.uint8)
                once = tables.lengths(a, np.array([0]))[0] - tables.lengths(a[:2 * tables.order], np.array([0]))[0]
                bits[i] += once
                continue
            piece = pad + raw[:PIECE]
            batch.append(piece)
            owner.append(i)
            held += len(piece)
            if held >= PIECE:
                flush()
    flush()
    out = []
    for i in range(len(texts)):
        if not sizes[i]:
            out.append((UND, 0.0, 0.0))
            continue
        best = int(np.argmin(bits[i]))
        odds = np.exp2(np.maximum(bits[i][best] - bits[i], -1000.0))
        out.append((tables.names[best], float(1.0 / odds.sum()), float(bits[i][best] / sizes[i])))
    return out


def train(docs: DataFrame) -> dict:
    texts: dict[str, list[str]] = {}
    for lang, text in sorted(learning_sample(docs).collect()):  # bounded: see learning_sample
        texts.setdefault(lang, []).append(text)
    return count_contexts(texts)


def language_of(docs: DataFrame, model: dict | None = None):
    """A function of a text column: struct of lang_pred, score, bits_per_byte,
    learned from ``docs`` (or by a ``model`` trained before)."""
    import uuid

    import pandas as pd

    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model or train(docs)) | {"id": uuid.uuid4().hex})

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = _tables(shared)
        for texts in batches:
            yield pd.DataFrame(score_texts(tables, [t if isinstance(t, str) else None for t in texts]),
                               columns=["lang_pred", "score", "bits_per_byte"])

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte: one row per row."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), language_of(docs)("text").alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.bits_per_byte")


def drop_unknown_language(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language cannot be told: texts without a letter, and
    texts that no learned language's tree explains."""
    model = train(docs)
    if not model["names"]:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    rows = docs.withColumn("__p", language_of(docs, model)("text"))
    return rows.where((F.col("__p.lang_pred") != UND) & (F.col("__p.bits_per_byte") <= MOST_BITS)).drop("__p")


def op2_ppm(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
