"""Toxicity by a linear-chain conditional random field (CRF).

Method: every token is tagged toxic or not by a two-state CRF over features of the
word and its first four and five bytes.  Forward-backward gives each token's exact
marginal; a document's score is a logistic function of its highest marginal and of its
expected number of toxic tokens, and neighbouring tokens with marginal of at least
one half form the offending spans.

Labelled tokens: labels exist per document, so a token of a toxic training document
counts as toxic if one of its features is a marker, that is, far more frequent in toxic
than in clean training documents (a likelihood ratio that chance gives to less than one
of all features seen).  All other tokens
are labelled clean.  The CRF's feature and transition weights and the logistic
function are then fitted on these, over every document of the sample.

Training is on a bounded sample: of the learning fold, ``MOST_TOXIC`` toxic and
``MOST_CLEAN`` clean labelled documents with the least hash of doc_id, those of at
most ``MOST_CHARS`` characters.  Scoring reads whole texts.

Messages of the two-state chain are products of 2 x 2 matrices.  Tokens are laid out in
lanes of ``LANE``; one sweep multiplies all lanes at once, a second one runs with the
message that enters each lane, so no Python step is taken per token.

Defined results: null and empty texts get the score of a document without toxic
tokens; a null doc_id is not held out and not learned from; a document with several
labels is toxic if any says so; with no labels at all every score is 0; repeated rows
are scored one by one; an empty table gives no rows; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import least_by_hash, table
from zonelens.llm.words import LETTERS, Words, mixed, pieces, stretch
from zonelens.session import prepare_workers

MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1500, 3500, 20_000
FEATURE_G2 = 8.0
LANE, ROUNDS, RATE = 64, 60, 0.3


def features(w: Words) -> np.ndarray:
    """One row of feature hashes per token: word, first four, first five bytes."""
    out = np.empty((3, len(w.hash)), np.uint64)
    out[0] = w.hash
    for i, n in ((1, 4), (2, 5)):
        end = np.minimum(w.end, w.start + n)
        out[i] = mixed(stretch(w.q, w.start, end) + np.uint64(i))
        out[i][w.end - w.start < n] = 0
    return out


class FeatureTable:
    """Number of a feature hash (0: unknown).  The table is at least four times as long as
    the features are many; a feature whose slot is taken has the next free one."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, bits = keys, 14
        while 1 << bits < 4 * len(keys):
            bits += 1
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.held, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        left = np.flatnonzero(keys)
        slot = (keys[left] >> self.shift).astype(np.int64)
        while len(left):
            place, first = np.unique(slot, return_index=True)
            first = first[self.held[place] == 0]
            self.held[slot[first]], self.number[slot[first]] = keys[left[first]], left[first] + 1
            again = np.ones(len(left), bool)
            again[first] = False
            left, slot = left[again], (slot[again] + 1) & self.last

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.shift).astype(np.int64)
        held = self.held[slot]
        out = np.where(held == hashes, self.number[slot], 0)
        open_ = np.nonzero((held != hashes) & (held != 0))
        slot = slot[open_]
        while len(slot):
            slot = (slot + 1) & self.last
            held, sought = self.held[slot], hashes[open_]
            hit = held == sought
            out[tuple(x[hit] for x in open_)] = self.number[slot[hit]]
            more = ~hit & (held != 0)
            open_, slot = tuple(x[more] for x in open_), slot[more]
        return out


def marginals(emit: np.ndarray, first: np.ndarray, move: np.ndarray, begin: np.ndarray):
    """P(token is toxic) by forward-backward over documents laid end to end.

    emit: log-odds of each token for the toxic state; first: is it a document's
    first; move[i, j]: weight of going from state i to j; begin: of the first state.
    Also the normalised forward and backward messages, for training."""
    n = len(emit)
    lanes = max(1, -(-n // LANE))
    flat_e, flat_s = np.ones(lanes * LANE), np.ones(lanes * LANE, bool)  # padding: documents of one token
    flat_e[:n] = np.exp(np.clip(emit, -40, 40))
    flat_s[:n] = first
    e, starts = flat_e.reshape(lanes, LANE).T.copy(), flat_s.reshape(lanes, LANE).T.copy()
    # the step into token t: v0 = a00 v0 + a01 v1, v1 = e (a10 v0 + a11 v1)
    a00, a01 = np.where(starts, begin[0], move[0, 0]), np.where(starts, begin[0], move[1, 0])
    a10, a11 = np.where(starts, begin[1], move[0, 1]) * e, np.where(starts, begin[1], move[1, 1]) * e
    p = np.zeros((4, lanes))
    p[0] = p[3] = 1.0
    for t in range(LANE):
        q0, q1 = a00[t] * p[0] + a01[t] * p[2], a00[t] * p[1] + a01[t] * p[3]
        q2, q3 = a10[t] * p[0] + a11[t] * p[2], a10[t] * p[1] + a11[t] * p[3]
        s = q0 + q1 + q2 + q3
        p[0], p[1], p[2], p[3] = q0 / s, q1 / s, q2 / s, q3 / s
    enter, leave = np.empty((2, lanes)), np.empty((2, lanes))
    v = (0.5, 0.5)
    cols = p.T.tolist()
    for i, (x0, x1, x2, x3) in enumerate(cols):
        enter[0, i], enter[1, i] = v
        u0, u1 = x0 * v[0] + x1 * v[1], x2 * v[0] + x3 * v[1]
        v = (u0 / (u0 + u1), u1 / (u0 + u1))
    v = (0.5, 0.5)
    for i in range(lanes - 1, -1, -1):
        leave[0, i], leave[1, i] = v
        x0, x1, x2, x3 = cols[i]
        u0, u1 = x0 * v[0] + x2 * v[1], x1 * v[0] + x3 * v[1]
        v = (u0 / (u0 + u1), u1 / (u0 + u1))
    f, b = np.empty((2, LANE, lanes)), np.empty((2, LANE, lanes))
    v0, v1 = enter
    for t in range(LANE):
        v0, v1 = a00[t] * v0 + a01[t] * v1, a10[t] * v0 + a11[t] * v1
        s = v0 + v1
        v0, v1 = v0 / s, v1 / s
        f[0, t], f[1, t] = v0, v1
    v0, v1 = leave
    for t in range(LANE - 1, -1, -1):
        b[0, t], b[1, t] = v0, v1
        v0, v1 = a00[t] * v0 + a10[t] * v1, a01[t] * v0 + a11[t] * v1
        s = v0 + v1
        v0, v1 = v0 / s, v1 / s
    flat = lambda x: x.T.reshape(-1)[:n]
    f0, f1, b0, b1 = flat(f[0]), flat(f[1]), flat(b[0]), flat(b[1])
    return f1 * b1 / (f0 * b0 + f1 * b1), (f0, f1, b0, b1)


def fit_crf(parts: list, n_features: int):
    """Feature weights (0: bias), transitions and first-state weights by gradient
    ascent (Adam) on the penalised log-likelihood of the tags.  Each part holds whole
    documents (feature numbers of the tokens, is it a document's first, tags); gradients
    are summed over the parts, so memory for a round is that of one part."""
    w, move = np.zeros(n_features + 1), np.zeros((2, 2))
    pairs, seen, held = np.zeros((2, 2)), np.zeros(n_features + 1), []
    for numbers, first, tags in parts:
        at, tok = np.nonzero(numbers)
        feat = numbers[at, tok]
        inner = ~first
        np.add.at(pairs, (tags[:-1][inner[1:]], tags[1:][inner[1:]]), 1)
        seen += np.bincount(feat, weights=tags[tok].astype(float), minlength=n_features + 1)
        seen[0] += tags.sum()
        held.append((feat.astype(np.int32), tok.astype(np.int32), first))
    begin = np.array([0.5, 0.5])
    m = [np.zeros_like(w), np.zeros_like(move)]
    v = [np.zeros_like(w), np.zeros_like(move)]
    for r in range(1, ROUNDS + 1):
        t = np.exp(move)
        g, gm = seen - 0.05 * w, pairs - 0.05 * move
        for feat, tok, first in held:
            emit = w[0] + np.bincount(tok, weights=w[feat], minlength=len(first))
            p, (f0, f1, b0, b1) = marginals(emit, first, t, begin)
            gain = np.bincount(feat, weights=p[tok], minlength=n_features + 1)
            gain[0] = p.sum()
            g -= gain
            k = ~first[1:]
            e = np.exp(np.clip(emit, -40, 40))[1:][k]
            x = [f0[:-1][k] * t[0, 0] * b0[1:][k], f0[:-1][k] * t[0, 1] * e * b1[1:][k],
                 f1[:-1][k] * t[1, 0] * b0[1:][k], f1[:-1][k] * t[1, 1] * e * b1[1:][k]]
            z = x[0] + x[1] + x[2] + x[3]
            gm -= np.array([(y / z).sum() for y in x]).reshape(2, 2)
        for i, (param, grad) in enumerate(((w, g), (move, gm))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad * grad
            param += RATE * (m[i] / (1 - 0.9 ** r)) / (np.sqrt(v[i] / (1 - 0.99 ** r)) + 1e-8)
    return w, np.exp(move), begin


def document_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: bias, log-odds of its highest marginal, log of 1 + expected
    number of toxic tokens (marginals of at least a tenth)."""
    top, mass = np.zeros(n), np.zeros(n)
    likely = p >= 0.01
    np.maximum.at(top, doc[likely], p[likely])
    likely = p >= 0.1
    np.add.at(mass, doc[likely], p[likely])
    top = np.clip(top, 1e-3, 1 - 1e-3)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(mass)], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - 0.1 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        beta += np.clip(np.linalg.solve(hess, grad), -2, 2)
    return beta


def without_copies(texts: list[str]) -> np.ndarray:
    """Numbers of texts that share none of four minhashes of word triples with an
    earlier one: words of a document with many near copies must not look frequent."""
    taken: set[int] = set()
    kept = []
    for first, raws in pieces(texts):
        w = Words(raws, LETTERS)
        grams, at = w.grams(3)
        doc = w.doc[at]
        begin = np.searchsorted(doc, np.arange(len(raws)))
        has = np.bincount(doc, minlength=len(raws)) > 0
        least = np.zeros((4, len(raws)), np.uint64)
        for i in range(4):
            if has.any():
                least[i][has] = np.minimum.reduceat(mixed(grams + np.uint64(2 * i + 1)), begin[has])
        for j in range(len(raws)):
            marks = [int(x) for x in least[:, j]] if has[j] else [hash(raws[j])]
            if not taken.intersection(marks):
                kept.append(first + j)
            taken.update(marks)
    return np.array(kept, np.int64)


class Model:
    def __init__(self, texts: list[str], labels: np.ndarray) -> None:
        self.rate = None
        self.beta = None
        if not len(labels):
            return
        kept = without_copies(texts)
        texts, labels = [texts[i] for i in kept], labels[kept]
        toxic, n1, n0 = labels == 1, int((labels == 1).sum()), int((labels == 0).sum())
        per_piece, owners = [], []
        for first, raws in pieces(texts):
            w = Words(raws, LETTERS)
            f = features(w)
            per_piece.append((first, w.doc, f))
            for row in f:
                owners.append(np.unique(np.stack([row, (w.doc + first).astype(np.uint64)]), axis=1))
        pairs = np.concatenate(owners, axis=1) if owners else np.zeros((2, 0), np.uint64)
        keys, at = np.unique(pairs[0], return_inverse=True)
        has = toxic[pairs[1].astype(np.int64)]
        a = np.bincount(at, weights=has, minlength=len(keys))
        b = np.bincount(at, weights=~has, minlength=len(keys))
        g2 = np.zeros(len(keys))
        for seen, size in ((a, n1), (b, n0), (n1 - a, n1), (n0 - b, n0)):
            both = a + b if seen is a or seen is b else (n1 + n0 - a - b)
            expect = both * size / (n1 + n0)
            with np.errstate(divide="ignore", invalid="ignore"):
                g2 += np.where(seen > 0, 2 * seen * np.log(seen / expect), 0)
        ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
        use = (g2 > FEATURE_G2) & (a + b >= 3) & ((ratio > 2) | (ratio < 0.5)) & (keys != 0)
        chance = 2 * np.log(max(2, np.count_nonzero(a + b >= 3)))
        marker = (g2 > chance) & (ratio > 4) & (keys != 0)
        self.table = FeatureTable(keys[use | marker])
        is_marker = np.concatenate([[False], marker[use | marker]])
        parts = []
        for first, doc, f in per_piece:
            if len(doc):
                num = np.stack([self.table.numbers(row) for row in f])
                tags = (is_marker[num].any(0) & toxic[doc + first]).astype(np.int64)
                parts.append((num, np.concatenate([[True], doc[1:] != doc[:-1]]), tags))
        self.rate = n1 / (n1 + n0)
        if not any(tags.any() for _, _, tags in parts):
            return
        self.w, self.move, self.begin = fit_crf(parts, len(self.table.keys))
        x = np.concatenate([document_features(self._tokens(doc, f)[0], doc, int(doc.max()) + 1 if len(doc) else 0)
                            for _, doc, f in per_piece])
        order = np.concatenate([np.arange(int(doc.max()) + 1 if len(doc) else 0) + first for first, doc, _ in per_piece])
        self.beta = fit_logistic(x, labels[order].astype(float))

    def _tokens(self, doc: np.ndarray, f: np.ndarray):
        emit = np.full(len(doc), self.w[0])
        weights = self.w.copy()
        weights[0] = 0
        for row in f:
            emit += weights[self.table.numbers(row)]
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        return marginals(emit, first, self.move, self.begin)

    def score(self, raws: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Score and offending (start, end) characters of each text."""
        spans: list[list[tuple[int, int]]] = [[] for _ in raws]
        if self.beta is None:
            return np.full(len(raws), self.rate or 0.0), spans
        w = Words(raws, LETTERS)
        p, _ = self._tokens(w.doc, features(w))
        x = document_features(p, w.doc, len(raws))
        hits = np.flatnonzero(p >= 0.5)
        new = np.ones(len(hits), bool)
        new[1:] = (np.diff(hits) > 1) | (np.diff(w.doc[hits]) > 0)
        begins = np.flatnonzero(new)
        done: dict[int, tuple[int, int]] = {}  # text: bytes and characters counted so far
        for i, j in zip(hits[begins], hits[np.append(begins[1:], len(hits)) - 1] if len(hits) else ()):
            d = int(w.doc[i])
            at, chars = done.get(d, (0, 0))
            s, e = int(w.start[i] - w.base[d]), int(w.end[j] - w.base[d])
            from_ = chars + len(raws[d][at:s].decode("utf-8", "replace"))
            to = from_ + len(raws[d][s:e].decode("utf-8", "replace"))
            spans[d].append((from_, to))
            done[d] = e, to
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30))), spans


def train(docs: DataFrame, labels: DataFrame) -> Model:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    by_doc = labels.where((fold != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fits = docs.where(F.length("text").between(1, MOST_CHARS)).select("doc_id")
    ids = least_by_hash(by_doc.join(fits, "doc_id", "left_semi"), "toxic", F.when(F.col("toxic") == 1, MOST_TOXIC).otherwise(MOST_CLEAN)).select("doc_id", "toxic")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.length("text").between(1, MOST_CHARS))
    rows = sample.select("doc_id", "text", "toxic").collect()  # bounded: MOST_TOXIC + MOST_CLEAN texts
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return Model([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64))


def tag_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (characters): one row per row."""
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator) -> Iterator:
        import pandas as pd

        model = shared.value
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for first, raws in pieces(texts):
                s, spans = model.score(raws)
                part = batch.iloc[first:first + len(raws)]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "held_out": part["held_out"].to_numpy(), "score": s,
                                    "predicted": (s >= 0.5).astype(np.int32),
                                    "spans": [[{"start": a, "end": b} for a, b in x] for x in spans]})

    kind = dict(docs.dtypes)["doc_id"]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInPandas(
        score, f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>")


def op5_crf(spark, sf_dir):
    return tag_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
