"""Operator 11 against a plain tree built in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from zonelens.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    out = b""
    for v in row:
        b = None if v is None else str(v).encode()
        out += b"-" if b is None else str(len(b)).encode() + b":" + b
    return hashlib.sha256(out).hexdigest()


def climb_all(hashes):
    """root and, per leaf, the list of (siblings before, siblings after) up to it."""
    level, paths, at = list(hashes), [[] for _ in hashes], list(range(len(hashes)))
    while len(level) > 1:
        for i, here in enumerate(at):
            lo = here // 8 * 8
            paths[i].append((level[lo:here], level[here + 1:lo + 8]))
            at[i] = here // 8
        level = [H(*level[k:k + 8]) for k in range(0, len(level), 8)]
    return (level[0] if level else None), paths


def model(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for doc_id, text, lang, source, n in rows:
        own = leaf((doc_id, source, lang, n, text))
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        claim = leaf((doc_id, source, lang, n, low)) if bad else own
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, claim, doc_id))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: climb_all([r[2] for r in sorted(trees[x])]) for x in order}
    root, upper = climb_all([built[x][0] for x in order])
    out = []
    for i, x in enumerate(order):
        for r, path in zip(sorted(trees[x]), built[x][1]):
            path, fold = path + upper[i], r[3]
            for before, after in path:
                fold = H(*before, fold, *after)
            proof = H(*[s for before, after in path for s in (*before, *after)])
            out.append((r[4], r[2], built[x][0], root, proof, fold, fold == root))
    return out


def run(docs, **more):
    changed = {c: docs[c] for c in merkle.FIELDS} | {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}
    got = merkle.verify(docs, F.when(F.crc32(docs["doc_id"].cast("string")) % 3 == 0, merkle.digest_of(changed)), **more)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(rng, sizes):
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((k, rng.choice(["Plain Text", "no upper case", "", None, "É, ß and Ä " * 3]) , lang, rng.choice(["a", None, ""])))
            k += 1
    return rows


@pytest.mark.parametrize("most", [merkle.MOST_NODES, 3])
def test_equals_plain_tree(make_docs, rng, most):
    sizes = {"en": 530, "de": 64, "fr": 65, "": 9, None: 8, "x": 1, "é": 2, "zz": 7, "y": 1, "a": 1, "b": 1, "c": 3}
    rows = rows_of(rng, sizes)
    want = sorted(model([(*r, None) for r in rows]), key=str)
    assert run(make_docs(rows), most_nodes=most) == want


def test_odd_rows(make_docs, odd_rows, clashing):
    rows = odd_rows + [(None, "Aa", "en", "a")] * 20 + [(30, "Aa", "en", "a")] * 20
    want = sorted(model([(*r, None) for r in rows]), key=str)
    assert run(make_docs(rows, (*clashing[:3], "first", "place", "digest", "claim", "position", "node", "tree"))) == want


@pytest.mark.parametrize("rows", [[], [(1, "A", "en")], [(3, "Abc", None)] * 3])
def test_few_rows(make_docs, rows):
    want = sorted(model([(*r, *[None] * (4 - len(r)), None) for r in rows]), key=str)
    assert run(make_docs(rows)) == want


def test_only_tampered_text_fails(make_docs, rng):
    rows = [(i, "Title %d" % i if i % 2 else "title", "en") for i in range(200)]
    bad = {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 0 and i % 2}
    assert {r[0] for r in run(make_docs(rows)) if not r[6]} == bad
