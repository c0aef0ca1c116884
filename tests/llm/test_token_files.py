"""Operator 12: exact round trips, and the ids against the library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from zonelens.llm import token_files as tf
from zonelens.llm.common import fresh_folder

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
PLAIN = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    SPEC = f.read()


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def model(rows):
    """rows: (doc_id, text): doc_id, start, n_tokens, crc in ascending order."""
    out, start = [], 0
    for k, t in rows:
        ids = ids_of(t)
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@given(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0 ̧́İΣßé'sT1.,<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=400, deadline=None)
def test_words_alone_give_the_ids_of_the_text(text):
    got = np.frombuffer(tf.Encoder.of(SPEC, 2).payload(text), "<u2")
    assert got.tolist() == ids_of(text)


def test_every_latin_letter_alone_and_in_words():
    encoder = tf.Encoder(SPEC, 2)
    letters = [chr(c) for c in range(0x21, 0x300)]
    text = " ".join([*letters, *(f"a{c}" for c in letters), *(f"{c}É{c}," for c in letters), *(f"x{c}Y.'" for c in letters)])
    assert encoder.plain and np.frombuffer(encoder.payload(text), "<u2").tolist() == ids_of(text)


def test_special_strings_and_long_words():
    encoder = tf.Encoder(SPEC, 2)
    for text in ("a<|endoftext|>b <|startoftext|> <|endoftext|", "x" * 5000 + " " + "ab1" * 900, "don't you've 'S 't", ""):
        for _ in range(2):  # the second time from memory
            assert np.frombuffer(encoder.payload(text), "<u2").tolist() == ids_of(text)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
def test_index_is_minimal_and_perfect(n):
    keys = [b"=%d" % (i * 7) for i in range(n)]
    slots = np.zeros(n, tf.SLOT)
    slots["shard"], slots["place"] = np.arange(n) % 5, np.arange(n)
    data = tf.pack_index(keys, slots)
    index = tf.Index(lambda a, b: data[a:a + b])
    assert index.n == n and len(data) == index.slots_at + n * tf.SLOT.itemsize  # no slot without a key
    found, there = index.find(keys)
    assert there.all() and found["place"].tolist() == list(range(n))
    for i in range(0, n, max(1, n // 50)):
        assert index.get(keys[i])["place"] == i
    strange = [b"=x%d" % i for i in range(2000)]
    assert not index.find(strange)[1].any() if n else True
    assert all(index.get(k) is None for k in strange[:50])


def test_a_lookup_reads_a_bounded_number_of_bytes():
    read = []
    for n in (1000, 100_000):
        keys = [b"=%d" % i for i in range(n)]
        data, seen = tf.pack_index(keys, np.zeros(n, tf.SLOT)), []
        index = tf.Index(lambda a, b: (seen.append(b), data[a:a + b])[1])
        assert all(index.get(k) is not None for k in keys[:200])
        read.append(sum(seen) / 200)
    assert max(read) < 200


def rows_of(spark, docs):
    got = tf.round_trip(docs, PATH, 2, fresh_folder(spark, "tokens"))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])


def test_round_trip(spark, make_docs, rng, monkeypatch):
    words = ["alpha", "Beta", "gamma's", "12", "né", "...", "日本"]
    rows = [(i * 3 + 1, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(700)]
    assert rows_of(spark, make_docs(rows)) == model(rows)


def test_shards_end_within_a_partition(spark, make_docs):
    """Texts beyond the size of a shard, and one key over several shards."""
    rows = [(i, "one two three " * (40 + i)) for i in range(30)] + [(1000, "same key %04d" % i) for i in range(3000)]
    docs = make_docs(rows)
    files = tf.write_tokens(docs, PATH, 2, fresh_folder(spark, "tokens"), shard_bytes=3000)
    assert files.shards.count() > 16 and files.shards.where("tokens < 1500 AND documents > 1").count() <= 8  # of 8 partitions
    got = sorted(tuple(r) for r in tf.read_tokens(files, docs.select(tf._key(docs, "doc_id").alias("key")).distinct()).collect())
    assert len(got) == len(rows)
    same = sorted(r for r in got if r[0] == "=1000")
    assert [b[1] - a[1] for a, b in zip(same, same[1:])] == [a[2] for a in same[:-1]]
    assert sorted(r[3] for r in same) == sorted(zlib.crc32(np.array(ids_of(t), "<u4").tobytes()) for k, t in rows if k == 1000)


def test_keyed_access(spark, make_docs):
    rows = [(5, "five five"), (6, None), (6, "six"), (None, "no key"), (-1, "below")]
    folder = fresh_folder(spark, "tokens")
    docs = make_docs(rows)
    tf.write_tokens(docs, PATH, 2, folder)
    files = tf.open_tokens(spark, folder)
    for key in (5, 6, None, -1):
        assert sorted(x.tolist() for x in tf.get(files, key)) == sorted(ids_of(t) for k, t in rows if k == key)
    assert tf.get(files, 7) == [] and tf.get(files, 10**12) == []
    asked = spark.createDataFrame([("=5",), ("=77",), ("",)], "key string")
    got = {r["key"]: r["ids"] for r in tf.read_tokens(files, asked, ids=True).collect()}
    assert got == {"=5": ids_of("five five"), "": ids_of("no key")}


def test_odd_rows(spark, make_docs, odd_rows, clashing):
    docs = make_docs(odd_rows, clashing + ("key", "id", "part", "shard"))
    got = rows_of(spark, docs)
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(k), n, c) for k, _, n, c in model([r[:2] for r in odd_rows]))
    assert [r[0] for r in got] == [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 9]
    assert [b[1] - a[1] for a, b in zip(got, got[1:])] == [a[2] for a in got[:-1]] and got[0][1] == 0
    assert rows_of(spark, make_docs([])) == []
