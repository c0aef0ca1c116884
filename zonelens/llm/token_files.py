"""Token ids as binary shards with a minimal perfect hash index.

**Encoding.**  The tokenizer file's text goes to the workers, which load it once.  A
worker asks the tokenizers library for each white-space separated word and remembers the
ids of words of up to ``WORD_BYTES``: none of the tokenizer's rules reaches across ASCII
white space (composition, lower-casing and splitting are tested to agree with the whole
text), and a corpus repeats its words.  Under the rules ``SPLITTING`` and ``NORMALISING``
words of Latin letters go to the library's model straight away.  Special tokens are not
added; the end id is.

**Files.**  Texts are range-partitioned and sorted by key (then text), so files in the
order of their partitions are the corpus in ascending order.  A shard is two files:
``.ids``, the documents' ids one after the other as little-endian unsigned integers of 2
bytes (4 if the vocabulary needs them), and ``.at``, where each document begins and the
last one ends, in ids, as 64-bit integers.  A table of shards tells how many documents
and ids come before each.  Names are new for every attempt of a task and only those of
finished tasks are listed, so a retry leaves no wrong file behind.

**Index.**  Distinct keys are dealt to buckets of some ``BUCKET_KEYS`` by hash.  In a
bucket a minimal perfect hash maps the n keys to the slots 0..n-1: at each level the
keys still open go to a bit array of twice their number; keys alone on a bit keep it, the
others go on to the next level, and the slot is the rank of the bit.  A slot holds a
32-bit fingerprint, the place (shard, number in it) of the key's first document and that
of its last.  Keys are not stored: a strange key fails the fingerprint except once in
2^32.  A lookup reads the header, some words of bits and one slot, however many keys
there are; lookups of many keys are shuffled by bucket, then by shard.

Defined results: a null text has no ids but the end id; rows that share a key lie next to
each other, in the order of their texts, and are found together; a null key is one as
any other and the first; a group of rows with one key may cover many shards and is
read from each by itself; an empty table writes no shard and gives no rows; further columns take no part.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelens.llm.common import buckets, fresh_folder, slices, stored, table
from zonelens.llm.warc import open_fs
from zonelens.session import prepare_workers

#: Bytes of a shard after which a task begins the next, and of one read.
SHARD_BYTES, READ_BYTES = 1 << 30, 4 << 20
BUCKET_KEYS = 50_000
#: Words that a worker remembers (twice as many at most), and their length.
WORDS, WORD_BYTES = 750_000, 48
#: Rules under which a word of Latin letters, lower-cased, is for the model
#: as it is, and ASCII punctuation after it is a word of its own.
SPLITTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISING = ["NFC", "Replace", "Lowercase"]
LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([.,;:!?]*)")
#: Bits of a level per key that is still open.
SPREAD = 2
LEVELS = 200


class Encoder:
    """Texts to payloads of ids, the end id last."""

    _made: dict[int, Encoder] = {}

    def __init__(self, spec: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id)
        self.code = {"<u2": "H", "<u4": "I"}[self.dtype]
        self.end = self._packed([end_id])
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        rules = json.loads(spec)
        self.plain = ([x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])] == NORMALISING
                      and [(x["type"], x.get("pattern", {}).get("Regex")) for x in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
                      == [("Split", SPLITTING), ("ByteLevel", None)])
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}  # how the model spells them

    @classmethod
    def of(cls, spec: str, end_id: int) -> Encoder:
        """One per worker process, kept between tasks."""
        key = hash((spec, end_id))
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(spec, end_id)
        return cls._made[key]

    def _packed(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _new(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words not remembered."""
        out, rest, old, known, tokenize = {}, [], self.old, self.known, self.tokenizer.model.tokenize
        for w in words:
            if w in old:
                out[w] = old[w]
                continue
            text = w.decode()
            m = LETTERS.fullmatch(text) if self.plain and len(w) <= WORD_BYTES else None
            if m is None:
                rest.append(text)
                continue
            head, tail = m[1].lower(), m[2]
            name = w if head == text else head.encode()
            ids = known.get(name) or old.get(name)
            if ids is None:
                ids = known[name] = self._packed([t.id for t in tokenize(head if len(name) == len(head) else head.translate(self.spelled))])
            if tail:
                marks = known.get(tail.encode())
                if marks is None:
                    marks = known[tail.encode()] = self._packed(self.tokenizer.encode(tail, add_special_tokens=False).ids)
                ids += marks
            out[w] = ids
        if rest:
            found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            out.update((t.encode(), self._packed(x.ids)) for t, x in zip(rest, found))
        return out

    def payload(self, text: str) -> bytes:
        words = text.encode().split()  # at ASCII white space only
        parts = list(map(self.known.get, words))
        if None in parts:
            here = self._new({w for w, p in zip(words, parts) if p is None})
            parts = [here[w] if p is None else p for w, p in zip(words, parts)]
            self.known.update((w, p) for w, p in here.items() if len(w) <= WORD_BYTES)
            if len(self.known) > WORDS:  # words not met since the last time go
                self.old, self.known = self.known, {}
        parts.append(self.end)
        return b"".join(parts)


def id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


# ---------------------------------------------------------------- minimal perfect hash

def _mixed(low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    x = low ^ (high * np.uint64(2 * level + 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two words that choose the bits, and the fingerprints."""
    import xxhash

    both = [xxhash.xxh3_128_intdigest(k) for k in keys]
    low = np.array([b & 0xFFFFFFFFFFFFFFFF for b in both], np.uint64)
    high = np.array([b >> 64 for b in both], np.uint64)
    return low, high, (_mixed(high, low, 77) >> np.uint64(32)).astype("<u4")


SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("place", "<u8"), ("last_shard", "<u4"), ("last_place", "<u8")])


def pack_index(keys: list[bytes], slots: np.ndarray) -> bytes:
    """The file of a bucket: number of keys and levels, words of each level, all bits,
    the ones before each word, the slots.  ``slots`` (``SLOT``, its prints unset) are in
    the order of the distinct ``keys``."""
    low, high, prints = hashes(keys)
    slots = slots.copy()
    slots["print"] = prints
    left, sizes, bits, at = np.arange(len(keys)), [], [], np.empty(len(keys), np.int64)
    base = 0
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("two keys have the same 128-bit hash")
        words = (SPREAD * len(left) + 63) // 64
        spot = (_mixed(low[left], high[left], len(sizes)) % np.uint64(64 * words)).astype(np.int64)
        alone = np.bincount(spot, minlength=64 * words) == 1
        mine = alone[spot]
        at[left[mine]] = base + spot[mine]
        bits.append(np.packbits(alone, bitorder="little"))
        sizes.append(words)
        base += 64 * words
        left = left[~mine]
    flat = np.concatenate(bits) if bits else np.empty(0, np.uint8)
    ones = np.unpackbits(flat, bitorder="little").reshape(-1, 64).sum(axis=1, dtype=np.int64)
    ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else np.empty(0, np.int64)
    ordered = slots[np.argsort(at)]  # the rank of a key's bit is its slot
    return b"".join([struct.pack("<QQ", len(keys), len(sizes)), np.array(sizes, "<u8").tobytes(), flat.tobytes(),
                     ranks.astype("<u8").tobytes(), ordered.tobytes()])


class Index:
    """The index of a bucket.  ``read(start, n)`` gives bytes of its file, so that a
    lookup of one key touches a bounded number of them."""

    def __init__(self, read) -> None:
        self.read = read
        self.n, levels = struct.unpack("<QQ", read(0, 16))
        self.sizes = np.frombuffer(read(16, 8 * levels), "<u8").astype(np.int64)
        self.bits_at = 16 + 8 * levels
        self.words = int(self.sizes.sum())
        self.ranks_at = self.bits_at + 8 * self.words
        self.slots_at = self.ranks_at + 8 * self.words

    def get(self, key: bytes):
        """The slot of one key, or None."""
        low, high, prints = hashes([key])
        base = 0
        for level, words in enumerate(self.sizes):
            spot = int(_mixed(low, high, level)[0] % np.uint64(64 * words))
            word = base + spot // 64
            bits = int.from_bytes(self.read(self.bits_at + 8 * word, 8), "little")
            if bits >> (spot % 64) & 1:
                rank = int.from_bytes(self.read(self.ranks_at + 8 * word, 8), "little") + (bits & ((1 << spot % 64) - 1)).bit_count()
                slot = np.frombuffer(self.read(self.slots_at + SLOT.itemsize * rank, SLOT.itemsize), SLOT)[0]
                return slot if slot["print"] == prints[0] else None
            base += int(words)
        return None

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of many keys and which of them there are."""
        low, high, prints = hashes(keys)
        bits = np.frombuffer(self.read(self.bits_at, 8 * self.words), np.uint8)
        ranks = np.frombuffer(self.read(self.ranks_at, 8 * self.words), "<u8").astype(np.int64)
        slots = np.frombuffer(self.read(self.slots_at, SLOT.itemsize * self.n), SLOT)
        flat = np.unpackbits(bits, bitorder="little")
        inside = np.cumsum(flat.reshape(-1, 64), axis=1, dtype=np.int64).reshape(-1) - flat
        at, open_, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, words in enumerate(self.sizes):
            spot = base + (_mixed(low[open_], high[open_], level) % np.uint64(64 * words)).astype(np.int64)
            hit = flat[spot] == 1
            at[open_[hit]] = ranks[spot[hit] // 64] + inside[spot[hit]]
            open_, base = open_[~hit], base + 64 * int(words)
        there = at >= 0
        there[there] = slots["print"][at[there]] == prints[there]
        return slots[at[there]], there


# ---------------------------------------------------------------- writing

@dataclass
class TokenFiles:
    """``shards``: shard, ids, at (files), documents, tokens, first_document, first_token;
    ``index``: bucket, file; ``type``: of an id; ``buckets``: their number."""

    spark: SparkSession
    shards: DataFrame
    index: DataFrame
    type: str
    buckets: int


def _bucket(key, count: int):
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def _key(df: DataFrame, name: str):
    """Key bytes as a string: empty for null."""
    value = df[name].cast("string")
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text",
                 shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Encodes ``text`` of every row with the tokenizer file at the path ``tokenizer``
    and writes shards and index below ``folder``, ascending by ``key``."""
    spark = docs.sparkSession
    prepare_workers(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    kind = Encoder.of(spec, end_id).dtype
    schema = "key string, part int, seq int, place long, n long, ids string, at string"

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part = Encoder.of(spec, end_id), TaskContext.get().partitionId()
        store, top = open_fs(folder)
        store.create_dir(top, recursive=True)
        name, out, starts, seq = "", None, [0], 0

        def close():
            out.close()
            with store.open_output_stream(f"{top}/{name}.at", compression=None) as f:
                f.write(np.array(starts, "<i8").tobytes())

        for batch in slices(batches, 500):
            rows = []
            for k, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                if out is None:
                    name, starts = f"tokens-{uuid.uuid4().hex}", [0]
                    out = store.open_output_stream(f"{top}/{name}.ids", compression=None)
                data = encoder.payload(t or "")
                out.write(data)
                n = len(data) // int(kind[2])
                rows.append((k, part, seq, len(starts) - 1, n, f"{name}.ids", f"{name}.at"))
                starts.append(starts[-1] + n)
                if starts[-1] * int(kind[2]) >= shard_bytes:
                    close()
                    out, seq = None, seq + 1
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "part", "seq", "place", "n", "ids", "at"), r)) for r in rows], schema=pa.schema([
                ("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("place", pa.int64()), ("n", pa.int64()),
                ("ids", pa.string()), ("at", pa.string())]))
        if out is not None:
            close()

    rows = docs.select(docs[key].alias("id"), _key(docs, key).alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    placed = rows.repartitionByRange(buckets(spark), *order[:2], F.monotonically_increasing_id()).sortWithinPartitions(*order).select("key", "text")
    entries = stored(placed.mapInArrow(write, schema), "token-entries")

    sums = entries.groupBy("part", "seq", "ids", "at").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))
    listed, documents, tokens = [], 0, 0
    for i, r in enumerate(sums.orderBy("part", "seq").collect()):  # a row per shard
        listed.append((i, r["part"], r["seq"], r["ids"], r["at"], r["documents"], r["tokens"], documents, tokens))
        documents, tokens = documents + r["documents"], tokens + r["tokens"]
    spark.createDataFrame(listed, "shard int, part int, seq int, ids string, at string, documents long, tokens long, "
                                  "first_document long, first_token long").coalesce(1).write.parquet(f"{folder}/shards")
    shards = spark.read.parquet(f"{folder}/shards")

    places = entries.join(shards.select("part", "seq", "shard"), ["part", "seq"])
    here = F.struct("shard", "place")
    keys = stored(places.groupBy("key").agg(F.min(here).alias("a"), F.max(here).alias("b")), "token-keys")
    count = max(1, -(-keys.count() // BUCKET_KEYS))
    _write_index(keys, count, folder)
    spark.createDataFrame([(kind, count)], "type string, buckets int").coalesce(1).write.parquet(f"{folder}/meta")
    return open_tokens(spark, folder)


def _write_index(keys: DataFrame, count: int, folder: str) -> None:
    """A file per bucket and the table of them; ``keys``: key, a and b (shard, place)."""

    def build(group):
        import pyarrow as pa

        names = [k.encode() for k in group["key"].to_pylist()]
        slots = np.zeros(len(names), SLOT)
        for field in ("shard", "place", "last_shard", "last_place"):
            slots[field] = group[field].to_numpy()
        store, top = open_fs(folder)
        store.create_dir(top, recursive=True)
        file = f"keys-{uuid.uuid4().hex}.mph"
        with store.open_output_stream(f"{top}/{file}", compression=None) as f:
            f.write(pack_index(names, slots))
        return pa.table({"bucket": pa.array([group["bucket"][0].as_py()], pa.int32()), "file": [file]})

    rows = keys.select(_bucket(F.col("key"), count).alias("bucket"), "key", F.col("a.shard").alias("shard"), F.col("a.place").alias("place"),
                       F.col("b.shard").alias("last_shard"), F.col("b.place").alias("last_place"))
    rows.groupBy("bucket").applyInArrow(build, "bucket int, file string").write.parquet(f"{folder}/index")


def open_tokens(spark: SparkSession, folder: str) -> TokenFiles:
    prepare_workers(spark)
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file"))
    shards = spark.read.schema("shard int, ids string, at string, documents long, tokens long, first_document long, first_token long").parquet(f"{folder}/shards")
    full = [F.concat(F.lit(folder.rstrip("/") + "/"), F.col(c)).alias(c) for c in ("ids", "at")]
    shards = shards.select("shard", *full, "documents", "tokens", "first_document", "first_token")
    index = spark.read.schema("bucket int, file string").parquet(f"{folder}/index").select("bucket", path.alias("file"))
    kind, count = spark.read.parquet(f"{folder}/meta").first()
    return TokenFiles(spark, shards, index, kind, count)


# ---------------------------------------------------------------- reading

def _runs(batches, column: str):
    """Arrow tables of consecutive rows with one value in ``column``."""
    import pyarrow as pa

    held, value = [], None
    for batch in batches:
        of = batch[column].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)] if len(of) else [0]
        for a, b in zip(edges, edges[1:]):
            if held and of[a] != value:
                yield pa.Table.from_batches(held)
                held = []
            value = of[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def lookup(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """key, shard, from_place, to_place: where the documents of each key of ``keys`` (a
    column ``key`` of distinct strings as in the index) lie; a row per shard; keys that
    are not there give none."""

    def find(batches):
        import pyarrow as pa

        for rows in _runs(batches, "bucket"):
            store, inner = open_fs(rows["file"][0].as_py())
            with store.open_input_file(inner) as f:
                data = f.read()
            names = rows["key"].to_pylist()
            slots, there = Index(lambda start, n: data[start:start + n]).find([k.encode() for k in names])
            found = pa.array(names, pa.string()).filter(pa.array(there))
            yield pa.RecordBatch.from_arrays([found, *(pa.array(slots[c].astype(t)) for c, t in (
                ("shard", "i4"), ("place", "i8"), ("last_shard", "i4"), ("last_place", "i8")))],
                names=["key", "shard", "place", "last_shard", "last_place"])

    asked = keys.select("key", _bucket(F.col("key"), files.buckets).alias("bucket")).join(files.index, "bucket")
    asked = asked.repartition(min(files.buckets, buckets(files.spark)), "bucket").sortWithinPartitions("bucket")
    found = asked.mapInArrow(find, "key string, shard int, place long, last_shard int, last_place long")
    each = found.select("*", F.explode(F.sequence("shard", "last_shard")).alias("here"))
    sizes = files.shards.select(F.col("shard").alias("here"), "documents")
    return each.join(sizes, "here").select(
        "key", F.col("here").alias("shard"), F.when(F.col("here") == F.col("shard"), F.col("place")).otherwise(0).alias("from_place"),
        F.when(F.col("here") == F.col("last_shard"), F.col("last_place") + 1).otherwise(F.col("documents")).alias("to_place"))


def read_tokens(files: TokenFiles, keys: DataFrame, ids: bool = False) -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, ids of every document
    that has a key of ``keys``."""
    kind, width = files.type, int(files.type[2])
    spots = lookup(files, keys).join(files.shards.select("shard", F.col("ids").alias("file"), "at", "first_token"), "shard")
    spots = spots.repartition(buckets(files.spark), "shard").sortWithinPartitions("shard", "from_place")
    names = ["key", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def read(batches):
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if ids else [])]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for part in _runs(batches, "shard"):
            (store, inner), first = open_fs(part["file"][0].as_py()), part["first_token"][0].as_py()
            at_store, at_inner = open_fs(part["at"][0].as_py())
            with at_store.open_input_file(at_inner) as f:
                at = np.frombuffer(f.read(), "<i8")
            rows, held = [], 0
            with store.open_input_file(inner) as f:
                data, base = b"", 0  # ids of the file from ``base``
                for key, a, b in zip(*(part[c].to_pylist() for c in ("key", "from_place", "to_place"))):
                    for place in range(a, b):
                        lo, hi = int(at[place]), int(at[place + 1])
                        if lo < base or hi > base + len(data) // width:
                            f.seek(lo * width)
                            data, base = f.read(max((hi - lo) * width, READ_BYTES // width * width)), lo
                        own = np.frombuffer(data, kind, hi - lo, (lo - base) * width)
                        rows.append((key, first + lo, hi - lo, zlib.crc32(own.astype("<u4").tobytes()), *([own.astype(np.int64)] if ids else [])))
                        held += (hi - lo) * 8 if ids else 64
                        if held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
            if rows:
                yield made(rows)

    return spots.select("key", "shard", "from_place", "to_place", "file", "at", "first_token").mapInArrow(
        read, "key string, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


def get(tables: TokenFiles, key) -> list[np.ndarray]:
    """The ids of every document with one key, by single reads of the files."""
    import xxhash

    name = b"" if key is None else b"=" + str(key).encode()
    signed = xxhash.xxh64_intdigest(name, 42)
    bucket = (signed - (1 << 64) if signed >> 63 else signed) % tables.buckets
    found = tables.index.where(F.col("bucket") == bucket).collect()
    if not found:
        return []
    store, inner = open_fs(found[0]["file"])
    with store.open_input_file(inner) as f:
        slot = Index(lambda start, n: (f.seek(start), f.read(n))[1]).get(name)
    out = []
    if slot is None:
        return out
    for r in tables.shards.where(F.col("shard").between(int(slot["shard"]), int(slot["last_shard"]))).orderBy("shard").collect():
        a = int(slot["place"]) if r["shard"] == slot["shard"] else 0
        b = int(slot["last_place"]) + 1 if r["shard"] == slot["last_shard"] else r["documents"]
        (store, inner), (at_store, at_inner) = open_fs(r["ids"]), open_fs(r["at"])
        with store.open_input_file(inner) as f, at_store.open_input_file(at_inner) as g:
            for place in range(a, b):
                g.seek(8 * place)
                lo, hi = np.frombuffer(g.read(16), "<i8")
                f.seek(int(lo) * int(tables.type[2]))
                out.append(np.frombuffer(f.read(int(hi - lo) * int(tables.type[2])), tables.type))
    return out


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read from the files by key."""
    files = write_tokens(docs, tokenizer, end_id, folder)
    asked = docs.select(_key(docs, "doc_id").alias("key")).distinct()
    number = F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(dict(docs.dtypes)["doc_id"])
    return read_tokens(files, asked).select(number.alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op12_perfect_hash(spark, sf_dir, tokenizer: str | None = None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return round_trip(table(spark, sf_dir, "documents"), str(tokenizer), 2, fresh_folder(spark, "tokens"))
