"""Removal of repeated substrings by prefix-free parsing.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier
in the corpus (smaller doc_id, or earlier in the document).  Strings never cross
documents, overlaps count, and everything is judged on the input.

Method.  Rolling-hash triggers cut every text into overlapping phrases (see
``phrases.py``): each phrase stands for the strings that elect one trigger, and equal
strings sit at equal offsets from equal triggers.  So all strings are decided on
two levels, and only the parse, about one row per 30 bytes, is ever shuffled:

1. Parse: phrases grouped by the hashes of trigger and phrase, by position within; no suffix
   array of the parse is built, as a string never reaches beyond its phrase.  A phrase that occurred
   before is repeated as a whole.  A phrase whose trigger no other phrase has cannot hold
   a repeated string.  What is left are the dictionary phrases whose trigger has several
   surroundings: the edges of repeats.
2. Dictionary: the suffixes of these phrases are ranked by their bytes (a suffix array to the
   depth of a string, for the phrases of whole triggers together).  Rank, then place in the
   parse, is the order of the corpus's strings; of equal neighbours all but the earliest are
   repeated.

Scale.  Hot passages: a map task keeps the first of each phrase and settles the rest
itself; of several phrases with one trigger, only the task's first goes to the trigger's
partition, the others go by phrase, so a trigger never gathers more than a row per task.
In level 2, the phrases of a trigger with more than ``HOT`` phrases are compared within
each task first, and only strings that a task has not seen are dealt out, by the string.

Disk.  The parse, each round of level 2 and the removal are jobs of their own: what they
find is written to the shared folder, so a lost executor does not repeat the parse, and the
files of a job's exchanges go before the next one begins.  Repeated runs are packed by
bucket of documents, some six bytes each, and dealt out to the texts as they are.  The
bytes of undecided phrases go out in as many rounds, by trigger, as keep a round's
bytes within those of the texts (or ``ROUND``): however many phrases of a large corpus are
undecided, the disk stays in proportion to it.  Every round and the removal shuffle the texts once.

Equality in level 1 is that of independent hashes of trigger (64 bits) and phrase (54
bits); level 2 is exact.

Defined results: null text is empty; texts shorter than ``LENGTH`` keep all bytes; a
null doc_id comes last; rows that share a doc_id are ordered by a hash of their text,
and rows that share doc_id and text are one document, whose result each of them gets;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonelens.llm.common import buckets, fresh_folder, slices, table
from zonelens.llm.phrases import Fingerprints, phrases
from zonelens.llm.words import pieces
from zonelens.session import prepare_workers, shuffles_removed

LENGTH, GRAIN = 100, 36
#: Phrases with one trigger that level 2 compares in one group (under a megabyte).
HOT = 5000
#: Phrases that a map task holds at a time; bytes of a text that are parsed at a time.
HELD, SEGMENT = 300_000, 1 << 20
LAST = (1 << 63) - 1
MOST_RUN = 200
#: Bytes of undecided phrases that a round of level 2 may deal out, however small the texts.
ROUND = 1 << 28
START_BITS = 40  # `at` is the document's sub-number, then the byte where a string starts


def parse_texts(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text number, start, number of strings, trigger and phrase hash of all phrases."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]

    def add(numbers, offsets, chunk, keep=None):
        lens = np.array([len(c) for c in chunk], np.int64)
        base = np.cumsum(lens) - lens
        fp = Fingerprints(np.frombuffer(b"".join(chunk), np.uint8))
        doc, a, n, trigger = phrases(fp, base, base + lens, LENGTH, GRAIN)
        if keep is not None:
            ok = (a >= keep[0]) & (a < keep[1])
            doc, a, n, trigger = doc[ok], a[ok], n[ok], trigger[ok]
        last = a + n - 1
        out[0].append(numbers[doc])
        out[1].append(a - base[doc] + offsets[doc])
        out[2].append(n)
        out[3].append(fp.first(trigger, trigger + GRAIN).view(np.int64))
        out[4].append(fp.second(a, last + LENGTH).view(np.int64))

    small = [i for i, r in enumerate(raws) if LENGTH <= len(r) <= SEGMENT]
    if small:
        add(np.array(small), np.zeros(len(small), np.int64), [raws[i] for i in small])
    for i, r in enumerate(raws):
        if len(r) > SEGMENT:  # a segment gets enough bytes around it to see whole phrases
            for s in range(0, len(r), SEGMENT):
                lo = max(0, s - 2 * LENGTH)
                add(np.array([i]), np.array([lo]), [r[lo:s + SEGMENT + 3 * LENGTH]], (s - lo, s - lo + SEGMENT))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: is each row the first of its group?"""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


# kinds of rows of the parse
ONE, SEVERAL, BY_PHRASE, REPEATED = 0, 1, 2, 3


def pack(v, n, kind):
    """Phrase hash (54 bits), number of strings and kind in one integer."""
    return (v & ~np.int64(0x3FF)) | (n.astype(np.int64) << 2) | kind


def unpack(mark):
    return mark & ~np.int64(0x3FF), (mark >> 2) & 0xFF, mark & 3


def settle_locally(k, v, doc, at, n):
    """What one task knows about its phrases: trigger, mark, doc, at, in reading order."""
    v = v & ~np.int64(0x3FF)
    o = np.lexsort((at, doc, v, k))
    kk, doc_, at_ = k, doc, at
    k, v, doc, at = k[o], v[o], doc[o], at[o]
    first_k, first_v = _groups(k), _groups(k, v)
    of_v = np.maximum.accumulate(np.where(first_v, np.arange(len(k)), 0))
    again = ~first_v & ((doc != doc[of_v]) | (at != at[of_v]))
    # of the phrases with one trigger, the earliest represents it
    group = np.cumsum(first_k) - 1
    heads = np.flatnonzero(first_v)
    by_place = heads[np.lexsort((at[heads], doc[heads], group[heads]))]
    lead = by_place[_groups(group[by_place])] if len(by_place) else by_place
    kind = np.full(len(k), -1, np.int8)
    kind[again] = REPEATED
    kind[heads] = BY_PHRASE
    several = np.bincount(group[heads], minlength=len(lead)) > 1 if len(heads) else np.zeros(0, bool)
    kind[lead] = np.where(several[group[lead]], SEVERAL, ONE)
    back = np.empty(len(o), np.int8)
    back[o] = kind
    keep = back >= 0
    original = np.empty(len(o), np.int64)
    original[o] = v
    return [kk[keep], pack(original, n, np.maximum(back, 0))[keep], doc_[keep], at_[keep]]


def settle_triggers(k, mark, doc, at):
    """One partition of the parse: (repeated?, trigger, doc, at, n) of the phrases that
    are repeated as a whole and of those that level 2 must look into; by document."""
    v, n, kind = unpack(mark)
    done = kind == REPEATED
    out = [(np.ones(done.sum(), bool), np.zeros(done.sum(), np.int64), doc[done], at[done], n[done])]
    for mine in (kind == BY_PHRASE, (kind == ONE) | (kind == SEVERAL)):
        kk, vv, dd, aa, nn, several = k[mine], v[mine], doc[mine], at[mine], n[mine], kind[mine] == SEVERAL
        o = np.lexsort((aa, dd, vv, kk))
        kk, vv, dd, aa, nn, several = kk[o], vv[o], dd[o], aa[o], nn[o], several[o]
        first_v = _groups(kk, vv)
        of_v = np.maximum.accumulate(np.where(first_v, np.arange(len(kk)), 0))
        again = ~first_v & ((dd != dd[of_v]) | (aa != aa[of_v]))
        group = np.cumsum(_groups(kk)) - 1
        size = int(group[-1]) + 1 if len(group) else 0
        open_ = np.ones(size, bool)
        if not (kind[mine] == BY_PHRASE).any():
            open_ = (np.bincount(group, weights=first_v, minlength=size) > 1) | (
                np.bincount(group, weights=several, minlength=size) > 0)
        for what, flag in ((again, True), (first_v & open_[group] if size else first_v, False)):
            out.append((np.full(what.sum(), flag), np.zeros(what.sum(), np.int64) if flag else kk[what], dd[what], aa[what], nn[what]))
    repeated, k, doc, at, n = (np.concatenate(x) for x in zip(*out))
    o = np.lexsort((at, doc, repeated))
    return [repeated[o], k[o], doc[o], at[o], n[o].astype(np.int32)]


def _columns(batches, names):
    """All rows of a partition as arrays (bounded by the number of partitions)."""
    import pyarrow as pa

    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    whole = pa.Table.from_batches(got)
    return [whole.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names]


def _emit(arrays, names, most: int = 200_000):
    import pyarrow as pa

    for i in range(0, len(arrays[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(x[i:i + most]) for x in arrays], names)


def _parse(batches):
    names = ["k", "mark", "doc", "at"]
    held, size = [], 0
    for batch in slices(batches):
        docs, subs = (batch.column(c).to_numpy() for c in (0, 1))
        for first, raws in pieces(batch.column(2).to_pylist()):
            number, start, n, k, v = parse_texts(raws)
            at = (subs[first + number].astype(np.int64) << START_BITS) | start
            held.append((k, v, docs[first + number], at, n))
            size += len(k)
            if size >= HELD:
                yield from _emit(settle_locally(*(np.concatenate(x) for x in zip(*held))), names)
                held, size = [], 0
    if size:
        yield from _emit(settle_locally(*(np.concatenate(x) for x in zip(*held))), names)


def spark_hash(*longs: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of columns of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(longs[0]), 42, np.uint64)
    for v in longs:
        h += p5 + np.uint64(8)
        h ^= turned(v.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = turned(h, 27) * p1 + p4
        for shift, factor in ((33, p2), (29, p3)):
            h ^= h >> np.uint64(shift)
            h *= factor
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def pack_runs(doc, at, n) -> bytes:
    """Runs in the order of doc: by column the bytes that any row needs."""
    out = [len(doc).to_bytes(4, "little")]
    for v in (np.diff(doc, prepend=np.int64(0)), at, n.astype(np.int64)):
        v = np.ascontiguousarray(v)
        width = (int(np.bitwise_or.reduce(v.view(np.uint64))).bit_length() + 7) // 8
        out += [bytes([width]), v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def unpack_runs(packed: bytes):
    """doc, at, n."""
    size, at, out = int.from_bytes(packed[:4], "little"), 4, []
    for _ in range(3):
        width = packed[at]
        v = np.zeros((size, 8), np.uint8)
        v[:, :width] = np.frombuffer(packed, np.uint8, size * width, at + 1).reshape(width, size).T
        at += 1 + size * width
        out.append(v.view(np.int64).ravel())
    return np.cumsum(out[0]), out[1], out[2]


def by_bucket(doc, at, n, parts: int):
    """These runs packed, a row (bucket, runs) for each bucket of documents."""
    bucket = (spark_hash(doc, at >> START_BITS) % parts).astype(np.int32)
    o = np.lexsort((at, doc, bucket))
    bucket, doc, at, n = bucket[o], doc[o], at[o], n[o]
    begin = np.flatnonzero(_groups(bucket))
    return bucket[begin], [pack_runs(doc[b:e], at[b:e], n[b:e]) for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(o)])]


def _settle(batches, parts: int):
    """Of a partition of the parse: how many strings it has (bucket -1), its repeated
    runs by bucket, and the phrases that level 2 must look into (no bucket)."""
    import pyarrow as pa

    cols = _columns(batches, ["k", "mark", "doc", "at"])
    if cols is None:
        return
    names = ["bucket", "runs", "k", "doc", "at", "n"]
    nulls = lambda size, kind=pa.int64(): pa.nulls(size, kind)
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), nulls(1, pa.binary()), nulls(1), nulls(1), nulls(1),
                                      pa.array([unpack(cols[1])[1].sum()], pa.int64())], names)
    repeated, k, doc, at, n = settle_triggers(*cols)
    bucket, runs = by_bucket(doc[repeated], at[repeated], n[repeated], parts)
    for i in range(0, len(runs), 1000):
        size = len(runs[i:i + 1000])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[i:i + 1000]), pa.array(runs[i:i + 1000], pa.binary()),
                                          nulls(size), nulls(size), nulls(size), nulls(size)], names)
    k, doc, at, n = (x[~repeated] for x in (k, doc, at, n.astype(np.int64)))
    for i in range(0, len(k), 200_000):
        j = slice(i, i + 200_000)
        size = len(k[j])
        yield pa.RecordBatch.from_arrays([nulls(size, pa.int32()), nulls(size, pa.binary()), *(pa.array(x[j]) for x in (k, doc, at, n))], names)


def suffix_ranks(data: np.ndarray) -> np.ndarray:
    """Rank, in byte order, of the ``LENGTH`` bytes that begin at each place of ``data``:
    the dictionary's suffix array to that depth, by doubling (places less than ``LENGTH``
    bytes before the end have no meaning).  Equal bytes, and only these, have equal ranks."""
    whole = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.zeros(len(data), np.uint64)
    for i in range(8):
        head = (head << np.uint64(8)) | whole[i:len(data) + i]
    rank, known = np.unique(head, return_inverse=True)[1], 8
    while known < LENGTH:
        step = min(known, LENGTH - known)
        later = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), rank.dtype)])[:len(rank)]
        rank, known = np.unique((rank << 32) | later, return_inverse=True)[1], known + step
    return rank


def sorted_strings(doc, at, n, phrase: list[bytes]):
    """The strings of these phrases in the order of the corpus's suffixes: by their bytes
    (the dictionary's order), equal ones by where they stand (the order of the parse).
    Gives the bytes, and of each string where it lies in them, doc, at, and whether it
    occurred before: its neighbour is equal."""
    lens = np.array([len(p) for p in phrase], np.int64)
    base = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(phrase), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    left, where, d = base[row] + j, at[row] + j, doc[row]
    rank = suffix_ranks(data)[left]
    o = np.lexsort((where, d, rank))
    left, where, d, rank = left[o], where[o], d[o], rank[o]
    new = np.append(True, rank[1:] != rank[:-1])[:len(o)]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0)) if len(o) else np.zeros(0, np.int64)
    return data, left, d, where, (d != d[lead]) | (where != where[lead])


def runs_of(d, where):
    """Neighbouring strings as doc, first at, number."""
    o = np.lexsort((where, d))
    d, where = d[o], where[o]
    begin = np.ones(len(d), bool)
    begin[1:] = (d[1:] != d[:-1]) | (where[1:] - where[:-1] > 1)
    begin[::MOST_RUN] = True  # a run's length is kept in one byte
    begin = np.flatnonzero(begin)
    runs = where[np.append(begin[1:], len(d)) - 1] - where[begin] + 1 if len(d) else np.zeros(0, np.int64)
    return d[begin], where[begin], runs.astype(np.int32)


def repeated_whole(doc, at, strings: list[bytes]):
    """``repeated_strings`` of single strings, ordered by eight bytes at a time."""
    block = np.zeros((len(strings), -(-LENGTH // 8) * 8), np.uint8)
    block[:, :LENGTH] = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, LENGTH)
    keys = block.view(">u8").astype(np.uint64).T
    o = np.lexsort((at, doc, *keys[::-1]))
    doc, at, new = doc[o], at[o], _groups(*(k[o] for k in keys))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    again = (doc != doc[lead]) | (at != at[lead])
    return runs_of(doc[again], at[again])


def repeated_strings(doc, at, n, phrase: list[bytes]):
    """Of the strings of these phrases: doc, at, n of the runs that occurred before."""
    _, _, d, where, again = sorted_strings(doc, at, n, phrase)
    return runs_of(d[again], where[again])


def _strings(batches):
    """Level 2, map side: the bytes of open phrases, by trigger.  Those of hot triggers
    are settled within the task, and only the strings that it sees first go on, by
    string (n is 0); the others are sent to the documents as repeated (no phrase)."""
    import pyarrow as pa

    names = ["route", "doc", "at", "n", "phrase"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    cold, hot, held, strings = [], [], 0, 0

    def of_hot():
        doc, at, n, phrase = zip(*hot)
        data, left, d, where, again = sorted_strings(*(np.array(x, np.int64) for x in (doc, at, n)), list(phrase))
        first = np.flatnonzero(~again)
        for i in range(0, len(first), 50_000):
            f = first[i:i + 50_000]
            block = np.ascontiguousarray(data[left[f][:, None] + np.arange(LENGTH)])
            route = Fingerprints(block.ravel()).first(np.arange(len(f)) * LENGTH, np.arange(1, len(f) + 1) * LENGTH).view(np.int64)
            text = pa.Array.from_buffers(pa.binary(LENGTH), len(f), [None, pa.py_buffer(block)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(d[f]), pa.array(where[f]),
                                              pa.array(np.zeros(len(f), np.int32)), text], names)
        d, where, runs = runs_of(d[again], where[again])
        for i in range(0, len(d), 200_000):
            k = slice(i, i + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(d[k] ^ where[k]), pa.array(d[k]), pa.array(where[k]), pa.array(runs[k]),
                                              pa.nulls(len(d[k]), pa.binary())], names)

    for batch in slices(batches):
        for doc, text, todo in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "todo"))):
            raw = text.encode("utf-8", "replace")
            for item in todo:
                at, n = item["at"], item["n"]
                s = at & ((1 << START_BITS) - 1)
                if item["hot"]:
                    hot.append((doc, at, n, raw[s:s + n - 1 + LENGTH]))
                    strings += n
                else:
                    cold.append((item["k"], doc, at, n, raw[s:s + n - 1 + LENGTH]))
                    held += 200
        if held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cold), kinds)], names)
            cold, held = [], 0
        if strings > 300_000:
            yield from of_hot()
            hot, strings = [], 0
    if cold:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cold), kinds)], names)
    if hot:
        yield from of_hot()


def _compare(batches, parts: int):
    """Level 2, reduce side: repeated runs, packed by bucket."""
    found = [x for x in _repeated(batches) if len(x[0])]
    if found:
        yield from _emit(by_bucket(*(np.concatenate(x) for x in zip(*found)), parts), ["bucket", "runs"], 1000)


def _repeated(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    whole = pa.Table.from_batches(got)
    done = whole.filter(pc.is_null(whole.column("phrase")))
    if done.num_rows:
        yield [done.column(c).combine_chunks().to_numpy() for c in ("doc", "at", "n")]
    whole = whole.filter(pc.is_valid(whole.column("phrase")))
    single = pc.equal(whole.column("n"), 0)  # of hot triggers, dealt out by string
    for part, compare in ((whole.filter(single), lambda doc, at, n, phrase: repeated_whole(doc, at, phrase)),
                          (whole.filter(pc.invert(single)), repeated_strings)):
        if not part.num_rows:
            continue
        route, doc, at, n = (part.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("route", "doc", "at", "n"))
        texts = part.column("phrase").to_pylist()
        o = np.argsort(route, kind="stable")
        edges = np.flatnonzero(_groups(route[o]))
        # whole groups, some hundred thousand strings at a time
        upto = np.append(edges[1:], len(o))
        size, begin = 0, 0
        for i, e in enumerate(upto):
            size += int(np.maximum(n[o[edges[i]:e]], 1).sum())
            if size >= 300_000 or i == len(edges) - 1:
                pick = o[begin:e]
                yield compare(doc[pick], at[pick], n[pick].astype(np.int64), [texts[x] for x in pick])
                size, begin = 0, e


def _remove(batches):
    """Of a bucket of documents: first the packed runs, then the texts."""
    import pyarrow as pa

    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    held, spans_of, s, e = [], None, None, None
    for part in slices(batches):
        known = part.column("runs").is_valid()
        held += [unpack_runs(x) for x in part.column("runs").filter(known).to_pylist()]
        part = part.filter(part.column("runs").is_null())
        if not part.num_rows:
            continue
        if spans_of is None:
            doc, at, n = (np.concatenate(x) for x in zip(*held)) if held else [np.zeros(0, np.int64)] * 3
            o = np.lexsort((at, doc))
            doc, at, n = doc[o], at[o], n[o]
            sub, s = at >> START_BITS, at & ((1 << START_BITS) - 1)
            e = s + n + LENGTH - 1
            begin = np.flatnonzero(_groups(doc, sub)).tolist()
            spans_of = dict(zip(zip(doc[begin].tolist(), sub[begin].tolist()), zip(begin, [*begin[1:], len(o)])))
            held = []
        sizes, removed, spans, kept = [], [], [], []
        for doc, sub, text in zip(*(part.column(c).to_pylist() for c in ("doc", "sub", "text"))):
            raw = text.encode("utf-8", "replace")
            sizes.append(len(raw))
            if (doc, sub) not in spans_of:
                removed.append(0)
                spans.append([])
                kept.append(raw)
                continue
            x, y = spans_of[doc, sub]
            starts, ends = s[x:y], np.maximum.accumulate(e[x:y])
            begin = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
            starts, ends = starts[begin], ends[np.append(begin[1:], len(ends)) - 1]
            at, left = 0, []
            for x, y in zip(starts.tolist(), ends.tolist()):
                left.append(raw[at:x])
                at = y
            left.append(raw[at:])
            kept.append(b"".join(left))
            removed.append(len(raw) - len(kept[-1]))
            spans.append([{"start": x, "end": y} for x, y in zip(starts.tolist(), ends.tolist())])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kinds),
             pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, doc (its place in the corpus order), sub (among rows of one doc), text."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    texts = docs.select("doc_id", doc.alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shared = texts.groupBy("doc").count().where("count > 1").select("doc")
    with shuffles_removed(docs.sparkSession):
        none = shared.isEmpty()
    if none:
        return texts.withColumn("sub", F.lit(0))
    hashed = texts.withColumn("h", F.xxhash64("text"))
    subs = (hashed.select("doc", "h").join(shared, "doc", "left_semi").distinct()
            .withColumn("sub", F.row_number().over(Window.partitionBy("doc").orderBy("h")) - 1))
    return hashed.join(subs, ["doc", "h"], "left").select("doc_id", "doc", "text", F.coalesce("sub", F.lit(0)).alias("sub"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed bytes, maximal), kept (bytes)."""
    spark = docs.sparkSession
    prepare_workers(spark)
    parts = buckets(spark)
    texts = _numbered(docs).select("doc_id", "doc", F.col("sub").cast("long").alias("sub"), "text")
    parsed = texts.select("doc", "sub", "text").mapInArrow(_parse, "k long, mark long, doc long, at long")
    kind = F.col("mark").bitwiseAND(3)
    route = (F.when(kind == BY_PHRASE, F.xxhash64("k", F.shiftright("mark", 10)))
             .when(kind == REPEATED, F.xxhash64("doc", "at")).otherwise(F.col("k")))
    folder = fresh_folder(spark, "parse")
    with shuffles_removed(spark):
        parsed.repartition(parts, route).mapInArrow(
            lambda batches: _settle(batches, parts), "bucket int, runs binary, k long, doc long, at long, n long").write.parquet(folder)
    settled = spark.read.schema("bucket int, runs binary, k long, doc long, at long, n long").parquet(folder)
    open_ = settled.where("bucket IS NULL").select("k", "doc", "at", "n")
    runs = [settled.where("bucket >= 0").select("bucket", "runs")]
    runs += [_edges(texts, of_round, parts) for of_round in _rounds(settled, open_)]
    packed = reduce(DataFrame.unionByName, runs)
    bucket = F.pmod(F.xxhash64("doc", "sub"), F.lit(parts)).cast("int").alias("bucket")
    dealt = texts.select(bucket, "*").unionByName(packed, allowMissingColumns=True).repartitionById(parts, "bucket")
    return dealt.sortWithinPartitions(F.col("runs").isNull()).mapInArrow(
        _remove, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, "
                 "spans array<struct<start:bigint,end:bigint>>, kept binary")


def _rounds(settled: DataFrame, open_: DataFrame) -> list[DataFrame]:
    """The phrases of level 2 in parts of whole triggers, each of about as many bytes to
    deal out as the texts have strings (or ``ROUND``)."""
    spark = open_.sparkSession
    most = LENGTH + 64  # bytes of a phrase beside its strings: place and trigger count as 64
    groups = open_.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    with shuffles_removed(spark):
        strings = settled.where("bucket = -1").agg(F.sum("n")).first()[0] or 0
        dealt = groups.agg(F.sum(F.when(F.col("size") > HOT, F.col("n") * most).otherwise(F.col("n") + F.col("size") * most))).first()[0] or 0
    rounds = -(-dealt // max(strings, ROUND))
    return [open_.where(F.pmod(F.xxhash64("k"), F.lit(rounds)) == i) for i in range(rounds)]


def _edges(texts: DataFrame, open_: DataFrame, parts: int) -> DataFrame:
    """bucket, runs: a round of level 2, written to the shared folder."""
    spark = texts.sparkSession
    hot = open_.groupBy("k").count().where(F.col("count") > HOT).select("k", F.lit(True).alias("hot"))
    todo = (open_.join(hot, "k", "left").select("doc", F.shiftright("at", START_BITS).alias("sub"), F.struct(
        "k", "at", "n", F.coalesce("hot", F.lit(False)).alias("hot")).alias("todo"))
        .groupBy("doc", "sub").agg(F.collect_list("todo").alias("todo")))
    strings = (texts.select("doc", "sub", "text").join(todo, ["doc", "sub"]).select("doc", "text", "todo")
               .mapInArrow(_strings, "route long, doc long, at long, n int, phrase binary"))
    folder = fresh_folder(spark, "edges")
    with shuffles_removed(spark):
        strings.repartition(parts, "route").mapInArrow(lambda batches: _compare(batches, parts), "bucket int, runs binary").write.parquet(folder)
    return spark.read.schema("bucket int, runs binary").parquet(folder)


def op1_prefix_free_parsing(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
