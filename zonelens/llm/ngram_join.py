"""Exact Jaccard self-join of word-shingle sets with a token-group matrix.

A document's set holds its distinct ``SHINGLE``-word shingles (A-Z lower-cased words
between white space); two documents link if 100 * |intersection| >= 80 * |union|.

Method.  Similar sets are partitioned into groups, each group stores the union of its
members' tokens, a query is compared with the unions first, and only groups whose
union could hold a partner are opened.

1. Equal sets become one.  A set's id is a 64-bit hash of its content; where sets that
   differ in a second one share it, the second one is their id.
2. Token-group matrix, sparse: sets are ordered by token hash, tokens common to many
   sets last.  Two linked sets share one of their first |s| - ceil(0.8 |s|) + 1 tokens,
   so only these are dealt out by token, and tokens of a single set are dropped at once.
3. Groups: every set names a leader, the set with the least id of most of its rows; sets
   with one leader form a group (parts of about ``GROUP`` members).  Sets whose bound (see 4)
   allows a link to their leader form first components.
4. A matrix row lists the groups that hold its token.  Each set queries the groups of
   other components in its rows (the smaller component queries the larger), after a
   length and position filter.  The bound on the overlap of query and group is taken on
   the group's union, kept as token counts by hash bucket (element-wise maximum of the
   members' counts): sum of minima, never below the true overlap.  Groups that reach
   ceil(0.8 |query|) are opened, members are bounded in the same way, and what is left is
   compared exactly, token by token, as are sets and leaders.
5. The links give components.  Where sets of one first component did not link, step 4 is
   repeated between their components within it.

No link is lost: all bounds are upper bounds, and sets that are not compared are in one
component already.  No group is compared all with all, and copies are never expanded.

Scale.  Step 2 shuffles about a fifth of the tokens, the only large shuffle of tokens.
The tokens of sets that have a candidate are fetched from their texts once, each from one
row, named by its content and not by its doc_id: the list of
these sets is broadcast up to ``MOST_WANTED`` (counted first), and joined by a shuffle
beyond.  Common tokens (more
than ``COMMON`` sets, counted by tasks that see at least ``REPORT`` of them) are found while
the sets are first read; at most ``MOST_COMMON`` of them are broadcast (8 bytes each).  The
order is only a matter of speed: should the row of another token still exceed ``LONG``
sets, its token joins the common ones and step 2 is run again (``PASSES`` times at most).

Defined results: null text, and text without words, has the empty set, links with nothing
and is its own component; fewer than ``SHINGLE`` words make one shingle of the whole
sequence; a null doc_id is carried and takes part only as a copy or member (the component's
id is the least non-null doc_id, null if there is none); repeated rows are copies of one
another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import ROW, buckets, cut, folder_of, keep_decided, slices, stored, table, with_row
from zonelens.llm.components import components
from zonelens.llm.words import STEP, Words, mixed, pieces
from zonelens.session import prepare_workers, scratch

SHINGLE, PERCENT = 5, 80
COMMON, MOST_COMMON, LONG, GROUP = 12, 1_000_000, 1000, 64
#: Ids of sets to fetch (16 bytes each) that are broadcast to the texts.
MOST_WANTED = 1_000_000
#: Tokens that a map task holds at a time, and how many of its sets must share a token
#: that it reports.  Passes over the matrix in which common tokens are still added.
HELD, REPORT, PASSES = 1_000_000, 3, 3


def shingle_sets(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    w = Words(raws)
    grams, at = w.grams(SHINGLE)
    doc = w.doc[at]
    for c in range(1, SHINGLE):  # the whole sequence of a short text
        few = np.flatnonzero(w.count == c)
        if len(few):
            h = np.full(len(few), np.uint64(c), np.uint64)
            for j in range(c):
                h = h * STEP + w.hash[w.first[few] + j]
            grams, doc = np.concatenate([grams, mixed(h)]), np.concatenate([doc, few])
    o = np.lexsort((grams, doc))
    grams, doc = grams[o], doc[o]
    new = np.ones(len(doc), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(raws) + 1))


def set_ids(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ids of each set's content (0: empty)."""
    upto = np.concatenate([[np.uint64(0)], np.cumsum(mixed(grams ^ np.uint64(0x5BD1E9955BD1E995)))])
    again = np.concatenate([[np.uint64(0)], np.cumsum(mixed(grams * np.uint64(0x9E3779B97F4A7C15)))])
    n = np.diff(bounds)
    one, two = (x[bounds[1:]] - x[bounds[:-1]] for x in (upto, again))
    ids = mixed(one + two * STEP + n.astype(np.uint64))
    second = mixed(one * np.uint64(0xFF51AFD7ED558CCD) ^ (two + np.uint64(0xC4CEB9FE1A85EC53)))
    ids[n == 0] = second[n == 0] = 0
    return ids.view(np.int64), second.view(np.int64)


def _settled(ids: np.ndarray, second: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The id by which a set is known: the second one where several sets share the first."""
    if not len(shared):
        return ids
    at = np.minimum(np.searchsorted(shared, ids), len(shared) - 1)
    return np.where(shared[at] == ids, second, ids)


def _buckets(n: int) -> int:
    m = 64
    while m < n // 2 and m < 8192:
        m *= 2
    return m


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Token counts by hash bucket (more buckets for larger sets; at 255, full)."""
    m = _buckets(len(tokens))
    return np.minimum(np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m), 255).astype(np.uint8)


def fold(counts: np.ndarray, m: int) -> np.ndarray:
    """The same counts (last axis) in m buckets; full buckets stay an upper bound."""
    full = counts == 255
    out = counts.astype(np.int32)
    out[full] = 1 << 20
    return out.reshape(*counts.shape[:-1], -1, m).sum(-2)


def overlap_bound(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of one set with each of many (rows)."""
    m = min(one.shape[-1], many.shape[-1])
    return np.minimum(fold(one, m), fold(many, m)).sum(-1)


def prefix_length(n):
    return n - (PERCENT * n + 99) // 100 + 1


def enough(a, b):
    """Least overlap with which sets of a and b tokens link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def may_link(n1, p1, n2, p2):
    """For sets with a shared token at these places: could it be their first shared
    one, and their overlap enough?"""
    return (np.minimum(n1 - p1, n2 - p2) >= enough(n1, n2)) & (100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2))


def _sets(batches, columns):
    """(other columns of the rows, tokens, bounds, both ids) of pieces of whole texts."""
    for batch in slices(batches, 2000):
        others = [batch.column(c) for c in columns]
        for first, raws in pieces(batch.column("text").to_pylist()):
            grams, bounds = shingle_sets(raws)
            yield [c.slice(first, len(raws)) for c in others], grams, bounds, set_ids(grams, bounds)


def _first_tokens(grams, bounds, common: np.ndarray):
    """Set number, token and place of each set's first tokens; common tokens last."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    if len(common) and len(grams):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        late = common[at] == grams
        o = np.lexsort((late, owner))  # stable: hash order within
        grams = grams[o]
    place = np.arange(len(grams)) - bounds[owner]
    mine = place < prefix_length(n)[owner]
    return owner[mine], grams[mine], place[mine]


def _read(batches, also=()):
    """Rows of the documents (token null; with their columns ``also``), and of tokens
    that several sets share."""
    import pyarrow as pa

    names = ["doc_id", "sid", "second", "n", "counts", "token", "sets", *also]
    seen, tokens, held = [], [], 0

    def shared(kind):
        _, first = np.unique(np.concatenate(seen), return_index=True)
        size = np.concatenate([np.diff(b) for _, b in tokens])
        keep = np.zeros(len(size), bool)
        keep[first] = True  # each set once
        tok = np.concatenate([g for g, _ in tokens])[np.repeat(keep, size)]
        tok.sort()
        edge = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])) if len(tok) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(tok)))
        tok, count = tok[edge][count >= REPORT].view(np.int64), count[count >= REPORT]
        return pa.RecordBatch.from_arrays([pa.nulls(len(tok), kind), pa.nulls(len(tok), pa.int64()), pa.nulls(len(tok), pa.int64()),
                                           pa.nulls(len(tok), pa.int32()), pa.nulls(len(tok), pa.binary()), pa.array(tok), pa.array(count, pa.int64()),
                                           *[pa.nulls(len(tok), pa.string()) for _ in also]], names)

    kind = pa.int64()
    for (ids, *others), grams, bounds, (sids, second) in _sets(batches, ["doc_id", *also]):
        kind = ids.type
        m = len(sids)
        counts = [sketch(grams[a:b]).tobytes() if b > a else None for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([ids, pa.array(sids), pa.array(second), pa.array(np.diff(bounds), pa.int32()), pa.array(counts, pa.binary()),
                                          pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *others], names)
        seen.append(sids)
        tokens.append((grams, bounds))
        held += len(grams)
        if held >= HELD:
            yield shared(kind)
            seen, tokens, held = [], [], 0
    if seen:
        yield shared(kind)


def _deal(common, shared):
    """The matrix, map side: first tokens of each set (once per task)."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for _, grams, bounds, both in _sets(batches, []):
            sids = _settled(*both, shared)
            new = np.zeros(len(sids), bool)
            for i, s in enumerate(sids.tolist()):
                if s and s not in seen:
                    seen.add(s)
                    new[i] = True
            if len(seen) > HELD // 4:
                seen.clear()
            owner, tok, place = _first_tokens(grams, bounds, common.value)
            mine = new[owner]
            owner, tok, place = owner[mine], tok[mine], place[mine]
            for i in range(0, len(owner), 100_000):
                o = owner[i:i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tok[i:i + 100_000].view(np.int64)), pa.array(sids[o]), pa.array(np.diff(bounds)[o], pa.int32()),
                     pa.array(place[i:i + 100_000], pa.int32())], ["token", "sid", "n", "place"])

    return run


def _table(batches):
    import pyarrow as pa

    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def _col(whole, c):
    return whole.column(c).combine_chunks().to_numpy(zero_copy_only=False)


def _rows_of(batches):
    """The matrix, reduce side: tokens of several sets, with each set's choice of a
    leader (least id) and whether any set of the row may link with it."""
    import pyarrow as pa

    whole = _table(batches)
    if whole is None:
        return
    tok, sid, n, place = (_col(whole, c) for c in ("token", "sid", "n", "place"))
    o = np.lexsort((sid, tok))
    tok, sid, n, place = tok[o], sid[o], n[o].astype(np.int64), place[o].astype(np.int64)
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])
    tok, sid, n, place = tok[new], sid[new], n[new], place[new]
    head = np.ones(len(tok), bool)
    head[1:] = tok[1:] != tok[:-1]
    row = np.cumsum(head) - 1
    size = np.bincount(row)
    keep = size[row] > 1
    tok, sid, n, place, row = tok[keep], sid[keep], n[keep], place[keep], row[keep]
    head = np.ones(len(tok), bool)
    head[1:] = tok[1:] != tok[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(tok)), 0)) if len(tok) else np.zeros(0, np.int64)
    with_lead = (lead != np.arange(len(tok))) & may_link(n, place, n[lead], place[lead])
    near = np.zeros(len(tok), bool)
    begins = np.flatnonzero(head)
    for a, b in zip(begins.tolist(), np.append(begins[1:], len(tok)).tolist()):
        if b - a > LONG:
            near[a:b] = True
        elif b - a == 2:
            near[a:b] = with_lead[a + 1]
        else:
            i, j = np.triu_indices(b - a, 1)
            ok = may_link(n[a + i], place[a + i], n[a + j], place[a + j])
            near[a + i[ok]] = True
            near[a + j[ok]] = True
    for i in range(0, len(tok), 200_000):
        s = slice(i, i + 200_000)
        if near[s].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[s][near[s]]) for x in (tok, sid, n.astype(np.int32), place.astype(np.int32))]
                + [pa.array(sid[lead[s]][near[s]], mask=~with_lead[s][near[s]])], ["token", "sid", "n", "place", "leader"])


def _fetch(shared):
    """The tokens of the wanted sets, from the rows that stand for them."""

    def run(batches):
        import pyarrow as pa

        for (sids,), grams, bounds, both in _sets(batches, ["sid"]):
            fits = np.flatnonzero(sids.to_numpy() == _settled(*both, shared))
            raw = [grams[bounds[i]:bounds[i + 1]].tobytes() for i in fits]
            yield pa.RecordBatch.from_arrays([sids.take(pa.array(fits)), pa.array(raw, pa.binary())], ["sid", "tokens"])

    return run


def _bounded(batches):
    """Pairs whose bound is enough."""
    import pyarrow as pa

    for batch in batches:
        x, y = (batch.column(c).to_pylist() for c in ("a_counts", "b_counts"))
        nx, ny = (batch.column(c).to_numpy().astype(np.int64) for c in ("a_n", "b_n"))
        need = enough(nx, ny)
        fits = 100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny)
        keep = [bool(f) and overlap_bound(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)) >= k
                for p, q, k, f in zip(x, y, need, fits)]
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _exact(batches):
    """Pairs that link."""
    import pyarrow as pa

    for batch in batches:
        keep = []
        for p, q in zip(batch.column("a_tokens").to_pylist(), batch.column("b_tokens").to_pylist()):
            x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int(np.count_nonzero(y[at] == x))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _side(sets: DataFrame, p: str, columns: list[str]) -> DataFrame:
    return sets.select(F.col("sid").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])


def _linked(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, token by token."""
    return (pairs.join(_side(tokens, "a", ["tokens"]), "a").join(_side(tokens, "b", ["tokens"]), "b")
            .mapInArrow(_exact, "a long, b long"))


def _placed(sets: DataFrame, comp: DataFrame) -> DataFrame:
    """sid, grp, comp, size of the component of every set (sid, grp)."""
    placed = (sets.join(comp.withColumnRenamed("node", "sid"), "sid", "left")
              .select("sid", "grp", F.coalesce("component", "sid").alias("comp")))
    sizes = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    return cut(placed.join(sizes, "comp").select("sid", "comp", "size", "grp"))


def _candidates(rows: DataFrame, placed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of different components that share a row, as far as the bounds on the
    groups' unions and then on their members allow."""
    asked = (rows.join(placed, "sid").repartition(buckets(rows.sparkSession), "token")
             .mapInArrow(_queries, "q long, grp long").distinct())
    known = sketches.select("sid", "n", "counts").join(placed, "sid")
    groups = (known.groupBy("grp").agg(F.collect_list(F.struct("sid", "n", "counts", "comp", "size")).alias("members"))
              .mapInArrow(_store, "grp long, tokens_union binary, counts binary, facts binary"))
    queries = known.select(F.col("sid").alias("q"), F.col("n").alias("q_n"), F.col("counts").alias("q_counts"),
                           F.col("comp").alias("q_comp"), F.col("size").alias("q_size"))
    return asked.join(queries, "q").join(groups, "grp").mapInArrow(_open, "a long, b long")


def _queries(batches):
    """Per matrix row: which sets query which groups of other components."""
    import pyarrow as pa

    whole = _table(batches)
    if whole is None:
        return
    tok, sid, n, place, comp, size, group = (_col(whole, c) for c in ("token", "sid", "n", "place", "comp", "size", "grp"))
    n, place = n.astype(np.int64), place.astype(np.int64)
    o = np.lexsort((sid, comp, size, tok))
    tok, sid, n, place, comp, size, group = (x[o] for x in (tok, sid, n, place, comp, size, group))
    head = np.ones(len(tok), bool)
    head[1:] = tok[1:] != tok[:-1]
    begins = np.flatnonzero(head)
    out: list[np.ndarray] = []
    held = 0

    def flush():
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["q", "grp"])

    for a, b in zip(begins.tolist(), np.append(begins[1:], len(tok)).tolist()):
        if comp[a] == comp[b - 1] and size[a] == size[b - 1]:
            continue
        # sorted by the component's size: each set queries what comes after its component
        edges = np.flatnonzero(np.append(True, comp[a + 1:b] != comp[a:b - 1]))
        after = np.append(edges[1:], b - a)
        for s, e in zip(edges.tolist(), after.tolist()):
            if e == b - a:
                break
            for i in range(a + s, a + e):
                r = slice(a + e, b)
                ok = may_link(n[i], place[i], n[r], place[r])
                if ok.any():
                    g = np.unique(group[r][ok])
                    out.append(np.stack([np.full(len(g), sid[i]), g], 1))
                    held += len(g)
            if held > 1_000_000:
                yield flush()
                out, held = [], 0
    if out:
        yield flush()


def _store(batches):
    """Groups as the matrix stores them: the union of the members' tokens, their own
    counts, and their ids, sizes, components and components' sizes."""
    import pyarrow as pa

    for batch in slices(batches):
        rows = []
        for grp, members in zip(batch.column("grp").to_pylist(), batch.column("members").to_pylist()):
            m = min(len(x["counts"]) for x in members)
            counts = np.stack([np.minimum(fold(np.frombuffer(x["counts"], np.uint8), m), 255).astype(np.uint8) for x in members])
            facts = np.array([[x[c] for x in members] for c in ("sid", "n", "comp", "size")], np.int64)
            rows.append((grp, counts.max(0).tobytes(), counts.tobytes(), facts.tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
                                         ["grp", "tokens_union", "counts", "facts"])


def _open(batches):
    """Groups whose union could hold a partner of the query are opened: its members
    of later components (see ``_queries``) whose own bound is enough, too."""
    import pyarrow as pa

    for batch in slices(batches):
        a, b = [], []
        for q, n, comp, size, mine, union, counts, facts in zip(*(batch.column(c).to_pylist() for c in (
                "q", "q_n", "q_comp", "q_size", "q_counts", "tokens_union", "counts", "facts"))):
            x, u = np.frombuffer(mine, np.uint8), np.frombuffer(union, np.uint8)
            if overlap_bound(x, u) < -(-PERCENT * n // 100):
                continue
            sids, sizes, comps, comp_sizes = np.frombuffer(facts, np.int64).reshape(4, -1)
            fits = np.flatnonzero((100 * np.minimum(sizes, n) >= PERCENT * np.maximum(sizes, n))
                                  & ((comp_sizes > size) | (comp_sizes == size) & (comps > comp)))
            if not len(fits):
                continue
            found = fits[overlap_bound(x, np.frombuffer(counts, np.uint8).reshape(len(sids), -1)[fits]) >= enough(sizes[fits], n)]
            a.extend([q] * len(found))
            b.extend(sids[found].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _matrix(docs: DataFrame, common: np.ndarray, shared: np.ndarray) -> DataFrame:
    """Rows of the token-group matrix that hold several sets, written once."""
    spark, parts = docs.sparkSession, buckets(docs.sparkSession)
    for left in reversed(range(PASSES)):
        rows = stored(docs.select("text").mapInArrow(_deal(spark.sparkContext.broadcast(common), shared), "token long, sid long, n int, place int")
                       .repartition(parts, "token").mapInArrow(_rows_of, "token long, sid long, n int, place int, leader long"), "matrix")
        if not left:
            return rows
        long = rows.groupBy("token").count().where(F.col("count") > LONG).orderBy(F.desc("count")).limit(MOST_COMMON).collect()
        more = np.union1d(common, np.array([r["token"] for r in long], np.int64).view(np.uint64))
        if len(more) == len(common):
            return rows
        common = more


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, ``ROW``, n (shingles), sid, cls (component;
    null for empty sets): one row per row.  Nothing else of what it writes stays."""
    prepare_workers(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        found = _found(docs, (ROW,))
        keep.append(folder_of(found))
    return found


def _found(docs: DataFrame, also: tuple[str, ...]) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    read = stored(docs.select("doc_id", *also, "text").mapInArrow(
        lambda batches: _read(batches, also), ", ".join([f"doc_id {kind}, sid long, second long, n int, counts binary, token long, sets long",
                                                         *[f"{c} string" for c in also]])), "sets")
    texts = read.where("token IS NULL")
    twice = texts.groupBy("sid").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo <> hi")
    shared = np.sort(np.array([r["sid"] for r in twice.select("sid").collect()], np.int64))  # 1e11 sets: some 300 in all
    sid = F.when(F.col("sid").isin(shared.tolist()), F.col("second")).otherwise(F.col("sid")) if len(shared) else F.col("sid")
    base = texts.select("doc_id", *also, sid.alias("sid"), F.col("n").cast("long").alias("n"), "counts")
    often = (read.where("token IS NOT NULL").groupBy("token").agg(F.sum("sets").alias("sets")).where(F.col("sets") > COMMON)
             .orderBy(F.desc("sets"), "token").limit(MOST_COMMON).collect())  # bounded: MOST_COMMON hashes
    rows = _matrix(docs, np.sort(np.array([r["token"] for r in often], np.int64).view(np.uint64)), shared)

    firsts = base.where("n > 0").groupBy("sid").agg(F.min(ROW).alias("first_row"), F.first("n").alias("n"), F.first("counts").alias("counts"))
    sketches = stored(firsts.join(rows.select("sid").distinct(), "sid").select("sid", "first_row", "n", "counts"), "sketches")

    # groups of similar sets: a set and those that share most with it
    choice = (rows.where("leader IS NOT NULL").groupBy("sid", "leader").count()
              .groupBy("sid").agg(F.max(F.struct("count", "leader")).alias("best")).select("sid", F.col("best.leader").alias("leader")))
    homes = sketches.select("sid").join(choice, "sid", "left").withColumn("home", F.coalesce("leader", "sid"))
    parts = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    grouped = cut(homes.join(parts, "home").select("sid", "leader", F.xxhash64("home", F.pmod(F.xxhash64("sid"), F.col("parts"))).alias("grp")))
    # each set and its leader, as far as the bound allows
    led = cut(grouped.where("leader IS NOT NULL").select(F.col("sid").alias("a"), F.col("leader").alias("b"))
              .join(_side(sketches, "a", ["n", "counts"]), "a").join(_side(sketches, "b", ["n", "counts"]), "b")
              .mapInArrow(_bounded, "a long, b long"))
    similar = _placed(grouped.select("sid", "grp"), components(led))
    asked = cut(_candidates(rows.select("token", "sid", "n", "place"), similar, sketches).unionByName(led).distinct())

    # the tokens of all sets that are compared, fetched once from one document each
    need = asked.select(F.col("a").alias("sid")).unionByName(asked.select(F.col("b").alias("sid"))).distinct()
    wanted = cut(sketches.select(F.col("first_row").alias(ROW), "sid").join(need, "sid"))
    if wanted.count() <= MOST_WANTED:  # else the texts are dealt out by row
        wanted = F.broadcast(wanted)
    tokens = stored(docs.select(ROW, "text").join(wanted, ROW).select("sid", "text")
                    .mapInArrow(_fetch(shared), "sid long, tokens binary").dropDuplicates(["sid"]), "tokens")
    links = cut(_linked(asked, tokens))

    # where the bound had joined sets that do not link: the same within that component
    linked = _placed(grouped.select("sid", "grp"), components(links))
    inner = linked.join(similar.select("sid", F.col("comp").alias("outer")), "sid")
    split = inner.select("outer", "comp").distinct().groupBy("outer").count().where("count > 1").select("outer")
    within = cut(inner.join(split, "outer", "left_semi"))
    again = (rows.select("token", "sid", "n", "place").join(within.select("sid", "outer"), "sid")
             .select(F.xxhash64("token", "outer").alias("token"), "sid", "n", "place"))
    more = _linked(_candidates(again, within.drop("outer"), sketches).distinct(), tokens)
    # what they join are whole components
    comp_of = linked.select("sid", "comp")
    joins = (more.join(comp_of.select(F.col("sid").alias("a"), F.col("comp").alias("a_comp")), "a")
             .join(comp_of.select(F.col("sid").alias("b"), F.col("comp").alias("b_comp")), "b")
             .select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    merged = components(joins).select(F.col("node").alias("comp"), F.col("component").alias("whole"))
    final = comp_of.join(merged, "comp", "left").select("sid", F.coalesce("whole", "comp").alias("component"))

    joined = base.select("doc_id", *also, "sid", "n").join(final, "sid", "left")
    return cut(joined.select("doc_id", *also, "n", "sid", F.when(F.col("n") > 0, F.coalesce("component", "sid")).alias("cls")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row."""
    joined = _classes(with_row(docs.select("doc_id", "text")))
    ids = joined.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("component_id"))
    return joined.join(ids, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component (least doc_id, null last, then least
    ``ROW``) and the rows without words; of rows equal in doc_id and text, one."""
    rows = _classes(with_row(docs))
    best = (rows.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("best"))
            .select("cls", F.col(f"best.{ROW}").alias("best")))
    return keep_decided(docs, rows.join(best, "cls", "left").select(ROW, F.coalesce(F.col(ROW) == F.col("best"), F.lit(True)).alias("kept")))


def op8_token_groups(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))

