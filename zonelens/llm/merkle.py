"""Merkle manifest of a dataset: proofs climbed by a recursive query.

A document is a leaf: the hash of its id, source, language, length and text.  The leaves
of a language ascend by doc_id and are hashed in runs of ``ARITY`` up to the language's
subroot; the subroots, ordered by language, are hashed in the same way up to the root.
H is SHA-256 in lowercase hex over the concatenated inputs; digests enter as hex text.

* **Build.**  Leaves are numbered by a range sort (``common.numbered``).  A level is one
  grouping of the level below by (tree, place div 8): groups of at most eight digests,
  whatever the language's size.  Every level is written to the shared folder as node rows
  (node, parent, slot, children): a node knows its parent's id, its own place among the
  parent's children, and the digests of its children in 32 bytes each.  The id is the
  level in the upper bits and, below, the tree's first leaf plus the place in the level.
* **Climb.**  A recursive SQL query goes from node to parent, appends the siblings to the
  proof and folds the digest claimed for each leaf with them.  The leaves of one run have
  all siblings above the run in common, so they climb as one row that holds the proof once
  and a fold for each leaf.  The upper levels, at most ``MOST_NODES`` rows, are joined by
  broadcast, so the few nodes that all leaves pass are no hot key; below them a node is
  passed by a bounded number of runs, and the join is an ordinary equi-join.

Defined results: a null field is ``-``, any other its UTF-8 byte count, ``:`` and the
value, so an empty text differs from a null one; a null language is a tree of its own,
the first; null ids come first within a language; rows that share a doc_id (or have none)
are leaves of their own, ordered by digest, and equal rows are as many leaves; a language
with one document has its leaf as subroot and a table with one language its subroot as
root; without siblings the proof is the hash of nothing; an empty table gives no rows;
further columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import numbered, stored, table

ARITY = 8
#: Node rows (of some 300 bytes) that are broadcast to a step of the climb.
MOST_NODES = 1 << 15
#: Bits of a node's id below its level; the levels of the tree over the subroots.
PLACE_BITS, TOP = 48, 64

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(fields: dict[str, Column]) -> Column:
    """H of the fields of a document, each with its length."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """``leaves``: doc_id, claim, leaf, first, size, position (in the tree); ``nodes``:
    node, parent, slot, children, level, a row per node that has children; ``subroots``:
    first, subroot, parent, slot; ``root``: null for an empty table.  All written."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None
    folders: list[str] = field(default_factory=list)


def _node(level, first: Column, place: Column) -> Column:
    return F.shiftleft(F.lit(level).cast("long"), PLACE_BITS) + first + place


def _parent(level: int, whole: Column) -> list[Column]:
    """parent and slot of a node of a level; null for the last one of its tree."""
    place, up = F.col("place"), F.expr(f"place div {ARITY}")
    return [F.when(whole > 1, _node(level + 1, F.col("first"), up)).alias("parent"),
            F.when(whole > 1, place % ARITY).otherwise(0).cast("int").alias("slot")]


def _levels(leaves: DataFrame, bottom: int, extra: Column | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The levels over leaves (first, size, place, digest), from the lowest: node rows
    of each, and (first, digest, node) of the last node of each tree.  ``extra`` is kept
    per leaf, in the rows of the first level."""
    spark, found, tops = leaves.sparkSession, [], []
    level, below = bottom, leaves
    while True:
        ends = below.where("size = 1").select("first", "digest", _node(level, F.col("first"), F.lit(0)).alias("node"))
        tops.append(ends)
        below = below.where("size > 1")
        if below.isEmpty():
            break
        level += 1
        entry = [F.expr(f"place % {ARITY}").alias("slot"), F.col("digest")]
        entry += [extra.alias("extra")] if extra is not None and level == bottom + 1 else []
        runs = below.groupBy("first", "size", F.expr(f"place div {ARITY}").alias("place")).agg(
            F.array_sort(F.collect_list(F.struct(*entry))).alias("run"))
        size = F.expr(f"(size + {ARITY - 1}) div {ARITY}")
        joined = F.array_join(F.expr("transform(run, x -> x.digest)"), "")
        rows = runs.withColumn("size", size).withColumn("joined", joined).select(
            "first", "size", "place", F.sha2("joined", 256).alias("digest"), F.unhex("joined").alias("children"),
            _node(level, F.col("first"), F.col("place")).alias("node"), *_parent(level, F.col("size")), F.lit(level).alias("level"),
            *([F.expr("transform(run, x -> x.extra)").alias("extra")] if len(entry) == 3 else []))
        below = stored(rows, "merkle-level")
        found.append(below)
    last = tops[0]
    for t in tops[1:]:
        last = last.unionByName(t)
    return found, last


def build(docs: DataFrame, claim: Column | None = None) -> Manifest:
    """The manifest of ``docs``.  ``claim``: a digest per row that ``climb`` checks
    against the tree in place of the row's own (null: its own)."""
    spark = docs.sparkSession
    fields = {c: docs[c] for c in FIELDS}
    claim = F.lit(None).cast("string") if claim is None else claim
    hashed = stored(docs.select(fields["doc_id"].alias("doc_id"), fields["lang"].cast("string").alias("lang"),
                                digest_of(fields).alias("digest"), claim.alias("claim")), "merkle-leaves")
    placed = numbered(hashed, "lang", "doc_id", "digest", name="merkle-order")
    trees = stored(placed.groupBy("lang").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("size")), "merkle-trees")
    leaves = stored(placed.join(trees.withColumnRenamed("lang", "tree"), F.col("lang").eqNullSafe(F.col("tree"))).select(
        "doc_id", "digest", "claim", "first", "size", (F.col("position") - F.col("first")).alias("place")), "merkle-placed")
    lower, tops = _levels(leaves, 0, F.struct("doc_id", "claim"))
    order = numbered(tops.select(F.col("first").alias("tree"), F.col("digest"), F.col("node").alias("below")), "tree", name="merkle-subroots")
    count = order.count()
    subroots = stored(order.select("tree", "below", "digest", F.lit(0).cast("long").alias("first"), F.lit(count).alias("size"),
                                   F.col("position").alias("place")), "merkle-top")
    upper, root = _levels(subroots, TOP)
    link = subroots.select("tree", "below", F.col("digest").alias("subroot"), *[c.alias(f"up_{n}") for n, c in
                           zip(("parent", "slot"), _parent(TOP, F.col("size")))])
    rows = [x.select("node", "parent", "slot", "children", "level") for x in (*lower, *upper)]
    nodes = spark.createDataFrame([], "node long, parent long, slot int, children binary, level int")
    for x in rows:
        nodes = nodes.unionByName(x)
    linked = nodes.join(link.select("below", "up_parent", "up_slot"), F.col("node") == F.col("below"), "left").select(
        "node", F.coalesce("parent", "up_parent").alias("parent"), F.when(F.col("below").isNull(), F.col("slot")).otherwise(F.col("up_slot")).alias("slot"),
        "children", "level")
    nodes = stored(linked, "merkle-nodes")
    found = root.select("digest").collect()  # one row, none for an empty table
    return Manifest(_starts(leaves, lower, link, nodes), nodes, link, found[0][0] if found else None)


def _starts(leaves: DataFrame, lower: list[DataFrame], link: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows that climb: run (its node), tree, docs, children; a run of leaves under
    one node, or the leaf that is a tree of its own."""
    spark = leaves.sparkSession
    kind = dict(leaves.dtypes)["doc_id"]
    shape = f"run long, tree long, docs array<struct<doc_id:{kind},claim:string>>, children binary, parent long, slot int"
    starts = spark.createDataFrame([], shape)
    alone = leaves.where("size = 1").join(link, F.col("first") == F.col("tree")).select(
        F.col("below").alias("run"), "tree", F.array(F.struct("doc_id", "claim")).alias("docs"), F.unhex("digest").alias("children"),
        F.col("up_parent").alias("parent"), F.col("up_slot").alias("slot"))
    starts = starts.unionByName(alone)
    if lower:
        runs = lower[0].select("node", F.col("first").alias("tree"), F.col("extra").alias("docs"))
        up = nodes.where(F.col("level") == 1).select("node", "children", "parent", "slot")
        starts = starts.unionByName(runs.join(up, "node").select(F.col("node").alias("run"), "tree", "docs", "children", "parent", "slot"))
    return stored(starts, "merkle-starts")


def _left(children: str, slot: str) -> str:
    return f"substring({children}, 1, 32 * {slot})"


def _right(children: str, slot: str) -> str:
    return f"substring({children}, 32 * {slot} + 33)"


def _fold(children: str, slot: str, digest: str) -> str:
    return f"unhex(sha2(concat(lower(hex({_left(children, slot)})), lower(hex({digest})), lower(hex({_right(children, slot)}))), 256))"


#: A row goes to its node's parent as long as there is one among the given nodes.
CLIMB = f"""
WITH RECURSIVE climb(run, parent, slot, proof, folds) AS (
  SELECT run, parent, slot, proof, folds FROM {{starts}}
  UNION ALL
  SELECT c.run, n.parent, n.slot,
         concat(c.proof, {_left('n.children', 'c.slot')}, {_right('n.children', 'c.slot')}),
         transform(c.folds, f -> {_fold('n.children', 'c.slot', 'f')})
  FROM climb c JOIN {{nodes}} n ON c.parent = n.node
)
SELECT run, parent, slot, proof, folds FROM climb
"""


def _ascend(starts: DataFrame, nodes: DataFrame, done: str) -> DataFrame:
    """Where the rows ``starts`` come to among ``nodes``; ``done`` tells of a row's
    parent that it is not there.  The query runs here, as its limit of rows (an error
    beyond a million) is a setting of the session."""
    spark = starts.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return stored(spark.sql(CLIMB, starts=starts, nodes=nodes).where(done), "merkle-climb")
    finally:
        spark.conf.set(limit, before)


def climb(manifest: Manifest, most_nodes: int = MOST_NODES) -> DataFrame:
    """Per leaf: doc_id, leaf, tree, proof_sha256 (of the siblings up to the root, from
    left to right level by level) and folded_root (from the claimed digest and the
    siblings)."""
    counts = {r["level"]: r["n"] for r in manifest.nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per level
    split, held = TOP + max(counts, default=0) + 1, 0
    for level in sorted(counts, reverse=True):  # the levels that are broadcast, from the root
        if held + counts[level] > most_nodes:
            break
        split, held = level, held + counts[level]
    first_fold = "CASE WHEN run < {0} THEN array(coalesce(unhex(docs[0].claim), children)) ELSE " \
                 "transform(docs, (d, i) -> {1}) END".format(
                     1 << PLACE_BITS, _fold("children", "i", f"coalesce(unhex(d.claim), substring(children, 32 * i + 1, 32))"))
    starts = manifest.leaves.select("run", "parent", "slot", F.expr("cast('' AS binary)").alias("proof"), F.expr(first_fold).alias("folds"))
    edge = split << PLACE_BITS
    low = manifest.nodes.where(F.col("level") < split).drop("level")
    if split > 2 and not low.isEmpty():
        starts = _ascend(starts, low, f"parent IS NULL OR parent >= {edge}")
    high = F.broadcast(manifest.nodes.where(F.col("level") >= split).drop("level"))
    arrived = _ascend(starts, high, "parent IS NULL")
    own = "substring(children, 32 * i + 1, 32)"
    per_leaf = f"""transform(docs, (d, i) -> struct(d.doc_id AS doc_id, lower(hex({own})) AS leaf,
        sha2(lower(hex(concat({_left('children', 'i')}, {_right('children', 'i')}, proof))), 256) AS proof_sha256,
        lower(hex(folds[i])) AS folded_root))"""
    # the siblings of a run's leaves are in the run itself, those above it in its proof
    return manifest.leaves.select("run", "tree", "docs", "children").join(arrived.select("run", "proof", "folds"), "run").select(
        "tree", F.explode(F.expr(per_leaf)).alias("x")).select("tree", "x.*")


def verify(docs: DataFrame, claim: Column | None = None, most_nodes: int = MOST_NODES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified per row of ``docs``."""
    manifest = build(docs, claim)
    found = climb(manifest, most_nodes).join(manifest.subroots.select("tree", "subroot"), "tree")
    return found.select("doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), "proof_sha256", "folded_root",
                        F.col("folded_root").eqNullSafe(F.lit(manifest.root)).alias("verified"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_climb(spark, sf_dir):
    """Tampering: the text of every document whose crc32 three divides has its A-Z lower-cased."""
    docs = table(spark, sf_dir, "documents")
    changed = {c: docs[c] for c in FIELDS} | {"text": F.translate("text", UPPER, LOWER)}
    return verify(docs, F.when(F.crc32(docs["doc_id"].cast("string")) % 3 == 0, digest_of(changed)))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                      lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS crc
  FROM documents),
h AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS claim
  FROM d),
g AS (SELECT coalesce('=' || lang, '') AS tree, * FROM h),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM g),
lv(tree, level, place, size, h) AS (
  SELECT tree, 0, place, size, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM lv WHERE size > 1
  GROUP BY tree, level, place // 8, size),
subroots AS (SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM lv WHERE size = 1),
tv(level, place, size, h) AS (
  SELECT 0, place, size, subroot FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM tv WHERE size > 1 GROUP BY level, place // 8, size),
nodes AS (SELECT tree, level, place, size, h FROM lv UNION ALL SELECT NULL, level, place, size, h FROM tv),
sib AS (
  SELECT n.tree, n.level, n.place, coalesce(string_agg(o.h, '' ORDER BY o.place) FILTER (o.place < n.place), '') AS l,
         coalesce(string_agg(o.h, '' ORDER BY o.place) FILTER (o.place > n.place), '') AS r
  FROM nodes n JOIN nodes o ON n.tree IS NOT DISTINCT FROM o.tree AND n.level = o.level AND n.place // 8 = o.place // 8
  WHERE n.size > 1 GROUP BY ALL),
climb(doc_id, k, tree, here, level, place, proof, fold) AS (
  SELECT doc_id, place, tree, tree, 0, place, '', coalesce(claim, leaf) FROM leaves
  UNION ALL
  SELECT c.doc_id, c.k, c.tree, CASE WHEN s.tree IS NULL THEN NULL ELSE c.here END, CASE WHEN s.tree IS NULL THEN 0 ELSE c.level + 1 END,
         CASE WHEN s.tree IS NULL THEN t.place ELSE c.place // 8 END,
         CASE WHEN s.tree IS NULL THEN c.proof ELSE c.proof || s.l || s.r END,
         CASE WHEN s.tree IS NULL THEN c.fold ELSE sha256(s.l || c.fold || s.r) END
  FROM climb c LEFT JOIN sib s ON s.tree = c.here AND s.level = c.level AND s.place = c.place JOIN subroots t ON t.tree = c.tree
  WHERE c.here IS NOT NULL),
top(doc_id, k, tree, level, place, proof, fold) AS (
  SELECT doc_id, k, tree, 0, place, proof, fold FROM climb WHERE here IS NULL
  UNION ALL
  SELECT c.doc_id, c.k, c.tree, c.level + 1, c.place // 8, c.proof || s.l || s.r, sha256(s.l || c.fold || s.r)
  FROM top c JOIN sib s ON s.tree IS NULL AND s.level = c.level AND s.place = c.place),
root AS (SELECT h FROM tv WHERE size = 1)
SELECT l.doc_id, l.leaf, s.subroot, root.h AS root, sha256(t.proof) AS proof_sha256, t.fold AS folded_root, t.fold = root.h AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree CROSS JOIN root
JOIN (SELECT *, row_number() OVER (PARTITION BY tree, k ORDER BY level DESC) AS last FROM top) t ON t.tree = l.tree AND t.k = l.place AND t.last = 1
"""
