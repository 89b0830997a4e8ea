"""Merkle manifest of a dataset as a postorder append log.

Every row is a leaf; the leaves of a language, ascending by id, form a binary tree, and the roots of the languages (null first, then
by their bytes) form one more. A run of one node becomes its hash too, so a tree of n leaves is as high as the powers of two say.

Aligned builders of 1024 leaves write their nodes in completion order, one log row for each builder. Builders of the next
round take the roots of 1024 builders, and so on: three rounds hold 10^9 leaves. A node needs no address in the log but its
level and number: the last leaf below it completes at twice its number less the ones in it, and the node ``level`` places later
(``position``). Proofs are read off the log rows by these places, one row of each round, never by following pointers.

Defined results: null fields are ``-``; null ids come first, repeated rows are leaves of their own, ordered by their digests;
null languages are a tree; further columns are ignored; an empty table gives no rows. Digests are hashed as hex text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base

#: Levels of a builder, which has 2^HEIGHT leaves. A log row has twice as many digests of 32 bytes.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOG = "tree string, total bigint, block bigint, leaves int, nodes binary, root binary"
#: Steps of a proof. Side 0: no sibling, the node is hashed alone; 1: the sibling comes first; 2: it comes second.
_PATH = "array<struct<side:int,digest:binary>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in columns]).cast("binary"), 256)


def position(level, number, leaves):
    """Place in the completion order of a tree of ``leaves`` leaves of node ``number`` of ``level``. Takes numpy arrays."""
    last = np.minimum((np.asarray(number, dtype=np.int64) + 1) << level, leaves) - 1
    return 2 * last - np.bitwise_count(last).astype(np.int64) + level


def height(leaves: int) -> int:
    return max(0, int(leaves - 1).bit_length())


def build_nodes(digests: list[bytes], levels: int) -> np.ndarray:
    """All nodes over ``digests`` up to ``levels`` above them, in completion order, 32 bytes each."""
    out = np.zeros((int(position(levels, 0, len(digests))) + 1, 32), dtype=np.uint8)
    row = [d.hex().encode() for d in digests]
    for level in range(levels + 1):
        places = position(level, np.arange(len(row)), len(digests))
        out[places] = np.frombuffer(bytes.fromhex(b"".join(row).decode()), dtype=np.uint8).reshape(-1, 32)
        row = [hashlib.sha256(b"".join(row[i:i + 2])).hexdigest().encode() for i in range(0, len(row), 2)]
    return out


def _build(nodes: DataFrame, h: int) -> DataFrame:
    """One log row for each aligned block of (tree, number, digest, total): these nodes and those up to the root of the block."""
    blocks = nodes.groupBy("tree", "total", F.shiftright("number", h).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("number", "digest"))).alias("run"))

    def build(batches):
        for batch in batches:
            rows = []
            for tree, total, block, run in zip(*(batch.column(i).to_pylist() for i in range(4))):
                made = build_nodes([r["digest"] for r in run], height(len(run)) if total <= 1 << h else h)
                rows.append((tree, total, block, len(run), made.tobytes(), made[-1].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                    ["tree", "total", "block", "leaves", "nodes", "root"])

    return base.written(blocks.mapInArrow(build, _LOG), "manifest-log")


def _siblings(nodes: bytes, leaves: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each level of a log row below its root: sides and digests of its leaves' siblings."""
    table = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, 32)
    levels = int(len(table) - 1 - (2 * (leaves - 1) - int(leaves - 1).bit_count()))
    sides, digests = [], []
    for level in range(levels):
        count = -(-leaves >> level)
        beside = (np.arange(leaves, dtype=np.int64) >> level) ^ 1
        there = beside < count
        sides.append(np.where(there, 1 + (beside & 1), 0))
        digests.append(table[position(level, np.where(there, beside, 0), leaves)])
    return sides, digests


def _paths(sides: list, digests: list, leaves: int, above: list[dict]) -> pa.Array:
    """The path of each leaf of a log row: its siblings in the row, then ``above``, which they share."""
    own, shared = len(sides), len(above)
    side = np.zeros((leaves, own + shared), dtype=np.int32)
    digest = np.zeros((leaves, own + shared, 32), dtype=np.uint8)
    for level in range(own):
        side[:, level], digest[:, level] = sides[level], digests[level]
    for i, step in enumerate(above):
        side[:, own + i] = step["side"]
        digest[:, own + i] = np.frombuffer(step["digest"], dtype=np.uint8)
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), leaves * (own + shared), [None, pa.py_buffer(digest.tobytes())])
    steps = pa.StructArray.from_arrays([pa.array(side.ravel()), flat.cast(pa.binary())], ["side", "digest"])
    return pa.ListArray.from_arrays(pa.array(np.arange(leaves + 1, dtype=np.int32) * (own + shared)), steps)


def _extract(log: DataFrame, above: DataFrame, h: int, carried: DataFrame | None = None) -> DataFrame:
    """(tree, number, path) of every leaf of the log rows; with ``carried`` (tree, block, rows of leaves) each leaf's row too.

    ``above`` (tree, number, path) has the path of each log row's root.
    """
    joined = log.select("tree", "block", "leaves", "nodes").join(above.select("tree", F.col("number").alias("block"), "path"), ["tree", "block"])
    if carried is not None:
        joined = joined.join(carried, ["tree", "block"])
    kind = carried.schema["rows"].dataType.elementType if carried is not None else None
    schema = f"tree string, number bigint, path {_PATH}" + (f", row {kind.simpleString()}" if kind else "")

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                leaves = row["leaves"][0].as_py()
                paths = _paths(*_siblings(row["nodes"][0].as_py(), leaves), leaves, row["path"][0].as_py())
                first = row["block"][0].as_py() << h
                out = [pa.array([row["tree"][0].as_py()] * leaves, pa.string()), pa.array(np.arange(first, first + leaves)), paths]
                if kind:
                    out.append(row["rows"].flatten())
                yield pa.RecordBatch.from_arrays(out, ["tree", "number", "path"] + (["row"] if kind else []))

    return joined.mapInArrow(read, schema)


@dataclass
class Manifest:
    """``leaves``: tree, lang, number, doc_id, leaf, claim, total. ``rounds``: the log, a table for each round of builders.
    ``subroots``: tree, number (in the tree of languages), digest. ``top``: the rounds of the tree of languages."""
    leaves: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    height: int

    def root(self) -> str | None:
        row = self.top[-1].select("root").first()
        return bytes(row.root).hex() if row else None

    def entries(self) -> DataFrame:
        """The log by place: tree, position, digest. A node that begins a later round is there once."""
        out, h, every = None, self.height, self.leaves.groupBy("tree").agg(F.first("total").alias("every"))
        for k, log in enumerate(self.rounds):
            def spread(batches, k=k):
                for batch in batches:
                    for row in batch.to_pylist():
                        nodes = np.frombuffer(row["nodes"], dtype=np.uint8).reshape(-1, 32)
                        places, digests = [], []
                        for level in range(len(_siblings(row["nodes"], row["leaves"])[0]) + 1):
                            if k and not level:
                                continue
                            inside = np.arange(-(-row["leaves"] >> level))
                            number = ((row["block"] << h) >> level) + inside
                            places.append(position(level + h * k, number, row["every"]))
                            digests += [d.tobytes() for d in nodes[position(level, inside, row["leaves"])]]
                        if places:
                            yield pa.RecordBatch.from_arrays([
                                pa.array([row["tree"]] * len(digests), pa.string()), pa.array(np.concatenate(places)),
                                pa.array(digests, pa.binary())], ["tree", "position", "digest"])
            part = log.join(every, "tree").mapInArrow(spread, "tree string, position bigint, digest binary")
            out = part if out is None else out.unionByName(part)
        return out


def _rounds(nodes: DataFrame, h: int) -> tuple[list[DataFrame], DataFrame]:
    """All rounds over (tree, number, digest, total); the roots of the trees."""
    rounds, roots = [], None
    while True:
        log = _build(nodes, h)
        rounds.append(log)
        ready = log.filter(F.col("total") <= 1 << h).select("tree", F.col("root").alias("digest"))
        roots = ready if roots is None else roots.unionByName(ready)
        nodes = log.filter(F.col("total") > 1 << h).select(
            "tree", F.col("block").alias("number"), F.col("root").alias("digest"),
            F.expr(f"(total + {(1 << h) - 1}) div {1 << h}").alias("total"))
        if nodes.isEmpty():
            return rounds, base.written(roots, "manifest-roots")


def build(docs: DataFrame, claims: dict[str, Column] | None = None, fields: dict[str, str] | None = None,
          height: int = HEIGHT) -> Manifest:
    """The manifest of ``docs``. ``claims`` are other values of some fields, whose leaf is kept beside the true one (``claim``).

    ``fields`` maps doc_id, source, lang, n_chars and text to the columns that have them.
    """
    base.set_up(docs.sparkSession)
    names = {f: (fields or {}).get(f, f) for f in FIELDS}
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    rows = docs.select(*[docs[names[f]].cast(kinds.get(f, "string")).alias(f) for f in FIELDS])
    claimed = [(claims or {}).get(f, F.col(f)) for f in FIELDS]
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # null before all languages
    leaf = leaf_digest([F.col(f) for f in FIELDS])
    narrow = rows.select(tree.alias("tree"), "doc_id", F.unhex(leaf).alias("leaf"), F.unhex(leaf_digest(claimed)).alias("claim"))
    narrow = base.written(narrow, "manifest-leaves")
    totals = narrow.groupBy("tree").agg(F.count("*").alias("total"))
    leaves = base.ranked(narrow, ["tree"], ["doc_id", "leaf"], "manifest-ranked").withColumnRenamed("rank", "number")
    leaves = base.written(leaves.join(F.broadcast(totals), "tree") if totals.count() <= 10_000 else leaves.join(totals, "tree"), "manifest-numbered")
    rounds, roots = _rounds(leaves.select("tree", "number", F.col("leaf").alias("digest"), "total"), height)
    top = base.ranked(roots, [], ["tree"], "manifest-top").withColumnRenamed("rank", "number")
    subroots = base.written(top, "manifest-subroots")
    heads = subroots.select(F.lit("").alias("tree"), "number", "digest", F.lit(subroots.count()).cast("bigint").alias("total"))
    base.discard(narrow, roots)
    return Manifest(leaves, rounds, subroots, _rounds(heads, height)[0], height)


def _down(rounds: list[DataFrame], above: DataFrame, h: int) -> DataFrame:
    """Paths of the log rows of the first round, from those of the trees' roots (tree, path)."""
    paths = above.select("tree", F.lit(0).cast("bigint").alias("number"), "path")
    for log in reversed(rounds[1:]):
        # A tree that needs fewer rounds has no row in this one: its root waits for its own round.
        lower = _extract(log, paths, h)
        paths = lower.unionByName(paths.join(log.select("tree").distinct(), "tree", "left_anti"))
    return paths


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, claim, subroot (binary) and path of every leaf: its siblings (side, digest) from the leaf to the root.

    Steps without a sibling are in the path too: there a node is hashed alone.
    """
    h, empty = manifest.height, F.array().cast(_PATH)
    heads = _down(manifest.top, manifest.top[0].select("tree").distinct().select("tree", empty.alias("path")), h)
    top = _extract(manifest.top[0], heads, h).select("number", "path").join(manifest.subroots, "number")
    paths = base.written(_down(manifest.rounds, top.select("tree", "path"), h), "manifest-paths")
    rows = manifest.leaves.groupBy("tree", F.shiftright("number", h).alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("number", "doc_id", "leaf", "claim"))),
                    lambda r: F.struct(r.doc_id.alias("doc_id"), r.leaf.alias("leaf"), r.claim.alias("claim"))).alias("rows"))
    rows = rows.join(manifest.subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    rows = rows.select("tree", "block", F.transform("rows", lambda r: r.withField("subroot", F.col("subroot"))).alias("rows"))
    return _extract(manifest.rounds[0], paths, h, rows).select("row.*", "path")


def fold(leaf: Column, path: Column) -> Column:
    """Root (hex) that a leaf (binary) and its path lead to."""
    return F.aggregate(path, F.lower(F.hex(leaf)), lambda at, step: F.sha2(F.concat(
        F.when(step.side == 1, F.lower(F.hex(step.digest))).otherwise(F.lit("")), at,
        F.when(step.side == 2, F.lower(F.hex(step.digest))).otherwise(F.lit(""))).cast("binary"), 256))


def audit(manifest: Manifest) -> DataFrame:
    """Every leaf with its roots, the digest of its proof, and whether its claim leads to the root."""
    root = F.lit(manifest.root()).cast("string")
    siblings = F.transform(F.filter("path", lambda s: s.side > 0), lambda s: F.lower(F.hex(s.digest)))
    text = lambda c: F.lower(F.hex(c))
    rows = proofs(manifest).withColumn("folded_root", fold(F.col("claim"), F.col("path")))
    return rows.select("doc_id", text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), root.alias("root"),
                       F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == root).alias("verified"))


def tampered(doc_id: Column, n_chars: Column) -> Column:
    """``n_chars`` and 1 where 7 divides the crc32 of the decimal id."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
    return F.when(hit, n_chars.cast("decimal(20,0)") + 1).otherwise(n_chars.cast("decimal(20,0)")).cast("decimal(20,0)")
