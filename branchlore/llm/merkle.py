"""A Merkle manifest of a dataset: digests of rows, of groups and of the whole, with a proof for every row.

Rows are the leaves of a tree per group, the roots of these trees the leaves of a tree on top.
A level is hashed in runs of ``FANOUT`` nodes.  Leaves lie in aligned blocks; a block hashes its
own levels, and what is above is worked out by a butterfly exchange: in round k every block meets
those blocks of its aligned group of ``GROUP`` whose places differ in the k-th digit alone.  They
swap the roots of their subtrees, and each block hashes the ancestors by itself.  After the last
round every block holds the root and all siblings on its way up, so nothing is sent down again.
A subtree at the end that lacks blocks lets those it has take the empty seats in turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchlore.llm.common import kept_columns
from branchlore.staging import release, stage, staging_path, stored

FANOUT = 2
BLOCK_LEVELS = 6  # levels that a block hashes by itself
ROUND_LEVELS = 6  # levels between two swaps: GROUP = FANOUT ** ROUND_LEVELS subtree roots meet
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left: binary, right: binary>>"
STEP = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def row_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 in hex of the fields: ``-`` where missing, else bytes, colon, value."""
    said = [f.cast("string") for f in fields]
    parts = [F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def parent(nodes: Sequence[bytes]) -> bytes:
    """The digest of a run of digests, whose hex texts are hashed."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def climb(nodes: list[bytes], levels: int, fanout: int) -> tuple[list[list[bytes]], bytes]:
    """The levels from the nodes up, without the last one, and the node on top of all."""
    floors = []
    for _ in range(levels):
        floors.append(nodes)
        nodes = [parent(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return floors, nodes[0]


def steps_up(floors: list[list[bytes]], at: int, fanout: int) -> list[dict]:
    """The siblings of node ``at`` of the lowest level and of its ancestors, left and right of them."""
    steps = []
    for nodes in floors:
        first = at - at % fanout
        steps.append({"left": b"".join(nodes[first:at]), "right": b"".join(nodes[at + 1 : first + fanout])})
        at //= fanout
    return steps


def levels_above(nodes: int, fanout: int) -> int:
    """How many levels there are above so many nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def _ranked(leaves: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``rank`` in the tree (from 0) and ``total``, the leaves of the tree.

    Leaves are sorted by ranges over the whole key, so a tree of any size is spread over tasks; a
    random last key does so for equal rows.  A row's place in its task and the leaves that
    earlier tasks hold of its tree give the rank.
    """
    ordered = leaves.orderBy("tree", *order, F.rand(0)).select("*", F.monotonically_increasing_id().alias("place"))
    ordered = stage(ordered, "merkle-ordered")
    part = F.shiftright("place", 33)
    ordered = ordered.select("*", part.alias("part"))
    runs = ordered.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "tree", "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(Window.partitionBy("tree")).alias("total"),
    )
    joined = ordered.join(stage(starts, "merkle-starts"), ["tree", "part"])
    return joined.select(*leaves.columns, (F.col("place") + F.col("shift")).alias("rank"), "total")


def _blocks(ranked: DataFrame, fanout: int) -> DataFrame:
    """One row per aligned block: ``tree``, ``block``, ``n`` (blocks of the tree), ``total`` and its leaves in order."""
    size = fanout**BLOCK_LEVELS
    leaf = F.struct("rank", *[c for c in ranked.columns if c not in ("tree", "rank", "total")])
    found = ranked.groupBy("tree", F.floor(F.col("rank") / size).alias("block")).agg(
        F.sort_array(F.collect_list(leaf)).alias("leaves"), F.first("total").alias("total")
    )
    return found.withColumn("n", F.ceil(F.col("total") / size))


def _own_levels(total: int, fanout: int) -> int:
    return min(BLOCK_LEVELS, levels_above(total, fanout))


def _block_roots(blocks: DataFrame, fanout: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, totals = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            tops = [climb(d, _own_levels(t, fanout), fanout)[1] for d, t in zip(digests, totals, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tops, pa.binary())], names=["tree", "block", "n", "node"])

    sent = blocks.select("tree", "block", "n", F.col("leaves.digest").alias("digests"), "total")
    return sent.mapInArrow(run, "tree string, block long, n long, node binary")


def _swap(nodes: DataFrame, unit: int, fanout: int, levels: int) -> DataFrame:
    """One round: blocks whose subtrees of ``unit`` blocks are in one group swap the roots of these.

    A group's swap is ``fanout ** levels`` short rows at most, one for each subtree.
    """
    width = fanout**levels
    child, off = F.floor(F.col("block") / unit), F.col("block") % unit
    held = F.least(F.lit(unit), F.col("n") - child * unit)  # blocks of this subtree
    seats = F.sequence(off, F.lit(unit - 1), held)
    taken = nodes.select("tree", "block", "n", "node", child.alias("child"), off.alias("off"), F.explode(seats).alias("seat"))
    member = F.struct("child", "block", "node", (F.col("seat") == F.col("off")).alias("own"))
    met = taken.groupBy("tree", F.floor(F.col("child") / width).alias("group"), "seat", "n").agg(
        F.sort_array(F.collect_list(member)).alias("members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made: list[tuple] = []
                part = batch.slice(at, 256)
                for tree, n, members in zip(*(part.column(c).to_pylist() for c in ("tree", "n", "members")), strict=True):
                    up = min(levels, levels_above(-(-n // unit), fanout))
                    floors, top = climb([m["node"] for m in members], up, fanout)
                    made += [(tree, m["block"], n, top, steps_up(floors, i, fanout)) for i, m in enumerate(members) if m["own"]]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), STEP)
                columns = zip(*made, strict=True) if made else [()] * len(kinds)
                arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["tree", "block", "n", "node", "steps"])

    return met.select("tree", "n", "members").mapInArrow(run, f"tree string, block long, n long, node binary, steps {STEPS}")


def _upper(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Per block ``top`` (its tree's root) and ``above`` (siblings from the block's root to it), by the butterfly."""
    spark = blocks.sparkSession
    nodes = stage(_block_roots(blocks, fanout), "merkle-roots")
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds, unit = [], 1
    while unit < most:
        # trees that are one node by now rest, the others' rows are swapped
        over = nodes.where(F.col("n") <= unit).select("tree", "block", "n", "node", F.array().cast(STEPS).alias("steps"))
        swapped = _swap(nodes.where(F.col("n") > unit), unit, fanout, levels)
        path = staging_path(spark, "merkle-round")
        done = stored(over.unionByName(swapped), path)
        rounds.append((len(rounds), done, path))
        nodes, unit = done.select("tree", "block", "n", "node"), unit * fanout**levels
    tops = nodes.select("tree", "block", F.col("node").alias("top"))
    if not rounds:
        return tops.withColumn("above", F.array().cast(STEPS))
    steps = None
    for number, done, _ in rounds:
        one = done.select("tree", "block", F.struct(F.lit(number).alias("round"), "steps", "node").alias("said"))
        steps = one if steps is None else steps.unionByName(one)
    said = F.sort_array(F.collect_list("said"))
    gathered = steps.groupBy("tree", "block").agg(said.alias("said"))
    found = stage(
        gathered.select("tree", "block", F.element_at("said", -1)["node"].alias("top"), F.flatten("said.steps").alias("above")), "merkle-upper"
    )
    for _, _, path in rounds:
        release(spark, path)
    return found


def _forest(leaves: DataFrame, order: Sequence[Column], fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the trees and what is above each: of ``tree`` (string), ``digest`` (binary) and further columns."""
    blocks = stage(_blocks(_ranked(leaves, order), fanout), "merkle-blocks")
    return blocks, _upper(blocks, fanout, levels)


def _proved(blocks: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """One row per leaf: ``tree``, ``leaf`` (the stored struct), ``top`` and ``proof``.

    A block's own siblings are worked out again, which is cheaper than keeping them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, digests, total = (batch.column(c)[row].as_py() for c in ("tree", "digests", "total"))
                up = batch.column("above")[row].as_py()
                top = batch.column("top")[row].as_py()
                floors, _ = climb(digests, _own_levels(total, fanout), fanout)
                k = len(digests)
                proofs = [steps_up(floors, i, fanout) + up for i in range(k)]
                leaves = batch.column("leaves").slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * k, pa.string()), leaves, pa.array([top] * k, pa.binary()), pa.array(proofs, STEP)],
                    names=["tree", "leaf", "top", "proof"],
                )

    joined = blocks.join(above, ["tree", "block"])
    sent = joined.select("tree", "leaves", F.col("leaves.digest").alias("digests"), "total", "top", "above")
    leaf = blocks.schema["leaves"].dataType.elementType.simpleString()
    return sent.mapInArrow(run, f"tree string, leaf {leaf}, top binary, proof {STEPS}")


def manifest(
    docs: DataFrame, carried: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = ROUND_LEVELS
) -> DataFrame:
    """Per row ``doc_id``, ``leaf``, ``subroot`` (of its language), ``root`` (hex) and ``proof``.

    ``proof`` holds, from the leaf up to the root, the digests left and right of the row's
    ancestor in its run (binary, 32 bytes each).  ``carried`` adds columns made of the
    documents' own.  A missing field is a field of its own kind; rows without a language are a
    group, first in order; rows without an id come first in their group; rows of one id are
    ordered by their digests and equal rows are leaves each; an empty text is a field of 0 bytes
    and a long one is hashed like any other; an empty table gives none; other columns are not
    looked at.
    """
    carried = carried or {}
    rows = kept_columns(docs, *FIELDS)
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # a missing one sorts before all
    leaves = rows.select(
        tree.alias("tree"),
        F.unhex(row_digest([F.col(c) for c in FIELDS])).alias("digest"),
        "doc_id",
        *[value.alias(f"carried_{name}") for name, value in carried.items()],
    )
    blocks, above = _forest(stage(leaves, "merkle-leaves"), [F.col("doc_id").asc_nulls_first(), F.col("digest")], fanout, levels)
    subroots = above.where("block = 0").select(
        F.lit("").alias("tree"), F.col("top").alias("digest"), F.col("tree").alias("lang_tree")
    )
    top_blocks, over = _forest(subroots, [F.col("lang_tree")], fanout, levels)
    tops = _proved(top_blocks, over, fanout)
    tops = stage(tops.select(F.col("leaf.lang_tree").alias("tree"), F.col("top").alias("root"), F.col("proof").alias("last")), "merkle-tops")
    # a language's blocks meet its one row; the planner splits a large language's
    whole = above.join(tops, "tree").select("tree", "block", F.struct("top", "root").alias("tops"), F.concat("above", "last").alias("above"))
    placed = whole.select("tree", "block", F.concat("tops.top", "tops.root").alias("top"), "above")
    proved = _proved(blocks, placed, fanout)
    digest = lambda c: F.lower(F.hex(c))
    return proved.select(
        "leaf.doc_id",
        digest(F.col("leaf.digest")).alias("leaf"),
        digest(F.substring("top", 1, 32)).alias("subroot"),
        digest(F.substring("top", 33, 32)).alias("root"),
        "proof",
        *[F.col(f"leaf.carried_{name}").alias(name) for name in carried],
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a digest (hex) and a proof give."""
    text = lambda c: F.lower(F.hex(c))
    return F.aggregate(
        proof, leaf, lambda node, step: F.sha2(F.concat(text(step["left"]), node, text(step["right"])).cast("binary"), 256)
    )


def proof_digest(proof: Column) -> Column:
    """SHA-256 in hex of all siblings of a proof."""
    siblings = F.transform(proof, lambda step: F.lower(F.concat(F.hex(step["left"]), F.hex(step["right"]))))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def verified_manifest(docs: DataFrame, tampered_every: int = 7) -> DataFrame:
    """The manifest with proofs as digests, checked against rows of which some have a changed ``n_chars``.

    Changed are rows whose id's CRC-32 is divisible by ``tampered_every``; rows without an id or
    without ``n_chars`` are not.
    """
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tampered_every == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    other = row_digest([more if c == "n_chars" else F.col(c) for c in FIELDS])
    changed = F.when(struck & F.col("n_chars").isNotNull(), F.unhex(other))
    found = manifest(docs, {"changed": changed})
    shown = F.coalesce(F.lower(F.hex("changed")), F.col("leaf"))
    result = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(shown, F.col("proof")).alias("folded_root"))
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))
