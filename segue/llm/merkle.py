"""Merkle manifest of a corpus: digests forward to the root, proof suffixes back to the leaves, both in label order."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.llm.store import saved

#: A task sweeps blocks of 2^HEIGHT nodes; their roots are the nodes of the next stage.
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32
#: In a proof: nothing beside the node, its sibling before it, its sibling after it.
ALONE, BEFORE, AFTER = b"\x00", b"\x01", b"\x02"


def digest_of(*children: str) -> str:
    """SHA-256 over the hex texts of the children, as lowercase hex."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of a document's fields, each ``-`` if null, else its bytes' count, a colon and its value."""
    values = [changed.get(name, F.col(name)).cast("string") for name in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def placed(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``i``, the place 0, 1, ... of a node in its group, and ``n``, the group's size.

    Nodes are dealt to ranges of (group, order) once and stored; a place is the place in the
    range's part of the group plus the sizes of its parts in earlier ranges, so no
    group is ever sorted or counted in one task.
    """
    ranged = saved(nodes.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()))
    same = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group] + [F.col(g).isNull() for g in group]
    keys = [f"k{j}" for j in range(len(same))]
    keyed = ranged.select("*", *[k.alias(n) for k, n in zip(same, keys)])
    sizes = keyed.groupBy(*keys, "part").agg(F.count("*").alias("size"))    # a row per range and group
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(whole).alias("n"))
    inside = Window.partitionBy("part", *group).orderBy(*order)
    return (keyed.withColumn("inner", F.row_number().over(inside) - 1).join(offsets, [*keys, "part"])
            .withColumn("i", F.col("offset") + F.col("inner")).drop("inner", "offset", "size", "part", *keys))


def label(level: int, index: int) -> int:
    """Place of a node in time: after all leaves below it and all nodes below it."""
    return ((index + 1) << level) * 64 + level


def _levels(n: int, height: int) -> int:
    """Levels that a block of a group with n nodes rises in one stage."""
    return min((n - 1).bit_length(), height)


class Forward:
    """Sweep of one block in label order; the queue holds what waits for a parent, at most two nodes a level."""

    def __init__(self, levels: int):
        self.levels, self.queue = levels, []
        self.root = None

    def _send(self, level: int, index: int, digest: str) -> None:
        if level == self.levels:
            self.root = digest
        else:
            heapq.heappush(self.queue, (label(level + 1, index >> 1), index, level + 1, digest))

    def until(self, now: float) -> Iterator[tuple[int, int, int, list[str]]]:
        """Nodes whose label lies before ``now``: label, level, index, digests of their children."""
        while self.queue and self.queue[0][0] < now:
            at, index, level, digest = heapq.heappop(self.queue)
            children = [digest]
            while self.queue and self.queue[0][0] == at:
                children.append(heapq.heappop(self.queue)[3])
            self._send(level, index >> 1, digest_of(*children))
            yield at, level, index >> 1, children

    def leaf(self, index: int, digest: str) -> Iterator[tuple[int, int, int, list[str]]]:
        yield from self.until(label(0, index))
        self._send(0, index, digest)


_NODE = "lang string, block long, label long, level int, idx long, children array<string>, root string, n long"


def _forward(nodes: DataFrame, height: int) -> DataFrame:
    """Inner nodes of every block in label order, and a last row per block with its root."""
    names = [field.split()[0] for field in _NODE.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64()]

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sweep, size = None, None, 0

        def closed(out: list[tuple]) -> None:
            out.extend((block[0], block[1], *node, None, size) for node in sweep.until(float("inf")))
            out.append((block[0], block[1], None, None, None, None, sweep.root, size))

        for batch in batches:
            out: list[tuple] = []
            for lang, number, i, n, digest in zip(*(batch.column(j).to_pylist() for j in range(5))):
                if block != (lang, number):
                    if block is not None:
                        closed(out)
                    block, sweep, size = (lang, number), Forward(_levels(n, height)), n
                out.extend((lang, number, *node, None, n) for node in sweep.leaf(i - (number << height), digest))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if block is not None:
            out = []
            closed(out)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    blocks = nodes.select("lang", F.shiftright("i", height).alias("block"), "i", "n", "digest")
    return saved(blocks.repartition("lang", "block").sortWithinPartitions("lang", "block", "i").mapInArrow(swept, _NODE))


def _backward(inner: DataFrame, nodes: DataFrame, messages: DataFrame, height: int, schema: str, answer) -> DataFrame:
    """Sweep of every block against label order: ``answer(row of node, its proof, subroot, root)`` for each node of ``nodes``.

    ``messages``: lang, block, suffix, subroot, root - the proof of the block's own root.
    ``nodes``: lang, i, n, digest and whatever ``answer`` reads as ``rest``.
    """
    names, types = [f.split()[0] for f in schema.split(", ")], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple] = []
        subroot = root = None
        for batch in batches:
            out = []
            columns = [batch.column(j).to_pylist() for j in range(len(batch.schema.names) - 1)]
            rests = batch.column(len(columns)).to_pylist()
            for (lang, block, at, level, index, children, digest, suffix, its_subroot, its_root, n), rest in zip(zip(*columns), rests):
                if suffix is not None:
                    top = _levels(n, height)
                    queue = [(-label(top, 0), 0, suffix)]
                    subroot, root = its_subroot, its_root
                    continue
                _, place, proof = heapq.heappop(queue)
                if level:
                    for k, child in enumerate(children):
                        if len(children) == 1:
                            beside = ALONE
                        else:
                            beside = (AFTER if k == 0 else BEFORE) + bytes.fromhex(children[1 - k])
                        heapq.heappush(queue, (-label(level - 1, index * 2 + k), index * 2 + k, beside + proof))
                else:
                    out.append(answer(lang, (block << height) + index, digest, proof, subroot, root, rest))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    number = F.col("i") - F.shiftleft(F.shiftright("i", height), height)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    no_rest = F.lit(None).cast(nodes.schema["rest"].dataType).alias("rest")
    first = messages.select("lang", "block", F.lit(2**62).alias("label"), none("int", "level"), none("long", "idx"), none("array<string>", "children"),
                            none("string", "digest"), "suffix", "subroot", "root", "n", no_rest)
    middle = inner.where("label IS NOT NULL").select("lang", "block", "label", "level", "idx", "children", none("string", "digest"), none("binary", "suffix"),
                                                     none("string", "subroot"), none("string", "root"), "n", no_rest)
    leaves = nodes.select("lang", F.shiftright("i", height).alias("block"), ((number + 1) * 64).alias("label"), F.lit(0).alias("level"), number.alias("idx"),
                          none("array<string>", "children"), "digest", none("binary", "suffix"), none("string", "subroot"), none("string", "root"), "n", "rest")
    rows = first.unionByName(middle).unionByName(leaves)
    return rows.repartition("lang", "block").sortWithinPartitions("lang", "block", F.desc("label")).mapInArrow(swept, schema)


def steps(proof: bytes) -> list[tuple[bytes, str]]:
    """A packed proof as (side, sibling) from the leaf up; the sibling is empty where a node is alone."""
    out, at = [], 0
    while at < len(proof):
        side = proof[at:at + 1]
        at += 1
        if side == ALONE:
            out.append((side, ""))
        else:
            out.append((side, proof[at:at + DIGEST].hex()))
            at += DIGEST
    return out


def folded(leaf: str, path: list[tuple[bytes, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for side, sibling in path:
        leaf = digest_of(sibling, leaf) if side == BEFORE else digest_of(leaf, sibling)
    return leaf


_MESSAGE = "lang string, i long, suffix binary, subroot string, root string"


def _message(lang, i, digest, proof, subroot, root, rest) -> tuple:
    """To the block of the stage before whose root this node is."""
    return lang, i, proof, subroot, root


def _tree(nodes: DataFrame, height: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """All stages of the trees of all groups: nodes and inner nodes per stage, and one row per group: lang, digest.

    Every stage replaces each block of 2^height nodes by its root, until each group is one node.
    """
    levels, inner = [nodes], []
    while True:
        inner.append(_forward(levels[-1], height))
        roots = inner[-1].where("root IS NOT NULL").select("lang", F.col("block").alias("i"), F.shiftright(F.col("n") + ((1 << height) - 1), height).alias("n"),
                                                           F.col("root").alias("digest"))
        if not roots.where("n > 1").limit(1).count():
            return levels, inner, roots.select("lang", "digest")
        levels.append(roots)


def _down(levels: list[DataFrame], inner: list[DataFrame], messages: DataFrame, height: int, schema: str, answer) -> DataFrame:
    """Proofs from the groups' roots down to the nodes of the first stage, stage by stage."""
    for stage in reversed(range(len(levels))):
        sizes = inner[stage].where("root IS NOT NULL").select("lang", "block", "n")
        same = sizes["lang"].eqNullSafe(messages["lang"]) & (sizes["block"] == messages["i"])
        asked = sizes.join(messages, same).select(sizes["lang"], "block", "n", "suffix", "subroot", "root")
        if stage:
            nodes = levels[stage].withColumn("rest", F.lit(None).cast("string"))
            messages = saved(_backward(inner[stage], nodes, asked, height, _MESSAGE, _message))
        else:
            return _backward(inner[stage], levels[stage], asked, height, schema, answer)
    raise AssertionError


_PROVED = ("lang string, doc_id long, leaf string, subroot string, root string, proof binary, proof_sha256 string, changed string, "
           "folded_root string")


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """``lang, doc_id, leaf, subroot, root, proof, proof_sha256, changed, folded_root`` of every document.

    A leaf is the digest of a document's five fields.  Per language the leaves in order of
    ``doc_id`` form a binary tree (a node alone in its run is hashed alone), and so do the
    languages' subroots in order of language, null first.  ``proof`` packs the siblings
    from the leaf to the root (see ``steps``); ``changed`` is the digest with the fields of
    ``tampered`` replaced, and ``folded_root`` the root that it and the proof lead to.

    Nodes are swept in blocks of 2^``height``, in label order: the sorted shuffle brings the
    nodes, a priority queue of two nodes a level holds the digests on their way to a
    parent.  The sweep back runs against label order and hands each node its proof.
    Blocks of one stage are the nodes of the next, so the longest row of stages has
    log(documents) / ``height`` of them, and no task holds more than its queue.

    Null fields have a form of their own in the leaf; documents without an id come first in
    their language; equal ids are ordered by leaf, so repeated rows are leaves side by side;
    texts are hashed whole; an empty table gives no rows.  Only the five fields are read, so
    further columns cannot clash.
    """
    changed = leaf_digest(**(tampered or {}))
    row_id = F.monotonically_increasing_id()
    leaves = saved(docs.select(*FIELDS).select("lang", "doc_id", leaf_digest().alias("digest"), changed.alias("changed"), row_id.alias("row_id")))
    nodes = placed(leaves, ["lang"], ["doc_id", "digest", "row_id"]).withColumn("rest", F.struct("doc_id", "changed"))
    nodes = saved(nodes.select("lang", "i", "n", "digest", "rest"))
    levels, inner, subroots = _tree(nodes, height)
    tops = placed(subroots.withColumnRenamed("lang", "of"), [], ["of"]).withColumn("lang", F.lit("")).withColumn("rest", F.col("of"))
    tops = saved(tops.select("lang", "i", "n", "digest", "rest"))
    top_levels, top_inner, top = _tree(tops, height)
    empty = top.select("lang", F.lit(0).cast("long").alias("i"), F.lit(b"").alias("suffix"), F.lit(None).cast("string").alias("subroot"),
                       F.col("digest").alias("root"))

    def to_language(lang, i, digest, proof, subroot, root, rest) -> tuple:
        return rest, 0, proof, digest, root

    messages = saved(_down(top_levels, top_inner, empty, height, _MESSAGE, to_language))

    def to_document(lang, i, digest, proof, subroot, root, rest) -> tuple:
        path = steps(proof)
        return (lang, rest["doc_id"], digest, subroot, root, proof, digest_of(*[sibling for _, sibling in path]), rest["changed"],
                folded(rest["changed"], path))

    return _down(levels, inner, messages, height, _PROVED, to_document)


def tampering() -> dict[str, Column]:
    """The check of a manifest: documents whose id's checksum 7 divides get one more in ``n_chars``."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    wide = F.col("n_chars").cast("decimal(20,0)")   # the largest long has a successor too
    return {"n_chars": F.when(F.coalesce(chosen, F.lit(False)), wide + 1).otherwise(wide)}


def digests(docs: DataFrame) -> DataFrame:
    """Leaves, subroots and root, the digest of every proof, and whether a tampered document still leads to the root."""
    return manifest(docs, tampering()).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                                              F.col("folded_root").eqNullSafe(F.col("root")).alias("verified"))
