"""Merkle manifest of a table by cogrouped subtree exchange.

Every row is a leaf: SHA-256 over its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value.  The leaves of a
tree (one for each language) ascend by id; every ``FANOUT`` consecutive nodes become one until a single one, the subroot, is
left; the subroots, in order of their trees, are joined likewise to the root.

Positions come from a range sort of the narrow leaf table and a small table of counts.  A superblock holds ``FANOUT ** LEVELS``
consecutive nodes of one tree.  Going up, superblocks are reduced to one node each until every tree has its subroot, then the
subroots likewise.  Going down, the nodes of a table and the outer nodes that their superblock's own node needs (the siblings
on its way to the root) are cogrouped by superblock: ``applyInPandas`` finishes the local reduction, joins both parts of each
proof and folds it.  No task holds more than a superblock of a tree and one path; texts are hashed where they are read and never move.

Defined results: a null field is ``-``; a null id comes first in its tree; rows equal in tree and id ascend by their leaf, so equal rows
are interchangeable; a null tree is a tree of its own and comes first; an empty table has no rows and no root; a
table of one row has an empty proof.  Only the named fields are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.llm.common import staged

FANOUT = 8
LEVELS = 3                       # levels that a superblock reduces: 512 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MAX_SPANS = 100_000              # spans of trees over partitions up to which their offsets are broadcast


def leaf(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each with its length."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def joined(nodes: list[bytes]) -> bytes:
    """Digest of consecutive digests, which are concatenated as hex text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def grown(nodes: list[bytes], n: int) -> list[list[bytes]]:
    """The nodes of a superblock and the rows above them, up to the superblock's own node.  ``n``: nodes of the whole tree
    in the lowest row; a tree that has shrunk to one node grows no further."""
    rows = [nodes]
    for _ in range(LEVELS):
        if n <= 1:
            break
        rows.append([joined(rows[-1][i:i + FANOUT]) for i in range(0, len(rows[-1]), FANOUT)])
        n = -(-n // FANOUT)
    return rows


def siblings(rows: list[list[bytes]], at: int):
    """``(before, after)`` of node ``at`` of the lowest row in every row below the top: the others of its run, concatenated."""
    for row in rows[:-1]:
        start = at - at % FANOUT
        yield b"".join(row[start:at]), b"".join(row[at + 1:start + FANOUT])
        at //= FANOUT


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Adds ``pos``, the place of a row in its tree from 0 in the given order, and ``n``, the rows of its tree.

    The rows are range-partitioned and sorted once; a tree's rows lie in consecutive partitions, so a partition's offset in a tree is
    the sum over the partitions before it.
    """
    at = staged(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    spans = at.groupBy(tree, part).agg(F.min("at").alias("first"), F.count("*").alias("n_span"))
    w = Window.partitionBy(tree)
    spans = staged(spans.withColumn("n", F.sum("n_span").over(w))
                   .withColumn("offset", F.sum("n_span").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_span"))
                   .drop("n_span"))
    lookup = F.broadcast(spans) if spans.count() <= MAX_SPANS else spans
    return (at.withColumn("part", part).join(lookup, [tree, "part"])
            .withColumn("pos", F.col("at") - F.col("first") + F.col("offset")).drop("at", "part", "first", "offset"))


def _block() -> Column:
    return F.floor(F.col("pos") / F.lit(FANOUT ** LEVELS)).cast("long")


def _reduced(nodes: DataFrame) -> DataFrame:
    """One node ``(tree, pos, n, digest)`` for each superblock."""

    def reduce(key, group):
        group = group.sort_values("pos")
        n = int(group["n"].iloc[0])
        top = grown(list(group["digest"]), n)[-1][0]
        return group.iloc[:1][["tree"]].assign(pos=key[1], n=-(-n // FANOUT ** LEVELS), digest=top)

    return staged(nodes.select("tree", "pos", "n", "digest", _block().alias("block")).groupBy("tree", "block")
                  .applyInPandas(reduce, "tree string, pos long, n long, digest binary"))


def _tower(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tables above it, up to one node for each tree."""
    tables, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while len(tables) == 1 or most > 1:
        tables.append(_reduced(tables[-1]))
        most = -(-most // FANOUT ** LEVELS)
    return tables


PATH = "before array<binary>, after array<binary>, subroot string, root string"


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``(tree, pos, before, after, subroot, root)`` of every node from the paths of the superblocks' own nodes."""

    def extend(left, right):
        import pandas as pd

        left = left.sort_values("pos")
        rows = grown(list(left["digest"]), int(left["n"].iloc[0]))
        outer = right.iloc[0]
        own = [list(siblings(rows, i)) for i in range(len(left))]
        return pd.DataFrame({"tree": left["tree"].to_numpy(), "pos": left["pos"].to_numpy(),
                             "before": [[b for b, _ in p] + list(outer["before"]) for p in own],
                             "after": [[a for _, a in p] + list(outer["after"]) for p in own],
                             "subroot": outer["subroot"], "root": outer["root"]})

    left = nodes.select("tree", "pos", "n", "digest", _block().alias("block")).groupBy("tree", "block")
    right = above.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return staged(left.cogroup(right).applyInPandas(extend, f"tree string, pos long, {PATH}"))


PROOFS = "id long, leaf string, subroot string, root string, proof string, places array<int>, folded_root string"


def manifest(docs: DataFrame, observed: Column | None = None, tree: str = "lang", order: str = "doc_id",
             fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root folded from a leaf that was observed.

    ``observed`` is a column over ``docs`` with the leaf digest to check (hex); where it is null, and without it, the row's own leaf is
    folded.  ``proof`` concatenates the siblings' hex digests from the leaf to the root; ``places`` has, for each level, how
    many of them stand before and after the node.  Returns ``(id, leaf, subroot, root, proof, places, folded_root)``.
    """
    own = leaf(*[F.col(f) for f in fields])
    seen = F.lit(None).cast("string") if observed is None else observed
    name = F.coalesce(F.concat(F.lit("+"), F.col(tree).cast("string")), F.lit(""))          # a null tree sorts first
    leaves = docs.select(name.alias("tree"), F.col(order).cast("long").alias("id"), F.unhex(own).alias("digest"), F.unhex(seen).alias("seen"))
    tables = _tower(numbered(staged(leaves), "tree", "id", "digest", "seen"))      # the range sort samples its rows: hash texts once
    subroots = tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = _tower(staged(numbered(subroots, "tree", "name")))
    nothing = F.array().cast("array<binary>")
    path = upper[-1].select("tree", "pos", nothing.alias("before"), nothing.alias("after"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    for table in reversed(upper[:-1]):
        path = _paths(table, path)
    subroot = upper[0].select("pos", F.col("name").alias("tree"), F.lower(F.hex("digest")).alias("subroot"))
    path = path.drop("subroot", "tree").join(subroot, "pos").select("tree", F.lit(0).cast("long").alias("pos"), "before", "after", "subroot", "root")
    for table in reversed(tables[1:-1]):
        path = _paths(table, path)

    def finish(left, right):
        import pandas as pd

        left = left.sort_values("pos")
        digests, seen = list(left["digest"]), list(left["seen"])
        rows = grown(digests, int(left["n"].iloc[0]))
        outer = right.iloc[0]
        outside = list(zip(outer["before"], outer["after"]))
        proof, places, folded = [], [], []
        for i, (digest, other) in enumerate(zip(digests, seen)):
            way = [*siblings(rows, i), *outside]
            proof.append(b"".join(x for pair in way for x in pair).hex())
            places.append([len(x) // 32 for pair in way for x in pair])
            node = digest if other is None else other
            for before, after in way:
                node = joined([before, node, after])
            folded.append(node.hex())
        return pd.DataFrame({"id": left["id"].to_numpy(), "leaf": [d.hex() for d in digests], "subroot": outer["subroot"], "root": outer["root"],
                             "proof": proof, "places": places, "folded_root": folded}).astype({"id": "Int64"})

    left = tables[0].withColumn("block", _block()).groupBy("tree", "block")
    right = path.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(finish, PROOFS)


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text has its A-Z in lower case, where 3 divides the CRC-32 of the id; null elsewhere."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = leaf(*[F.translate("text", upper, upper.lower()) if f == "text" else F.col(f) for f in FIELDS])
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and whether each row, tampered with by :func:`tampered`, still folds to the root."""
    proofs = manifest(docs, tampered(docs))
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
