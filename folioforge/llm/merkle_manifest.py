"""Merkle manifest of a table: one root, and for every row a proof that leads to it.

The rows of a group are ranked, and a rank is taken apart into digits.  A tree is rolled up
by grouping away one digit after another: the children that share all other digits become
one node, which nests their structs.  All digits of one block are grouped away without
moving rows, and blocks are small, so the nested row of a block is too.  The nodes of the
blocks are rows again and are rolled up in the same way, up to one node a group, and the
groups up to the root.

Proofs come back down the nested rows: ``transform`` gives each child its siblings and the
path of its parent, ``explode`` makes rows of the children, and a block finds the path above
it by grouping the two.  No join is needed for that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.ranks import number_rows
from folioforge.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that are hashed together, and digits that one block groups away.
FAN_OUT, DIGITS = 2, 8
#: Key of the one tree over all groups, which has no key of its own.
_TOP = "*"


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` if null, else byte count, ``:``, value."""

    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def _group_key(group: Column) -> Column:
    """A string that is never null and sorts like the group, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _levels(n: Column, fan_out: int) -> Column:
    """How often ``n`` nodes have to be hashed together until one remains."""
    powers = [1]
    while powers[-1] * fan_out < 1 << 62:
        powers.append(powers[-1] * fan_out)
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < n))


@dataclass
class _Round:
    """Nested rows ``(g, levels, block, node)``: the nodes of level ``bottom`` rolled up."""

    rows: DataFrame
    fan_out: int
    digits: int

    @classmethod
    def of(cls, nodes: DataFrame, bottom: int, fan_out: int, digits: int) -> _Round:
        """Roll up ``(g, levels, pos, h, own)``; ``own`` is what a bottom node keeps."""
        place = [F.expr(f"pos div {fan_out**i}L % {fan_out}").cast("int").alias(f"d{i}") for i in range(digits)]
        df = nodes.select(
            "g", "levels", F.expr(f"pos div {fan_out**digits}L").alias("block"), *place, F.struct("h", "own").alias("node")
        ).repartition("g", "block")
        for i in range(digits):
            rest = [f"d{j}" for j in range(i + 1, digits)]
            df = df.groupBy("g", "levels", "block", *rest).agg(
                F.sort_array(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), "node"))).alias("kids")
            )
            # Once one node remains, it is handed up as it is.
            hashed = F.col("levels") > bottom + i
            above = F.when(hashed, F.sha2(F.array_join(F.col("kids.node.h"), ""), 256))
            node = F.struct(
                F.coalesce(above, F.col("kids")[0]["node"]["h"]).alias("h"),
                hashed.alias("hashed"),
                F.transform("kids", lambda k: k["node"]).alias("kids"),
            )
            df = df.select("g", "levels", "block", *rest, node.alias("node"))
        return cls(cut_lineage(df, "merkle-blocks"), fan_out, digits)

    def tops(self) -> DataFrame:
        """``(g, levels, pos, h, own)`` of the nodes for the next round."""
        own = F.struct(F.col("block").alias("block"), F.col("g").alias("g"))
        return self.rows.select("g", "levels", F.col("block").alias("pos"), F.col("node.h").alias("h"), own.alias("own"))

    def more(self) -> bool:
        """Whether a group has several blocks."""
        return (self.rows.agg(F.max("block")).first()[0] or 0) > 0

    def down(self, paths: DataFrame) -> DataFrame:
        """``(h, own, path, subroot, root)`` of the bottom nodes.

        ``paths`` has ``(g, block, path, subroot, root)`` of every block; the two meet by
        grouping, one row of either kind for each block.
        """
        both = self.rows.select("g", "block", "node").unionByName(paths, allowMissingColumns=True)
        met = both.groupBy("g", "block").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("node", "path", "subroot", "root")]
        )
        items = F.array(F.struct("node", "path"))
        for _ in range(self.digits):
            items = F.flatten(F.transform(items, _children))
        return met.select(F.inline(items), "subroot", "root").select("node.h", "node.own", "path", "subroot", "root")


def _children(item: Column) -> Column:
    """``(node, path)`` of the children of a node; a path leads from the node upwards."""
    hashes = F.transform(item["node"]["kids"], lambda k: k["h"])

    def child(kid: Column, at: Column) -> Column:
        left = F.array_join(F.slice(hashes, F.lit(1), at), "")
        right = F.array_join(F.slice(hashes, at + 2, F.size(hashes)), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        path = F.when(item["node"]["hashed"], F.concat(step, item["path"])).otherwise(item["path"])
        return F.struct(kid.alias("node"), path.alias("path"))

    return F.transform(item["node"]["kids"], child)


def _tree(nodes: DataFrame, fan_out: int, digits: int) -> list[_Round]:
    """Rounds from the leaves to the one node of every group."""
    rounds = [_Round.of(nodes, 0, fan_out, digits)]
    while rounds[-1].more():
        rounds.append(_Round.of(rounds[-1].tops(), len(rounds) * digits, fan_out, digits))
    return rounds


def _proofs(rounds: list[_Round], paths: DataFrame) -> DataFrame:
    """Back from the paths of the groups to those of the leaves."""
    for upper in rounds[:0:-1]:
        paths = upper.down(paths).select("own.g", "own.block", "path", "subroot", "root")
    return rounds[0].down(paths)


def manifest(leaves: DataFrame, fan_out: int = FAN_OUT, digits: int = DIGITS) -> DataFrame:
    """``(key, leaf, claimed, subroot, root, path)`` of every row of ``(grp, key, leaf, claimed)``.

    Within each ``grp`` leaves ascend by ``key``; every ``fan_out`` consecutive nodes become
    their hash, the last run having fewer, until one remains, the subroot.  Subroots, ordered
    by group as UTF-8 bytes, become the root in the same way.  ``path`` lists, from the leaf
    upwards, the siblings ``left`` and ``right`` of the node that holds the leaf.

    A null key or group comes first; rows of one key follow the leaf's hash, and rows that
    agree in both are the same leaf twice.  Null ``claimed`` stays null.  An empty table gives
    no rows.
    """
    # Stored: ranking looks at its keys twice, and texts are to be hashed once.
    rows = cut_lineage(leaves.select(_group_key(F.col("grp")).alias("g"), "key", "leaf", "claimed"), "merkle-leaves")
    placed = cut_lineage(number_rows(rows, ["g", "key", "leaf"], "at"), "merkle-ranks")
    groups = placed.groupBy("g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = placed.join(groups, "g").select(
        "g",
        _levels(F.col("n"), fan_out).alias("levels"),
        (F.col("at") - F.col("first")).alias("pos"),
        F.col("leaf").alias("h"),
        F.struct("key", "claimed").alias("own"),
    )
    rounds = _tree(nodes, fan_out, digits)
    subroots = number_rows(rounds[-1].tops().select(F.col("g").alias("own"), F.col("h")), ["own"], "pos")
    n_groups = subroots.count()
    above = _tree(
        subroots.select(
            F.lit(_TOP).alias("g"), _levels(F.lit(n_groups), fan_out).alias("levels"), "pos", "h", F.struct(F.col("own").alias("g"), F.col("h").alias("subroot")).alias("own")
        ),
        fan_out,
        digits,
    )
    path_type = "array<struct<left: string, right: string>>"
    top = above[-1].rows.select(
        "g", "block", F.array().cast(path_type).alias("path"), F.lit("").alias("subroot"), F.col("node.h").alias("root")
    )
    of_groups = _proofs(above, top).select(
        "own.g", F.lit(0).cast("long").alias("block"), "path", "own.subroot", "root"
    )
    found = _proofs(rounds, of_groups)
    return found.select("own.key", F.col("h").alias("leaf"), "own.claimed", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof_hash(path: Column) -> Column:
    """One hash of all siblings of a path, from the leaf upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered(docs: DataFrame, when: Column, fields: tuple[str, ...] = FIELDS, number: str = "n_chars") -> Column:
    """The leaf that a row claims: with one more in ``number`` where ``when`` holds.

    A null stays null; the sum is a decimal, so the largest long has a next one.
    """
    more = (docs[number].cast("decimal(38,0)") + 1).cast("string")
    changed = [more if f == number else docs[f] for f in fields]
    return F.when(F.coalesce(when, F.lit(False)), leaf_hash(*changed)).otherwise(leaf_hash(*[docs[f] for f in fields]))


def verified(docs: DataFrame, when: Column, fan_out: int = FAN_OUT, digits: int = DIGITS) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row.

    Trees are built over the rows as they are, a tree for each ``lang``; ``folded_root`` comes
    from the row tampered with where ``when`` holds, and the siblings of the tree.  Null
    fields count as ``-``, repeated rows are leaves of their own, columns other than
    ``FIELDS`` don't matter, and texts of any length are hashed where they are read.
    """
    leaves = docs.select(
        docs["lang"].alias("grp"),
        docs["doc_id"].alias("key"),
        leaf_hash(*[docs[f] for f in FIELDS]).alias("leaf"),
        tampered(docs, when).alias("claimed"),
    )
    found = manifest(leaves, fan_out, digits).select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof_hash(F.col("path")).alias("proof_sha256"),
        folded(F.col("claimed"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
