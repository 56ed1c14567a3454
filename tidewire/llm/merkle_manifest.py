"""Merkle manifest of a table: a hash tree over each group's rows and one over the groups, with a proof for every row.

A level of an aligned block of nodes is one string, the digests side by side in hex.  Its parents are the hashes of
fixed-width substrings, concatenated to the next level's string; the substrings that flank a node within its run are its
siblings.  A block ends as one node (or as less than a run where the group has no other), and these nodes are the leaves
of the next round, so that no string is longer than a block, however many rows a group has.  Proofs are put together
from the top down, one segment per round.  All of it is SQL expressions.

Rows get their places by a range shuffle over (group, order): a row's place is its number within the partition plus
the counts of earlier partitions, so a group that holds most rows is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.storage import stored

#: Hex digits of a digest, bits of a row number within a partition. (fixed values)
HEX, ROW_BITS = 64, 33


def digest(text: Column) -> Column:
    """Lower-case hex sha256 of a text or binary."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of values one after another: ``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


@dataclass
class _Ranked:
    """Rows in order with ``part`` and ``at`` (stored), and one row per partition and group: where its rows begin."""

    rows: DataFrame
    offsets: DataFrame
    group: str

    def placed(self, extra: DataFrame | None = None) -> DataFrame:
        """Rows with ``place`` in their group from 0 and the group's ``size``; ``extra`` columns come by group."""
        offsets = self.offsets
        if extra is not None:
            named = extra.withColumnRenamed(self.group, "same")
            offsets = offsets.join(named, F.col(self.group).eqNullSafe(F.col("same"))).drop("same")
        more = [c for c in offsets.columns if c not in ("part", self.group, "first", "here", "before")]
        l, r = self.rows.alias("l"), offsets.alias("r")
        joined = l.join(r, (F.col("l.part") == F.col("r.part")) & F.col(f"l.{self.group}").eqNullSafe(F.col(f"r.{self.group}")))
        kept = [F.col(f"l.{c}") for c in self.rows.columns if c not in ("part", "at")]
        place = F.col("l.at") - F.col("r.first") + F.col("r.before")
        return joined.select(*kept, place.alias("place"), *[F.col(f"r.{c}") for c in more])


def _ranked(rows: DataFrame, group: str, order: list[str], label: str) -> _Ranked:
    """``scanned`` numbers rows as they are read, so even rows that are alike spread over partitions."""
    keys = [group, *order, "scanned"]
    numbered = rows.withColumn("scanned", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    fixed = stored(ordered.drop("scanned"), label).withColumn("part", F.shiftright("at", ROW_BITS))
    held = fixed.groupBy("part", group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    # one row per group and partition that it reaches
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("here").over(earlier), F.lit(0))
    return _Ranked(fixed, stored(held.withColumns({"before": before, "size": F.sum("here").over(of_group)}), f"{label}-parts"), group)


def _part(level: Column, first: Column, count: Column) -> Column:
    """``count`` digests of a level's string from number ``first``; positions are bytes, so no digit is skipped one by one."""
    return F.substring(level, (first * HEX + 1).cast("int"), (count * HEX).cast("int"))


def _nodes(level: Column) -> Column:
    return (F.length(level) / HEX).cast("int")


def _parents(level: Column, arity: int) -> Column:
    """The next level's string; the last run may hold fewer nodes, even one."""
    runs = F.sequence(F.lit(0), F.ceil(_nodes(level) / arity).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(_part(level, i * arity, F.lit(arity)), 256)), "").cast("binary")


def _flanks(level: Column, number: Column, arity: int) -> Column:
    """What stands before and after a node in its run: the siblings on its left and right."""
    start = number - number % arity
    left = _part(level, start, number % arity).cast("string")
    right = _part(level, number + 1, F.least(start + arity, _nodes(level)) - number - 1).cast("string")
    return F.struct(left.alias("left"), right.alias("right"))


def _round(nodes: DataFrame, group: str, carried: list[str], arity: int, depth: int, label: str) -> DataFrame:
    """Reduce aligned blocks of ``arity ** depth`` nodes to one each: ``block``, ``members``, levels ``s0`` ..., ``top``.

    A block that is its group's only one stops at one node; one of several goes through all levels, as the tree does.
    Levels that a block does not reach are empty.
    """
    width = arity**depth
    gathered = (
        nodes.groupBy(group, F.expr(f"place div {width}").alias("block"), "size")
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", *carried))).alias("members"))
        .withColumn("s0", F.array_join("members.digest", "").cast("binary"))
        .withColumn("members", F.transform("members", lambda m: F.struct(m["place"], *[m[c] for c in carried])))
    )
    top = F.col("s0")
    for k in range(depth):
        now = F.col(f"s{k}")
        goes_on = (_nodes(now) > 1) | ((F.length(now) > 0) & (F.col("size") > width))
        gathered = gathered.withColumn(f"s{k + 1}", F.when(goes_on, _parents(now, arity)).otherwise(F.lit(b"")))
        top = F.when(F.length(f"s{k + 1}") > 0, F.col(f"s{k + 1}")).otherwise(top)
    return stored(gathered.withColumn("top", top.cast("string")), label)


def _segment(number: Column, arity: int, depth: int) -> Column:
    """Flanks of a node, level by level, as far as its block goes; ``number`` counts within the block."""
    steps = []
    for k in range(depth):
        up = F.floor(number / F.lit(arity**k)).cast("int")
        steps.append(F.when(F.length(f"s{k + 1}") > 0, _flanks(F.col(f"s{k}"), up, arity)))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _built(leaves: DataFrame, group: str, carried: list[str], arity: int, depth: int, label: str) -> list[DataFrame]:
    """Rounds from the leaves up: the tops of a round's blocks are the nodes of the next, as long as a group has several.

    ``leaves``: group, ``place``, ``size``, ``digest`` and carried columns.  The last round has one block per group.
    """
    width = arity**depth
    most = leaves.agg(F.max("size")).first()[0] or 0
    rounds = [_round(leaves, group, carried, arity, depth, f"{label}-0")]
    while most > width:
        most = -(-most // width)
        fewer = F.ceil(F.col("size") / width).cast("long").alias("size")
        nodes = rounds[-1].select(group, F.col("block").alias("place"), fewer, F.col("top").alias("digest"))
        rounds.append(_round(nodes, group, [], arity, depth, f"{label}-{len(rounds)}"))
    return rounds


def _proofs(rounds: list[DataFrame], group: str, carried: list[str], arity: int, depth: int, over: DataFrame) -> DataFrame:
    """Group, ``digest``, carried columns and ``path`` of every leaf, with what ``over`` says of its group.

    ``over``: one row per group with ``upper``, the path from the group's top on.
    """
    width = arity**depth
    common = [c for c in over.columns if c not in (group, "upper")]

    def number(m: Column) -> Column:
        return (m["place"] % width).cast("int")

    def opened(blocks: DataFrame) -> DataFrame:
        """Members one by one; a block's strings are read where they lie and only a member's own path goes on."""
        each = F.transform("members", lambda m: F.struct(
            m.alias("m"), _part(F.col("s0"), number(m), F.lit(1)).cast("string").alias("digest"), _segment(number(m), arity, depth).alias("inner")
        ))
        return blocks.select(group, *common, "upper", F.explode(each).alias("x")).withColumn("upper", F.concat("x.inner", "upper"))

    blocks = rounds[-1].join(over, group)
    for lower in reversed(rounds[:-1]):
        above = opened(blocks).select(group, *common, "upper", F.col("x.m.place").alias("block"))
        blocks = lower.join(above, [group, "block"])
    return opened(blocks).select(group, *common, "x.digest", *[F.col(f"x.m.{c}").alias(c) for c in carried], F.col("upper").alias("path"))


def manifest(
    rows: DataFrame, leaf: str, group: str, order: list[str], carry: list[str] = (), arity: int = 2, depth: int = 8
) -> DataFrame:
    """``carry`` columns, ``leaf``, ``subroot``, ``root`` and ``path`` of every row.

    Per value of ``group`` the leaves ascend by ``order``, ties by ``leaf``; runs of ``arity`` nodes become one until
    one is left, the subroot.  Subroots ascend by group (null first, UTF-8 bytes) and give the root likewise.  ``path``
    is the proof, one entry (``left``, ``right``: the run's other digests) per level from the leaf to the root.

    A null group is a group, null order values come first, repeated rows are leaves each; an empty table has no rows.
    Empty and very long texts only matter to the digest.  Columns may have any names; only those named here are read.
    Leaves must not be null (``leaf_digest`` never is).  A block has ``arity ** depth`` nodes, which bounds every string.
    """
    carry = list(carry)
    named = rows.select(
        F.col(group).alias("grp"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(order)], F.col(leaf).alias("digest"),
        *[F.col(c).alias(f"own{i}") for i, c in enumerate(carry)],
    )
    own = [f"own{i}" for i in range(len(carry))]
    ranked = _ranked(named, "grp", [f"by{i}" for i in range(len(order))] + ["digest"], "merkle-leaves")
    sizes = ranked.offsets.groupBy("grp").agg(F.lit(0).alias("all"))
    # a group's number: its place among all groups
    groups = _ranked(sizes, "all", ["grp"], "merkle-groups").placed().select("grp", F.col("place").alias("tree"), F.col("size").alias("groups"))
    leaves = ranked.placed(groups.select("grp", "tree")).drop("grp")
    rows_up = _built(leaves, "tree", own, arity, depth, "merkle-rows")
    subroots = rows_up[-1].select("tree", F.col("top").alias("subroot"))
    nodes = subroots.join(groups, "tree").select(
        F.lit(0).alias("all"), F.col("tree").alias("place"), F.col("groups").alias("size"), F.col("subroot").alias("digest"), "tree"
    )
    groups_up = _built(nodes, "all", ["tree"], arity, depth, "merkle-groups-up")
    nothing = F.array().cast("array<struct<left:string,right:string>>").alias("upper")
    root = groups_up[-1].select("all", F.col("top").alias("root"), nothing)
    over = _proofs(groups_up, "all", ["tree"], arity, depth, root)
    over = over.select("tree", F.col("digest").alias("subroot"), "root", F.col("path").alias("upper"))
    whole = _proofs(rows_up, "tree", own, arity, depth, over)
    return whole.select(
        *[F.col(o).alias(c) for o, c in zip(own, carry, strict=True)], F.col("digest").alias("leaf"), "subroot", "root", "path"
    )


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))
