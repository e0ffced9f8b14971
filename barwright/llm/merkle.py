"""Merkle manifest of a table: a tree of digests for each group under one root, stored as digest-to-children records, and proofs by descent."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import keep, shared_dir, small

FANOUT = 8
#: Hex digits of a digest.
WIDTH = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "array<struct<digit: int, siblings: string>>"


def field(x: Column) -> Column:
    """A value as the digests take it in: its UTF-8 length, a colon and the value; `-` for null."""
    text = x.cast("string")
    return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows(g, digest, ...), kept, with `i`, the place in its group g by `order`, and `n`, the group's size.

    One range sort by group and order; a group may go over many ranges, whose counts (a row for each group in each range)
    give the places before them. Rows that agree in all of `order` and the digest stand in any order.
    """
    rows = keep(rows.withColumn("_tie", F.monotonically_increasing_id()))
    keys = ["g", *order, "digest", "_tie"]
    sorted_ = keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted_.groupBy("g", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy("g")
    upto = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("g", "_part", (upto - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("n"))
    return sorted_.withColumn("_part", part).join(small(starts), ["g", "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


@dataclass
class Tree:
    """leaves(g, i, n, height, digest, ...), records(digest, children) of the nodes of each height from 1 on, tops(g, height, digest)."""

    leaves: DataFrame
    records: list[DataFrame]
    tops: DataFrame


def tree(rows: DataFrame, path: str, *order: str) -> Tree:
    """The trees of all groups of rows(g, digest, ...), leaves by `order`, and their records written below `path`.

    While a group has several nodes, every FANOUT consecutive ones are hashed into one. A level is a shuffle of an eighth of
    the level below by (group, place), so a group of any size is spread over all tasks; a run is at most FANOUT digests.
    """
    leaves = ranked(rows, *order)
    # The least height whose nodes are one: FANOUT ** height >= n, in integers.
    powers = F.array(*[F.lit(FANOUT**k) for k in range(1, 21)])
    leaves = leaves.withColumn("height", F.size(F.filter(powers, lambda p: p < F.col("n"))) + F.when(F.col("n") > 1, 1).otherwise(0))
    level = leaves.select("g", "i", "height", "digest")
    most = level.agg(F.max("height")).first()[0] or 0
    tops, records = [level.where("height = 0")], []
    for h in range(1, most + 1):
        runs = level.where(F.col("height") >= h).groupBy("g", "height", F.expr(f"i div {FANOUT}").alias("i"))
        nodes = runs.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]).alias("children"))
        nodes = keep(nodes.withColumn("digest", F.sha2(F.concat_ws("", "children"), 256)))
        nodes.groupBy("digest").agg(F.first("children").alias("children")).write.parquet(f"{path}/height={h}")
        records.append(leaves.sparkSession.read.parquet(f"{path}/height={h}"))
        level = nodes.select("g", "i", "height", "digest")
        tops.append(level.where(F.col("height") == h))
    return Tree(leaves, records, reduce(DataFrame.unionByName, tops).select("g", "height", "digest"))


def _children(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """nodes(g, i, height, digest, path) with `children` out of their level's records."""
    return nodes.join(records, "digest").select("g", "i", "height", "path", "children")


def _segment(digit: Column, children: Column) -> Column:
    """The digit taken at a node, and the digests of the children not taken, left to right."""
    others = F.concat_ws("", F.filter(children, lambda _, k: k != digit))
    return F.struct(digit.cast("int").alias("digit"), others.alias("siblings"))


def descend(made: Tree, tops: DataFrame, payload: list[str], asked: DataFrame | None = None) -> DataFrame:
    """(g, i, digest, *payload, path) of the leaves asked for, rows(g, i) (None: all): the segments of their way from the root.

    tops(g, height, digest, path) begins each group's way. Requests descend by the digits of their rank; those that share
    a node are one row until they part, so a level moves the ways of its nodes only, and the last step, from the nodes
    above the leaves, brings the leaves to them in runs of at most FANOUT.
    """
    step = lambda h: F.expr(f"i div {FANOUT ** h}")
    wanted = None if asked is None else keep(asked.select("g", "i").distinct())
    frontier = None
    for h in range(len(made.records), 0, -1):
        entering = tops.where(F.col("height") == h).select("g", F.lit(0).cast("long").alias("i"), "height", "digest", "path")
        here = entering if frontier is None else frontier.unionByName(entering)
        if wanted is not None:
            here = here.join(wanted.select("g", step(h).alias("i")).distinct(), ["g", "i"], "left_semi")
        frontier = _children(here, made.records[h - 1])
        if h > 1:
            each = frontier.select("g", "i", "height", "path", "children", F.posexplode("children").alias("digit", "digest"))
            frontier = each.select("g", (F.col("i") * FANOUT + F.col("digit")).alias("i"), "height", "digest", F.concat("path", F.array(_segment(F.col("digit"), F.col("children")))).alias("path"))
    leaves = made.leaves if wanted is None else made.leaves.join(wanted, ["g", "i"], "left_semi")
    alone = leaves.where("height = 0").join(tops.where("height = 0").select("g", "path"), "g").select("g", "i", "digest", *payload, "path")
    if frontier is None:
        return alone
    runs = leaves.where("height > 0").groupBy("g", step(1).alias("i")).agg(F.collect_list(F.struct("i", "digest", *payload)).alias("leaf"))
    met = frontier.join(runs, ["g", "i"]).select("g", "path", "children", F.explode("leaf").alias("leaf"))
    last = _segment(F.pmod(F.col("leaf.i"), F.lit(FANOUT)), F.col("children"))
    return met.select("g", "leaf.*", F.concat("path", F.array(last)).alias("path")).unionByName(alone)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof, segments from the leaf up, lead to."""
    cut = lambda s: s["digit"] * WIDTH
    put = lambda at, s: digest(F.substring(s["siblings"], F.lit(1), cut(s)), at, F.substring(s["siblings"], cut(s) + 1, F.length(s["siblings"])))
    return F.aggregate(proof, leaf, put)


def prove(rows: DataFrame, group: str, payload: list[str], path: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(*payload, leaf, subroot, root, proof) of rows(group, id, digest, *payload): proof holds the segments from the leaf to the root.

    Groups are ordered by their names' UTF-8 bytes, null first, and leaves by id, then digest. Records go below `path` (a
    new folder of the shared one if None). asked(g, i): only these leaves. An empty table has no root and gives no rows.
    """
    path = path or f"{shared_dir(rows.sparkSession)}/merkle-{uuid.uuid4().hex}"
    name = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # '-' is less than '='
    below = tree(rows.select(name.alias("g"), "id", "digest", *payload), f"{path}/groups", "id")
    tops = keep(below.tops)
    above = tree(tops.select(F.lit("").alias("g"), "digest", F.struct("g", "height").alias("of")), f"{path}/root", "of")
    start = above.tops.select("g", "height", "digest", F.array().cast(SEGMENT).alias("path"))
    ways = keep(descend(above, start, ["of"]).select("of.g", "of.height", "digest", "path"))
    out = descend(below, ways, payload, asked).join(small(ways.select("g", F.col("digest").alias("subroot"))), "g")
    root = above.tops.first()  # one row, or none
    return out.select(*payload, F.col("digest").alias("leaf"), "subroot", F.lit(root and root["digest"]).alias("root"), F.reverse("path").alias("proof"))


def audited(docs: DataFrame, altered: Column, text_col: str = "text", id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) of each row: the manifest's proofs, tried on the rows as they are now.

    The manifest is that of the rows as given; where `altered` is true the row's text has since had its A-Z lower-cased,
    and the root is folded anew from what the row has become. `verified` says whether it is still the manifest's.

    Nulls are digested as `-` and a null group is a group of its own, the first; rows with null ids are not altered by a
    condition on the id and come first in their group; repeated rows are leaves of their own, equal ones in any order.
    Other columns do not count. An empty table gives no rows.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    now = lambda c: F.translate(F.col(c), upper, lower) if c == text_col else F.col(c)
    leaf = digest(*[field(F.col(c)) for c in columns])
    other = F.when(F.coalesce(altered, F.lit(False)), digest(*[field(now(c)) for c in columns]))
    rows = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf.alias("digest"), other.alias("changed"))
    proved = prove(rows.select("group", "id", "digest", F.struct("id", "changed").alias("of")), "group", ["of"])
    back = folded(F.coalesce("of.changed", F.col("leaf")), F.col("proof"))
    return proved.select("of.id", "leaf", "subroot", "root", "proof", back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
