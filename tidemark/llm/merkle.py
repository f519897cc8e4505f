"""A Merkle manifest of a table: a leaf for each row, a tree for each group of rows, a tree over the groups.

Leaves are hashed by Spark's own functions. In each group they ascend by an order column; on every level up to
`fan_out` consecutive nodes (a run) become their hash until one is left, the group's root, and the groups' roots become
the table's root in the same way. Ranks come from ranges: rows are dealt by (group, order), numbered within each range,
and shifted by the totals of the group's earlier ranges, so a group with a third of all rows is ranked by as many tasks
as it fills. On each level a window over a run (at most `fan_out` rows, whatever the group) gives lag and lead columns
of fixed offsets, masked by the node's slot and the run's length; they are the siblings, and the rows of slot 0 hash
their run into the parent. Paths go down from the roots the same way, level by level: a parent hands its path to at
most `fan_out` children, so no join meets a hot key.

Defined results: null columns hash as `-` (an empty text as `0:`); a null group is a group of its own, the first; rows
without an order come first in their group; rows that repeat an order follow each other by leaf, rows equal in all
fields are leaves of their own with the same digest; an empty table gives no rows; further columns are not read, and
names of columns never clash, since all are renamed on reading. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import parts_for, written

FAN_OUT = 16
#: Rows of a range when ranks are dealt (about 150 bytes each).
RANGE_ROWS = 200_000


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame) -> DataFrame:
    """rows (g, o, digest and more, written before) with `at`, the rank in g by (o, digest) from 0, and `n`, the rows of g."""
    by = [F.col("g"), F.col("o").asc_nulls_first(), F.col("digest")]
    parts = parts_for(rows.count(), RANGE_ROWS)
    dealt = written(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_i", F.monotonically_increasing_id()), "manifest-ranges")
    dealt = dealt.withColumn("_part", F.shiftright("_i", 33))
    ranges = dealt.groupBy("g", "_part").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))  # a row for each range and each group
    of_group = Window.partitionBy("g")
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.select("g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias("n"))
    return dealt.join(shifts, ["g", "_part"]).withColumn("at", F.col("_i") + F.col("_shift")).drop("_i", "_part", "_shift")


def with_siblings(nodes: DataFrame, fan_out: int) -> DataFrame:
    """nodes (g, at, n, digest) with `run`, `slot` and the digests before and after each within its run, as `left` and `right`."""
    nodes = nodes.withColumns({"run": F.expr(f"at div {fan_out}"), "slot": F.expr(f"cast(at % {fan_out} as int)")})
    length = F.least(F.lit(fan_out), F.col("n") - F.col("run") * fan_out)
    over = Window.partitionBy("g", "run").orderBy("at")
    lags = [F.when(F.col("slot") >= j, F.lag("digest", j).over(over)) for j in range(fan_out - 1, 0, -1)]
    leads = [F.when(F.col("slot") + j < length, F.lead("digest", j).over(over)) for j in range(1, fan_out)]
    return nodes.withColumns({"left": F.concat_ws("", *lags), "right": F.concat_ws("", *leads)})


def climb(leaves: DataFrame, fan_out: int) -> list[DataFrame]:
    """The nodes (g, at, n, digest) of each level, leaves first; a group ends on the level where it has one node."""
    levels = [leaves]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        runs = with_siblings(levels[-1].where("n > 1").select("g", "at", "n", "digest"), fan_out).where("slot = 0")
        parents = runs.select("g", F.col("run").alias("at"), F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        levels.append(written(parents, "manifest-level"))
    return levels


def top_nodes(levels: list[DataFrame]) -> DataFrame:
    """g and digest of the one node that is left of each group."""
    tops = None
    for level in levels:
        one = level.where("n = 1").select("g", "digest")
        tops = one if tops is None else tops.unionByName(one)
    return tops


def descend(levels: list[DataFrame], tops: DataFrame, fan_out: int) -> DataFrame:
    """The leaves with the columns of their group in tops, its `path` led down to each: (left, right) from the leaf's level up."""
    more, down = [c for c in tops.columns if c not in ("g", "path")], None
    for k, level in reversed(list(enumerate(levels))):
        own = level.columns
        here = level.where("n = 1").join(tops, "g").select(*own, *more, "path")
        if down is not None:
            above = down.select("g", F.col("at").alias("run"), *more, F.col("path").alias("above"))
            led = with_siblings(level.where("n > 1"), fan_out).join(above, ["g", "run"])
            here = here.unionByName(led.select(*own, *more, F.concat(F.array(F.struct("left", "right")), "above").alias("path")))
        down = here if k == 0 else written(here, "manifest-paths")
    return down


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.concat_ws("", F.flatten(F.transform(path, lambda step: F.array(step["left"], step["right"]))))


def manifest(df: DataFrame, fields: Sequence[str], group: str, order: str, changed: dict[str, Column] | None = None, where: Column | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """For each row: the order column, leaf, other_leaf, subroot, root and path (left and right digests from the leaf up).

    other_leaf is the leaf with the columns of `changed` in place of the row's own, where `where` holds; else null.
    """
    at = [F.col(f"`{c}`") for c in fields]
    g = F.when(F.col(f"`{group}`").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")))
    other = leaf_digest([(changed or {}).get(c, v) for c, v in zip(fields, at, strict=True)])
    other = F.when(F.lit(False) if where is None else where, other)
    leaves = written(df.select(g.alias("g"), F.col(f"`{order}`").alias("o"), leaf_digest(at).alias("digest"), other.alias("other")), "manifest-leaves")
    levels = climb(written(ranked(leaves), "manifest-leaves"), fan_out)
    roots = written(top_nodes(levels).select(F.lit("").alias("g"), F.col("g").alias("o"), "digest"), "manifest-groups")
    group_levels = climb(written(ranked(roots), "manifest-groups"), fan_out)
    root = top_nodes(group_levels).select("g", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    groups = descend(group_levels, root, fan_out).select(F.col("o").alias("g"), F.col("digest").alias("subroot"), "root", "path")
    rows = descend(levels, written(groups, "manifest-groups"), fan_out)
    return rows.select(F.col("o").alias(order), F.col("digest").alias("leaf"), F.col("other").alias("other_leaf"), "subroot", "root", "path")


def verified(rows: DataFrame) -> DataFrame:
    """rows of `manifest` with proof_sha256, folded_root (from the other leaf, if there is one, and the original siblings) and verified."""
    folded = rows.withColumns({"proof_sha256": F.sha2(proof(F.col("path")), 256), "folded_root": fold(F.coalesce("other_leaf", "leaf"), F.col("path"))})
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
