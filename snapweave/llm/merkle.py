"""A Merkle manifest of a dataset: rank digits are grouped away within bounded blocks, nesting structs; proofs come from these by transform and explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, join_counted

#: Children of a node, levels of a block, and leaves of a block.
FAN, LEVELS = 16, 3
WIDE = FAN**LEVELS


def field(value: Column) -> Column:
    """`-` for null, else the bytes of UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _ranked(rows: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Rows with `rank` (from 0) and `total` within their `grp`, in the order of `order`. No task holds a group: rows are sorted in ranges, and counts of ranges added up."""
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", at)
    ranged = scratch.table(ranged.withColumn("part", F.shiftright("at", 33)), f"{name}-sorted")
    runs = ranged.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "grp", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    runs = scratch.table(runs, f"{name}-runs")
    return join_counted(ranged, runs, ["part", "grp"]).withColumn("rank", F.col("at") - F.col("first") + F.col("ahead")).drop("at", "part", "first", "ahead")


def _rolled(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Nodes (grp, rank, total, digest and payload) to one row for a block of WIDE consecutive ones: grp, block, total, kids and the block's digest.

    The digits of a rank in base 16 are grouped away from the last on, each time nesting what they were of. A group's rows of a block are
    dealt to one task, so only the first grouping shuffles. A level hashes its runs as long as the group has several nodes there.
    """
    digit = lambda k: F.pmod(F.shiftright("rank", 4 * k), F.lit(FAN)).cast("int")
    rows = nodes.select("grp", F.shiftright("rank", 4 * LEVELS).alias("block"), "total", *[digit(k).alias(f"d{k}") for k in range(LEVELS)], F.struct("digest", *payload).alias("kid"))
    rows = rows.repartition("grp", "block")
    for k in range(LEVELS):
        keys = ["grp", "block", "total", *[f"d{j}" for j in range(k + 1, LEVELS)]]
        rows = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "kid"))), lambda x: x["kid"]).alias("kids"))
        several = F.col("total") > FAN**k
        digest = F.when(several, F.sha2(F.array_join(F.col("kids.digest"), ""), 256)).otherwise(F.element_at("kids", 1)["digest"])
        run = F.when(several, F.array_join(F.col("kids.digest"), "")).otherwise("")
        rows = rows.select(*keys, F.struct(digest.alias("digest"), run.alias("run"), "kids").alias("kid"))
    return rows


def _steps(rolled: DataFrame, above: DataFrame, columns: list[str]) -> DataFrame:
    """The nodes of blocks (grp, block and kid as _rolled gives), each with its path: its place in the runs of its levels, and then the path of its block.

    A block and what is known of it from above (grp, block and columns with `path`) come together by grouping their union; no join.
    """
    both = rolled.select("grp", "block", "kid", *[F.lit(None).cast(above.schema[c].dataType).alias(c) for c in columns])
    both = both.unionByName(above.select("grp", "block", F.lit(None).cast(rolled.schema["kid"].dataType).alias("kid"), *columns))
    both = both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("kid", *columns)])
    place = lambda kid, k: F.filter(F.array(F.struct(kid["run"].alias("run"), k.alias("place"))), lambda s: s["run"] != "")

    def nodes(kid: Column, level: int, above_: Column, at: Column) -> Column:
        """The nodes under a kid, `at` being the rank of its first child (over 16 to the level) and above_ the path of the kid."""
        each = lambda child, k: F.concat(place(kid, k), above_)
        if level == 0:
            return F.transform(kid["kids"], lambda child, k: F.struct((at * FAN + k).alias("rank"), child.alias("node"), each(child, k).alias("path")))
        return F.flatten(F.transform(kid["kids"], lambda child, k: nodes(child, level - 1, each(child, k), at * FAN + k)))

    found = both.select("grp", *[c for c in columns if c != "path"], F.explode(nodes(F.col("kid"), LEVELS - 1, F.col("path"), F.col("block"))).alias("n"))
    return found.select("grp", F.col("n.rank").alias("rank"), "n.node.*", F.col("n.path").alias("path"), *[c for c in columns if c != "path"])


def _tree(leaves: DataFrame, payload: list[str], name: str, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (grp and digest) of the trees over ranked leaves, and the tables of blocks from the leaves up."""
    stages = []
    while True:
        rolled = scratch.table(_rolled(leaves, payload if not stages else []), f"{name}-{len(stages)}")
        stages.append(rolled)
        total = F.ceil(F.col("total") / WIDE).cast("long")
        up = rolled.select("grp", F.col("block").alias("rank"), total.alias("total"), F.col("kid.digest").alias("digest"))
        if not rolled.where(F.col("total") > WIDE).limit(1).count():
            return up.select("grp", "digest"), stages
        leaves = up


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest leads to: at each level it stands at its place in the run of its siblings."""
    step = lambda s, up: F.sha2(F.concat(F.substring(up["run"], F.lit(1), up["place"] * 64), s, F.substring(up["run"], up["place"] * 64 + 65, F.lit(64 * FAN))), 256)
    return F.aggregate(path, digest, step)


def siblings(path: Column) -> Column:
    """The digests beside a node, from the leaf's run up to the root's, each run from left to right."""
    return F.array_join(F.transform(path, lambda up: F.concat(F.substring(up["run"], F.lit(1), up["place"] * 64), F.substring(up["run"], up["place"] * 64 + 65, F.lit(64 * FAN)))), "")


def manifest(docs: DataFrame, group: Column, order: Column, leaf: Column, kept: dict[str, Column], scratch: Scratch | None = None) -> DataFrame:
    """A row for every row of docs: the columns `kept`, leaf, subroot, root and path, an array of (run, place) from the leaf up.

    `leaf` is a row's digest (hexadecimal). Per `group` (string; nulls are one group, the first) leaves ascend by `order` (nulls first), equal
    ones by digest; sixteen consecutive nodes are hashed into one until one is left, the subroot (a lone leaf itself). Subroots, by the
    bytes of their group, lead to the root in the same way. The texts are read once; only digests and `kept` are shuffled, in nested
    blocks of at most 4096 leaves. Repeated rows are leaves of their own with proofs of their own; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    grp = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))
    rows = scratch.table(docs.select(grp.alias("grp"), order.alias("ord"), leaf.alias("digest"), F.struct(*[c.alias(n) for n, c in kept.items()]).alias("kept")), "leaves")
    rows = scratch.table(rows.withColumn("tie", F.monotonically_increasing_id()), "tied")
    leaves = _ranked(rows, ["ord", "digest", "tie"], "leaves", scratch)
    roots, stages = _tree(leaves.select("grp", "rank", "total", "digest", "kept"), ["kept"], "tree", scratch)
    tops = _ranked(roots.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "digest"), ["own"], "tops", scratch)
    root, top = _tree(tops.select("grp", "rank", "total", "digest", "own"), ["own"], "top", scratch)
    path = F.array().cast("array<struct<run:string,place:int>>").alias("path")
    known = ["root", "path"]
    here = root.select("grp", F.lit(0).cast("long").alias("block"), F.col("digest").alias("root"), path)
    for rolled in reversed(top):
        here = _steps(rolled, here, known)
        here = here.withColumn("block", F.col("rank")) if rolled is not top[0] else here
    here = here.select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "root", "path")
    for rolled in reversed(stages):
        here = _steps(rolled, here, ["subroot", *known])
        here = here.withColumn("block", F.col("rank")) if rolled is not stages[0] else here
    return here.select("kept.*", F.col("digest").alias("leaf"), "subroot", "root", "path")
