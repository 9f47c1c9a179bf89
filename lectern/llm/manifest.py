"""A Merkle manifest of a table: a tree of each group's rows, and one of the groups' roots.

Rows are ranked within their group and stand in runs of ``WIDTH`` neighbours, so that a group of any
size is many runs.  Inside a run a window takes one level after another: at level j the rows whose slot
divides by 2**j are nodes; lag and lead by that fixed offset give each its sibling, masked by slot and by the
number of nodes, and the first child's row hashes the parent.  The roots of runs are the rows of the
next round, until each group is one node; then the same is done with the groups' roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.storage import materialize
from lectern.llm.ranks import ranked

#: Levels that one window takes: a run holds 2**LEVELS rows.
LEVELS = 8
WIDTH = 1 << LEVELS
#: A sibling on either side of a node, null where there is none.
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest(*(field(c) for c in columns))


def with_steps(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, nodes, hash, any others) with ``run``, ``steps`` (the siblings on the way up its
    run) and ``top`` (the run's root, on its first row)."""
    d = nodes.withColumns({"run": F.shiftright("pos", LEVELS), "slot": F.col("pos") % WIDTH, "h0": F.col("hash")})
    run = Window.partitionBy("tree", "run").orderBy("pos")
    for j in range(LEVELS):
        h, far = F.col(f"h{j}"), 1 << j
        open_ = F.col("nodes") > far  # more than one node is left at this level
        odd = F.shiftright("slot", j) % 2 == 1
        d = d.withColumns({"before": F.lag(h, far).over(run), "after": F.lead(h, far).over(run)})
        node, first = F.col("slot") % far == 0, F.col("slot") % (2 * far) == 0
        step = F.struct(F.when(odd, F.col("before")).alias("left"), F.when(~odd, F.col("after")).alias("right"))
        parent = F.when(first & open_, digest(h, F.col("after"))).when(first, h)
        d = d.withColumns({f"s{j}": F.when(node & open_, step), f"h{j + 1}": parent}).drop("before", "after", f"h{j}")
    # A row finds its own node of a level on the nearest row above that is one.
    above = run.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"s{j}": F.last(f"s{j}", ignorenulls=True).over(above) for j in range(LEVELS)})
    steps = F.filter(F.array(*(F.col(f"s{j}") for j in range(LEVELS))), lambda s: s.isNotNull())
    return d.select(*nodes.columns, "run", steps.alias("steps"), F.col(f"h{LEVELS}").alias("top"))


def run_roots(nodes: DataFrame) -> DataFrame:
    """The next round's rows: a node for each run."""
    tops = with_steps(nodes).where(F.col("pos") % WIDTH == 0)
    return tops.select("tree", F.col("run").alias("pos"), F.expr(f"(nodes + {WIDTH - 1}) div {WIDTH}").alias("nodes"), F.col("top").alias("hash"))


def rounds_up(nodes: DataFrame) -> list[DataFrame]:
    """The rows of all rounds, the given ones first; in the last each tree is one node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("nodes")).first()[0] or 0) > 1:
        rounds.append(materialize(run_roots(rounds[-1]), "nodes"))
    return rounds


def with_paths(rounds: list[DataFrame], top: DataFrame | None = None) -> DataFrame:
    """The first round's rows with ``path``, the siblings on the way up, ``subroot``, their tree's root, and ``root``.

    ``top`` (tree, higher, root) goes on from the subroots; without it they are the roots.  Later rounds
    are a 256th of the one before, so their paths are written; the first one's aren't.
    """
    up = rounds[-1].withColumn("subroot", F.col("hash"))
    if top is None:
        up = up.withColumns({"path": F.array().cast(f"array<{STEP}>"), "root": F.col("hash")})
    else:
        up = up.join(top.withColumnRenamed("higher", "path"), "tree")
    for k in range(len(rounds) - 2, -1, -1):
        higher = up.select("tree", F.col("pos").alias("run"), F.col("path").alias("higher"), "subroot", "root")
        own = with_steps(rounds[k]).drop("top").join(higher, ["tree", "run"])
        up = own.select(*rounds[k].columns, F.concat("steps", "higher").alias("path"), "subroot", "root")
        up = materialize(up, "paths") if k else up
    return up


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path make."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def proof_text(path: Column) -> Column:
    """The siblings level by level, left to right, in a row."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.array_compact(F.array(s["left"], s["right"])))), "")


def merkle_manifest(docs: DataFrame, columns: list[str], by: str = "lang", extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, ``path`` (the siblings from leaf to root) and the columns ``extra`` of every row.

    Leaves are rows of ``columns``; within equal ``by`` they ascend by doc_id (null last), repeated doc_ids by
    leaf.  Rows alike in all columns are leaves of their own and may stand in for each other.  Groups are
    ordered by the bytes of ``by``, null first.  A null and an empty ``by`` are different groups.  Text
    lengths don't matter beyond the hash; columns that aren't named, whatever they are called, don't
    count.  An empty table has no rows and no root.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    extra = extra or {}
    leaves = docs.select(F.col("doc_id"), tree.alias("tree"), leaf([F.col(c) for c in columns]).alias("hash"), *(c.alias(k) for k, c in extra.items()))
    order = [F.col("tree"), F.col("doc_id").asc_nulls_last(), F.col("hash")]
    placed = ranked(leaves, order, "leaves", within="tree").withColumnsRenamed({"rank": "pos", "total": "nodes"})
    rounds = rounds_up(placed)
    roots = rounds[-1].select("tree", "hash")
    forest = ranked(roots, [F.col("tree")], "subroots")
    groups = forest.select(F.lit("").alias("tree"), F.col("rank").alias("pos"), F.col("total").alias("nodes"), "hash", F.col("tree").alias("group"))
    top = with_paths(rounds_up(groups)).select(F.col("group").alias("tree"), F.col("path").alias("higher"), "root")
    own = with_paths(rounds, materialize(top, "groups"))
    return own.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path", *extra)
