"""Sharding by a histogram sort.

Each row has a pseudo-random sort key.  Rounds of exact byte counts below candidate boundaries refine
the probes around each wanted cut until every splitter meets the tolerance or sits between two
neighbouring keys; then the rows are exchanged once, straight to their place.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.storage import materialize
from lectern.llm.text import body, unwrapped, wrapped

KEY_BITS = 60
#: Bits by which a round of probes refines the last one: at most 2**16 counts, then 2**12 a cut.
ROUNDS = (16, 12, 12, 10, 10)
#: Bytes that one task sorts.
RUN_BYTES = 128 << 20


def sort_key(salt: str = "") -> Column:
    """60 bits of an MD5 over doc_id and text: spread evenly, the same on every run."""
    name = F.concat_ws("\x1f", F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), body())
    return F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long")


def document_size() -> Column:
    return (F.octet_length(body()) + 8).cast("long")


class Cut(NamedTuple):
    """Rows with a key below ``key`` lie before the cut; where several rows share the key ``shared``, they have ``at`` bytes from ``low`` on."""

    key: int
    shared: int
    low: int
    at: int


def find_splitters(rows: DataFrame, key: str, targets: list[float], offset: int = 0, bits: int = KEY_BITS, tolerance: float = 0) -> list[Cut]:
    """For each target the boundary between keys below which the bytes are nearest to it.

    ``rows`` has ``key`` (below 2**bits) and ``size``; ``offset`` is added to all counts.  Each round
    counts exact bytes of all rows of the ranges that still hold an open target.
    """
    answer: dict[int, Cut] = {}
    active: dict[int, int] = {0: offset}  # prefix of a range -> bytes below it
    wanted, done, steps = dict(enumerate(targets)), 0, [*ROUNDS, 12]
    while wanted:
        step = min(steps.pop(0), bits - done)
        done += step
        outer, inner = (F.shiftright(F.col(key), bits - d) for d in (done - step, done))
        part = rows if done == step else rows.where(outer.isin(sorted(active)))
        ranges, below = [], dict(active)
        for c in sorted(part.groupBy(inner.alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()):
            ranges.append((c["bin"], below[c["bin"] >> step], c["size"], c["n"]))
            below[c["bin"] >> step] += c["size"]
        starts, active, still = [r[1] for r in ranges], {}, {}
        for j, target in wanted.items():
            name, low, size, n = ranges[max(0, bisect_left(starts, target) - 1)]
            up = target - low > low + size - target
            if done == bits or abs(target - low - size * up) <= tolerance:
                answer[j] = Cut((name + up) << (bits - done), name, low, size if done == bits and n > 1 else 0)
            else:
                still[j], active[name] = target, low
        wanted = still
    return [answer[j] for j in range(len(targets))]


def _shard_of(key: Column, splitters: list[int], low: int = 0) -> Column:
    """A balanced tree of comparisons: how many splitters are at or below the key."""
    if not splitters:
        return F.lit(low)
    mid = len(splitters) // 2
    return F.when(key < splitters[mid], _shard_of(key, splitters[:mid], low)).otherwise(_shard_of(key, splitters[mid + 1 :], low + mid + 1))


def histogram_shards(docs: DataFrame, num_shards: int = 24, tolerance: float = 0, salt: str = "") -> DataFrame:
    """``docs`` with the column ``__shard`` = struct(law, shard, slot, size): near equal bytes in each shard.

    A cut lies where the bytes below it are nearest to its share (the lower one on a tie), or within
    ``tolerance`` bytes of it.  A null text has 8 bytes.  Rows alike in doc_id and text share a key;
    where a cut falls among rows of such a key and they hold more than a hundredth of a shard, they are
    cut by a second, arbitrary key.  Slots count from 0 in each shard without a gap.  All columns stay,
    whatever their names, but for one named ``__shard``, which gives way; an empty table gives no rows,
    fewer rows than shards leave shards empty.
    """
    spark = docs.sparkSession
    kept = wrapped(docs).select("row", sort_key(salt).alias("key"), document_size().alias("size"))
    # Written once: the second key must be the same in every round.
    rows = materialize(kept.withColumn("tie", F.monotonically_increasing_id()), "sharding", compression="zstd")
    slim = rows.select("key", "tie", "size")
    total = slim.agg(F.sum("size")).first()[0] or 0
    targets = [total * j / num_shards for j in range(1, num_shards) if total]
    cuts = find_splitters(slim, "key", targets, tolerance=tolerance) if targets else []
    shard = _shard_of(F.col("key"), [c.key for c in cuts])
    # A key that many rows share can't be cut by the key alone.
    for key, low, at in sorted({(c.shared, c.low, c.at) for c, t in zip(cuts, targets, strict=True) if c.at > total / num_shards / 100 and c.low < t < c.low + c.at}):
        shared = slim.where(F.col("key") == key)
        ties = find_splitters(shared, "tie", [t for t in targets if low < t < low + at], offset=low, bits=63)
        shard = F.when(F.col("key") == key, _shard_of(F.col("tie"), [t.key for t in ties], sum(t <= low for t in targets))).otherwise(shard)

    runs = max(1, -(-total // (num_shards * RUN_BYTES)))
    run = (shard * runs + F.pmod(F.xxhash64("key", "tie"), F.lit(runs))).cast("int")
    per_run = slim.groupBy(run.alias("run")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.expr(f"run div {runs}")).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = per_run.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.withColumn("run", run).repartitionById(num_shards * runs, F.col("run"))
    slot = F.row_number().over(Window.partitionBy("run").orderBy("key", "tie")) - 1
    if runs > 1:
        placed = placed.join(base, "run")
        slot = slot + F.col("base")
    law = F.struct(F.lit("bytes").alias("law"), F.expr(f"cast(run div {runs} as int)").alias("shard"), slot.cast("long").alias("slot"), F.col("size").alias("size"))
    return unwrapped(placed.withColumn("__shard", law), docs.columns, "__shard")
