"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a key's hash. A bucket over the byte limit splits on one more bit, the
others stay as they are, so shards differ in depth. A bucket of depth d is a shard when it fits and the bucket it was
split from did not; as bytes only fall with depth, that needs no loop over splits: the bytes of all prefixes come from
one aggregation over the cells of the directory, and the smallest depth that fits is the shard's.

Passes work on a thin table (hash, bytes): the texts are read once. The directory has a row for each cell in use; Spark
broadcasts it only when its size allows, else it is joined by shuffle. Cells that don't fit at the directory's depth
are taken up again with further bits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, doc_id, documents, hash60

BITS = 60


def shards(docs: DataFrame, max_bytes: int = 64 << 20, step: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, oversized): ``shard`` is the hash prefix of ``depth`` bits as a string.

    Rows of one doc_id share a shard. A null doc_id hashes as ''. A null text has 0 bytes. Keys whose first 60 bits are
    all the same can't be split: their shard is marked ``oversized``. An empty table gives no rows; a table within the
    limit is the one shard ''. Further columns are not read. ``step``: bits that a round of the directory adds, by
    default enough for the whole input.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    d = documents(docs)
    sized = cut(d.select("_d", hash60(F.lit("shard"), F.when(F.col("_d") != -(2**63), F.col("_d"))).alias("_h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")))
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    step = step or min(24, max(4, math.ceil(math.log2(max(1, total / max_bytes))) + 4))
    out, todo, low = sized.withColumn("_depth", F.lit(None).cast("int")), sized, 0
    while True:
        high = min(BITS, low + step)
        cell = F.shiftright("_h", BITS - high)
        cells = todo.groupBy(cell.alias("_c")).agg(F.sum("n_bytes").alias("_n"))
        nodes = cells.select("_c", "_n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_l"))
        nodes = nodes.withColumn("_p", F.expr(f"shiftright(_c, {high} - _l)"))
        # Buckets over the limit are few, one in ``max_bytes`` of each depth; a cell's shard lies one bit below its last.
        over = nodes.groupBy("_l", "_p").agg(F.sum("_n").alias("_t")).filter(F.col("_t") > max_bytes).select("_l", "_p")
        last = nodes.join(over, ["_l", "_p"]).groupBy("_c").agg(F.max("_l").alias("_last"))
        depth = F.coalesce(F.col("_last") + 1, F.lit(low))
        found = cut(cells.join(last, "_c", "left").select("_c", F.when(depth <= high, depth).alias("_m")))
        out = out.withColumn("_c", cell).join(found, "_c", "left").withColumn("_depth", F.coalesce("_depth", "_m")).drop("_c", "_m")
        rest = found.filter(F.col("_m").isNull())
        if high == BITS or rest.isEmpty():
            break
        todo, low = todo.withColumn("_c", cell).join(rest, "_c", "left_semi").drop("_c"), high
    depth = F.coalesce("_depth", F.lit(BITS))
    return out.select(doc_id(), "n_bytes", F.substring(F.lpad(F.bin("_h"), BITS, "0"), F.lit(1), depth).alias("shard"), depth.alias("depth"), F.col("_depth").isNull().alias("oversized"))


SQL = """
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, coalesce(strlen(text), 0) AS n
  FROM documents),
b AS (SELECT substr(lpad(bin(h), 60, '0'), 1, l) AS p, l, sum(n) AS t FROM d, range(0, 25) r(l) GROUP BY ALL),
m AS (SELECT h, min(l) AS depth FROM (SELECT DISTINCT h FROM d) x JOIN b ON b.p = substr(lpad(bin(h), 60, '0'), 1, l) WHERE t <= 67108864 GROUP BY h)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard, CAST(depth AS INTEGER) AS depth, false AS oversized
FROM d JOIN m USING (h)
"""
