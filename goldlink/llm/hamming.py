"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments of at most about log2(rows) bits, so that a value of a segment is held by few codes at any scale; of
these widths the one with the least work in probes and codes met together is taken (:func:`cheapest_segment`). If two codes differ in at most m * (r + 1) - 1 bits, m segments
of them cannot all differ in more than r bits, so probing every value within r bits of the query's segment, in each segment's
table, finds every such code. Rounds grow r by one: a query probes only the values at exactly r bits, verifies the
full distance of what it meets, keeps its k best, and is finished once its k-th verified distance is covered,
that is at most m * (r + 1) - 1. Nothing else ends a query, so results are exact. In a round only as many segments
are probed as its k-th distance so far needs: segments 0 to a at r and the rest at r - 1 cover m * r + a.

Equal codes form one entry with the k smallest ids of its rows, so a code that a third of all rows share is one
row of a table; ties of distance go to the smaller id.

The code of a vector has a bit for each component of the longest vector; components that a shorter one lacks are 0.

Defined results: a null, empty or non-finite vector has no code and is neither found nor a query; a query row finds
itself (and copies of it) like any other row; with fewer than k coded rows all are returned; repeated rows are rows of
their own; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldlink.plans.scratch import materialize

#: Narrowest and widest segment.
LEAST, MOST = 8, 24
#: Probes that are few enough to be broadcast, by their counted number (about 50 bytes each).
FEW_PROBES = 200_000
#: A probe is exploded, shuffled and sorted; a code that it meets is compared in place. What a probe costs in such codes.
PROBE_COST = 8


def segment_bits(rows: int, bits: int) -> int:
    """Width of the segments for so many rows: near log2(rows), evened out over the segments."""
    width = min(MOST, max(LEAST, round(math.log2(max(2, rows)))))
    return math.ceil(bits / max(1, round(bits / width)))


def expected_distance(rows: int, bits: int, k: int) -> int:
    """The smallest distance within which k of so many random codes are expected."""
    far, ring = 0, 1
    within = ring
    while far < bits and within * rows < k << bits:
        ring = ring * (bits - far) // (far + 1)
        far, within = far + 1, within + ring
    return far


def expected_work(rows: int, bits: int, segment: int, far: int) -> tuple[float, float]:
    """Probes of one query whose k-th is ``far`` away, and random codes that they meet: all rounds below it, then what it needs."""
    m = math.ceil(bits / segment)
    rest = bits - (m - 1) * segment  # the last one may be narrow, and a value of it is held by many codes
    radius, last = min(far // m, segment), far % m
    probes = met = 0.0
    for i in range(m):
        width, upto = (rest if i == m - 1 else segment), (radius if i <= last else radius - 1)
        probes += sum(math.comb(segment, r) for r in range(upto + 1))
        met += sum(math.comb(width, r) for r in range(upto + 1)) * rows / 2**width
    return probes, met


def cheapest_segment(rows: int, bits: int, k: int) -> int:
    """The width with the least expected work among those up to :func:`segment_bits`; of equals the widest."""
    widest = segment_bits(rows, bits)
    widths = sorted({math.ceil(bits / m) for m in range(math.ceil(bits / widest), bits + 1) if bits / m >= LEAST} | {widest}, reverse=True)
    far = expected_distance(rows, bits, k)
    work = {w: expected_work(rows, bits, w, far) for w in widths}
    return min(widths, key=lambda w: PROBE_COST * work[w][0] + work[w][1])


def sign_code(vector: str, bits: int, segment: int = 16) -> Column:
    """The signs of the first ``bits`` components (missing ones: 0) as array<int> of segments."""
    parts = []
    for low in range(0, bits, segment):
        total = F.lit(0)
        for i in range(min(segment, bits - low)):
            total = total + F.when(F.coalesce(F.get(vector, F.lit(low + i)), F.lit(0.0)) > 0, F.lit(1 << i)).otherwise(F.lit(0))
        parts.append(total)
    return F.when(usable(vector), F.array(*parts))


def usable(vector: str) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _distance(a: str, b: str, m: int) -> Column:
    total = F.lit(0)
    for i in range(m):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))).cast("int")
    return total


def masks(weight: int, segment: int = 16) -> list[int]:
    """All values of a segment with so many bits set."""
    return [sum(1 << i for i in c) for c in itertools.combinations(range(segment), weight)]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "id", code: str = "code", segment: int = 16) -> DataFrame:
    """query_id, rank, id, distance: the k nearest rows of ``codes`` for every row of ``queries``.

    Both have an id and an array<int> of segments of ``segment`` bits. Query ids should be distinct; rows with a null code are left out.
    """
    spark = codes.sparkSession
    m = codes.where(F.col(code).isNotNull()).select(F.size(code)).first()
    m = m[0] if m else 1
    known = codes.where(F.col(code).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(code).alias("code"))
    # two-level: k smallest of each slice first, so that no task gathers all rows of one code
    sliced = W.partitionBy("code", "slice").orderBy(F.col("id").asc_nulls_last())
    whole = W.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    first = known.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(1024))).withColumn("r", F.row_number().over(sliced)).where(F.col("r") <= k)
    best = first.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k)
    entries = materialize(best.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.sum(F.when(F.col("id").isNull(), 1).otherwise(0)).alias("nameless")), "mih-entries")
    table = materialize(entries.select("code", F.posexplode("code").alias("segment", "value")), "mih-table")
    rows_total = best.count()

    asked = materialize(queries.where(F.col(code).isNotNull()).select(F.col(id_column).cast("long").alias("query_id"), F.col(code).alias("q")), "mih-queries")
    n_asked = asked.count()
    open_queries, found, done = asked.withColumn("kth", F.lit(None).cast("int")), None, None
    for radius in range(segment + 1):
        if open_queries.isEmpty():
            break
        probes = open_queries.select("query_id", "q", "kth", F.posexplode("q").alias("segment", "own"))
        # a code missed with segments 0 to a at this radius, the others one below, is farther than m * radius + a: enough segments to cover the k-th
        probes = probes.where(F.col("kth").isNull() | (F.col("segment") <= F.col("kth") - m * radius))
        probes = probes.select("query_id", "q", "kth", "segment", F.explode(F.split(F.lit(",".join(map(str, masks(radius, segment)))), ",").cast("array<int>")).alias("flip"), "own")
        probes = probes.select("query_id", "q", "kth", "segment", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
        # no estimate before the explode can tell how many probes there are: few are broadcast, by number; many are merged
        few = n_asked * m * math.comb(segment, radius) <= FEW_PROBES
        met = (F.broadcast(probes) if few else probes.hint("merge")).join(table if few else table.hint("merge"), ["segment", "value"]).withColumn("distance", _distance("q", "code", m))
        # beyond the k-th distance so far nothing can be in the answer
        fresh = met.where(F.col("kth").isNull() | (F.col("distance") <= F.col("kth"))).select("query_id", "code", "distance")
        kept = materialize((fresh if found is None else fresh.unionByName(found)).distinct(), "mih-found")
        sized = kept.join(entries.select("code", (F.size("ids") + F.col("nameless")).alias("rows")), "code")
        upto = F.sum("rows").over(W.partitionBy("query_id").orderBy("distance").rangeBetween(W.unboundedPreceding, W.currentRow))
        reach = sized.withColumn("upto", upto).where(F.col("upto") >= min(k, rows_total)).groupBy("query_id").agg(F.min("distance").alias("best"))
        covered = m * (radius + 1) - 1
        state = open_queries.select("query_id", "q").join(reach, "query_id", "left").withColumnRenamed("best", "kth")
        state = materialize(state, "mih-state")
        ends = F.col("kth") <= covered if radius < segment else F.lit(True)
        ended = state.where(ends).select("query_id", F.coalesce("kth", F.lit(m * segment)).alias("kth"))
        result = kept.join(ended, "query_id").where("distance <= kth").select("query_id", "code", "distance")
        done = result if done is None else done.unionByName(result)
        open_queries = state.where(~F.coalesce(ends, F.lit(False)))
        going = open_queries.select("query_id", "kth")
        found = kept.join(going, "query_id").where(F.col("kth").isNull() | (F.col("distance") <= F.col("kth"))).select("query_id", "code", "distance")
    if done is None:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, distance int")
    each = done.join(entries.select("code", "ids", "nameless"), "code").select("query_id", "distance", F.explode(F.concat("ids", F.array_repeat(F.lit(None).cast("long"), F.col("nameless").cast("int")))).alias("id"))
    ranked = W.partitionBy("query_id").orderBy("distance", F.col("id").asc_nulls_last())
    return each.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def op10_hamming_top_k(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 100, over all vectors."""
    bits, rows = embeddings.where(usable("embedding")).agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    segment = cheapest_segment(rows, bits or 1, k)
    coded = materialize(embeddings.select(F.col("vec_id").alias("id"), sign_code("embedding", bits or 1, segment).alias("code")), "mih-codes")
    return top_k(coded, coded.where(F.col("id") % 100 == 0), k, segment=segment).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP10_SQL = """
WITH c AS (SELECT vec_id, list_transform(range((SELECT max(len(embedding)) FROM embeddings)), lambda i: CASE WHEN embedding[CAST(i + 1 AS INT)] > 0 THEN 1 ELSE 0 END) AS code
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.code, c.code), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INT) AS distance
  FROM c AS q CROSS JOIN c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
