"""Mixing sources to target weights by Sainte-Lague apportionment, in native expressions only.

1. Targets. The sources share the corpus total by weight; a source's target stops at ``max_epochs`` times
   its size and the excess is shared again by weight. Sorted by (limit / weight) the fixed point has a
   closed form: the first source that stays below its limit fixes the common rate.
2. Quotas. The total is cut into blocks of ``block_words`` words. Blocks go to the sources with the highest
   quotients target / (k - 1/2), for the first shard, the first two shards and so on; the method is
   monotone in the number of blocks, so differences are the integer quotas of each shard. Two divisors
   that bracket the answer leave at most two undecided blocks a source, which are ranked exactly.
3. Selection. Each source's documents are put in a seeded order (hash buckets, then the hash within a
   bucket) and its words are numbered through; block b is words [b * block, (b + 1) * block). A seeded
   starting block and the following ones, cyclically, fill the quota; a quota beyond the number of
   blocks takes whole passes over the source first.

Rows that are equal in every column are counted first and take one place in the order, one copy after the other, so
that neither a bucket nor a result depends on how many there are or where they come from; each copy has pieces of its own.

Defined results: a null source is a source of its own, ordered last; null or empty texts have size 0 and are
taken 0 times; ties in key are ordered by text, then by the other columns; an empty input gives an empty
output; an input column with the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldlink.plans.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the blanks before it; the last one also with those behind it. Joined, they give the text again.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\z)?"
OUTPUTS = ("size", "source_size", "target", "pieces", "taken")


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """source, source_size, n_docs, place, target: one row for each source."""
    copies = F.col("copies") if "copies" in sized.columns else F.lit(1)
    stats = sized.groupBy("source").agg(F.sum(F.col("size") * copies).cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    every = W.orderBy(F.col("source").asc_nulls_last())
    ranked = stats.withColumn("place", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("most", (F.col("source_size") * max_epochs).cast("double"))
    rising = W.orderBy(F.col("most") / F.col("weight"), "place")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rate = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("rate", rate).withColumn("order", F.row_number().over(rising))
    stays = F.when(F.col("most") >= F.col("weight") * F.col("rate"), F.col("order"))
    ranked = ranked.withColumn("common", F.min_by("rate", stays).over(everything))
    return ranked.select("source", "source_size", "n_docs", "place", F.least("most", F.col("weight") * F.col("common")).alias("target"))


def apportion(targets: DataFrame, total_blocks: Column, n_shards: int) -> DataFrame:
    """place, shard, upto: blocks of each source in the shards up to this one (Sainte-Lague)."""
    every = W.partitionBy("shard")
    rows = targets.select("place", "target", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    rows = rows.withColumn("seats", F.floor(total_blocks * (F.col("shard") + 1) / n_shards))
    rows = rows.withColumn("slack", F.count(F.lit(1)).over(every) / 2 + 1).withColumn("whole", F.sum("target").over(every))
    awards = lambda seats: F.greatest(F.floor(F.col("target") * seats / F.col("whole") + 0.5), F.lit(0))
    rows = rows.withColumn("sure", F.when(F.col("whole") > 0, awards(F.col("seats") - F.col("slack"))).otherwise(F.lit(0)))
    rows = rows.withColumn("open", F.when(F.col("whole") > 0, awards(F.col("seats") + F.col("slack"))).otherwise(F.lit(0)))
    rows = rows.withColumn("left", F.col("seats") - F.sum("sure").over(every))
    tried = rows.where("open > sure").select("place", "shard", "target", "left", F.explode(F.sequence(F.col("sure") + 1, F.col("open"))).alias("k"))
    best = W.partitionBy("shard").orderBy((F.col("target") / (F.col("k") - 0.5)).desc(), "place", "k")
    won = tried.withColumn("r", F.row_number().over(best)).where("r <= left").groupBy("place", "shard").agg(F.count(F.lit(1)).alias("more"))
    return rows.join(won, ["place", "shard"], "left").select("place", "shard", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("upto"))


def mix(
    documents: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    n_shards: int = 8,
    block_words: int = 16,
    max_epochs: int = 3,
    seed: int = 20240606,
    bucket_rows: int = 2048,
    text: str = "text",
) -> DataFrame:
    """doc_id, source, size, source_size, target, pieces, taken for each row of ``documents``.

    ``pieces`` are structs of shard, epoch, from_word and to_word (words of the document, end excluded) that
    the mix takes; ``taken`` is their total length.
    """
    placed = _place(documents.withColumn("__row", F.lit(0).cast("long")), weights, n_shards, block_words, max_epochs, seed, bucket_rows, text)
    return placed.select("doc_id", "source", "size", "source_size", "target", "pieces", "taken")


def _place(documents: DataFrame, weights: Sequence[float], n_shards: int, block_words: int, max_epochs: int, seed: int, bucket_rows: int, text: str) -> DataFrame:
    """What :func:`mix` returns, and the ``row`` of an equal row of ``documents`` (the smallest ``__row``)."""
    others = [F.col(f"`{c}`") for c in sorted(documents.columns) if c not in ("doc_id", "source", text, "__row")]
    rest = F.xxhash64(*others) if others else F.lit(0).cast("long")
    bare = documents.select("doc_id", "source", n_words(text).alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("h"), F.xxhash64(text).alias("of_text"), rest.alias("of_rest"), F.col("__row").alias("row"))
    sized = materialize(bare.groupBy("doc_id", "source", "size", "h", "of_text", "of_rest").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row")), "mix-sizes")
    targets = materialize(source_targets(sized, weights, max_epochs), "mix-targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    block = F.lit(block_words).cast("long")
    quotas = apportion(targets, F.lit(round(total / block_words)), n_shards)

    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    limit = F.least("upto", blocks * max_epochs)
    steps = quotas.join(targets, "place").withColumn("blocks", blocks).withColumn("upto", limit)
    steps = steps.withColumn("after", F.coalesce(F.lag("upto").over(W.partitionBy("place").orderBy("shard")), F.lit(0)))
    steps = steps.withColumn("first", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "source"), F.greatest(F.col("blocks"), F.lit(1)))))
    steps = steps.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    lo = F.col("first") + F.greatest(F.col("after") - F.col("epoch") * F.col("blocks"), F.lit(0))
    hi = F.col("first") + F.least(F.col("upto") - F.col("epoch") * F.col("blocks"), F.col("blocks"))
    straight = F.struct(lo.alias("lo"), F.least(hi, F.col("blocks")).alias("hi"))
    wrapped = F.struct((F.greatest(lo, F.col("blocks")) - F.col("blocks")).alias("lo"), (hi - F.col("blocks")).alias("hi"))
    spans = steps.select("place", "shard", "epoch", "source_size", F.explode(F.array(straight, wrapped)).alias("b")).where("b.lo < b.hi and b.lo >= 0")
    spans = spans.select("place", F.struct((F.col("b.lo") * block).alias("lo"), F.least(F.col("b.hi") * block, F.col("source_size")).alias("hi"), "shard", "epoch").alias("span"))
    chosen = targets.join(spans.groupBy("place").agg(F.array_sort(F.collect_list("span")).alias("spans")), "place", "left")
    chosen = materialize(chosen.withColumn("buckets", F.ceil(F.col("n_docs") / bucket_rows).cast("long")), "mix-spans")

    near = chosen.select(F.col("source").alias("s"), "place", "buckets")
    rows = sized.join(near, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.pmod(F.col("h"), F.col("buckets")))
    # running sums in two steps, so that no task takes all buckets of a source
    sums = rows.groupBy("place", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("in_bucket")).withColumn("part", F.floor(F.col("bucket") / 4096))
    sums = materialize(sums, "mix-buckets")
    parts = sums.groupBy("place", "part").agg(F.sum("in_bucket").alias("in_part"))
    parts = parts.select("place", "part", (F.sum("in_part").over(W.partitionBy("place").orderBy("part")) - F.col("in_part")).alias("base"))
    inner = F.sum("in_bucket").over(W.partitionBy("place", "part").orderBy("bucket")) - F.col("in_bucket")
    starts = sums.withColumn("inner", inner).join(parts, ["place", "part"])
    starts = materialize(starts.select("place", "bucket", (F.col("base") + F.col("inner")).alias("start")), "mix-starts")
    along = W.partitionBy("place", "bucket").orderBy("h", "doc_id", "size", "of_text", "of_rest").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("size") * F.col("copies")).over(along)).join(starts, ["place", "bucket"])
    placed = placed.withColumn("first", F.col("start") + F.col("end") - F.col("size") * F.col("copies"))
    # copies of a row one by one: runs of 1,000 first, so that many copies spread over tasks
    spread = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(1000).cast("long"))))
    many = spread.where("copies > 1000").repartition("place", "bucket", "h", "run")
    single = spread.where("copies <= 1000").unionByName(many)
    single = single.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + 999, F.col("copies") - 1))))
    single = single.withColumn("begin", F.col("first") + F.col("copy") * F.col("size")).withColumn("end", F.col("begin") + F.col("size"))
    wide = single.join(chosen.select("place", "source_size", "target", "spans"), "place")
    hit = F.filter("spans", lambda s: (s["lo"] < F.col("end")) & (s["hi"] > F.col("begin")))
    piece = lambda s: F.struct(s["shard"].alias("shard"), s["epoch"].alias("epoch"), (F.greatest(s["lo"], F.col("begin")) - F.col("begin")).alias("from_word"), (F.least(s["hi"], F.col("end")) - F.col("begin")).alias("to_word"))
    pieces = F.when((F.col("size") > 0) & F.col("spans").isNotNull(), F.transform(hit, piece)).otherwise(F.array().cast("array<struct<shard:int,epoch:int,from_word:bigint,to_word:bigint>>"))
    out = wide.select("doc_id", "source", "size", "source_size", "target", pieces.alias("pieces"), "row")
    return out.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["to_word"] - p["from_word"]))


def mixed_rows(
    documents: DataFrame, weights: Sequence[float] = (5, 2, 1), n_shards: int = 8, block_words: int = 16, max_epochs: int = 3, seed: int = 20240606, bucket_rows: int = 2048
) -> DataFrame:
    """The mix itself: a row of ``documents`` for each piece, with the piece's text and ``n_chars``, if there is such a column.

    A piece that is the whole document keeps its text as it is. Of a part, each word keeps the blanks before it, and
    the last word those behind it: the pieces of one pass over a document, joined, give its text.
    """
    # rows are numbered in a table, as numbers given on the fly may change when a task runs again
    numbered = materialize(documents.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    chosen = _place(numbered, weights, n_shards, block_words, max_epochs, seed, bucket_rows, "text")
    chosen = chosen.where(F.size("pieces") > 0).select(F.col("row").alias("__row"), F.col("size").alias("__size"), F.explode("pieces").alias("__piece"))
    joined = numbered.join(chosen, "__row")
    words = F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0))
    part = F.array_join(F.slice(words, (F.col("__piece.from_word") + 1).cast("int"), (F.col("__piece.to_word") - F.col("__piece.from_word")).cast("int")), "")
    whole = (F.col("__piece.from_word") == 0) & (F.col("__piece.to_word") == F.col("__size"))
    out = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])


def op6_mixing(documents: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")
