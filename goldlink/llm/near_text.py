"""MinHash near-duplicate detection by chosen-path set similarity join.

1. Each text becomes its set of word shingles, as 128-bit digests. Documents with equal sets form a class, by map-side
   combined aggregation; only classes are compared, so thousands of copies cost one comparison each.
2. Each class gets a sketch of ``positions`` minwise tokens. In each of ``trees`` independent trees a class
   starts at the root and goes, at every node, into the branch of each of its tokens that a hash of
   (node, token) selects with probability 1 / (rate * positions). Two sets of similarity s share s / rate
   branches on average at each level, so with rate below the threshold the tree keeps a similar pair with
   constant probability, and the trees together miss it with a probability that falls exponentially.
3. Nodes of at most ``small`` members are compared exhaustively on sketches, one node at a time from a sorted stream.
   Larger nodes are never gathered: a bounded sample of each tells whether many of its pairs look similar. If
   so, its members face the one that agrees best with the sample's consensus; if not, each member branches on.
4. Verification is of pairs, on whole texts. First every class meets the one partner that promises most (in a group of
   near copies usually the text they derive from): one comparison a member. What is confirmed is connected;
   every other pair that met in a node with like sketches and is not connected yet is then compared too, so no
   link is lost. The pairs of one text are dealt out in groups of ``block`` and stream past it. Where pairs are too many to
   list (dense nodes, and small ones with more than ``LISTED`` open pairs a member), blocks of the members that are not
   connected to the rest meet slices of all members.

Nothing is capped: every class stays in every node that its tokens select. Recall at exact similarity 0.8 is
1 - 0.3748**trees for two levels at rate 0.6 (0.99999 for 12 trees), and rises with similarity; in nodes that
branch on, down to ``most_depth``, a tree keeps a pair at 0.8 with probability 0.47 at least (12 trees: 0.9995).

Defined results: a null or blank text has an empty set, links with nothing and is its own component; texts of any
length are used whole; repeated rows are documents like any others; a null id takes part, and a
component's id is its smallest non-null id; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldlink.llm.common import U64, mix64, ranges, release, runs, shared_shingles, shingle_sets
from goldlink.operators.components import connected_components
from goldlink.operators.components import smallest_in_component as components
from goldlink.plans.scratch import discard, materialize

POSITIONS = 64
#: Members of a large node whose sketches tell whether it is dense.
SAMPLE = 64
#: Open pairs for each member of a small node up to which pairs are listed; beyond, blocks of members are compared.
LISTED = 2


def _salts() -> np.ndarray:
    return mix64(np.arange(1, POSITIONS + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def sketch_of(shingles: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """16-bit minwise tokens, one for each position."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            np.minimum(low, (mix64(shingles[i : i + 1024])[:, None] * salts ^ (salts >> U64(7))).min(axis=0), out=low)
    return (mix64(low) & U64(0xFFFF)).astype(np.uint16)


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums that identify a set, one for each half of the digests."""
    with np.errstate(over="ignore"):
        a, b = mix64(shingles).sum(axis=1, dtype=U64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sets(documents: DataFrame, shingle_words: int) -> DataFrame:
    """``documents`` (id, text, rest) with set keys, set size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _salts()
        for batch in batches:
            k1, k2, n, sketches = [], [], [], []
            for shingles in shingle_sets((t.as_py() for t in batch.column("text")), shingle_words):
                a, b = set_keys(shingles)
                k1.append(a)
                k2.append(b)
                n.append(shingles.shape[1])
                sketches.append(sketch_of(shingles[0], salts).tobytes() if shingles.shape[1] else b"")
            made = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "k1", "k2", "n", "sketch"])
        release()

    made = [T.StructField(c, T.LongType()) for c in ("k1", "k2", "n")] + [T.StructField("sketch", T.BinaryType())]
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, *made]))


def _tokens(sketch: np.ndarray) -> np.ndarray:
    return mix64(sketch.astype(U64) + np.arange(POSITIONS, dtype=U64) * U64(0x10001))


def _branch(paths: np.ndarray, tokens: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Child paths of rows (path, tokens), and the row of each."""
    h = mix64(paths[:, None] ^ tokens)
    row, at = np.nonzero(h < U64(int(2**64 / (rate * POSITIONS))))
    return mix64(h[row, at]), row


def _grow(classes: DataFrame, trees: int, depth: int, rate: float) -> DataFrame:
    """path, cid: the nodes of each class at the starting depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix64(np.arange(trees, dtype=U64) + U64(0xC0FFEE))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, POSITIONS)
                tokens = _tokens(sketch)
                doc = np.repeat(np.arange(len(sketch)), trees)
                paths = np.tile(roots, len(sketch))
                for _ in range(depth):
                    paths, row = _branch(paths, tokens[doc], rate)
                    doc = doc[row]
                yield pa.RecordBatch.from_arrays([pa.array(paths.astype(np.int64)), part.column("cid").take(pa.array(doc))], names=["path", "cid"])

    return classes.mapInArrow(run, "path bigint, cid bigint")


def _shared(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` whose path has another row; nodes are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, if it is the first of its path
        before = None  # its path
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column("path").to_numpy()
            same = np.zeros(len(paths) + 1, dtype=bool)
            same[0] = before is not None and before == paths[0]
            same[1:-1] = paths[1:] == paths[:-1]
            if same[0] and held is not None:
                yield held
            keep = same[:-1] | same[1:]
            yield batch.filter(pa.array(keep))
            held = None if keep[-1] else batch.slice(len(paths) - 1)
            before = paths[-1]

    return nodes.repartition("path").sortWithinPartitions("path").mapInArrow(run, nodes.schema)


class _Node:
    """Members of nodes: paths, ids, set sizes and 8-bit sketches."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        self.path = table.column("path").to_numpy()
        self.cid = table.column("cid").to_numpy()
        self.n = table.column("n").to_numpy()
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS)


def _similar(s: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, ratio: float) -> np.ndarray:
    """Agreeing positions of the pairs a-b; 0 where these are too few or set sizes rule the threshold out."""
    fits = np.flatnonzero(np.minimum(n[a], n[b]) >= ratio * np.maximum(n[a], n[b]))
    out = np.zeros(len(a), dtype=np.int32)
    for i in range(0, len(fits), 65536):
        part = fits[i : i + 65536]
        out[part] = (s[a[part]] == s[b[part]]).sum(axis=1)
    return np.where(out >= least, out, 0)


def _all_pairs(node: _Node, cuts: np.ndarray, least: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similar pairs within each run of rows, all runs at once, by distance between rows; and how many positions agree."""
    sizes = np.diff(cuts)
    end = np.repeat(cuts[1:], sizes)
    found = [np.zeros((3, 0), dtype=np.int64)]
    rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
    step = 1
    while len(rows := rows[rows + step < end[rows]]):
        agree = _similar(node.sketch, node.n, rows, rows + step, least, ratio)
        ok = agree > 0
        found.append(np.stack([rows[ok], rows[ok] + step, agree[ok]]))
        step += 1
    return tuple(np.concatenate(found, axis=1))


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of complete small nodes from batches sorted by path."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        last = int(runs(table.column("path").to_numpy())[-2])
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


_MET = "path bigint, cid bigint, centre bigint, agree int"


def _meet(nodes: DataFrame, least: int, ratio: float) -> DataFrame:
    """Small nodes: (path of a group of like members, cid, centre, agree), a row for each member.

    ``centre`` is the member that the others resemble most, or, for one that does not resemble it, its best partner;
    null for the centre itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_nodes(batches):
            node = _Node(table)
            a, b, agree = _all_pairs(node, runs(node.path), least, ratio)
            if not len(a):
                continue
            group = components(len(node.cid), a, b)
            one, two, like = np.r_[a, b], np.r_[b, a], np.r_[agree, agree]
            mass = np.bincount(one, like, minlength=len(group))
            members = np.unique(one)
            # the centre of each group: most mass, then the smallest class
            order = members[np.lexsort((node.cid[members], -mass[members], group[members]))]
            first = order[runs(group[order])[:-1]]
            centre_of = np.full(len(group), -1, dtype=np.int64)
            centre_of[group[first]] = first
            # each member's best partner: its centre where they are alike, else whom it resembles most
            to_centre = two == centre_of[group[one]]
            rank = np.lexsort((node.cid[two], -like, ~to_centre, one))
            best = rank[runs(one[rank])[:-1]]
            member, partner, value = one[best], two[best], like[best]
            own = member == centre_of[group[member]]
            path = mix64(node.path[group[member]].astype(U64) ^ mix64(node.cid[group[member]])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(path), pa.array(node.cid[member]), pa.array(node.cid[partner], mask=own), pa.array(value.astype(np.int32), mask=own)], names=["path", "cid", "centre", "agree"]
            )
            release()

    return nodes.repartition("path").sortWithinPartitions("path").mapInArrow(run, _MET)


_OPEN = "main bigint, a bigint, b bigint, n bigint, label bigint"


def _open_pairs(nodes: DataFrame, least: int, ratio: float) -> DataFrame:
    """What is left open in small nodes, at most ``LISTED`` rows for each member of a node.

    Where few similar pairs have different labels: these pairs (a, b). Where many have: the node's members as rows
    (main, a, n, label), ``main`` being the smallest label in the node; blocks of them are compared without listing pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_nodes(batches):
            node, label = _Node(table), table.column("label").to_numpy()
            cuts = runs(node.path)
            a, b, _ = _all_pairs(node, cuts, least, ratio)
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            sizes = np.diff(cuts)
            of = np.repeat(np.arange(len(sizes)), sizes)
            crowded = np.bincount(of[a], minlength=len(sizes)) > LISTED * sizes
            rows = np.flatnonzero(crowded[of])
            a, b = (node.cid[x[~crowded[of[a]]]] for x in (a, b))
            none = lambda m: pa.nulls(m, pa.int64())
            main = np.repeat(np.minimum.reduceat(label, cuts[:-1]), sizes)
            for columns in (
                [none(len(a)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none(len(a)), none(len(a))],
                [pa.array(main[rows]), pa.array(node.cid[rows]), none(len(rows)), pa.array(node.n[rows]), pa.array(label[rows])],
            ):
                yield pa.RecordBatch.from_arrays(columns, names=["main", "a", "b", "n", "label"])
            release()

    return nodes.repartition("path").sortWithinPartitions("path").mapInArrow(run, _OPEN)


def _judge(samples: DataFrame, least: int, ratio: float) -> DataFrame:
    """path, dense, consensus: from a bounded list of (n, sketch) for each large node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense, consensus = [], []
            for some in batch.column("some"):
                drawn = some.as_py()
                n = np.array([x["n"] for x in drawn])
                s = np.frombuffer(b"".join(x["sketch"] for x in drawn), dtype=np.uint8).reshape(-1, POSITIONS)
                x, y = np.triu_indices(len(n), 1)
                dense.append(bool(len(x) and (_similar(s, n, x, y, least, ratio) > 0).mean() >= 0.25))
                consensus.append(bytes(int(np.bincount(s[:, i]).argmax()) for i in range(POSITIONS)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(dense), pa.array(consensus, pa.binary())], names=["path", "dense", "consensus"])

    return samples.mapInArrow(run, "path bigint, dense boolean, consensus binary")


def _agreement(rows: DataFrame) -> DataFrame:
    """path, cid, n, sketch, dense and how many positions of the sketch agree with ``consensus``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, c = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS) for x in ("sketch", "consensus"))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("path", "cid", "n", "sketch", "dense")], pa.array((s == c).sum(axis=1).astype(np.int32))], names=["path", "cid", "n", "sketch", "dense", "agree"])

    return rows.mapInArrow(run, "path bigint, cid bigint, n bigint, sketch binary, dense boolean, agree int")


def _deeper(rows: DataFrame, rate: float) -> DataFrame:
    """path, cid: the branches of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = _Node(batch)
            paths, row = _branch(node.path.astype(U64), _tokens(node.sketch), rate)
            yield pa.RecordBatch.from_arrays([pa.array(paths.astype(np.int64)), pa.array(node.cid[row])], names=["path", "cid"])

    return rows.mapInArrow(run, "path bigint, cid bigint")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the similarity, exactly."""
    shared = shared_shingles(a, b)
    return 100 * shared >= percent * (a.shape[1] + b.shape[1] - shared)


class _Block:
    """Sets that other sets are compared with, by an index from shingles to the sets that hold them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([s.shape[1] for s in sets])
        if len(sets) > 1:
            shingles, owner = np.concatenate([s[0] for s in sets]), np.repeat(np.arange(len(sets)), self.sizes)
            order = np.argsort(shingles, kind="stable")
            cuts = runs(shingles[order])
            self.keys, self.starts, self.ends, self.owner = shingles[order][cuts[:-1]], cuts[:-1], cuts[1:], owner[order]

    def partners(self, other: np.ndarray) -> list[int]:
        """Which sets are linked with ``other``: first by the index, which never misses one, then exactly."""
        if len(self.sets) == 1:
            return [0] if linked(self.sets[0], other, self.percent) else []
        at = np.searchsorted(self.keys, other[0])
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == other[0]]
        shared = np.bincount(self.owner[ranges(self.starts[at], self.ends[at])], minlength=len(self.sets))
        likely = np.flatnonzero(100 * shared >= self.percent * (self.sizes + other.shape[1] - shared))
        return [i for i in likely.tolist() if linked(self.sets[i], other, self.percent)]


def _verify(wanted: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Links (a, b) on whole texts: in each group g the rows of role 1 stream past the block of its rows of role 0.

    ``wanted``: g, role, cid, label; rows of one label are connected already, and of the links between two labels one is given.
    """
    # the wanted texts grow with the corpus: never broadcast
    rows = wanted.hint("merge").join(texts.hint("merge"), "cid").select("g", "role", "cid", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads, sets, block, root = None, [], [], None, {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        for batch in batches:
            found = []
            column = [batch.column(c).to_pylist() for c in ("g", "role", "cid", "label")]
            for g, role, cid, label, shingles in zip(*column, shingle_sets((t.as_py() for t in batch.column("text")), shingle_words), strict=True):
                if g != group:
                    group, heads, sets, block, root = g, [], [], None, {}
                if role == 0:
                    heads.append((cid, label))
                    sets.append(shingles)
                    continue
                if block is None and heads:
                    block = _Block(sets, percent)
                for i in block.partners(shingles) if block is not None else ():
                    low, high = sorted((find(heads[i][1]), find(label)))
                    if low != high:
                        root[high] = low
                        found.append((heads[i][0], cid))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
        release()

    return materialize(rows.repartition("g").sortWithinPartitions("g", "role").mapInArrow(run, "a bigint, b bigint"), "near-links")


def _deal_pairs(pairs: DataFrame, block: int) -> DataFrame:
    """Groups for :func:`_verify` of pairs (a, b): ``a`` and at most about ``block`` of its partners."""
    blocks = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "near-blocks")
    placed = pairs.join(blocks, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("blocks"))).alias("g"))
    heads = placed.select("g", F.lit(0).alias("role"), F.col("a").alias("cid")).distinct()
    return heads.union(placed.select("g", F.lit(1).alias("role"), F.col("b").alias("cid"))).withColumn("label", F.col("cid"))


def _of_hubs(hubs: DataFrame) -> DataFrame:
    """Members (main, cid, n, label) of dense nodes, rows (centre, cid, n, label); ``main`` is the label of the centre."""
    main = hubs.where("cid = centre").select("centre", F.col("label").alias("main")).distinct()
    return hubs.join(main, "centre").select("main", "cid", "n", "label")


def _deal_rest(members: DataFrame, block: int) -> DataFrame:
    """Groups for :func:`_verify` of what is left open in nodes with many open pairs: rows (main, cid, n, label).

    Nodes of one ``main`` label form one set of members. Of a pair that is still open, one member at
    least has another label: blocks of those, of bounded size, meet slices of all members.
    """
    member = materialize(members.groupBy("main", "cid").agg(F.first("n").alias("n"), F.first("label").alias("label")), "near-members")
    aside = F.col("label") != F.col("main")
    sums = member.groupBy("main").agg(F.count(F.lit(1)).alias("members"), F.count(F.when(aside, 1)).alias("rest"), F.sum(F.when(aside, F.col("n"))).alias("size")).where("rest > 0")
    # a block holds about ``block`` sets and 4,096 shingles for each place in it
    cut = sums.select("main", F.ceil(F.greatest(F.col("rest") / block, F.col("size") / (4096 * block))).cast("int").alias("blocks"), F.ceil(F.col("members") / (8 * block)).cast("int").alias("slices"))
    both = member.join(materialize(cut, "near-rest"), "main")
    slot = lambda c, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rest = both.where(aside).withColumn("j", upto("slices")).select(F.xxhash64("main", slot("blocks", 1), "j").alias("g"), F.lit(0).alias("role"), "cid", "label")
    every = both.withColumn("i", upto("blocks")).select(F.xxhash64("main", "i", slot("slices", 2)).alias("g"), F.lit(1).alias("role"), "cid", "label")
    return rest.union(every)


def _components(documents: DataFrame, id_column: str, text: str, shingle_words: int, percent: int, trees: int, start_depth: int, rate: float, small: int, most_depth: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, id, rest, n, k1, k2), and for each set (k1, k2, n) its component_id and the first row of its component."""
    least = int(np.floor(POSITIONS * (percent / 100 - 0.22)))
    ratio = percent / 100 - 1e-9
    others = [F.col(f"`{c}`") for c in documents.columns if c not in (id_column, text)]
    named = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.struct(*others or [F.lit(0).alias("none")]).alias("rest"))
    sets = materialize(_sets(named, shingle_words).withColumn("rid", F.monotonically_increasing_id()), "near-sets")
    rank = F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("id"), F.xxhash64("text").alias("h"), F.col("rid").alias("rid"))
    grouped = sets.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(rank).alias("head"), F.first("sketch").alias("sketch"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    sketches = classes.select("cid", "n", F.concat(*[F.substring("sketch", 2 * i + 1, 1) for i in range(POSITIONS)]).alias("sketch"))

    spent, met, hubs = [], [], []
    level = materialize(_grow(classes.select("cid", "sketch"), trees, start_depth, rate), "near-nodes")
    for depth in range(start_depth, most_depth + 1):
        large = materialize(level.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > small).select("path"), "near-large")
        cold = _shared(level.join(large, "path", "left_anti")).join(sketches, "cid").select("path", "cid", "n", "sketch")
        met.append(materialize(_meet(cold, least, ratio), "near-met"))
        spent += [level, large]
        if large.isEmpty():
            break
        rows = materialize(level.join(large, "path", "left_semi").join(sketches, "cid").select("path", "cid", "n", "sketch"), "near-rows")
        drawn = rows.groupBy("path", F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(SAMPLE))).agg(F.min_by(F.struct("n", "sketch"), F.xxhash64("cid", F.lit(8))).alias("one"))
        judged = _judge(drawn.groupBy("path").agg(F.collect_list("one").alias("some")), least, ratio)
        if depth == most_depth:  # no further branching: compare what is left, whatever it is
            judged = judged.withColumn("dense", F.lit(True))
        marked = materialize(_agreement(rows.join(materialize(judged, "near-judged"), "path")), "near-marked")
        hub = marked.where("dense").groupBy("path").agg(F.max_by("cid", F.struct("agree", -F.col("cid"))).alias("centre"))
        # nodes with one centre are one set of members: each member meets it once, however many nodes they share
        mine = marked.where("dense").join(hub, "path").groupBy("centre", "cid").agg(F.first("n").alias("n"), F.max("agree").alias("agree"))
        hubs.append(materialize(mine, "near-hubs"))
        level = materialize(_deeper(marked.where("not dense"), rate), "near-nodes")
        spent += [rows, marked]
    spent.append(level)

    star = [m.where("centre is not null").select("cid", "centre", "agree") for m in met] + [h.where((F.col("agree") >= least) & (F.col("cid") != F.col("centre"))).select("cid", "centre", "agree") for h in hubs]
    best = _all(star).groupBy("cid").agg(F.max_by("centre", F.struct("agree", -F.col("centre"))).alias("centre"))
    first_pairs = materialize(best.select(F.col("centre").alias("a"), F.col("cid").alias("b")), "near-first")
    concerned = _all([m.select("cid") for m in met] + [h.select("cid") for h in hubs]).distinct()
    texts = classes.join(concerned.hint("merge"), "cid").select("cid", F.col("head.rid").alias("rid")).hint("merge").join(sets.select("rid", "text").hint("merge"), "rid").select("cid", "text")
    texts = materialize(texts, "near-texts")
    confirmed = _verify(_deal_pairs(first_pairs, block), texts, shingle_words, percent)
    final = connected_components(confirmed, "a", "b")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("component", "cid")).drop("component")

    known = materialize(labelled(_all([m.select("path", "cid") for m in met])), "near-known")
    still = known.groupBy("path").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("path")
    left = materialize(_open_pairs(known.join(still, "path", "left_semi").join(sketches, "cid").select("path", "cid", "n", "sketch", "label"), least, ratio), "near-open")
    tried = first_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialize(left.where("main is null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "near-more")
    links = [confirmed]
    if not more.isEmpty():
        links.append(_verify(_deal_pairs(more, block), texts, shingle_words, percent))
    crowds = [left.where("main is not null").select("main", F.col("a").alias("cid"), "n", "label")]
    if hubs:
        crowds.append(_of_hubs(labelled(_all([h.select("centre", "cid", "n") for h in hubs]))))
    rest = materialize(_deal_rest(_all(crowds), block), "near-dealt")
    if not rest.isEmpty():
        links.append(_verify(rest, texts, shingle_words, percent))
    if len(links) > 1:
        final = connected_components(_all(links), "a", "b")
    for table in [*spent, *met, *hubs, known, texts]:
        discard(table)

    joined = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    heads = materialize(joined.groupBy("component").agg(F.min("head.id").alias("component_id"), F.min("head").alias("first")), "near-heads")
    labels = materialize(joined.join(heads, "component").select("k1", "k2", "n", "component_id", F.col("first.rid").alias("first_rid")), "near-labels")
    return sets, labels


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.union(table)
    return out


#: Options of the operator: words of a shingle, percent of similarity, trees, depth at which they start, branching rate, members of a
#: node that is compared as a whole, greatest depth, pairs of a text that one group compares.
DEFAULTS = {"shingle_words": 5, "percent": 80, "trees": 12, "start_depth": 2, "rate": 0.6, "small": 256, "most_depth": 9, "block": 64}


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, n_shingles, component_id and kept (id = component_id) for every row; see ``DEFAULTS`` for options."""
    sets, labels = _components(documents.select(id_column, text), id_column, text, **{**DEFAULTS, **options})
    out = sets.select("id", "n", "k1", "k2").join(labels, ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def deduplicate(documents: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` without near-duplicates: of each component one row stays, of blank texts every row.

    The decision is made for each row: of the rows of a component the first by id (null last), then by a hash of the text.
    """
    sets, labels = _components(documents, id_column, text, **{**DEFAULTS, **options})
    out = sets.select("rid", "id", "text", "rest", "n", "k1", "k2").join(labels, ["k1", "k2", "n"], "left").where("n = 0 or rid = first_rid")
    kind = documents.schema[id_column].dataType
    own = {id_column: F.col("id").cast(kind), text: F.col("text")}
    return out.select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in documents.columns])


def op7_near_duplicates(documents: DataFrame) -> DataFrame:
    """Components of documents linked at similarity 0.8 of two-word shingles."""
    return near_duplicates(documents, shingle_words=2)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x AS a JOIN x AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.m AS component_id, c.m = s.doc_id AS kept FROM s JOIN c ON c.a = s.doc_id
"""
