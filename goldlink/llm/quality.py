"""Quality classifier by co-training of two views of a document.

Content view: hashed counts of word shapes (runs of upper case, lower case, digits and each other character) and of
words, with the shares of distinct and of repeated words. Metadata view: language, source, stored length and
layout (lines, line length, share of white space, of upper case, of characters that are neither letters nor
digits). Each view has a logistic regression. In each round both score every unlabelled document of the corpus, and each
hands some of those that it is confident of, drawn by a seeded hash in the proportion of the labels, to the other as
pseudo-labels: a tenth as many as there are labelled ones to fit, whatever the corpus' size. At the end each view is
calibrated on labelled documents that no fit has seen (Platt scaling), and a document's score is the mean of the
calibrated logits, weighted by how well each view ranks the calibration set.

The fit reads a bounded sample of labelled documents: at most ``most_labelled``, by smallest seeded hash of the id, so it is the
same on every run. The unlabelled documents are all scored in each round, where they are; only the pseudo-labelled ones come
to the driver. Features are made for a slice of about ``AT_ONCE`` bytes of texts at a time. Every document is scored on its whole text.

Defined results: a null or empty text is scored like any other, on what it has; null metadata is a value of its
own; repeated rows get equal scores; labels that are null are ignored and those of a repeated id are averaged; where the labels
have only one class, or there are none, every document gets the share of good labels (1 without labels) and is
kept; an empty input gives an empty output; an input column with the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldlink.llm.common import U64, content_hashes, release, runs, word_spans
from goldlink.plans.scratch import discard, materialize

SHAPES, WORDS, FACTS = 2048, 8192, 512
_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x41:0x5B] = 1
_KIND[0x61:0x7B] = 2
_KIND[0x80:] = 2
_KIND[0x30:0x3A] = 3
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes of texts whose features are made together (a longer text is a slice of its own).
AT_ONCE = 1 << 20


def _text_hash(value: str | None, salt: int) -> int:
    data = np.frombuffer(("\0" if value is None else value).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return int(content_hashes(data, np.array([0]), np.array([len(data)]))[0][0] >> U64(salt))


def _counts(doc: np.ndarray, hashes: np.ndarray, size: int, first: int, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, indices and log counts, scaled to a length of ``scale`` for each row."""
    cell, n = np.unique(doc * size + (hashes % U64(size)).astype(np.int64), return_counts=True)
    row, value = cell // size, np.log1p(n)
    length = np.sqrt(np.bincount(row, value * value, minlength=len(scale)))
    return row, cell % size + first, value * (scale / np.maximum(length, 1e-9))[row]


def _share(first: int, x: np.ndarray, steps: int = 16) -> np.ndarray:
    """Shares as one of ``steps`` indicator features."""
    return first + np.clip((x * steps).astype(np.int64), 0, steps - 1)


def views_of(texts: list[str | None], langs: list[str | None], sources: list[str | None], sizes: list[int | None]) -> list[Sparse]:
    """The content view and the metadata view of documents; see ``AT_ONCE`` for how many to pass."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n, length = len(raw), np.array([len(r) for r in raw], dtype=np.int64)
    begin = np.r_[0, np.cumsum(length + 1)]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    of = lambda places: np.searchsorted(begin, places, side="right") - 1
    total = lambda flags: np.add.reduceat(flags, begin[:-1], dtype=np.int64)
    one = np.arange(n)

    lower = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    starts, ends = word_spans(data)
    words, doc = content_hashes(lower, starts, ends)[0], of(starts)
    many = np.bincount(doc, minlength=n)
    kinds = np.where(_WHITE[data], np.uint8(0), _KIND[data])
    at = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    packed = kinds[at]
    s, e = word_spans(np.where(packed == 0, np.uint8(0x20), packed))
    shapes, shape_doc = content_hashes(packed, s, e)[0], of(at[s])
    # words of a document are told apart by 40 bits of their hashes
    kept = np.unique(doc.astype(U64) << U64(40) | words >> U64(24)) >> U64(40)
    distinct = np.where(many > 0, np.bincount(kept.astype(np.int64), minlength=n) / np.maximum(many, 1), 1.0)
    same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc[1:][same], minlength=n) / np.maximum(many - 1, 1)
    trust = many / (many + 24)  # a few words say little: short texts stay near the prior
    parts = [
        _counts(shape_doc, shapes, SHAPES, 0, trust),
        _counts(doc, words, WORDS, SHAPES, trust * 0.5),
        (one, _share(SHAPES + WORDS, distinct), trust),
        (one, _share(SHAPES + WORDS + 16, np.minimum(1.0, again * 4)), trust),
        (one, np.full(n, SHAPES + WORDS + 32), np.ones(n)),
    ]
    content = Sparse.join(parts, n)

    size = np.maximum(1, length)
    lines = total(data == 0x0A) + 1
    upper, letters, digits, white = total(kinds == 1), total(kinds == 2), total(kinds == 3), total(kinds == 0) - 1
    log = lambda x, most: np.minimum(most, np.log2(x).astype(np.int64))
    lang = {x: _text_hash(x, 1) % 64 for x in set(langs)}
    source = {x: 64 + _text_hash(x, 2) % 256 for x in set(sources)}
    stored = np.array([max(0, x or 0) for x in sizes], dtype=np.float64)
    sure = length / (length + 150)
    facts = [
        (np.array([lang[x] for x in langs]), np.ones(n)),
        (np.array([source[x] for x in sources]), np.full(n, 0.5)),
        (320 + log(1 + stored, 31), 0.5 * sure),
        (352 + log(lines, 15), 0.5 * sure),
        (368 + log(1 + length / lines, 15), 0.5 * sure),
        (_share(384, upper / size), sure),
        (_share(400, white / size * 2), sure),
        (_share(416, (length - upper - letters - digits - white) / size * 2), sure),
        (_share(432, digits / size * 2), sure),
        (np.full(n, 448), np.ones(n)),
    ]
    return [content, Sparse.join([(one, i, v) for i, v in facts], n)]


def features(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of both views of one document."""
    return [(v.index, v.value) for v in views_of([text], [lang], [source], [n_chars])]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[Sparse]]]:
    """First and last row, and both views, of slices of a batch with text, lang, source and n_chars."""
    columns = [batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")]
    lo, held = 0, 0
    for i, text in enumerate(columns[0]):
        held += len(text or "")
        if held >= AT_ONCE or i == batch.num_rows - 1:
            yield lo, i + 1, views_of(*[c[lo : i + 1] for c in columns])
            lo, held = i + 1, 0


SIZES = (SHAPES + WORDS + 33, FACTS)


@dataclass
class Sparse:
    """Rows of (indices, values)."""

    index: np.ndarray
    value: np.ndarray
    row: np.ndarray
    n: int

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        sizes = [len(i) for i, _ in rows]
        return Sparse(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.repeat(np.arange(len(rows)), sizes), len(rows))

    @staticmethod
    def join(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Sparse:
        """Of (rows, indices, values), in order of rows."""
        row, index, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(row, kind="stable")
        return Sparse(index[order].astype(np.int32), value[order].astype(np.float32), row[order], n)

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        cuts = np.searchsorted(self.row, np.arange(1, self.n))
        return list(zip(np.split(self.index, cuts), np.split(self.value, cuts), strict=True))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index] * self.value, minlength=self.n)


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, size: int, ridge: float = 1.0, steps: int = 80) -> np.ndarray:
    """L2-regularised logistic regression by Nesterov's accelerated gradient; deterministic."""
    top = np.bincount(x.index, x.value, minlength=size) + 1e-3  # power iteration for the curvature's bound
    for _ in range(12):
        top = np.bincount(x.index, (weight * x.dot(top / np.linalg.norm(top)))[x.row] * x.value, minlength=size)
    rate = 1.0 / (0.25 * 1.1 * np.linalg.norm(top) + ridge)
    w = look = np.zeros(size)
    for step in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x.dot(look), -30, 30)))
        gradient = np.bincount(x.index, ((p - y) * weight)[x.row] * x.value, minlength=size) + ridge * look
        after = look - rate * gradient
        look = after + step / (step + 3.0) * (after - w)
        w = after
    return w


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate logits on held-out labels (Newton, with Platt's smoothed targets)."""
    good, bad = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * logit + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - target) * logit).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(v * logit * logit).sum() + 1e-3, (v * logit).sum()], [(v * logit).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def ranking(logit: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve."""
    order = np.argsort(logit, kind="stable")
    rank = np.empty(len(logit))
    cuts = runs(logit[order])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        rank[order[lo:hi]] = (lo + hi + 1) / 2
    good = y > 0.5
    return float((rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / max(1, good.sum() * (~good).sum()))


@dataclass
class Model:
    weights: list[np.ndarray]
    scale: list[tuple[float, float]]
    share: list[float]
    constant: float | None = None

    def score(self, views: list[tuple[np.ndarray, np.ndarray]]) -> float:
        return float(self.scores([Sparse.of([v]) for v in views])[0])

    def scores(self, views: list[Sparse]) -> np.ndarray:
        if self.constant is not None:
            return np.full(views[0].n, self.constant)
        total = np.zeros(views[0].n)
        for view, w, (a, b), share in zip(views, self.weights, self.scale, self.share, strict=True):
            total += share * (a * view.dot(w) + b)
        return _sigmoid(total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


#: Asked with the weights of both views, how many positive and negative pseudo-labels a view hands over, the confidence
#: needed and what has been handed over: for each view new (key, views, label) of documents it is confident of.
Ask = Callable[[list[np.ndarray], tuple[int, int], float, list[set]], list[list[tuple]]]


def ask_rows(pool: list) -> Ask:
    """Pseudo-labels among rows that are here."""
    views = [Sparse.of([p[v] for p in pool]) for v in (0, 1)]

    def ask(weights, quota, confident, given):
        out = []
        for v in (0, 1):
            p = _sigmoid(views[v].dot(weights[v]))
            free = [i for i in range(len(pool)) if i not in given[v]]
            out.append([(i, pool[i], label) for label, most in ((1.0, quota[0]), (0.0, quota[1])) for i in [i for i in free if abs(p[i] - 1 + label) >= confident][:most]])
        return out

    return ask


def co_train(labelled: list, y: np.ndarray, ask: Ask | None, rounds: int = 2, hand_over: float = 0.1, confident: float = 0.95) -> Model:
    """``labelled``: view lists. A fifth of the labelled rows only calibrates."""
    if not len(y) or y.min() == y.max():
        return Model([], [], [], float(y.mean()) if len(y) else 1.0)
    held = np.arange(len(y)) % 5 == 4
    if held.sum() == 0 or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), dtype=bool)  # too few to set some aside: calibrate on what was fitted
    fit_rows = np.flatnonzero(~held)
    check = np.flatnonzero(held) if held.any() else fit_rows
    quota = max(1, round(hand_over * len(fit_rows) * y.mean())), max(1, round(hand_over * len(fit_rows) * (1 - y.mean())))
    extra: list[list[tuple]] = [[], []]  # (key, views, label) that each view was handed by the other
    weights: list[np.ndarray] = [np.zeros(0), np.zeros(0)]
    for turn in range(rounds + 1):
        for v in (0, 1):
            rows = [labelled[i][v] for i in fit_rows] + [views[v] for _, views, _ in extra[v]]
            target = np.r_[y[fit_rows], [label for _, _, label in extra[v]]]
            trust = np.r_[np.ones(len(fit_rows)), np.full(len(extra[v]), 0.5)]
            weights[v] = fit_logistic(Sparse.of(rows), target, trust, SIZES[v])
        if turn == rounds or ask is None:
            break
        handed = ask(weights, quota, confident, [{k for k, _, _ in extra[1 - v]} for v in (0, 1)])
        for v in (0, 1):
            extra[1 - v] += handed[v]
    scale, skill = [], []
    for v in (0, 1):
        logit = Sparse.of([labelled[i][v] for i in check]).dot(weights[v])
        scale.append(platt(logit, y[check]))
        skill.append(max(1e-3, ranking(logit, y[check]) - 0.5))
    return Model(weights, scale, [s / sum(skill) for s in skill])


_VIEWS = "ci binary, cv binary, mi binary, mv binary"


def _read(documents: DataFrame, wanted: list[int]) -> dict[int, list]:
    """Both views of the documents with these ids (a bounded list), by id; of a repeated id the smallest by content."""
    if not wanted:
        return {}
    ids = F.broadcast(documents.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, views in _slices(batch):
                packed = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for rows in (v.rows() for v in views) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *packed], names=["doc_id", "ci", "cv", "mi", "mv"])

    found = documents.select("doc_id", "text", "lang", "source", "n_chars").join(ids, "doc_id").mapInArrow(run, f"doc_id bigint, {_VIEWS}").collect()
    out: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r[0], *map(bytes, r[1:]))):
        view = lambda i, r=r: (np.frombuffer(r[i], dtype=np.int32), np.frombuffer(r[i + 1], dtype=np.float32))
        out.setdefault(r[0], [view(1), view(3)])
    return out


def ask_corpus(documents: DataFrame, clean: DataFrame, seed: int) -> Ask:
    """Pseudo-labels among all unlabelled documents: every one is scored, in place."""
    # labelled documents are scored too and then set aside, so that texts stay where they are
    body = documents.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")

    def ask(weights, quota, confident, given):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, views in _slices(batch):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *[pa.array(_sigmoid(views[v].dot(weights[v]))) for v in (0, 1)]], names=["doc_id", "p0", "p1"])
            release()

        scored = body.mapInArrow(run, "doc_id bigint, p0 double, p1 double").join(clean.select("doc_id"), "doc_id", "left_anti")
        scored = materialize(scored.groupBy("doc_id").agg(F.avg("p0").alias("p0"), F.avg("p1").alias("p1")), "quality-pool")
        picked = []
        for v in (0, 1):
            for label, most in ((1.0, quota[0]), (0.0, quota[1])):
                sure = scored.where(F.col(f"p{v}") >= confident if label else F.col(f"p{v}") <= 1 - confident).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
                # ``given`` and ``quota`` are bounded by the labelled sample
                drawn = [r[0] for r in sure.select("doc_id").limit(most + len(given[v])).collect()]
                picked += [(v, i, label) for i in [i for i in drawn if i not in given[v]][:most]]
        discard(scored)
        views = _read(documents, sorted({i for _, i, _ in picked}))
        return [[(i, views[i], label) for w, i, label in picked if w == v] for v in (0, 1)]

    return ask


def fit(documents: DataFrame, labels: DataFrame, most_labelled: int = 5000, seed: int = 9, **options) -> Model:
    """Fit on a bounded sample of the labels and on all unlabelled documents; see the module's description."""
    clean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    ids = documents.select("doc_id").where("doc_id is not null").distinct()
    known = clean.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_labelled)
    quality = {r[0]: r[1] for r in known.collect()}  # at most most_labelled
    views = _read(documents, sorted(quality))
    return co_train(list(views.values()), np.array([1.0 if quality[k] >= 0.5 else 0.0 for k in views]), ask_corpus(documents, clean, seed), **options)


def classify(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``documents`` with quality_score (0 to 1) and quality_keep."""
    body = documents.drop("quality_score", "quality_keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, views in _slices(batch):
                scores = model.scores(views)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(scores), pa.array(scores >= least)], names=[*batch.schema.names, "quality_score", "quality_keep"])
        release()

    return body.mapInArrow(run, T.StructType([*body.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_keep", T.BooleanType())]))


def op9_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision for every document."""
    scored = classify(documents.select("doc_id", "text", "lang", "source", "n_chars"), fit(documents, labels))
    return scored.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_keep").alias("keep"))
