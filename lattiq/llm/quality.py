"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

The trees are grown on binned statistics of a bounded sample of labelled texts and flattened into arrays,
so that a batch of texts descends all trees level by level in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import Scratch, by_bytes, ship, unused

#: At most so many labelled texts are learned from: those of the smallest hashes of their ids.
SAMPLE = 20_000
NAMES = (
    "log_chars", "log_words", "word_chars", "lines_per_kchar", "upper", "digit", "space", "stop", "comma", "bang", "other_ascii", "wide_letter", "wide_other",
    "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "log_longest_word", "log_longest_line", "bars", "full_stops",
)
_CLASS = np.full(0x110000, 8, np.uint8)  # 8: other, beyond ASCII
_CLASS[:128] = 7
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = 1, 0, 2
for _c, _k in ((32, 3), (9, 3), (10, 3), (13, 3), (46, 4), (44, 5), (33, 6), (63, 6)):
    _CLASS[_c] = _k
_CLASS[0xC0:0x250] = 9
_CLASS[0x370:0x2000] = 9
_CLASS[0x3040:0xE000] = 9


def features(text: str) -> list[float]:
    """The statistics of one text, in the order of NAMES; character classes are added by matrix()."""
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    return [
        log1p(len(words)), len(text) / n, 1000 * len(lines) / max(1, len(text)),
        len(counts) / n, top / n, len(set(pairwise(words))) / max(1, len(words) - 1), len(set(lines)) / len(lines), log1p(max(map(len, counts), default=0)),
        log1p(max(map(len, lines))), text.count("|") / n, text.count(". ") / n,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    """A row of statistics for each text; an empty text has those of no words."""
    out = np.zeros((len(texts), len(NAMES)))
    at = [NAMES.index(x) for x in ("log_words", "word_chars", "lines_per_kchar", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "log_longest_word", "log_longest_line", "bars", "full_stops")]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if sizes.sum():
        classes = _CLASS[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        owner = np.repeat(np.arange(len(texts)), sizes)
        share = np.bincount(owner * 10 + classes, minlength=len(texts) * 10).reshape(-1, 10) / np.maximum(1, sizes)[:, None]
        for name, k in (("upper", 1), ("digit", 2), ("space", 3), ("stop", 4), ("comma", 5), ("bang", 6), ("other_ascii", 7), ("wide_other", 8), ("wide_letter", 9)):
            out[:, NAMES.index(name)] = share[:, k]
    out[:, 0] = np.log1p(sizes)
    for i, text in enumerate(texts):
        out[i, at] = features(text)
    return out


class Trees:
    """Flat arrays over all nodes of all trees: feature, cut (go left if the value is at most this), left, right, value."""

    def __init__(self, base: float):
        self.base, self.roots, self.depth = base, [], 0
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []

    def node(self) -> int:
        for values, v in ((self.feature, 0), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            values.append(v)
        return len(self.left) - 1

    def close(self) -> Trees:
        self.feature, self.left, self.right, self.roots = (np.array(x, np.int32) for x in (self.feature, self.left, self.right, self.roots))
        self.cut, self.value = np.array(self.cut, np.float64), np.array(self.value, np.float64)
        # a leaf leads to itself
        leaf = self.left < 0
        own = np.arange(len(leaf), dtype=np.int32)
        self.left, self.right = np.where(leaf, own, self.left), np.where(leaf, own, self.right)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosting with logistic loss on binned columns; every level of a tree is one histogram over (node, column, bin).

    Without rows the score is 0.5; labels of one kind give a constant near it."""
    y = y.astype(np.float64)
    rate0 = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(rate0 / (1 - rate0))))
    if not len(y) or y.min() == y.max():
        return model.close()
    model.depth = depth
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: value <= edges[b]
    n, m = binned.shape
    column = np.arange(m) * bins
    margin = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        root = model.node()
        model.roots.append(root)
        node, of = np.zeros(n, np.int64), [root]
        for level in range(depth + 1):
            k = len(of)
            live = node >= 0
            sums_g, sums_h = (np.bincount(node[live], w[live], minlength=k) for w in (g, h))
            for i, number in enumerate(of):
                model.value[number] = float(-rate * sums_g[i] / (sums_h[i] + ridge))
            if level == depth:
                break
            flat = (node[live, None] * (m * bins) + column + binned[live]).ravel()
            hist = [np.bincount(flat, np.repeat(w, m), minlength=k * m * bins).reshape(k, m, bins).cumsum(2) for w in (g[live], h[live], np.ones(live.sum()))]
            total = [z[:, :, -1:] for z in hist]
            gain = hist[0] ** 2 / (hist[1] + ridge) + (total[0] - hist[0]) ** 2 / (total[1] - hist[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(hist[2] < least) | (total[2] - hist[2] < least)] = 0
            best = gain.reshape(k, -1).argmax(1)
            to, new = np.full((k, 2), -1), []
            for i, number in enumerate(of):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] <= 1e-6 or b >= len(edges[j]):
                    continue
                model.feature[number], model.cut[number] = j, float(edges[j][b])
                model.left[number], model.right[number] = model.node(), model.node()
                to[i] = len(new), len(new) + 1
                new += [model.left[number], model.right[number]]
            j = best // bins
            side = np.where(live, binned[np.arange(n), j[node]] > (best % bins)[node], 0).astype(np.int64)
            old = node
            node = np.where(live, to[old, side], -1)
            # rows whose node stays a leaf leave the tree here
            done = live & (node < 0)
            margin[done] += np.array(model.value)[np.array(of)[old[done]]]
            of = new
            if not of:
                break
        if of:
            live = node >= 0
            margin[live] += np.array(model.value)[np.array(of)[node[live]]]
    return model.close()


def held_out(doc_id) -> Column:
    """Whether a document's labels are kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learns from at most `sample` labelled texts outside the held-out fold (the smallest hashes of doc_id).

    Labels of a document are averaged, 1 from a half on; null labels and labels without a text are left out;
    of several texts with one doc_id the least is taken."""
    ship(spark)
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = Scratch(spark, "quality").keep(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole):
                x = matrix(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], names=schema.names)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(run, schema)  # broadcast: `sample` pairs of numbers at most
    found = found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x"))  # one row an id, however often it repeats
    found = sorted(tuple(r) for r in found.collect())
    x = np.array([r[2] for r in found]).reshape(len(found), len(NAMES))
    return fit(x, np.array([r[1] for r in found], np.int64))


def scored(spark: SparkSession, docs: DataFrame, model: Trees, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` of docs (default: all) with the score (0 to 1, higher: better) of every whole text; null texts count as empty."""
    ship(spark)
    keep = docs.columns if keep is None else keep
    schema = T.StructType([*docs.select(keep).schema.fields, T.StructField(name, T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, len(keep)):
                score = shared.value.score(matrix(b.column(len(keep)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*keep, name])

    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(unused(keep, "text_"))).mapInArrow(run, schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on) of every row of docs.

    Nothing but the text enters a score. Repeated rows get equal scores; a null doc_id is not held out; an empty
    table of documents gives an empty result, an empty table of labels the score 0.5.
    """
    rows = scored(spark, docs, train(spark, docs, labels, sample), ["doc_id"])
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows scored below the threshold; columns as in docs.

    A null text is scored as an empty one; repeated rows stay or go together; an empty table stays empty, and without
    labels every score is 0.5; columns may have any names."""
    columns = docs.columns
    score = unused(columns, "score")
    return scored(spark, docs, train(spark, docs, labels, sample), name=score).filter(F.col(score) >= threshold).select(columns)
