"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches on the executors. Trees are fitted on the driver on the
statistics of a bounded sample of labelled rows (``SAMPLE`` of each label): values are put into quantile bins, each
level of a tree is chosen from per-bin sums of gradients and second derivatives, and trees are kept as flat arrays of
complete binary trees, which numpy walks for a whole batch at once.

Defined results: a null text is empty, and empty texts are scored like any other; with no usable labels, or only one of
the two, the score is the share of label 1 (0.5 without any); held_out is false where doc_id is null; repeated rows are scored alike; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, read, text_of
from .labelled import held_out, sample

#: Labelled rows of each label that trees are fitted on, at most.
SAMPLE = {0: 4000, 1: 8000}
TREES, DEPTH, RATE, BINS, L2, LEAST = 120, 4, 0.1, 64, 1.0, 5.0
FEATURES = ("log_chars", "words", "chars_per_word", "longest_word", "lines", "words_per_line", "letters", "capitals", "digits", "spaces", "marks", "other_ascii", "beyond_ascii", "bangs", "bars", "stops", "commas", "distinct_words", "distinct_lines", "repeats_next", "top_word", "words_ending_in_mark", "entropy", "all_capital_words", "marks_runs")
CLASSES = np.zeros(256, dtype=np.int64)  # 0 other ASCII
for _codes, _class in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), ((9, 10, 11, 12, 13, 32), 4), (b".,;:?'\"-()", 5), (range(128, 256), 6)):
    for _code in _codes:
        CLASSES[_code] = _class


def statistics(text: str) -> list[float]:
    data = text.encode()
    size = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    of_class = np.bincount(CLASSES, weights=counts, minlength=7)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    share = counts[counts > 0] / size
    letters = of_class[1] + of_class[2]
    return [
        np.log1p(len(data)), np.log1p(len(words)), len(data) / n, np.log1p(max(map(len, words), default=0)), np.log1p(len(lines)), n / len(lines), letters / size, of_class[2] / max(1, letters), of_class[3] / size, of_class[4] / size, of_class[5] / size, of_class[0] / size, of_class[6] / size, counts[33] / n, counts[124] / n, counts[46] / n, counts[44] / n,
        len(seen) / n, len(set(lines)) / len(lines), sum(map(str.__eq__, words, words[1:])) / n, max(seen.values(), default=0) / n, sum(c * (not w[-1].isalnum()) for w, c in seen.items()) / n, float(-(share * np.log2(share)).sum()), sum(c for w, c in seen.items() if len(w) > 1 and w.isupper()) / n, len(MARKS.findall(text)) / n,
    ]


MARKS = re.compile(r"[#$%&*@^~=+_]{2,}")


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Flat trees: for node i of a complete tree, children 2 i + 1 (value <= threshold) and 2 i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, values: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(values), self.base), np.arange(len(values))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(values), dtype=np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (values[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(values: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = L2, least: float = LEAST) -> Trees:
    """Logistic loss; a node that gains nothing sends all rows left."""
    share = labels.mean() if len(labels) else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    if len(labels) == 0 or share in (0, 1):
        base = 0.0 if not len(labels) else (12.0 if share else -12.0)
        return Trees(base, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) for v in values.T]
    binned = np.stack([np.searchsorted(e, v, "left") for e, v in zip(edges, values.T, strict=True)])
    total, out = np.full(len(labels), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, second = p - labels, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(labels), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.zeros(n)
            for f, (own, bounds) in enumerate(zip(binned, edges, strict=True)):
                if not len(bounds):
                    continue
                place = (node - first) * bins + own
                g, h = (np.bincount(place, w, n * bins).reshape(n, bins).cumsum(axis=1) for w in (gradient, second))
                gl, hl, gt, ht = g[:, : len(bounds)], h[:, : len(bounds)], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least / 10) | (ht - hl < least / 10)] = 0
                cut = gain.argmax(axis=1)
                better = gain[np.arange(n), cut] > best + 1e-12
                best = np.where(better, gain[np.arange(n), cut], best)
                feature[first : first + n][better] = f
                threshold[first : first + n][better] = bounds[cut[better]]
            node = 2 * node + 1 + (values[np.arange(len(labels)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, gradient, leaves) / (np.bincount(at, second, leaves) + l2)
        total += leaf[at]
        out.append((feature, threshold, leaf))
    return Trees(base, *(np.stack(x) for x in zip(*out, strict=True)))


def trained(docs: DataFrame, labels: DataFrame, most_of_each: dict[int, int] = SAMPLE) -> Trees:
    rows = sample(docs, labels, "quality", most_of_each)

    def run(batches):
        for batch in batches:
            values = matrix(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    found = sorted(rows.select("doc_id", "label", "text").mapInArrow(in_slices(run), "doc_id long, label int, x array<double>").collect())
    return fit(np.array([r["x"] for r in found], dtype=float).reshape(len(found), len(FEATURES)), np.array([r["label"] for r in found], dtype=float))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            score = model.score(matrix(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text")).mapInArrow(in_slices(run), "doc_id long, held_out boolean, score double, predicted int")


def op3_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, trained(docs, read(spark, sf_dir, "labels")))
