"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; a shallow tree on the binned feature is fitted to the gradient of the log
loss and added, shrunk, to that feature's lookup table.  Then pairs of features, ranked by what a grid of cells would
still gain, get two-dimensional tables in the same way.  A score is the logistic of a sum of looked-up bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, map_batches, mix64, table, utf8, words_of
from quarry.llm.training import held_out, labelled

FEATURES = (
    "words", "bytes", "word_length", "upper", "digits", "exclaims", "marks", "symbols", "pipes", "non_ascii", "spaces",
    "lines", "line_words", "same_as_before", "distinct_words", "top_word", "distinct_pairs", "distinct_lines",
    "end_symbol", "no_letter", "long_words", "short_words", "capitalised", "stops",
)

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_MARK = np.isin(_BYTE, [ord(c) for c in ".,;:?'\"()-"])
_STOP = np.isin(_BYTE, [ord(c) for c in ".?!"])
_SYMBOL = (_BYTE > 32) & (_BYTE < 127) & ~_LETTER & ~_DIGIT & ~_MARK & (_BYTE != 33) & (_BYTE != 124)


def text_features(column: pa.Array, rows: int = 250) -> np.ndarray:
    """The features of each whole text; null counts as empty, and an empty text gives zeros.  Works on a few texts at once,
    as arrays of a number for each byte would else fill a worker."""
    parts = [_features(column.slice(at, rows)) for at in range(0, len(column), rows)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _features(column: pa.Array) -> np.ndarray:
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    starts, ends, hashes, first = words_of(raw, offsets)
    words = np.diff(first).astype(float)
    per = lambda x, d: x / np.maximum(d, 1)

    def bytes_in(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[raw])])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def words_where(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[first[1:]] - total[first[:-1]]).astype(float)

    def distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of distinct keys of each text, and the count of its most frequent one."""
        if not len(keys):
            return np.zeros(n), np.zeros(n)
        order = np.argsort(mix64(keys + mix64(owner.astype(np.uint64) + np.uint64(1))))
        k, o = keys[order], owner[order]
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
        runs, of = np.diff(np.append(edge, len(k))), o[edge]
        most = np.zeros(n)
        np.maximum.at(most, of, runs)
        return np.bincount(of, minlength=n).astype(float), most

    letters = bytes_in(_LETTER)
    owner = np.repeat(np.arange(n), np.diff(first))
    lengths = ends - starts
    kinds, top = distinct(hashes, owner)
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, int)
    pairs, _ = distinct(hashes[inner] * np.uint64(3) + hashes[inner + 1], owner[inner])
    # lines: the sum of their word hashes, each weighted by its place among the words
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    line = breaks[starts]
    begins = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])])) if len(starts) else np.zeros(0, int)
    if len(begins):
        place = np.arange(len(starts)) - np.repeat(begins, np.diff(np.append(begins, len(starts))))
        line_hash = np.add.reduceat(hashes * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), begins)
        line_owner = owner[begins]
    else:
        line_hash, line_owner = np.zeros(0, np.uint64), np.zeros(0, int)
    lines = np.bincount(line_owner, minlength=n).astype(float)
    line_kinds, _ = distinct(line_hash, line_owner)
    has_letter = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    same = np.zeros(len(hashes), bool)
    same[inner + 1] = hashes[inner + 1] == hashes[inner]
    columns = [
        np.log2(words + 1), np.log2(size + 1), per(size - bytes_in(SPACE), words), per(bytes_in(_UPPER), letters), per(bytes_in(_DIGIT), size),
        per(bytes_in(_BYTE == 33), words), per(bytes_in(_MARK), words), per(bytes_in(_SYMBOL), words), per(bytes_in(_BYTE == 124), words),
        per(bytes_in(_BYTE >= 128), size), per(bytes_in(SPACE), size), np.log2(lines + 1), per(words, lines), per(words_where(same), words),
        per(kinds, words), per(top, words), per(pairs, np.maximum(words - 1, 1)), per(line_kinds, lines), per(words_where(_SYMBOL[raw[ends - 1]]), words),
        per(words_where(has_letter[ends] == has_letter[starts]), words), per(words_where(lengths > 15), words), per(words_where(lengths <= 2), words),
        per(words_where(_UPPER[raw[starts]]), words), per(words_where(_STOP[raw[ends - 1]]), words),
    ]
    return np.where((size > 0)[:, None], np.column_stack(columns), 0.0)


@dataclass
class AdditiveModel:
    """intercept + sum of tables[j][bin of feature j] + sum of pair tables[bin, bin]."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cuts, x[:, j], side="right")]
        for a, b, values in self.pairs:
            total += values[np.searchsorted(self.pair_cuts[a], x[:, a], side="right"), np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin of the best tree of that depth on sums of gradients and Hessians."""
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g), np.cumsum(h)
        gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > _gain(cg[-1], ch[-1]) + 1e-9:
            return np.concatenate([_shallow_tree(g[:at], h[:at], depth - 1), _shallow_tree(g[at:], h[at:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + 1.0))


def _cell_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """As above on a grid: one cut of the first feature, then one cut of the second on either side."""
    cg, ch = np.cumsum(g.sum(1)), np.cumsum(h.sum(1))
    gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
    best, value = -1.0, np.zeros_like(g)
    for at in range(1, len(g)):
        total, leaf = 0.0, []
        for part in (slice(0, at), slice(at, None)):
            pg, ph = g[part].sum(0), h[part].sum(0)
            tree = _shallow_tree(pg, ph, 1)
            total += float((tree * (2 * pg - tree * (ph))).sum())
            leaf.append(np.broadcast_to(tree, g[part].shape))
        if total > best:
            best, value = total, np.concatenate(leaf)
    return value if len(gain) else np.full_like(g, g.sum() / (h.sum() + 1.0))


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, n_pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 30) -> AdditiveModel:
    """Fit on features x and labels y.  Without both labels, the model is the smoothed share of label 1."""
    n1 = float(y.sum())
    p = (n1 + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(p / (1 - p))))
    if n1 in (0.0, float(len(y))):
        return model
    model.cuts = [_quantiles(x[:, j], bins) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    f = np.full(len(y), model.intercept)

    def sums(b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return np.bincount(b, y - q, size), np.bincount(b, q * (1 - q), size)

    for _ in range(rounds):
        for j, values in enumerate(model.tables):
            step = rate * np.clip(_shallow_tree(*sums(binned[j], len(values))), -4, 4)
            values += step
            f += step[binned[j]]
    model.pair_cuts = [_quantiles(x[:, j], pair_bins) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]
    ranked = []
    for a in range(len(sizes)):
        for b in range(a):
            g, h = sums(coarse[a] * sizes[b] + coarse[b], sizes[a] * sizes[b])
            ranked.append((float(_gain(g, h).sum()), a, b))
    for _, a, b in sorted(ranked, reverse=True)[:n_pairs]:
        model.pairs.append((a, b, np.zeros((sizes[a], sizes[b]))))
    for _ in range(pair_rounds):
        for a, b, values in model.pairs:
            cell = coarse[a] * sizes[b] + coarse[b]
            g, h = sums(cell, values.size)
            step = rate * np.clip(_cell_tree(g.reshape(values.shape), h.reshape(values.shape)), -4, 4)
            values += step
            f += step[coarse[a], coarse[b]]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on at most max_train_rows labelled documents outside the held-out fold; the driver gets their features only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"y": batch.column(1), "x": pa.array(list(text_features(batch.column(0))), pa.list_(pa.float64()))})

    rows = map_batches(labelled(docs, labels, label, max_train_rows, id_col, text_col), run, "y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))  # the sums don't depend on the order of tasks
    return fit_additive(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], float))


def score_quality(docs: DataFrame, model: AdditiveModel, columns: list[str], text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``columns`` of every row, then score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts are scored as texts without words.  Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(text_features(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    rows = docs.select(*columns, F.col(text_col).cast("string").alias("__scored_text"))
    schema = rows.schema
    from pyspark.sql import types as T

    out = T.StructType([*schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_batches(rows, run, out)


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't reject.  A model without tables has learned nothing
    and rejects nothing."""
    if not model.tables:
        return docs
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(text_features(batch.column(place).cast(pa.string()))) >= threshold))

    return map_batches(docs, run, docs.schema)


def op9_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op9_gam_quality": op9_gam_quality}
ORACLES: dict[str, str] = {}
