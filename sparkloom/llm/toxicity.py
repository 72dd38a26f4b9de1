"""Toxicity by a chain of linear classifiers (operator 3).

Categories are predicted one after another. Each is a logistic model over hashed words and word beginnings, and
each also takes the probabilities of the categories before it. In training these are out-of-fold predictions,
so that a later model sees earlier probabilities of the quality it will meet on new texts.

Fitted on at most ``max_rows`` labelled documents (a documented bound, chosen by a hash of doc_id); scores cover every
document and every word. The model is a table of ``2**BITS`` weights for each category, whatever the input's size.

Defined results: a null or empty text has no features and gets the models' intercepts; labels that are null are left
out, and for repeated labels of a doc_id the largest counts; without any labelled document, or without both classes
of a category, that category's probability is the share of its positives (0 if there is none); repeated documents
are scored each, and of several texts of one doc_id the first by a hash of the text is learnt from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import as_rows, dropped, small_batches, tidy, with_columns, written
from .words import Words, mix, powers, text_chunks

BITS = 20
MASK = np.uint64((1 << BITS) - 1)
PREFIXES = (4, 5, 6, 7)
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def features(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, feature number) arrays: the word without punctuation around it, and its first bytes."""
    words = Words(raw, off)
    doc = np.repeat(np.arange(len(off) - 1), words.counts())
    for k, m, base, sums in words.segments():
        s, e = words.starts[k:m].copy(), words.ends[k:m].copy()
        for _ in range(4):
            s += (e - s > 1) & _EDGE[raw[s]]
            e -= (e - s > 1) & _EDGE[raw[e - 1]]
        s, e, d, down = s - base, e - base, doc[k:m], powers(len(sums))[1]
        yield d, (mix((sums[e] - sums[s]) * down[s]) & MASK).astype(np.int32)
        for length in PREFIXES:
            long = np.flatnonzero(e - s > length)
            p = s[long]
            yield d[long], (mix((sums[p + length] - sums[p]) * down[p] + np.uint64(length)) & MASK).astype(np.int32)


def present(raw: np.ndarray, off: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs, of the wanted features where given, in order."""
    keys = []
    for d, f in features(raw, off):
        if wanted is not None:
            hit = np.flatnonzero(wanted[f])
            d, f = d[hit], f[hit]
        keys.append(np.unique(d.astype(np.int64) << BITS | f))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, (key & int(MASK)).astype(np.int32)


def logistic(doc: np.ndarray, col: np.ndarray, n: int, k: int, dense: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 300):
    """Weights of a ridge-penalised logistic regression over sparse 0/1 columns and a few dense ones, and an intercept.

    Accelerated gradient steps, scaled by a bound of each column's curvature.
    """
    width = dense.shape[1]
    w = np.zeros(k + width + 1)
    look, step = w.copy(), 1.0
    row_norm = np.bincount(doc, minlength=n) + 1.0 + np.abs(dense).sum(1)
    scale = np.concatenate([np.bincount(col, row_norm[doc], minlength=k), (np.abs(dense) * row_norm[:, None]).sum(0), [row_norm.sum()]]) / 4 + ridge
    for _ in range(steps):
        z = np.bincount(doc, look[:k][col], minlength=n) + dense @ look[k:-1] + look[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([np.bincount(col, r[doc], minlength=k) + ridge * look[:k], dense.T @ r + ridge * look[k:-1], [r.sum()]])
        new, old_step = look - g / scale, step
        move = new - w
        step = 1.0 if g @ move > 0 else (1 + np.sqrt(1 + 4 * step * step)) / 2  # start anew where the momentum leads uphill
        look, w = new + (old_step - 1) / step * move if step > 1 else new, new
        if np.abs(move).max() < 1e-4:
            break
    return w


def fit_chain(doc: np.ndarray, col: np.ndarray, k: int, labels: np.ndarray, folds: int = 5, seed: int = 3) -> list[np.ndarray]:
    """One weight vector for each category: k columns, the categories before it, the intercept."""
    n = len(labels)
    fold = np.random.default_rng(seed).permutation(n) % folds
    earlier, models = np.zeros((n, 0)), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        rate = float(y.mean()) if n else 0.0
        if not 0 < rate < 1:
            w = np.zeros(k + earlier.shape[1] + 1)
            w[-1] = np.log((rate + 1e-9) / (1 - rate + 1e-9))
            out = np.full(n, rate)
        else:
            w = logistic(doc, col, n, k, earlier, y)
            out = np.empty(n)
            for f in range(folds):
                train, test = fold != f, fold == f
                number = np.cumsum(train) - 1
                use = train[doc]
                part = logistic(number[doc[use]], col[use], int(train.sum()), k, earlier[train], y[train])
                z = np.bincount(doc, part[:k][col], minlength=n) + earlier @ part[k:-1] + part[-1]
                out[test] = 1 / (1 + np.exp(-np.clip(z[test], -30, 30)))
        models.append(w)
        earlier = np.column_stack([earlier, out])
    return models


def train_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_rows: int = 10_000, top: int = 400, least: float = 20.0):
    """(selected features, models). labels: doc_id and a 0/1 column for each category.

    A feature is selected by the chi-squared statistic of its presence in positive and negative documents, at least
    ``least``, and at most the ``top`` strongest of each category.
    """
    names = list(categories)
    known = labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ["doc_id", *names])).groupBy("doc_id").agg(*[F.max(c).cast("int").alias(f"y{i}") for i, c in enumerate(names)])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = sample.toPandas()  # at most max_rows numbers a category
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame(rows)) if len(rows) else sample
    ys = [f"y{i}" for i in range(len(names))]
    # Of a doc_id with several texts the least by hash and text is learnt from, so that reruns learn the same.
    joined = with_columns(docs, "doc_id", "text").join(sample, "doc_id").withColumn("h", F.struct(F.xxhash64("text"), "text"))
    texts = written(joined.groupBy("doc_id", *ys).agg(F.min("h").alias("h")).select(*ys, "h.text"), "labelled-texts")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(ys) + 1, 1 << BITS), np.int32)
        for batch in batches:
            y = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ys])
            for i, j, raw, off in text_chunks(batch.column("text")):
                d, f = present(raw, off, None)
                np.add.at(sums[0], f, 1)
                for c in range(len(ys)):
                    np.add.at(sums[c + 1], f[y[i:j, c][d] == 1], 1)
        f = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), *[pa.array(s[f].astype(np.int64)) for s in sums]], ["f", "n", *ys])

    counts = texts.mapInArrow(tidy(totals), "f int, n long, " + ", ".join(f"{y} long" for y in ys)).groupBy("f").agg(*[F.sum(c).alias(c) for c in ["n", *ys]])
    total = len(rows)
    chosen: set[int] = set()
    for y in ys:
        pos = int(rows[y].sum()) if total else 0
        if not 0 < pos < total:
            continue
        a, n = F.col(y).cast("double"), F.col("n").cast("double")
        gap = a * total - n * pos
        chi = gap * gap * total / (n * (total - n + 1e-9) * pos * (total - pos))
        chosen |= {r.f for r in counts.where("n >= 3").withColumn("chi", chi).where(F.col("chi") >= least).orderBy(F.desc("chi"), "f").limit(top).select("f").collect()}
    picked = np.array(sorted(chosen), np.int32)
    wanted = np.zeros(1 << BITS, bool)
    wanted[picked] = True

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in text_chunks(batch.column("text")):
                d, f = present(raw, off, wanted)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(j - i + 1)).astype(np.int32)), pa.array(f))
                yield pa.RecordBatch.from_arrays([lists, *[batch.column(c).slice(i, j - i).cast(pa.int32()) for c in ys]], ["f", *ys])

    got = texts.mapInArrow(tidy(found), "f array<int>, " + ", ".join(f"{y} int" for y in ys)).toPandas()  # at most max_rows rows of selected features
    dropped(texts)
    cols = [np.asarray(x, np.int32) for x in got["f"]]
    doc = np.repeat(np.arange(len(cols)), [len(x) for x in cols]).astype(np.int64)
    col = np.searchsorted(picked, np.concatenate(cols)) if cols else np.zeros(0, np.int64)
    return picked, fit_chain(doc, col, len(picked), got[ys].to_numpy().reshape(len(got), len(ys)))


def _scored(rows: DataFrame, text_of: Callable[[pa.RecordBatch], pa.Array], keep: Sequence[str], categories: Sequence[str], threshold: float, picked: np.ndarray, models: list[np.ndarray]) -> DataFrame:
    """The kept columns of rows, p_<category> and rejected, from the text that text_of finds in a batch."""
    small_batches(rows.sparkSession)
    k = len(picked)
    names = [f"p_{c}" for c in categories]
    slot = np.full(1 << BITS, -1, np.int32)
    slot[picked] = np.arange(k)
    model = rows.sparkSession.sparkContext.broadcast((slot, models))  # fixed size: 2**BITS slots

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, models = model.value
        wanted = slot >= 0
        for batch in batches:
            for i, j, raw, off in text_chunks(text_of(batch)):
                d, f = present(raw, off, wanted)
                col, probs = slot[f], []
                for w in models:
                    z = np.bincount(d, w[:k][col], minlength=j - i) + w[-1]
                    for p, v in zip(probs, w[k:-1]):
                        z = z + p * v
                    probs.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), *map(pa.array, probs), pa.array(probs[-1] > threshold)], [*keep, *names, "rejected"])

    new = StructType.fromDDL(", ".join(f"{c} double" for c in names) + ", rejected boolean")
    return rows.mapInArrow(tidy(score), StructType([*(rows.schema[c] for c in keep), *new]))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str] = ("low_quality", "toxic"),
    threshold: float = 0.4,
    max_rows: int = 10_000,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The kept columns, a probability p_<category> for each category, and rejected: the last category's is over the threshold."""
    picked, models = train_chain(docs, labels, categories, max_rows)
    return _scored(with_columns(docs, *dict.fromkeys([*keep, "text"])), lambda batch: batch.column("text"), keep, categories, threshold, picked, models)


def without_toxic(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"), threshold: float = 0.4, max_rows: int = 10_000) -> DataFrame:
    """The rows of docs, with all their columns, that the chain does not reject. Each text goes to a worker once, inside its row."""
    picked, models = train_chain(docs, labels, categories, max_rows)
    scored = _scored(as_rows(docs), lambda batch: pc.struct_field(batch.column("row"), "text"), ("row",), categories, threshold, picked, models)
    return scored.where("NOT rejected").select("row.*")


def category_labels(labels: DataFrame) -> DataFrame:
    """The labels table as the default categories: a document of quality 0 is low_quality."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))
