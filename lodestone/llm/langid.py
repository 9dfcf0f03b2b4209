"""Language identification: sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, spread

UNDETERMINED = "und"
#: Odd 32-bit multipliers of the n-gram hash.
MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def ngram_counts(text: str, orders: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of a whole text, and how often each occurs.

    Case is folded, and runs of ASCII other than letters count as one space.
    """
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    gap = (code < 97) | ((code > 122) & (code < 128))
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    keep[0] = True
    code = np.where(gap, np.uint32(32), code)[keep]
    spots = []
    h = np.zeros(len(code), np.uint32)
    for n in range(orders):
        if n >= len(code):
            break
        grown = code[n:] * np.uint32(MIX[n % 3]) + np.uint32(n)
        h = (h[: len(grown)] ^ (h[: len(grown)] >> np.uint32(15))) * np.uint32(MIX[1]) + grown
        spot = (h ^ (h >> np.uint32(16))) * np.uint32(MIX[2]) >> np.uint32(32 - bits)
        spots.append(spot.astype(np.uint16) if bits <= 16 else spot)
    # Sorted rather than counted in an array of all features; 16 bits sort by radix.
    spots = np.sort(np.concatenate(spots), kind="stable")
    edges = np.flatnonzero(np.append(True, spots[1:] != spots[:-1]))
    return spots[edges].astype(np.int64), np.diff(np.append(edges, len(spots)))


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF times IDF, of length 1."""
    x = (1 + np.log(n)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Model:
    """Weights by n-gram and language, and what calibrates them."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    orders: int
    bits: int

    def predict(self, text: str) -> tuple[str, float]:
        at, n = ngram_counts(text, self.orders, self.bits)
        z = (tfidf(at, n, self.idf) @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    width: int,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    seed: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate follow-the-regularised-leader with elastic-net penalties.

    ``rows`` are (feature, value). The last coordinate, the bias, is not penalised by ``l1``.
    """
    z, n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))

    def solve(zs: np.ndarray, ns: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - penalty, 0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, width), np.append(x, 1.0)
            penalty = np.where(at == width, 0.0, l1)[:, None]
            w = solve(z[at], n[at], penalty)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = np.outer(x, p)
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = solve(z, n, np.append(np.full(width, l1), 0.0)[:, None])
    return w[:-1], w[-1]


#: Between these the temperature is searched.
COLDEST, HOTTEST = 1e-3, 1e3


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.

    The n rows show no more certainty than n cases can: the target of a row's own class is
    (n + 1) / (n + classes), as if every class had been seen once more, and not 1. So rows that are
    all classified rightly have an optimum too, and don't drive the temperature to 0.
    """
    if not len(labels):
        return 1.0
    n, classes = logits.shape
    target = np.full((n, classes), 1 / (n + classes))
    target[np.arange(n), labels] = (n + 1) / (n + classes)

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - (target * z).sum(axis=1)))

    low, high, ratio = np.log(COLDEST), np.log(HOTTEST), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _gathered(orders: int, bits: int):
    """Training rows to document frequencies by task, and the features of sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << bits, np.int64)
        kinds = [("lang", pa.string()), ("h", pa.int64()), ("at", pa.binary()), ("n", pa.binary())]
        kinds += [("feature", pa.int64()), ("df", pa.int64())]
        schema = pa.schema(kinds)
        for batch in batches:
            out = []
            for text, lang, h, wanted in zip(*(batch.column(k) for k in range(4)), strict=True):
                at, n = ngram_counts(text.as_py(), orders, bits)
                df[at] += 1
                if wanted.as_py():
                    row = (lang.as_py(), h.as_py(), at.astype("<i4").tobytes(), n.astype("<i4").tobytes())
                    out.append(dict(zip(schema.names, (*row, None, None), strict=True)))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        at = np.flatnonzero(df)
        none = [pa.nulls(len(at), t) for _, t in kinds[:4]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at), pa.array(df[at])], schema=schema)

    return run


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_language: int = 400,
    orders: int = 3,
    bits: int = 15,
    most_languages: int = 1000,
) -> Model | None:
    """Trains on ``labelled``; None where no row has a language and a letter.

    Document frequencies count all rows. The weights are fitted on a bounded sample: of each
    language the ``per_language`` rows of least key hash, features and no texts, so the driver
    gets some 2 * languages * per_language rows of at most 2**bits features. Of rows that
    repeat a key one is in the sample. A fifth of the sample is held back to calibrate the
    temperature. More than ``most_languages`` languages raise: the model is shared as a whole.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & has_letter(F.col(text)))
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(1 << 40))
    per = {r[0]: r[1] for r in labelled.groupBy(lang).count().limit(most_languages + 1).collect()}
    if not per:
        return None
    if len(per) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    languages = sorted(per)
    # Twice the wanted share, so that nearly always enough rows come; cut to size below.
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, (2 * per_language + 20) / per[k]))])
    rows = spread(labelled).select(
        text, F.col(lang).alias("lang"), h.alias("h"), (h < shares[F.col(lang)] * F.lit(float(1 << 40))).alias("wanted")
    )
    found = materialise(
        rows.mapInArrow(
            _gathered(orders, bits), "lang string, h long, at binary, n binary, feature long, df long"
        ),
        "features",
    )
    df = np.zeros(1 << bits)
    for r in found.where("df is not null").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r.feature] = r.df
    idf = np.log((1 + sum(per.values())) / (1 + df)) + 1
    sample: dict[str, list] = {k: [] for k in languages}
    # One row of each key: repeated keys, however many, don't add to what the driver gets.
    once = found.where("df is null").groupBy("lang", "h").agg(F.min(F.struct("at", "n")).alias("x"))
    for r in once.select("lang", "h", "x.at", "x.n").toLocalIterator():
        sample[r.lang].append((r.h, bytes(r["at"]), bytes(r.n)))
    xs, ys, held = [], [], []
    for k, name in enumerate(languages):
        for i, (_, at, n) in enumerate(sorted(sample[name])[:per_language]):
            at = np.frombuffer(at, "<i4")
            xs.append((at, tfidf(at, np.frombuffer(n, "<i4"), idf)))
            ys.append(k)
            held.append(i % 5 == 4)
    y, held = np.array(ys), np.array(held)
    learn = np.flatnonzero(~held)
    w, b = train_ftrl([xs[i] for i in learn], y[learn], len(languages), 1 << bits)
    keep = np.flatnonzero(held)
    logits = np.array([xs[i][1] @ w[xs[i][0]] + b for i in keep]).reshape(len(keep), len(languages))
    return Model(languages, w.astype(np.float32), b, idf, fit_temperature(logits, y[keep]), orders, bits)


def with_language(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability.

    Null texts, texts without a letter, and all texts where nothing was learned get ``und``, 0.
    A very long text is read as a whole within its task, in memory in proportion to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [
                model.predict(t.as_py()) if ok.as_py() and model else (UNDETERMINED, 0.0)
                for t, ok in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True)
            ]
            columns = [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = [c for c in docs.columns if c not in (lang, score)]
    names = [*kept, lang, score]
    at = kept.index(text)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"{lang} string, {score} double"])
    rows = spread(docs).select(*[F.col(f"`{c}`") for c in kept], has_letter(F.col(text)).alias("_letter"))
    return rows.mapInArrow(run, schema)
