"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, extended, mix, read, slices

#: n-grams of 1 to 3 characters, hashed to so many features.
ORDERS, FEATURES = (1, 2, 3), 1 << 13
#: Labelled documents of each language that training takes, on average, of up to LANGUAGES languages. More languages share the rows of that many, with
#: LEAST of each at least: the bound is one on rows, every language is learned.
SAMPLE, LANGUAGES, LEAST = 600, 64, 20
#: Bytes of features (8 for each of a row) that training takes; if the sample has more, each language gives a smaller share of it, by the same hash.
SAMPLE_BYTES = 64 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 4
#: This share of the sample calibrates the temperature and isn't trained on.
CALIBRATION = 0.2
PIECE = 1 << 20


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the whole text and how often each occurs. Characters are lower-cased; a run of space is one space.

    Long texts are counted piece by piece, with the last characters of one piece before the next.
    """
    text = " ".join((text or "").lower().split())
    total = np.zeros(FEATURES, np.int64)
    before = " "
    for at in range(0, max(1, len(text)), PIECE):
        piece = text[at : at + PIECE]
        x = np.frombuffer(f"{before}{piece}{' ' if at + PIECE >= len(text) else ''}".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        gram = np.zeros(len(x), np.uint64)
        known = len(before) if at else 0  # n-grams within these are counted already
        for n in ORDERS:
            gram = (gram[: len(x) - n + 1] << np.uint64(21)) | x[n - 1 :] if n > 1 else x
            new = gram[max(0, known - n + 1) :]
            total += np.bincount((mix(new + np.uint64(n)) % np.uint64(FEATURES)).astype(np.int64), minlength=FEATURES)
        before = (before + piece)[-(max(ORDERS) - 1) :]
    some = np.flatnonzero(total)
    return some.astype(np.int32), total[some]


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features + 1 (the last one for the bias) by languages
    temperature: float

    def vector(self, some: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[some]
        return v / max(1e-12, np.sqrt((v * v).sum()))

    def probabilities(self, some: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (self.vector(some, counts) @ self.weights[some] + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, languages: list[str]) -> Model:
    """Follow the regularised leader, each weight with its own rate, l1 and l2 penalties; then the temperature of least log loss."""
    k = len(languages)
    at = {x: i for i, x in enumerate(languages)}
    model = Model(languages, idf, np.zeros((FEATURES + 1, k)), 1.0)
    if not k:
        return model
    rng = np.random.default_rng(0)
    order = rng.permutation(len(rows))
    n_hold = int(len(rows) * CALIBRATION) if len(rows) >= 10 else 0
    held, used = order[:n_hold], order[n_hold:]
    known = {rows[j][2] for j in used}
    lost = np.array([rows[j][2] not in known for j in held], bool)  # all rows of a language: it is learned, not held out
    held, used = held[~lost], np.append(used, held[lost])
    n_hold = len(held)
    data = [(np.append(some, FEATURES), np.append(model.vector(some, counts), 1.0), at[lang]) for some, counts, lang in rows]
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for j in rng.permutation(used):
            i, x, y = data[j]
            w = weights(i)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    final = weights(np.arange(FEATURES + 1))
    scores = np.array([data[j][1] @ final[data[j][0]] for j in (held if n_hold else used)]).reshape(-1, k)
    truth = np.array([data[j][2] for j in (held if n_hold else used)], int)

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).sum())

    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    return model._replace(weights=final, temperature=float(min(grid, key=loss)))


def fit(labelled: DataFrame, text: str, lang: str, key: str) -> Model:
    """From labelled rows: document frequencies over all of them, weights of every language from a sample of about SAMPLE rows each (fewer beyond LANGUAGES).

    A row is in the sample by a hash of its key, so the sample is the same in every run and doesn't grow with the table: SAMPLE bounds its rows,
    SAMPLE_BYTES its size on the driver, where it is sorted by content, so that equal rows (ties) can stand in any order. Rows with a null label
    count towards the document frequencies only; null or empty texts count as a single space; a null key is hashed as such; an empty
    table gives a model without languages. Very long texts count whole. Weights are dense, FEATURES + 1 numbers a language.
    """
    per = labelled.where(F.col(lang).isNotNull()).groupBy(lang).count().collect()
    languages = sorted(r[0] for r in per)
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)), 1.0)
    each = max(LEAST, SAMPLE * min(1.0, LANGUAGES / len(per)))
    share = F.create_map(*(x for r in per for x in (F.lit(r[0]), F.lit(each / r[1]))))[F.col(lang)]
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    wanted = labelled.select(F.col(text).alias("text"), F.when(draw < share, F.col(lang)).alias("lang"), (draw / F.least(share, F.lit(1.0))).alias("draw"))

    names = ["lang", "draw", "some", "counts", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in slices(batches, "text"):
            out = []
            for t, y, at in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "draw"))):
                some, counts = counts_of(t)
                df[some] += 1
                n += 1
                if y is not None:
                    out.append((y, at, some.astype("<i4").tobytes(), counts.astype("<f4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] + [pa.nulls(len(out), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.binary()), pa.array([df.astype("<i8").tobytes()]), pa.array([n], pa.int64())], names=names)

    made = durable(wanted.mapInArrow(run, "lang string, draw double, some binary, counts binary, n long"))
    # sums by feature in Spark: what reaches the driver is FEATURES rows and the sample
    frequency = made.where("lang IS NULL").select("n", "counts").mapInArrow(_unpacked, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df, total = np.zeros(FEATURES), 0
    for f, n in frequency.collect():
        if f < 0:
            total = n
        else:
            df[f] = n
    sample = made.where("lang IS NOT NULL")
    size = sample.agg(F.sum(F.length("some") + F.length("counts"))).first()[0] or 0
    taken = sorted(sample.where(F.col("draw") < min(1.0, SAMPLE_BYTES / max(1, size))).select("lang", "some", "counts").collect())
    rows = [(np.frombuffer(r["some"], "<i4"), np.frombuffer(r["counts"], "<f4").astype(float), r["lang"]) for r in taken]
    return train(rows, np.log((1 + total) / (1 + df)) + 1, languages)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's document frequencies by feature; under -1 its number of documents."""
    df, total = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for n, counts in zip(batch.column("n").to_pylist(), batch.column("counts").to_pylist()):
            total += n
            df += np.frombuffer(counts, "<i8")
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], total))], names=["feature", "n"])


def predict(docs: DataFrame, model: Model, text: str = "text", prefix: str = "li_", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with pred and score, its calibrated probability, named with prefix, from each row's whole text alone.

    Null texts and ones without a letter are "und" with score 0, as are all if no language was learned. Repeated rows get equal
    results; of equal probabilities the first language in order of name wins; an empty table gives an empty one; a column called
    like a new one is an error. A very long text is counted whole, PIECE characters at a time.
    """
    schema = extended(docs, keep, f"{prefix}pred string, {prefix}score double")
    carried = [f.name for f in schema.fields[:-2]]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, text):
            pred, score = [], []
            for t in batch.column(text).to_pylist():
                if not t or not model.languages or not any(map(str.isalpha, t)):
                    pred.append("und")
                    score.append(0.0)
                    continue
                p = model.probabilities(*counts_of(t))
                best = int(p.argmax())
                pred.append(model.languages[best])
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def is_held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id isn't held out and isn't learned from."""
    docs = read(spark, sf_dir, "documents")
    labelled = docs.where(~is_held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fit(labelled.select("doc_id", "text", "lang"), "text", "lang", "doc_id")
    d = predict(docs.select("doc_id", "text", is_held_out("doc_id").alias("held_out")), model, keep=["doc_id", "held_out"])
    return d.select("doc_id", "held_out", F.col("li_pred").alias("lang_pred"), F.col("li_score").alias("score"))
