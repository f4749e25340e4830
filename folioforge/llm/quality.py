"""Operator 9: quality classifier by compression.

Two zstandard dictionaries are built from good and bad labelled text. A text is cut into blocks of BLOCK bytes, each
block is compressed with either dictionary, and the normalised difference of the summed sizes is calibrated to a
probability by a logistic curve fitted on other labelled rows. The curve also sees the compressed share of the text and
the logarithm of its size: the same difference says less of a short text, and repetition compresses under either
dictionary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import crc_mod, prepared, table, with_columns

#: Block size; dictionary size; labelled rows of each class that the dictionaries are fitted on at most, and as many
#: others for the calibration, taken by hash of the id; the curve's ridge. Dictionaries, calibration and scores see whole texts.
BLOCK, DICT_BYTES, FIT_ROWS, LEVEL, RIDGE = 512, 65536, 1200, 3, 0.1


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the measures, then the offset


def _blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]


def _compressor(words: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_AUTO if words[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)


def measures(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, ...]:
    """(bad size - good size) / (bad size + good size) over all blocks; the compressed share, its root and its square; the size's logarithm. All 0 for an empty text."""
    g = b = n = 0
    for x in _blocks(text):
        g += len(good.compress(x))
        b += len(bad.compress(x))
        n += len(x)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    share = (g + b) / (2 * n)
    return (b - g) / (b + g), share, math.sqrt(share), share * share, math.log(n)


def _measurer(good: bytes, bad: bytes):
    """The measures of a batch of texts, as the values of one column."""
    g, b = _compressor(good), _compressor(bad)
    return lambda texts: [[list(measures(t, g, b)) for t in texts]]


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained from the samples, or their own text where they are too few for training; never empty."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:] or b" "


def _logistic(x: np.ndarray, y: np.ndarray, shift: float) -> tuple[float, ...]:
    """Weights and offset of a ridge logistic curve on standardised measures. Without both classes: no weights, the smoothed share.

    shift is added to the offset: it takes the curve from the classes' shares in the sample to those among all labels.
    """
    n = len(y)
    if n == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2)
        return (*[0.0] * x.shape[1], math.log(p / (1 - p)))
    mid, wide = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    a, w = np.column_stack([(x - mid) / wide, np.ones(n)]), np.zeros(x.shape[1] + 1)
    ridge = np.array([RIDGE] * x.shape[1] + [1e-6])
    loss = lambda w: (np.logaddexp(0, a @ w) - y * (a @ w)).sum() + 0.5 * ridge @ (w * w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        # shorter steps where the classes are nearly apart
        while np.abs(step).max() > 1e-10 and loss(w + step) > loss(w):
            step /= 2
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / wide
    return (*slopes.tolist(), float(w[-1] - slopes @ mid + shift))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """A model from the labels outside the held-out fold (crc32 of the id as text, modulo 3, equal to 1).

    Null labels and labels without a document are left out; of several labels of an id the smallest counts, and of
    several texts of an id the least. Of each class, `rows` rows make the dictionaries and `rows` others the
    calibration, picked by the hash of their ids.
    """
    prepared(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & (crc_mod(F.col(id_col), 3) != 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    order = F.md5(F.concat(F.lit("quality:"), F.col("_id").cast("string")).cast("binary"))
    picked = [known.where(F.col("_y") == y).orderBy(order).limit(2 * rows) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).where("_id IS NOT NULL")  # at most 4 * rows ids: a fixed bound
    found = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")).join(F.broadcast(ids), "_id")
    held = found.select("_id", "_y", order.alias("_rank")).distinct().collect()
    held.sort(key=lambda r: r["_rank"])
    role = [(r["_id"], k % 2 == 0) for y in (0, 1) for k, r in enumerate(r for r in held if r["_y"] == y)]
    roles = docs.sparkSession.createDataFrame(role, T.StructType([T.StructField("_id", found.schema["_id"].dataType), T.StructField("_words", T.BooleanType())]))
    dealt = found.join(F.broadcast(roles), "_id")
    # whole texts stay out of the driver: a dictionary is built in a task, and of the calibration's rows the measures come
    def trained(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.sort_values("_rank")["_text"]
        return pd.DataFrame({"y": rows["_y"].iloc[:1].to_numpy(), "words": [_dictionary([b for t in texts for b in _blocks(t)])]})

    once = dealt.groupBy("_id", "_y", "_words").agg(F.min("_text").alias("_text")).withColumn("_rank", order)
    made = once.where("_words").groupBy("_y").applyInPandas(trained, "y int, words binary").collect()  # two rows of DICT_BYTES
    words = {0: b" ", 1: b" "} | {r["y"]: bytes(r["words"]) for r in made}
    whole = with_columns(once.where("NOT _words").select("_y", "_rank", "_text"), "_text", lambda: _measurer(words[1], words[0]), "_m array<double>")
    rest = [(r["_m"], r["_y"]) for r in sorted(whole.select("_y", "_rank", "_m").collect(), key=lambda r: r["_rank"])]  # five numbers a row
    total = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # two rows
    own = {y: max(1, sum(k == y for _, k in rest)) for y in (0, 1)}
    shift = math.log(total[1] / own[1]) - math.log(total[0] / own[0]) if total.get(0) and total.get(1) else 0.0
    x = np.array([m for m, _ in rest]).reshape(len(rest), 5)
    return Model(words[1], words[0], _logistic(x, np.array([float(y) for _, y in rest]), shift))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """df with the score, 0 to 1, higher for better text. Only the text counts; null is empty, and empty texts get the curve's value at 0 for all measures."""

    def make():
        measured, weights = _measurer(model.good, model.bad), np.array(model.weights)

        def step(texts: list) -> list[list]:
            x = np.array(measured(texts)[0], dtype=float).reshape(len(texts), len(weights) - 1)
            return [1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -500, 500)))]

        return step

    return with_columns(df, text, make, f"{out} double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = crc_mod(F.col("doc_id"), 3) == 1
    return score(docs, model).select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
