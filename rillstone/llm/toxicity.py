"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of words, word pairs and pairs with one word between them, each hashed into
`2 ** bits` buckets. Per-coordinate rates and L1 leave few weights, which are collected (at most one for each bucket)
and broadcast. Labels are learnt from a bounded sample; every text is scored whole.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, table

BITS = 20
#: Bounds of the labelled documents that are learnt from, in number and in characters of their texts together: those whose
#: md5 of doc_id is smallest.
SAMPLE, SAMPLE_CHARS = 16_384, 1 << 28
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
#: Toxic rows are few; their gradients count this much.
TOXIC_WEIGHT = 2.0
#: ASCII characters that separate words besides white space.
BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed features of a text, repeats included; a text without words has none."""
    words = (text or "").lower().encode("utf-8", "replace").translate(BREAKS).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    shift = np.uint64(64 - bits)
    parts = [(h * MIX[0]) >> shift]
    if len(h) > 1:
        parts.append((h[:-1] * MIX[1] + h[1:] * MIX[2]) * MIX[0] >> shift)
    if len(h) > 2:
        parts.append((h[:-2] * MIX[2] + h[2:] * MIX[3]) * MIX[0] >> shift)
    return np.concatenate(parts).astype(np.int32)


def fit(texts, labels, bits: int = BITS, epochs: int = EPOCHS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
    """(bucket, weight) of the weights that are not 0, and the bias. Order of the rows is the order of learning."""
    rows = [np.unique(buckets(t, bits)) for t in texts]
    y = np.asarray(labels, dtype=np.float64)
    prior = (y.sum() + 0.5) / (len(y) + 1.5)
    bias, seen = math.log(prior / (1 - prior)), 1.0
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(epochs):
        for idx, label in zip(rows, y, strict=True):
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2), 0.0)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + bias)))) - label
            g *= TOXIC_WEIGHT if label else 1.0
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[idx] = ni + g * g
            seen += g * g
            bias -= 0.1 * g / math.sqrt(seen)
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    kept = np.flatnonzero(w)
    return kept, w[kept], bias


def score_text(text: str | None, weights: np.ndarray, bias: float, bits: int = BITS) -> float:
    """Probability of label 1; weights: float32 of 2 ** bits. A text without features gets the bias alone."""
    idx = buckets(text, bits)
    hit = idx[weights[idx] != 0]
    total = float(weights[np.unique(hit)].sum(dtype=np.float64)) + bias if len(hit) else bias
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, float]:
    """Weights and bias from documents whose crc32(doc_id as text) mod 5 is not 0.

    Rows without doc_id or label are left out, as are labels of documents that are not there; a doc_id with several labels
    counts as toxic if one says so. Of a doc_id that has several rows in docs the one with the smallest md5 of its text is
    learnt, so that neither repeats nor long texts go beyond the bounds. Without any label the weights are empty and every
    text scores below one half.
    """
    usable = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    usable = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    # the smallest digests lie below a share of all that is a little too large, so few rows of each task are compared
    most = min(1.0, 1.2 * sample / max(1, usable.count()) + 1e-6)
    digest = F.md5(F.col("doc_id").cast("string"))
    share = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))
    ids = (
        usable.where(share <= most)
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
        .orderBy(digest)
        .limit(sample)
    )
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = own.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.md5("text"))).alias("text"))
    # at most `sample` rows, in the order of learning; their lengths are summed before their texts are taken
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).over(Window.orderBy(digest))
    rows = one.withColumn("so_far", so_far).where(F.col("so_far") <= chars).select("text", "label")

    def train(batches):
        texts, ys = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            ys += b.column("label").to_pylist()
        at, w, bias = fit(texts, ys, bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at.tolist()], pa.int32()), pa.array([bias, *w.tolist()], pa.float64())], ["bucket", "weight"]
        )

    found = rows.mapInArrow(train, "bucket int, weight double").collect()
    weights, bias = np.zeros(1 << bits, dtype=np.float32), math.log(0.5 / 1.0)
    for r in found:
        if r.bucket < 0:
            bias = r.weight
        else:
            weights[r.bucket] = r.weight
    return weights, bias


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """docs with __toxicity, from 0 to 1; where docs has such a column, the new one's name ends in underscores. Null and
    empty texts get the bias; other columns pass through untouched. An empty table gives an empty one."""
    weights, bias = learn(docs, labels, sample, bits)
    at = np.flatnonzero(weights).astype(np.int32)
    sparse = docs.sparkSession.sparkContext.broadcast((at.tobytes(), weights[at].tobytes(), bias))
    name = fresh(docs, "__toxicity")

    def score(batches):
        where, values, b0 = sparse.value
        w = np.zeros(1 << bits, dtype=np.float32)
        w[np.frombuffer(where, np.int32)] = np.frombuffer(values, np.float32)
        for b in batches:
            at_text = b.schema.get_field_index("text")
            scores = [score_text(t.as_py(), w, b0, bits) for t in b.column(at_text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])

    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(score, schema)


def toxicity_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are not rejected, with their columns, whatever their names."""
    name = fresh(docs, "__toxicity")
    return toxicity(docs, labels).where(F.col(name) < threshold).drop(name)


def op9_toxicity(spark, sf_dir):
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False)).alias("held_out"),
        F.col("__toxicity").alias("score"),
        F.when(F.col("__toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def toxicity_rows(spark, sf_dir):
    """What op9_toxicity has that SQL can compute too: its rows and which of them are held out."""
    return op9_toxicity(spark, sf_dir).select("doc_id", "held_out", F.col("score").between(0, 1).alias("in_range"))


ROWS_ORACLE = r"""
select doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 5 = 0 as held_out, true as in_range
from documents
"""
