"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte trigrams of the lower-cased text, as a unit vector. The machines are fitted here on a bounded
sample of labelled rows; every row is then predicted where it was read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, in_slices, mix

#: ISO 639-1 codes by language family. A label outside it is a family by itself.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga cy gd br".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn mr pa gu ur ne".split(),
    "semitic": "ar he mt am".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
UNKNOWN = "und"


def vectors(strings: pa.Array, size: int) -> np.ndarray:
    """A row of hashed trigram counts for each text, scaled to unit length (no trigram: zeros)."""
    raw, offsets = as_bytes(pc.utf8_lower(strings))
    out = np.zeros((len(strings), size), np.float32)
    n = len(raw)
    if n < 3:
        return out
    space = raw <= 32
    low = np.where(space, 32, raw).astype(np.uint64)
    gram = low[: n - 2] | low[1 : n - 1] << np.uint64(8) | low[2:] << np.uint64(16)
    doc = np.repeat(np.arange(len(strings)), np.diff(offsets))
    same = (doc[: n - 2] == doc[2:]) & ~(space[: n - 2] & space[1 : n - 1])
    slot = (mix(gram[same]) % np.uint64(size)).astype(np.int64)
    counts = np.bincount(doc[: n - 2][same] * size + slot, minlength=len(strings) * size)
    out = counts.reshape(len(strings), size).astype(np.float32)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def support_vectors(x: np.ndarray, y: np.ndarray, c: float, steps: int) -> np.ndarray:
    """Weights and bias of the machine that parts y = 1 from y = -1: squared hinge loss, accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c
    w = v = np.zeros(x.shape[1], np.float32)
    rate, t = 1 / (1 + 2 * 2 * c), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * x.T @ (weight * slack * y))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + np.float32((before - 1) / t) * (new - w), new
    return w


def one_versus_one(x: np.ndarray, label: np.ndarray, classes: list[str], c: float, steps: int) -> list[tuple[int, int, np.ndarray]]:
    out = []
    for a, b in combinations(range(len(classes)), 2):
        rows = (label == classes[a]) | (label == classes[b])
        out.append((a, b, support_vectors(x[rows], np.where(label[rows] == classes[a], 1, -1).astype(np.float32), c, steps)))
    return out


def vote(x: np.ndarray, machines: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The class with the most votes (ties: the larger sum of margins, then the first), and its mean share of the pairs it is in."""
    won, share = np.zeros((len(x), n)), np.zeros((len(x), n))
    for a, b, w in machines:
        p = 1 / (1 + np.exp(-np.clip(3 * (x @ w[:-1] + w[-1]), -50, 50)))
        won[:, a] += p >= 0.5
        won[:, b] += p < 0.5
        share[:, a] += p
        share[:, b] += 1 - p
    best = np.argmax(won + share / (2 * max(1, n)), 1)
    return best, share[np.arange(len(x)), best] / max(1, n - 1) if n > 1 else np.ones(len(x))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, size: int = 1 << 13, c: float = 100.0, steps: int = 150) -> dict:
    """The model from a sample of about ``per_lang`` different texts of each language, and never over twice as many, chosen by a hash of the text (all where there are fewer).

    Rows with a null text or language are left out; an empty table gives a model that knows no language. Only the sample's
    sparse vectors reach the driver: at most 2 x ``per_lang`` x languages x ``size`` numbers, whatever the table's size, its
    texts' lengths and its copies."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("key", F.xxhash64("text"))
    shares = {r["lang"]: min(1.0, per_lang / r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    classes = sorted(shares)
    if not classes:
        return {"families": [], "langs": {}, "first": [], "within": {}, "size": size}
    share = F.create_map(*[F.lit(x) for k in classes for x in (k, shares[k])])[F.col("lang")]
    picked = rows.where(F.pmod(F.xxhash64("key", F.lit("pick")), F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["key", "lang"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key", F.lit("pick")), "key"))
    picked = picked.withColumn("nth", nth).where(F.col("nth") <= 2 * per_lang).drop("nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, rows=500):
            x = vectors(b.column("text"), size)
            at = [np.flatnonzero(r) for r in x]
            out = [b.column("key"), b.column("lang"), pa.array([i.astype(np.int32) for i in at], pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(x, at, strict=True)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(out, names=["key", "lang", "at", "value"])

    sample = picked.mapInArrow(run, "key long, lang string, at array<int>, value array<float>").toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])
    x = np.zeros((sample.num_rows, size), np.float32)
    at, values = sample.column("at").combine_chunks(), sample.column("value").combine_chunks()
    if sample.num_rows:
        x[np.repeat(np.arange(sample.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = values.flatten().to_numpy()
    label = np.array(sample.column("lang").to_pylist(), dtype=object)
    family = np.array([FAMILY_OF.get(k, "other " + k) for k in label], dtype=object)
    families = sorted({FAMILY_OF.get(k, "other " + k) for k in classes})
    langs = {f: [k for k in classes if FAMILY_OF.get(k, "other " + k) == f] for f in families}
    within = {f: one_versus_one(x[family == f], label[family == f], langs[f], c, steps) for f in families}
    return {"families": families, "langs": langs, "first": one_versus_one(x, family, families, c, steps), "within": within, "size": size}


def predict(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for every row, with the columns ``keep`` unchanged.

    ``und`` with score 0 where the text is null, empty or without a letter, or where the model knows no language. Repeated
    rows stay, and an empty table gives no rows. A kept column that is named like one of the results comes as ``<name>_in``. The text alone decides; of families or languages with equal votes the one with
    the larger sum of margins wins, then the first by name. Whole texts are read, a bounded slice or one very long text at a time."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x (languages + 1) weight vectors of ``size`` numbers

    wanted = [c for c in keep or [] if c != id_col]
    own = text_col not in wanted or dict(df.dtypes)[text_col] != "string"  # else the text crosses to Python once, as a kept column
    names = {c: f"k{i}" for i, c in enumerate(wanted)}  # no name of the table can clash on the way
    column = "_text" if own else names[text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in in_slices(batches, column, rows=500):
            text = b.column(column)
            n = b.num_rows
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            good = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if m["families"] and good.any():
                x = vectors(text, m["size"])
                family, sure = vote(x, m["first"], len(m["families"]))
                for k, f in enumerate(m["families"]):
                    rows = np.flatnonzero(good & (family == k))
                    if len(rows):
                        best, inner = vote(x[rows], m["within"][f], len(m["langs"][f]))
                        lang[rows] = np.array(m["langs"][f], object)[best]
                        score[rows] = np.clip(sure[rows] * inner, 0, 1)
            kept = [x for x in b.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in kept], pa.array(lang, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    cols = [F.col(id_col).cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(k) for c, k in names.items()], *[F.col(text_col).cast("string").alias("_text")] * own]
    rows = df.select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    out = rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
    results = ("doc_id", "lang_pred", "score")
    return out.select("doc_id", *[F.col(k).alias(f"{c}_in" if c in results else c) for c, k in names.items()], "lang_pred", "score")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text leaves no remainder; a null id is an empty text, whose crc32 is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == 0
