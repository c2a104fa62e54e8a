"""Language identification by the nearest of several centroids per language.

A text is the normalised TF-IDF vector of its hashed n-grams of 1 to 3 bytes of UTF-8 (inside words, ASCII case aside).
Document frequencies come from all rows that may be learned from. Centroids are fitted by spherical k-means on a bounded
sample of different texts per language; a cluster of few rows is given up, and its rows go to the nearest other one; so is
a cluster that is nearer to another language's mean than to its own, whose rows are taken to be labelled wrongly. A text
gets the language of the centroid with the largest cosine. It is rejected where it is too far from that centroid: below
a share of the least cosines that the sample's texts have, whole ones and stretches of them, that hold about as many different n-grams. So short texts
are held to short texts.

Edge cases: a null or empty text, or one without a letter, is `und` with score 0 and rejected; other rows, repeated ones
included, are judged each on their own text; rows with null language teach nothing; without any labelled row all
texts are `und`; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut_lineage, lean, small_batches, text_chunks

UND = "und"
#: Bounds of the fitted sample, documented: different texts of each language, lowest hash of the text first.
SAMPLE_ROWS, CENTROIDS, DIMENSIONS = 600, 4, 4096
#: The least part of a language's sample that a cluster is made of.
LEAST_CLUSTER = 0.02
#: A text is rejected below this share of the cosine that all but a 200th of the sample's texts of its size reach.
MARGIN, QUANTILE = 0.6, 0.005
#: Bytes of the stretches of sample texts that tell how near short texts are.
STRETCHES = (12, 25, 50, 100, 200, 400, 800, 1600)
#: Bytes of text at once, for the arrays of n-grams.
CHUNK = 400_000
_U = np.uint64

#: Bytes that are no part of a word: ASCII other than letters. All bytes of a multi-byte character are.
OUTSIDE = np.ones(256, bool)
OUTSIDE[0x41:0x5B] = OUTSIDE[0x61:0x7B] = False
OUTSIDE[0x80:] = False


def gram_counts(data: np.ndarray, offsets: np.ndarray, dimensions: int) -> np.ndarray:
    """(documents, dimensions) counts of hashed byte n-grams of 1 to 3 (with one blank at either side of a word)."""
    n = len(offsets) - 1
    out = np.zeros((n, dimensions), np.float32)
    if not len(data):
        return out
    low = LOWER[data].astype(np.uint32)
    low[OUTSIDE[data]] = 0
    doc = np.repeat(np.arange(n), np.diff(offsets))
    two = (low[:-1] << 8) | low[1:]
    three = (two[:-1] << 8) | low[2:]
    salt = np.uint32(0x9E3779B1)
    for size, grams in ((1, low), (2, two), (3, three)):
        here = doc[: len(grams)]
        middle = low[: len(grams)] if size == 1 else low[1 : 1 + len(grams)] if size == 3 else grams
        use = (middle != 0) & (doc[size - 1 :] == here)
        slot = ((grams[use] * np.uint32(4) + np.uint32(size)) * salt) >> np.uint32(32 - dimensions.bit_length() + 1)
        at = here[use]
        edges = np.searchsorted(at, np.arange(n + 1))
        for d in range(n):
            if edges[d] < edges[d + 1]:
                out[d] += np.bincount(slot[edges[d] : edges[d + 1]], minlength=dimensions)
    return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of (1 + log tf) * idf; a zero vector stays zero."""
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.maximum(norm, 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    floors: np.ndarray  # of texts with up to 2, 4, 8, ... different n-grams, the cosine that nearly all of the sample reach


def document_frequencies(docs: DataFrame, text_col: str, dimensions: int) -> tuple[np.ndarray, int]:
    """How many of all rows hold each n-gram slot, and the number of rows; each task sums before one narrow shuffle."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(dimensions, np.int64), 0
        for b in batches:
            for first, last, data, offsets in text_chunks(b.column(0), CHUNK):
                df += (gram_counts(data, offsets, dimensions) > 0).sum(0)
                rows += last - first
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1)), pa.array(np.append(df, rows))], names=["slot", "n"])

    found = small_batches(docs).select(text_col).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(dimensions + 1, np.int64)
    out[found["slot"]] = found["n"]
    return out[:-1], int(out[-1])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, least: float = LEAST_CLUSTER) -> np.ndarray:
    """At most k centroids of unit rows; starts from rows far from each other, and gives up clusters of a few rows."""
    k = min(k, len(x))
    chosen = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[chosen[0]]
    for _ in range(k - 1):
        # not the farthest row, which may be alone, but one that many rows as far away are like
        far = np.argsort(near, kind="stable")[: max(8, len(x) // 20)]
        chosen.append(int(far[np.argmax((x[far] @ x[far].T).sum(1))]))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for step in range(rounds):
        own = np.argmax(x @ c.T, 1)
        sizes = np.bincount(own, minlength=len(c))
        if step > rounds // 2 and len(c) > 1 and (sizes < least * len(x)).any():
            c = c[sizes >= max(least * len(x), 1)]
            own = np.argmax(x @ c.T, 1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(0)
                c[j] /= max(np.linalg.norm(c[j]), 1e-12)
    return c.astype(np.float32)


def size_class(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for up to 2, 4, 8, ... different n-grams of each row of counts."""
    different = np.maximum((counts > 0).sum(1), 1)
    return np.maximum(np.ceil(np.log2(different)).astype(int) - 1, 0)


def floors_by_size(cosines: np.ndarray, sizes: np.ndarray, classes: int, quantile: float = QUANTILE) -> np.ndarray:
    """Of each size class, the cosine below which that share of the sample's texts lie; never less for more n-grams."""
    out = np.zeros(classes)
    for j in range(classes):
        own = cosines[sizes == j]
        out[j] = np.quantile(own, quantile) if len(own) >= 20 else np.nan
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return np.zeros(classes)
    out = np.interp(np.arange(classes), known, out[known], left=0.0)
    return np.minimum.accumulate(out[::-1])[::-1]


def stretches(texts: list[bytes]) -> list[bytes]:
    """Beginnings of whole words of the texts, of each of some lengths; the model alone learns from them."""
    out = []
    for n in STRETCHES:
        for t in texts:
            cut = t.find(b" ", n) if len(t) > n else -1
            if cut > 0:
                out.append(t[:cut])
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS, dimensions: int = DIMENSIONS) -> Model:
    """A model from labelled rows: document frequencies over all of them, centroids from at most sample_rows different texts a language."""
    labelled = labelled.filter(F.col(lang_col).isNotNull())
    df, rows = document_frequencies(labelled, text_col, dimensions)
    idf = (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)
    ranked = labelled.filter(has_letter(F.col(text_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # a bounded sample by a threshold on a hash: different texts are counted per language first, so that few are ever moved
    sizes = {r["lang"]: r["n"] for r in ranked.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return Model(idf, np.zeros((0, dimensions), np.float32), [], np.zeros(1))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.6 * sample_rows / max(n, 1) + 30 / max(n, 1)))).otherwise(share)
    u = F.pmod(F.xxhash64("h", F.lit(5)), F.lit(1_000_003)) / 1_000_003
    few = cut_lineage(ranked.filter(u < share).dropDuplicates(["lang", "h"]).select("lang", "h", "text"))

    @lean
    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("whole", pa.bool_()), ("v", pa.binary()), ("size", pa.int32())])
        for b in batches:
            for lang, h, text in zip(*(b.column(c).to_pylist() for c in ("lang", "h", "text"))):
                raw = text.encode()
                own = [raw, *stretches([raw])]
                counts = gram_counts(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]), dimensions)
                v, size = weighted(counts, idf).astype(np.float16), size_class(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([h] * len(own)), pa.array([True] + [False] * (len(own) - 1)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(size, pa.int32())], schema=schema)

    vectors = few.mapInArrow(vectorise, "lang string, h long, whole boolean, v binary, size int")
    # bounded: about sample_rows texts a language, and for the floors the cosines of their stretches
    kept: dict[str, list] = {}
    for r in vectors.filter("whole").collect():
        kept.setdefault(r["lang"], []).append((r["h"], bytes(r["v"])))
    unpacked = lambda rows_: np.stack([np.frombuffer(v, np.float16) for v in rows_]).astype(np.float32)
    samples = {lang: unpacked([v for _, v in sorted(kept[lang])[:sample_rows]]) for lang in sorted(kept)}
    means = np.stack([np.median(x, 0) if len(x) > 2 else x.mean(0) for x in samples.values()])
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    found, languages = [], []
    for j, (lang, x) in enumerate(samples.items()):
        c = spherical_kmeans(x, centroids)
        at_home = (c @ means.T).argmax(1) == j
        c = c[at_home] if at_home.any() else c
        found.append(c)
        languages += [lang] * len(c)
    model = Model(idf, np.concatenate(found), languages, np.zeros(1))
    owner = {lang: np.array([x == lang for x in languages]) for lang in sizes}

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cos = unpacked(b.column("v").to_pylist()) @ model.centroids.T
                own = np.stack([owner[x] for x in b.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("size"), pa.array(np.where(own, cos, -1).max(1).astype(float))], names=["size", "cos"])

    measured = vectors.mapInArrow(measure, "size int, cos double").toPandas()
    model.floors = floors_by_size(measured["cos"].to_numpy(), measured["size"].to_numpy(), dimensions.bit_length())
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score (cosine of the nearest centroid, 0 to 1) and rejected, which replace columns of these names."""
    dimensions = len(model.idf)
    out = "pred struct<lang:string, score:double, rejected:boolean>"
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    @lean
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model  # bounded: languages * centroids * dimensions
        for b in batches:
            letters = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_chunks(b.column(at), CHUNK):
                n, ok = last - first, letters[first:last]
                if m.languages:
                    counts = gram_counts(data, offsets, dimensions)
                    cos = weighted(counts, m.idf) @ m.centroids.T
                    best = cos.argmax(1)
                    top = np.clip(cos[np.arange(n), best], 0, 1).astype(float)
                    langs, scores, gone = [m.languages[j] if good else UND for j, good in zip(best, ok)], np.where(ok, top, 0.0), ~ok | (top < margin * m.floors[np.minimum(size_class(counts), len(m.floors) - 1)])
                else:
                    langs, scores, gone = [UND] * n, np.zeros(n), np.ones(n, bool)
                pred = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(gone)], names=["lang", "score", "rejected"])
                part = b.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pred], names=[*part.schema.names[:-1], "pred"])

    keep = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    at = columns.index(text_col)
    rows = small_batches(docs).select(*keep, has_letter(F.col(text_col)).alias("its letters"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    judged = rows.mapInArrow(judge, f"{fields}, {out}")
    return judged.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.col("pred.lang").alias("lang_pred"), F.col("pred.score").alias("score"), F.col("pred.rejected").alias("rejected"))
