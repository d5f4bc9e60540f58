"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A text is a sequence of words (runs without white space, A-Z lower-cased), and each word also has
a form: case, digits, the punctuation it holds, and whether it repeats the word before. The n-grams
of up to three words and of up to three forms are hashed into ``BUCKETS`` buckets each. The raw
model counts them over all documents; the target model over documents labelled as good, smoothed
towards the raw one. A document's weight is the ratio of its likelihood under the two models.
Documents fall into ``FOLDS`` folds by their text, and a document is weighed by the models of the
other fold: words are so many that a model knows the very texts it counted, and labelled documents
would weigh more than their unlabelled likes. Documents are drawn without replacement in proportion to their weights by adding Gumbel
noise to the log weights and keeping the k largest; k is the number of good documents that the
weights, calibrated on the labelled rows, lead to expect, plus two standard deviations.

All models are tables of 2 * ``BUCKETS`` rows whatever the corpus; the k-th largest key is found by
counting, 16 bits of it at a time, so no keys are gathered.

Defined results: a null or blank text has no n-grams and weight 1; documents whose keys tie with
the k-th are all kept; without labels of both kinds everything is kept; a null doc_id is an id.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.llm.labelled import labelled_sample, logistic
from sitemill.llm.shingles import mix, word_hashes
from sitemill.llm.slices import slices, prepare_workers
from sitemill.session import materialise

BUCKETS = 1 << 16
FOLDS = 2
#: Labelled rows of each kind that are read at most: the target model's text and the calibration's rows.
FIT_ROWS = 20_000
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("a"):ord("z") + 1] = _CLASS[0x80:] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def form_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word's form, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    byte = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    space = _SPACE[byte]
    before = np.r_[True, space[:-1]]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    kind = _CLASS[byte]
    # runs of one class count once, but a run of punctuation shows that it is one
    turn = ~space & (before | np.r_[True, kind[1:] != kind[:-1]])
    again = ~space & ~turn & np.r_[False, turn[:-1]] & (kind != ord("a")) & (kind != ord("A"))
    seen = turn | again
    word = np.cumsum(~space & before) - 1
    at, w = np.flatnonzero(seen), word[seen]
    place = np.arange(len(at)) - np.flatnonzero(np.r_[True, w[1:] != w[:-1]])[w]
    value = mix((kind[at] << np.uint64(1) | again[at].astype(np.uint64)) + np.minimum(place, 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    forms = np.add.reduceat(value, np.flatnonzero(np.r_[True, w[1:] != w[:-1]]))
    whole = np.add.reduceat(mix((byte.astype(np.uint64) + np.uint64(1)) * (np.arange(len(byte), dtype=np.uint64) - starts[np.maximum(word, 0)].astype(np.uint64) + np.uint64(7))) * (~space), starts)
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
    counts = np.diff(np.r_[0, ends])
    repeat = np.r_[False, whole[1:] == whole[:-1]]
    first = (ends - counts)[counts > 0]
    repeat[first] = False
    return np.where(repeat, mix(forms + np.uint64(1)), forms), counts


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of 1 to 3 words, then of every n-gram of 1 to 3 forms, whose buckets follow."""
    owners, buckets = [], []
    for kind, (hashes, counts) in enumerate((word_hashes(texts), form_hashes(texts))):
        text = np.repeat(np.arange(len(texts)), counts)
        gram = hashes
        for n in (1, 2, 3):
            gram = mix(hashes) if n == 1 else mix(gram[:-1] * np.uint64(3) + hashes[n - 1:] + np.uint64(n)) if len(gram) else gram
            same = text[n - 1:] == text[:len(text) - n + 1] if len(text) >= n else np.zeros(0, bool)
            owners.append(text[:len(same)][same])
            buckets.append((gram[:len(same)][same] & np.uint64(BUCKETS - 1)).astype(np.int64) + kind * BUCKETS)
    return np.concatenate(owners), np.concatenate(buckets)


def folds(texts: list[str]) -> np.ndarray:
    """Each text's fold: equal texts have the same."""
    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts], np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts of each fold; each task sends a row for each of its buckets."""
    size = FOLDS * 2 * BUCKETS

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for part in slices(b):
                texts = part["text"].tolist()
                owner, bucket = ngram_buckets(texts)
                total += np.bincount(folds(texts)[owner] * (2 * BUCKETS) + bucket, minlength=size)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used.astype(np.int32), "n": total[used]})

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # FOLDS * 2 * BUCKETS rows at most
    out = np.zeros(size)
    out[rows["bucket"].to_numpy(int)] = rows["n"]
    return out.reshape(FOLDS, 2 * BUCKETS)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw): raw smoothed towards even shares, the target as much by raw shares as by its own counts."""
    share = (raw + 1) / (raw.sum() + len(raw))
    much = max(len(raw), target.sum())
    return np.log((target / share + much) / (target.sum() + much))


def fold_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each fold, the log ratios by the counts of all other folds; words and forms are models of their own."""
    target, raw = (c.sum(axis=0) - c for c in (target, raw))
    return np.array([np.concatenate([log_ratio(t[k:k + BUCKETS], r[k:k + BUCKETS]) for k in (0, BUCKETS)]) for t, r in zip(target, raw)])


def weigher(ratio: np.ndarray):
    """A column function text -> struct(n_grams, log_weight)."""

    @F.pandas_udf("n_grams long, log_weight double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for part in slices(texts):
                part = part.fillna("").tolist()
                owner, bucket = ngram_buckets(part)
                # as many of words as of forms
                parts.append(pd.DataFrame({"n_grams": np.bincount(owner, minlength=len(part)) // 2, "log_weight": np.bincount(owner, ratio[folds(part)[owner], bucket], len(part))}))
            yield pd.concat(parts) if parts else pd.DataFrame({"n_grams": [], "log_weight": []})

    return weigh


def rank(doc_id: Column, weight: Column, seed: int) -> Column:
    """The log weight plus Gumbel noise drawn by a hash of the document, in millionths: an ordered whole number."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, weight["n_grams"], F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return F.round((weight["log_weight"] - F.log(-F.log(uniform))) * 1e6).cast("long")


def kth_largest(table: DataFrame, key: str, k: int) -> int:
    """The k-th largest value of a long column, found from the counts of its leading bits, 16 at a time."""
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        # the sign bit is flipped, so that larger longs have larger bits
        bits = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-2**63)), shift)
        within = table if shift == 48 else table.where(F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-2**63)), shift + 16) == F.lit(prefix))
        counts = within.groupBy(bits.bitwiseAND(F.lit(0xFFFF)).alias("d")).count().orderBy(F.desc("d")).collect()  # 65,536 rows at most
        for r in counts:
            if left <= r["count"]:
                prefix = prefix << 16 | r["d"]
                break
            left -= r["count"]
    return prefix - 2**63


class Draw:
    """Models, threshold and weights of a draw from ``docs``."""

    def __init__(self, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 1):
        prepare_workers(docs)
        self.seed = seed
        sample = labelled_sample(docs, labels, "quality", fit_rows)
        share = labels.where("quality IN (0, 1)").agg(F.avg(F.col("quality").cast("double"))).first()[0]
        raw, target = bucket_counts(docs), bucket_counts(sample.where("y = 1"))
        # where nothing is labelled good, the smoothed target is the raw text and every weight is 1
        self.weigh = weigher(fold_ratios(target, raw))
        table = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), self.weigh(F.col("text").cast("string")).alias("w")), "weights")
        self.table = table.select("doc_id", "w.n_grams", "w.log_weight", rank(F.col("doc_id"), F.col("w"), seed).alias("rank"))
        fit = sample.select("y", self.weigh("text")["log_weight"].alias("log_weight")).toPandas()  # 2 * fit_rows rows at most
        self.least = None  # the least rank that is kept
        if share is not None and fit["y"].nunique() == 2:
            # P(good) = 1 / (1 + exp(-(a + b * log_weight)))
            a, b = logistic(np.c_[np.ones(len(fit)), np.clip(fit["log_weight"], -50, 50)], fit["y"].to_numpy(), share).tolist()
            good = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.least(F.greatest(F.col("log_weight"), F.lit(-50.0)), F.lit(50.0)))))
            n, mean, spread = self.table.agg(F.count("*"), F.sum(good), F.sqrt(F.sum(good * (1 - good)))).first()
            if n:
                self.least = kth_largest(self.table, "rank", max(1, min(n, math.ceil(mean + 2 * spread))))

    def kept(self, rank_: Column) -> Column:
        return F.lit(True) if self.least is None else rank_ >= F.lit(self.least)

    def filter(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that are drawn, all columns; weighed again, so that no text is shuffled."""
        return docs if self.least is None else docs.where(self.kept(rank(docs["doc_id"].cast("long"), self.weigh(docs["text"].cast("string")), self.seed)))


def resample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, key (with the noise), kept."""
    draw = Draw(docs, labels, fit_rows, seed)
    return draw.table.select("doc_id", "n_grams", "log_weight", (F.col("rank") / 1e6).alias("key"), draw.kept(F.col("rank")).alias("kept"))
