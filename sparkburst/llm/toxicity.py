"""Toxicity by compression distance between two zstandard dictionaries.

A window is one word (a run of letters, in lower case). It is compressed twice, with a
dictionary of toxic text and with one of ordinary text; what the toxic dictionary saves
over the ordinary one is the window's distance. A document's evidence is how many of its
windows reach each distance, and a logistic calibration turns that into a score.

Both dictionaries end with the same marker, which also follows every window. A few bytes
alone would be stored raw, and the library looks for no match in an input's last eight
bytes; with the marker behind them, lengths tell apart words of four letters.

The dictionaries' contents are the words and word beginnings that set toxic documents apart
and the most frequent ones of ordinary documents, both counted by documents over the labelled rows. (The
library's own dictionary trainer keeps what is frequent, and toxic words are rare in toxic
text.) Near copies count once, by the least hash of their word 4-grams.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

_WORD = re.compile(r"[^\W\d_]+")
MARKER = bytes(range(128, 160))
#: Distances whose counts are the evidence, and the most words that a worker remembers.
DISTANCES = (1, 2, 3, 4, 5, 6, 7, 8)
#: Lengths of the word beginnings that may enter a dictionary beside whole words.
STEMS = (4, 5, 6, 7)
CACHE_WORDS = 400_000


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """Two dictionaries' contents and the calibration; everything a task needs."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    level: int = 6
    _known: dict = field(default_factory=dict, repr=False)
    _codecs: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_codecs": None}

    def _codec(self, content: bytes):
        parameters = zstandard.ZstdCompressionParameters.from_level(self.level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
        held = zstandard.ZstdCompressionDict(content + MARKER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters).compress

    def distance(self, word: str) -> tuple[int, bool]:
        """Bytes that the toxic dictionary saves on a window over the ordinary one, and if it holds the window whole.

        A window that costs hardly more than the marker alone is one match.
        """
        if self._codecs is None:
            self._codecs = (self._codec(self.ordinary), self._codec(self.toxic))
        word_bytes = b" " + word.encode("utf-8", "replace") + b" "
        ordinary, toxic = (len(c(word_bytes + MARKER)) for c in self._codecs)
        whole = len(word_bytes) >= 7 and toxic <= len(self._codecs[1](MARKER)) + 4
        return ordinary - toxic, whole

    def evidence(self, text: str | None) -> list[float]:
        """The number of windows, the greatest distance, and the windows that reach each of DISTANCES, in all and whole ones."""
        known, found = self._known, words(text)
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(found).difference(known):
            known[word] = self.distance(word)
        far = [d for d in map(known.__getitem__, found) if d[0] >= DISTANCES[0]]
        parts = [[d for d, _ in far], [d for d, whole in far if whole]]
        return [float(len(found)), float(max(parts[0], default=0)), *(float(sum(d >= k for d in part)) for part in parts for k in DISTANCES)]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(evidence))
        x = (_features(evidence) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ self.weights, -30, 30)))


def _features(evidence: np.ndarray) -> np.ndarray:
    n, greatest, counts = evidence[:, :1], evidence[:, 1:2], evidence[:, 2:]
    return np.hstack([np.log1p(n), greatest, np.log1p(counts), np.sqrt(counts / (n + 20))])


def calibrate(model: Model, evidence: np.ndarray, labels: np.ndarray, times: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> None:
    """Fit the logistic calibration by Newton steps, each row counted so many ``times``; with one class only, the score is its share."""
    if not len(labels):
        return
    x = _features(evidence)
    model.centre = np.average(x, axis=0, weights=times)
    model.scale = np.sqrt(np.average((x - model.centre) ** 2, axis=0, weights=times)) + 1e-9
    x = np.column_stack([np.ones(len(x)), (x - model.centre) / model.scale])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w)), x.T @ (times * (labels - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learnt from: crc32 of the id's text is divisible by 5 (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _word_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found, copies = [], []
        for text in f["text"]:
            all_ = words(text)
            grams = (zlib.crc32(" ".join(all_[i : i + 4]).encode("utf-8", "replace")) for i in range(max(1, len(all_) - 3)))
            copies.append(min(grams))
            found.append(list({w[:k] for w in set(all_) for k in (*STEMS, len(w))}))
        yield pd.DataFrame({"toxic": f["toxic"], "doc_id": f["doc_id"], "copies": copies, "words": found})


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, toxic_bytes: int = 32_768, ordinary_words: int = 8_000, least: float = 16.0, ratio: float = 6.0) -> Model:
    """Learn from a bounded sample of labelled rows that aren't held out.

    At most about ``max_labelled`` rows are used, taken by a hash of the label's id and, where
    ids are repeated in ``docs``, of the row. 60 % of them fill the dictionaries, the rest
    calibrate; of those, rows of equal evidence come to the driver as one. A word is toxic if its share of toxic documents is
    over ``ratio`` times its share of ordinary ones and its log-likelihood gain over
    ``least``. Only word counts that reach these bounds come to the driver, at most what the
    dictionaries hold. A document with several labels counts once, as the greatest of them; null ids,
    labels and texts teach nothing; without both classes every score is 0 or the share.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))

    def share_of(n: int, *of: str | Column) -> Column:  # by 40 bits of a hash
        return F.shiftrightunsigned(F.xxhash64(*of), 24) < math.ceil(min(1.0, max_labelled / max(n, 1)) * (1 << 40))

    known = known.where(share_of(known.count(), "doc_id", F.lit("sample")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(known), "doc_id")
    rows = rows.where(share_of(rows.count(), "doc_id", "text", F.lit("row")))
    fill = F.pmod(F.xxhash64("doc_id", F.lit("fill")), F.lit(10)) < 6

    exploded = materialise(rows.where(fill).mapInPandas(_word_rows, "toxic int, doc_id long, copies long, words array<string>"))
    once = exploded.groupBy("toxic", "copies").agg(F.min_by("words", "doc_id").alias("words"))
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    counts = once.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    counts = materialise(counts.where("t > 3 or o > 3"))
    if not n_toxic or not n_other:
        return Model(b"", b"")
    gain = F.log((F.col("t") / n_toxic) / ((F.col("o") + 0.5) / n_other))
    strong = counts.where((gain > math.log(ratio)) & (F.col("t") * gain > least)).orderBy(F.desc(F.col("t") * gain), "word").limit(toxic_bytes // 4).select("word", "t").collect()
    usual = counts.where("o > 3").orderBy(F.desc("o"), "word").limit(ordinary_words).select("word").collect()
    join = lambda found: b"".join(b" " + r["word"].encode() for r in reversed(found))  # noqa: E731  the strongest last: near matches are the cheapest
    model = Model(join(strong)[-toxic_bytes:], join(usual))

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"toxic": f["toxic"], "evidence": [model.evidence(t) for t in f["text"]]})

    seen = rows.where(~fill).mapInPandas(weigh, "toxic int, evidence array<double>").groupBy("toxic", "evidence").count().toPandas()
    if len(seen):
        calibrate(model, np.array(seen["evidence"].tolist()), seen["toxic"].to_numpy(float), seen["count"].to_numpy(float))
    return model


def score_column(model: Model) -> Column:
    """The score of a text column; null and empty texts have that of a text without windows."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([model.evidence(t) for t in texts]).reshape(len(texts), 2 * len(DISTANCES) + 2)))

    return score("text")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Null and repeated ids and equal rows give a row each; whole texts are scored, however
    long; further columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted to be toxic.

    All columns stay, whatever their names; null and empty texts have the score of a text
    without windows and stay as long as that is under 0.5; equal rows share their fate; an
    empty table stays empty.
    """
    model = train(docs, labels)
    return docs.where(score_column(model) < 0.5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels that aren't held out; cases as in ``score_documents``."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
