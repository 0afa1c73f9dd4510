"""Compression of vectors to short codes: product quantisation by Lloyd rounds with Hamerly's bounds.

Vectors of integers are cut into equal parts, and each part's place has its own codebook. For
every part two numbers are kept from round to round: an upper bound of the distance to its
entry and a lower bound of the distance to the second-nearest one. When entries move, the
bounds move by as much. A part whose upper bound is strictly less than the lower bound, or
than half the way from its entry to the next one, keeps its entry. Otherwise the upper
bound is made exact, and if that fails too, all entries are compared in integers; equal
distances go to the lower index. So bounds save work and never decide a tie.

Each round reads the rows with their bounds and writes them anew, then the former table goes.
The sums of the parts of each entry travel in a column of their own that holds one value a
batch, so the new codebook is read from that column alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, stored_step, table
from .vectors import finite_vectors, greatest_width, padded_matrix

#: How far a bound of 32 bits may lie from what doubles give, relative to it.
_SLACK = 1e-6
#: Parts of a label's sum where labels are too many to be broadcast.
SALTS = 64


@dataclass(frozen=True)
class Codebooks:
    """Entries (part, entry, position) as integers, before and after the last round."""

    now: np.ndarray
    before: np.ndarray | None = None

    def moved(self) -> np.ndarray:
        """How far each entry went (part, entry), rounded up."""
        if self.before is None:
            return np.zeros(self.now.shape[:2])
        return np.sqrt(((self.now - self.before) ** 2).sum(axis=2).astype(float)) * (1 + _SLACK)

    def halves(self) -> np.ndarray:
        """Half the distance from each entry to the nearest other one, rounded down."""
        apart = ((self.now[:, :, None, :] - self.now[:, None, :, :]) ** 2).sum(axis=3).astype(float)
        apart[:, np.arange(apart.shape[1]), np.arange(apart.shape[1])] = np.inf
        return np.sqrt(apart.min(axis=2)) / 2 * (1 - _SLACK)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.now.ravel().tolist())).encode()).hexdigest()


def integer_vectors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); integers end where sums of their squared differences would need more than 64 bits."""
    most = 2.0 ** ((62 - int(np.ceil(np.log2(max(x.shape[1], 2))))) // 2 - 1)
    return np.clip(np.floor(scale * x), -most, most).astype(np.int64)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries and bounds of rows (row, part, position) after the entries moved, and how many parts met all entries."""
    own, upper, lower, scanned = own.copy(), upper.copy(), lower.copy(), 0
    moved, halves = books.moved(), books.halves()
    for p in range(x.shape[1]):
        entries, o = books.now[p], own[:, p]
        far = np.argsort(moved[p])
        most = moved[p][far[-1]]
        most = np.where(o == far[-1], moved[p][far[-2]] if len(far) > 1 else 0.0, most)
        u = upper[:, p] + moved[p][o]
        low = np.maximum(lower[:, p] - most, 0)
        bound = np.maximum(low, halves[p][o])
        todo = np.flatnonzero(~(u < bound))
        if len(todo):
            u[todo] = np.sqrt(((x[todo, p] - entries[o[todo]]) ** 2).sum(axis=1).astype(float)) * (1 + _SLACK)
            todo = todo[~(u[todo] < bound[todo])]
        if len(todo):
            scanned += len(todo)
            part = x[todo, p]
            d = (part**2).sum(axis=1)[:, None] - 2 * part @ entries.T + (entries**2).sum(axis=1)[None, :]
            first = d.argmin(axis=1)
            own[todo, p] = first
            u[todo] = np.sqrt(d[np.arange(len(todo)), first].astype(float)) * (1 + _SLACK)
            if len(entries) > 1:
                d[np.arange(len(todo)), first] = np.iinfo(np.int64).max
                low[todo] = np.sqrt(d.min(axis=1).astype(float)) * (1 - _SLACK)
            else:
                low[todo] = np.inf
        upper[:, p], lower[:, p] = u, low
    return own, upper, lower, scanned


def part_sums(x: np.ndarray, own: np.ndarray, entries: int) -> np.ndarray:
    """Per part and entry the sums of its parts' components, and behind them how many there are."""
    out = np.zeros((x.shape[1], entries, x.shape[2] + 1), np.int64)
    for p in range(x.shape[1]):
        np.add.at(out[p, :, :-1], own[:, p], x[:, p])
        out[p, :, -1] = np.bincount(own[:, p], minlength=entries)
    return out


_STATE = "vec_id long, label {label}, x binary, own binary, upper binary, lower binary, sums binary"


def _start(width: int, scale: int, parts: int):
    """Rows (vec_id, label, v) with integer vectors, and bounds that hold for any codebook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integer_vectors(padded_matrix(batch.column("v"), width), scale).astype("<i4")
            n = batch.num_rows
            fixed = [np.zeros(parts, "<i2").tobytes(), np.full(parts, np.inf, "<f4").tobytes(), np.zeros(parts, "<f4").tobytes()]
            columns = [pa.array([r.tobytes() for r in x], pa.binary()), *(pa.array([c] * n, pa.binary()) for c in fixed), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], ["vec_id", "label", "x", "own", "upper", "lower", "sums"])

    return run


def _columns(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, ...]:
    read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, parts, -1)
    return read("x", "<i4").astype(np.int64), read("own", "<i2")[:, :, 0].astype(np.int64), read("upper", "<f4")[:, :, 0].astype(float), read("lower", "<f4")[:, :, 0].astype(float)


def _round(books: Codebooks, parts: int):
    """The rows with their entries and bounds after ``books`` moved; each batch's first row has the batch's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own, upper, lower = _columns(batch, parts)
            own, upper, lower, _ = assign(x, own, upper, lower, books)
            up, down = np.nextafter(upper.astype("<f4"), np.float32(np.inf)), np.nextafter(lower.astype("<f4"), np.float32(-np.inf))
            sums = [part_sums(x, own, books.now.shape[1]).tobytes(), *[None] * (batch.num_rows - 1)]
            as_bytes = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), as_bytes(own.astype("<i2")), as_bytes(up), as_bytes(down), pa.array(sums, pa.binary())], batch.schema.names)

    return run


def _final(books: Codebooks, parts: int):
    """(vec_id, label, code, error) of the rows after a last assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own, upper, lower = _columns(batch, parts)
            own, _, _, _ = assign(x, own, upper, lower, books)
            error = ((x - books.now[np.arange(parts)[None, :], own]) ** 2).sum(axis=(1, 2))
            code = ["".join(f"{i:02x}" for i in row) for row in own.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def _added(shape: tuple[int, ...]):
    """The sums of a partition's batches as rows (slot, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(np.prod(shape)), np.int64)
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                total += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["slot", "total"])

    return run


def _moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at their parts' means, rounded down; unused ones stay. As many numbers as the codebooks hold come to the driver."""
    shape = (*books.now.shape[:2], books.now.shape[2] + 1)
    rows = state.select("sums").where("sums is not null").mapInArrow(_added(shape), "slot long, total long")
    total = np.zeros(int(np.prod(shape)), np.int64)
    for slot, value in rows.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        total[slot] = value
    total = total.reshape(shape)
    count = total[:, :, -1:]
    return Codebooks(np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books.now), books.now)


def code_vectors(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of the rows (vec_id, embedding, label), and the codebooks; cases as in ``coded_table``."""
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    kept = finite_vectors(named, "v")
    width = -(-max(greatest_width(kept, "v"), 1) // parts) * parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()["v"].combine_chunks()
    start = integer_vectors(padded_matrix(first, width), scale).reshape(len(first), parts, width // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    schema = _STATE.format(label=kept.schema["label"].dataType.simpleString())
    state, path = stored_step(kept.mapInArrow(_start(width, scale, parts), schema))
    if len(first):
        for _ in range(rounds):
            now, place = stored_step(state.mapInArrow(_round(books, parts), schema))
            discard(rows.sparkSession, path)
            state, path, books = now, place, _moved(now, books)
    coded = materialise(state.mapInArrow(_final(books, parts), f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"))
    discard(rows.sparkSession, path)
    return coded, books


def coded_table(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, most_labels: int = 1 << 16) -> DataFrame:
    """Per row of (vec_id, embedding, label): vec_id, code, error, label_error and the codebooks' digest.

    Vectors that are null or hold null or non-finite components are left out; shorter vectors
    count as padded with zeros to the longest and to a multiple of ``parts``. Codebooks start
    with the ``entries`` smallest ids (null ids last, equal ids by their vectors), fewer if
    there are fewer rows. Null and repeated ids, equal rows and ties are rows like others;
    null labels are one label. Components end at 2^27 in widths up to 64 (less in wider
    ones), and label sums at the greatest long. More than ``most_labels`` sums aren't broadcast. Further columns are ignored; without rows to
    keep, none are returned.
    """
    coded, books = code_vectors(rows, parts, entries, rounds)
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = materialise(sums)
    if sums.count() <= most_labels:
        out = coded.join(F.broadcast(sums.withColumnRenamed("label", "_label")), F.col("label").eqNullSafe(F.col("_label")))
    else:  # a label's rows go to SALTS parts
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
        spread = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
        out = coded.withColumn("_salt", salt).join(spread, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_part")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 8 parts and 16 entries, after 6 rounds, of all embeddings; cases as in ``coded_table``."""
    return coded_table(table(spark, sf_dir, "embeddings"), 8, 16, 6)
