"""N-gram Jaccard join of documents by grouped prefixes.

1. Every document becomes its set of distinct word shingles; equal sets are one node.
2. Shingles have one global order: by hash, with those that many documents share last. Two
   sets with Jaccard similarity t share a shingle among the first n - ceil(t n) + 1 of each
   (the prefix). Any order is right; putting frequent shingles last keeps the lists short.
3. Nodes with the same size and prefix are collapsed into a group: members are verified
   against the leader, and those that link to it are carried by it; others stay alone.
4. Groups that meet in a prefix shingle are candidates. A list of groups is not expanded
   into its pairs: first each group of a long list is tried against the list's first one,
   then, of each component of connected groups, its nearest pair with another, then all
   pairs that are left.
5. Group pairs are filtered by size and by parity bitmaps: a bit that differs is caused by
   an element of one set only, which bounds the overlap from above, less the distance of a
   group's members from their leader. What passes is expanded to its members, whose own
   bitmaps are compared, and what passes again is verified by the sets themselves.

No key goes to one task as a whole: copies, groups with one prefix and components are
reduced in salted parts (``least_of``); shingles that many documents share are summed
before they are shuffled; long lists are dealt by blocks; and a text that is compared with
many others goes once to each block of them (``verify``).

So each candidate is either refuted by an exact bound, verified, or already known to be in
the same component, and no link between different texts is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialise, narrow, stored_step, table
from .components import connected
from .shingles import mix64, shingle_sets

#: Bytes of text that are hashed at once, and members of a list that are compared in one task.
SLICE_BYTES, LIST_BLOCK = 1 << 19, 512
#: Shingles that are counted at once in a task.
HELD_SHINGLES = 1_000_000
#: Lists of at most so many groups need no star: all their pairs are tried.
SMALL_LIST = 2
#: Shares of the shingles that are shuffled one after the other (a power of two).
SHINGLE_PARTS = 4
#: Texts that meet one copy of another text, rows of one part of a list, and parts of a key.
STAR_BLOCK, LIST_PART, SALTS = 128, 1024, 256


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(column)]
    return zip(edges[:-1], edges[1:])


def frequent_shingles(docs: DataFrame, k: int, share: float, most: int = 1_000_000) -> np.ndarray:
    """Shingles that about ``share`` of the documents or more hold, rarest first.

    Tasks count documents per shingle over some thousand rows at a time and pass on those that
    reach half the share there; the counts are added up over all documents. The result orders
    shingles and nothing else, and at most (mean set size / share) of them can exist.
    """

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        kept = n >= max(3, len(sets) * share / 2)
        return pa.RecordBatch.from_arrays([pa.array(found[kept].view(np.int64)), pa.array(n[kept].astype(np.int64))], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                held += shingle_sets(batch.column(0).slice(a, b - a), k)
                size += sum(map(len, held[a - b :]))
                if size > HELD_SHINGLES:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= max(4, docs.count() * share / 2)).orderBy(F.desc("n"), "shingle").limit(most).toPandas()
    return counts["shingle"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """One bit per residue: the parity of the elements that have it. At least one bit an element."""
    bits = max(64, 1 << int(len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def bitmap_distance(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps, the longer one folded: at most the size of the sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def allowed_difference(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The greatest symmetric difference of linked sets of sizes a and b, or -1 if none can link."""
    overlap = -(-percent * (a + b) // (100 + percent))
    return np.where(overlap <= np.minimum(a, b), a + b - 2 * overlap, -1)


def least_of(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the least ``value`` of the rows with the same ``keys``.

    Each key is cut into ``SALTS`` parts by a hash of the value; only one row a part meets
    the others of its key, so a key that holds a third of all rows is no single task's work.
    """
    salted = rows.withColumn("_value", value).withColumn("_salt", F.pmod(F.xxhash64("_value"), F.lit(SALTS)))
    parts = salted.groupBy(*keys, "_salt").agg(F.min("_value").alias("_part"))
    whole = parts.groupBy(*keys).agg(F.min("_part").alias(name))
    return salted.drop("_value").join(parts.join(whole.hint("merge"), keys).drop("_part").hint("merge"), [*keys, "_salt"]).drop("_salt")


def sketch_documents(docs: DataFrame, k: int, percent: int, last: np.ndarray) -> DataFrame:
    """Per row of (rid, doc_id, text): set size n, set digest, prefix with its digest, how many of it are not in ``last``, and bitmap."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = shared.value
        by = np.argsort(ranked)
        sorted_ = ranked[by]
        for batch in batches:
            text = batch.column("text")
            for a, b in _slices(text):
                n, s1, s2, sp, prefix, rare, bitmap = [], [], [], [], [], [], []
                for s in shingle_sets(text.slice(a, b - a), k):
                    n.append(len(s))
                    if len(sorted_) and len(s):
                        at = np.minimum(np.searchsorted(sorted_, s), len(sorted_) - 1)
                        held = sorted_[at] == s
                        order = np.concatenate([s[~held], ranked[np.sort(by[at[held]])]])
                        few = int(len(s) - held.sum())
                    else:
                        order, few = s, len(s)
                    p = order[: len(s) - -(-percent * len(s) // 100) + 1] if len(s) else s
                    s1.append(np.bitwise_xor.reduce(s, initial=0))
                    s2.append(mix64(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64))
                    sp.append(mix64(p ^ np.uint64(0xB5026F5AA)).sum(dtype=np.uint64))
                    prefix.append(p.view(np.int64))
                    rare.append(min(few, len(p)))
                    bitmap.append(parity_bitmap(s) if len(s) else b"")
                digests = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2, sp)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(n, pa.int64()), *digests, pa.array(prefix, pa.list_(pa.int64())), pa.array(rare, pa.int32()), pa.array(bitmap, pa.binary())], ["rid", "doc_id", "n", "s1", "s2", "sp", "prefix", "rare", "bitmap"])

    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, n long, s1 long, s2 long, sp long, prefix array<long>, rare int, bitmap binary")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of row ids those whose texts link, with the size of their symmetric difference.

    The b's of an a are dealt to blocks of about ``STAR_BLOCK``. Each block gets the text of
    its a once, ahead of the b's, so a task holds one set and the batch at hand, however
    many pairs an a has.
    """
    pairs = materialise(pairs.select("a", "b"))
    large = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > STAR_BLOCK).select("a", F.ceil(F.col("_c") / STAR_BLOCK).alias("_parts")))
    dealt = pairs.join(narrow(large), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1))).cast("int").alias("part"))
    heads = dealt.select("a", "part").distinct()
    wanted = materialise(dealt.select(F.col("b").alias("rid"), "a", "part", F.lit(True).alias("member")).union(heads.select(F.col("a").alias("rid"), "a", "part", F.lit(False).alias("member"))))
    sent = texts.select("rid", "text").join(narrow(wanted, BROADCAST_ROWS // 2), "rid").repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            ids, keys, member, text = batch.column("rid").to_pylist(), batch.column("a").to_pylist(), batch.column("member").to_pylist(), batch.column("text")
            out = []
            for i, j in _slices(text):
                for at, own in enumerate(shingle_sets(text.slice(i, j - i), k), i):
                    if not member[at]:
                        head = own
                        continue
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    union = len(head) + len(own) - both
                    if 100 * both >= percent * union:
                        out.append((keys[at], ids[at], union - both))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["a", "b", "apart"])

    return materialise(sent.select("rid", "a", "member", "text").mapInArrow(run, "a long, b long, apart long"))


def _near_pairs(percent: int):
    """Of pairs with sizes, radii and bitmaps those that no bound refutes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            most = allowed_difference(f["n"].to_numpy(), f["m"].to_numpy(), percent)
            slack = (f["r"] + f["q"]).to_numpy()
            kept = [w >= 0 and bitmap_distance(x, y) - s <= w for w, s, x, y in zip(most, slack, f["x"], f["y"])]
            yield f.loc[kept, ["a", "b"]]

    return run


def _pairs_of_list(n, radius, comp, g, side, maps, pivot: int, percent: int, nearest: bool) -> list[tuple[int, int]]:
    """Pairs of a list's groups (or of two blocks of it; ascending by size) that aren't connected, weren't tried and that no bound refutes.

    ``nearest``: of each component only the nearest such pair.
    """
    one = bool((side == side[0]).all())
    out: list[tuple[int, int]] = []
    best: dict[int, tuple[int, int, int]] = {}
    folded: dict[int, np.ndarray] = {}
    for i in range(len(n) - 1):
        rest = np.arange(i + 1, np.searchsorted(n, n[i] * 100 // percent + 1))
        rest = rest[(comp[rest] != comp[i]) & (one | (side[rest] != side[i]))]
        if not len(rest):
            continue
        words = len(maps[i])
        if words not in folded:
            folded[words] = np.array([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) if len(x) >= words else np.zeros(words, np.uint64) for x in maps])
        away = np.bitwise_count(folded[words][rest] ^ maps[i]).sum(axis=1).astype(np.int64)
        most = allowed_difference(n[i], n[rest], percent)
        tried = ((g[rest] == pivot) | (g[i] == pivot)) & (radius[rest] + radius[i] == 0)
        kept = (most >= 0) & ~tried & (away - radius[i] - radius[rest] <= most)
        for j, d in zip(rest[kept].tolist(), away[kept].tolist()):
            pair = (int(min(g[i], g[j])), int(max(g[i], g[j])))
            if nearest:
                for own in (int(comp[i]), int(comp[j])):
                    best[own] = min(best.get(own, (1 << 60, 0, 0)), (d, *pair))
            else:
                out.append(pair)
    return [*out, *{(a, b) for _, a, b in best.values()}]


def _list_pairs(percent: int, nearest: bool):
    """Over a partition sorted by list, block pair and size: the pairs of each list, many lists a batch."""
    keys = ["list", "_i", "_j"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            held = f if held is None else pd.concat([held, f], ignore_index=True)
            marks = held[keys].to_numpy()
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            if len(edges):
                yield found(held.iloc[: edges[-1]], np.concatenate(([0], edges)))
                held = held.iloc[edges[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield found(held, np.array([0, len(held)]))

    def found(f: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        n, radius, comp, g, side, pivot = (f[c].to_numpy() for c in ("n", "radius", "comp", "g", "side", "pivot"))
        maps = [np.frombuffer(x, np.uint64) for x in f["bitmap"]]
        names, out = f["list"].to_numpy(), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            out += [(int(names[a]), *pair) for pair in _pairs_of_list(n[a:b], radius[a:b], comp[a:b], g[a:b], side[a:b], maps[a:b], int(pivot[a]), percent, nearest)]
        return pd.DataFrame(out, columns=["list", "a", "b"]).astype("int64")

    return run


def _met(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(list, a, b): pairs of each list of rows (list, pivot, size, g, n, radius, comp, bitmap), compared in blocks of ``LIST_BLOCK``."""
    blocks = F.ceil(F.col("size") / LIST_BLOCK).cast("int")
    part = rows.withColumn("side", F.pmod(F.xxhash64("g"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    part = part.select("list", F.least("side", "_other").alias("_i"), F.greatest("side", "_other").alias("_j"), "g", "n", "radius", "comp", "side", "pivot", "bitmap")
    dealt = part.repartition("list", "_i", "_j").sortWithinPartitions("list", "_i", "_j", "n", "g")
    return materialise(dealt.mapInPandas(_list_pairs(percent, nearest), "list long, a long, b long"))


def _with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of (list, pivot, size, g, n, radius, comp) that may have a pair left in their list.

    In a list of up to ``LIST_PART`` rows: rows with one of another component among those of a
    size that can link. In a longer one: all rows, if it has two components. Pairs with the
    list's first group were tried, but for members. No bitmap is looked at, so only what
    stays takes its bitmap along.
    """
    other = F.col("g") != F.col("pivot")
    lo, hi = F.min(F.when(other, F.col("comp"))), F.max(F.when(other, F.col("comp")))
    first, last, most = F.min("comp"), F.max("comp"), F.max("radius")

    reach = int(math.log(100 / percent) * 1e6) + 2  # in millionths, rounded up
    near = Window.partitionBy("list").orderBy("_log").rangeBetween(-reach, reach)
    short = rows.where(F.col("size") <= LIST_PART).withColumn("_log", F.floor(F.log("n") * 1e6))
    short = short.withColumns({"_two": other & (lo.over(near) != hi.over(near)), "_members": (first.over(near) != last.over(near)) & (most.over(near) > 0)})
    short = short.where("_two or _members").drop("_log", "_two", "_members")

    long = rows.where(F.col("size") > LIST_PART)
    open_ = long.groupBy("list", "size").agg((lo != hi).alias("_two"), ((first != last) & (most > 0)).alias("_members")).where("_two or _members")
    parts = F.ceil(F.col("size") / LIST_PART)
    open_ = open_.select("list", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("_part"))
    long = long.withColumn("_part", F.pmod(F.xxhash64("g"), parts).cast("int")).join(open_, ["list", "_part"]).drop("_part")
    return short.unionByName(long)


def _with_comp(rows: DataFrame, comps: DataFrame, of: str, name: str) -> DataFrame:
    """Add ``name``: the component of the node in column ``of``; a node without links is its own."""
    return rows.join(comps.select(F.col("v").alias(of), F.col("comp").alias("_comp")).hint("merge"), of, "left").withColumn(name, F.coalesce("_comp", of)).drop("_comp")


def _lists(posted: DataFrame) -> DataFrame:
    """(list, pivot, size, g) of all shingles of (g, _at, shingle, rare) that several groups hold; equal lists once."""
    listing = {"size": F.count(F.lit(1)), "list": F.bit_xor(F.xxhash64("g")), "pivot": F.min("g")}
    per = Window.partitionBy("shingle")
    rare = posted.where("_at < rare").select("g", "shingle").withColumns({name: f.over(per) for name, f in listing.items()})
    often = posted.where("_at >= rare").select("g", "shingle")  # of at most as many shingles as were sent to the tasks
    often = often.join(F.broadcast(often.groupBy("shingle").agg(*[f.alias(name) for name, f in listing.items()])), "shingle")
    pivot = F.when(F.col("size") > SMALL_LIST, F.col("pivot")).otherwise(-1)
    return rare.unionByName(often).where("size > 1").select("list", pivot.alias("pivot"), "size", "g").distinct()


def link_components(docs: DataFrame, k: int = 5, percent: int = 80, share: float = 0.0005) -> DataFrame:
    """Per row of (rid, doc_id, text): rid, doc_id, n_shingles, component_id, and comp, the component's own number.

    Two documents link if their shingle sets have a Jaccard similarity of ``percent`` / 100
    or more; component_id is the least doc_id that links reach. Documents without words link
    with nothing and are their own component. Null text has no words; null ids take part,
    but name a component only if it has no other id (then it is null); equal rows are one node.
    Very long texts are taken whole. Further columns are ignored; an empty table gives no rows.
    ``docs`` is read several times: it should be a table, with a unique long ``rid`` in each
    row (``numbered``).
    """
    rows, sketches = stored_step(sketch_documents(docs, k, percent, frequent_shingles(docs, k, share)))
    full = rows.where("n > 0")
    nodes = materialise(least_of(full.select("rid", "doc_id", "s1", "s2", "n"), ["s1", "s2", "n"], F.col("rid"), "node").select("rid", "doc_id", "node"))
    again = narrow(materialise(nodes.where("rid <> node").select("rid")))
    single = full.join(again, "rid", "left_anti")

    # groups of nodes with the same size and prefix
    alike = least_of(single.select("rid", "n", "sp"), ["n", "sp"], F.col("rid"), "a").where("rid <> a")
    inside = verify(alike.select("a", F.col("rid").alias("b")), docs, k, percent)
    carried = narrow(inside.select(F.col("b").alias("rid")))
    leaders = single.join(carried, "rid", "left_anti")
    radius = inside.groupBy(F.col("a").alias("rid")).agg(F.max("apart").alias("radius"))
    groups = materialise(leaders.select("rid", "n", "bitmap").join(radius, "rid", "left").select(F.col("rid").alias("g"), "n", "bitmap", F.coalesce("radius", F.lit(0)).cast("long").alias("radius")))

    # lists of groups that share a prefix shingle; equal lists once
    posted = leaders.select(F.col("rid").alias("g"), F.posexplode("prefix").alias("_at", "shingle"), "rare")
    # as many bits as let one shingle in some hundreds fall together with another, which adds candidates only
    postings = full.agg(F.sum(F.size("prefix"))).first()[0] or 1
    posted = posted.withColumn("shingle", F.col("shingle").bitwiseAND(F.lit((1 << min(8 + int(postings).bit_length(), 62)) - 1)))
    # only one share's shuffle is on disk at a time
    found = [materialise(_lists(posted.where(F.col("shingle").bitwiseAND(F.lit(SHINGLE_PARTS - 1)) == part))) for part in range(SHINGLE_PARTS)]
    lists = materialise(reduce(DataFrame.union, found).distinct())

    # the prefixes, most of the sketches, are in the lists now
    sizes_of_rows = materialise(rows.select("rid", "doc_id", "n"))
    single = materialise(single.select("rid", "n", "bitmap"))
    discard(docs.sparkSession, sketches)

    star = lists.where("pivot >= 0 and g <> pivot").select(F.col("pivot").alias("a"), F.col("g").alias("b")).distinct()
    sizes = groups.select("g", "n", "radius").hint("merge")
    left = groups.select(F.col("g").alias("a"), F.col("radius").alias("r"), F.col("bitmap").alias("x"))
    right = groups.select(F.col("g").alias("b"), F.col("n").alias("m"), F.col("radius").alias("q"), F.col("bitmap").alias("y"))
    sized = star.join(groups.select(F.col("g").alias("a"), "n").hint("merge"), "a").join(right.hint("merge"), "b")
    sized = sized.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).join(left.hint("merge"), "a")  # bitmaps of pairs whose sizes can link
    links = verify(sized.mapInPandas(_near_pairs(percent), "a long, b long"), docs, k, percent).select("a", "b")
    links = materialise(links.union(inside.select("a", "b")))
    comps = connected(links)

    wide = groups.where("radius > 0").select("g", F.col("radius").alias("_r"))
    with_pairs = None
    for nearest in (True, False):
        now = materialise(_with_comp(lists, comps, "g", "comp").join(sizes, "g"))
        if with_pairs is not None:  # a list without a near pair of components then has none now
            now = now.join(narrow(with_pairs), "list", "left_semi")
        kept = _with_partners(now, percent).drop("n", "radius")
        met = _met(kept.join(groups.hint("merge"), "g"), percent, nearest)
        if met.isEmpty():
            break
        pairs = met.select("a", "b").distinct()
        if nearest:
            with_pairs = materialise(met.select("list").distinct())
            found = verify(pairs, docs, k, percent).select("a", "b")
        else:  # a group's members stand for themselves
            pairs = materialise(pairs.join(wide.select(F.col("g").alias("a"), F.col("_r").alias("_ra")), "a", "left").join(wide.select(F.col("g").alias("b"), F.col("_r").alias("_rb")), "b", "left").select("a", "b", F.coalesce("_ra", "_rb").isNotNull().alias("wide")))
            found = verify(pairs.where("not wide"), docs, k, percent).select("a", "b")
        if not found.isEmpty():
            links = links.union(found)
            comps = connected(links)
        if not nearest:
            links, comps = _link_members(pairs.where("wide").select("a", "b"), inside, single, links, comps, docs, k, percent)

    placed = materialise(_with_comp(nodes, comps, "node", "comp").select("rid", "doc_id", "comp"))
    placed = materialise(least_of(placed, ["comp"], F.col("doc_id"), "component_id").select("rid", "comp", "component_id"))
    out = sizes_of_rows.join(placed, "rid", "left")
    alone = F.col("n") == 0
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("rid")).otherwise(F.col("comp")).alias("comp"))


def _link_members(pairs: DataFrame, inside: DataFrame, single: DataFrame, links: DataFrame, comps: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links and components after members of group pairs (a, b) met: the nearest two of each pair first, then all that no bound refutes.

    A pair's members are dealt like a list, one row each, and not multiplied out.
    """
    for nearest in (True, False):
        open_ = _with_comp(_with_comp(pairs, comps, "a", "_ca"), comps, "b", "_cb").where("_ca <> _cb")
        open_ = materialise(open_.select(F.xxhash64("a", "b").alias("list"), F.explode(F.array(F.struct(F.col("a").alias("head"), F.col("_ca").alias("comp")), F.struct(F.col("b").alias("head"), F.col("_cb").alias("comp")))).alias("_s")).select("list", "_s.head", "_s.comp"))
        if open_.isEmpty():
            break
        heads = open_.select("head").distinct()
        members = materialise(inside.select(F.col("a").alias("head"), F.col("b").alias("g")).join(heads, "head").union(heads.select("head", F.col("head").alias("g"))))
        maps = materialise(single.select(F.col("rid").alias("g"), "n", "bitmap").join(narrow(members.select("g")), "g", "left_semi"))
        listed = open_.join(members, "head").join(maps, "g")
        listed = materialise(listed.select("list", "g", "n", "comp", "bitmap", F.lit(0).cast("long").alias("radius"), F.lit(-1).cast("long").alias("pivot")))
        sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
        met = _met(listed.join(sizes, "list"), percent, nearest)
        found = verify(met.select("a", "b").distinct(), docs, k, percent).select("a", "b")
        if not found.isEmpty():
            links = links.union(found)
            comps = connected(links)
    return links, comps


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as a table with a unique ``rid`` in each row."""
    return materialise(docs.withColumn("rid", F.monotonically_increasing_id()))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id (null ids last).

    Documents without words (null, empty or white space) all stay; of equal rows one stays.
    All columns stay, whatever their names; very long texts are compared whole; an empty
    table stays empty.
    """
    base = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("_doc")))
    found = materialise(link_components(base.select("rid", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text")), k, percent))
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "rid")
    gone = least_of(found.select("rid", "doc_id", "comp"), ["comp"], order, "_first").where("rid <> _first.rid").select("rid")
    return base.join(narrow(materialise(gone)), "rid", "left_anti").select("_doc.*")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its set's size and its component; null and repeated ids and texts as in ``link_components``."""
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return link_components(docs).select("doc_id", "n_shingles", "component_id")
