"""Document fingerprints: canonical exact digests, with DataFrame functions only.

Canonical form: NFKC, full case folding, NFKC again, and every run of white space as one
space with none at the ends. The digest is 128 bits of xxhash64 under two seeds. Documents
whose digests meet are compared byte by byte; should different canonical texts share a
digest, each takes a number behind it, so equal fingerprints mean equal canonical texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, narrow, table

_WHITE = r"[\s\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{A0}\x1C-\x1F]"


def canonical(text: Column) -> Column:
    """The canonical form of a text (null: empty). Unicode work is done by ICU, which Spark ships."""
    text = F.coalesce(text, F.lit(""))
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    ascii_only = F.octet_length(text) == F.char_length(text)
    plain = F.when(ascii_only, F.lower(text)).otherwise(again)
    return F.trim(F.regexp_replace(plain, f"{_WHITE}{{2,}}|(?! ){_WHITE}", " "))


def digest(canon: Column) -> Column:
    """128 bits of a canonical text as 32 hex digits."""
    wide = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2)]
    return F.concat(*wide)


def collisions(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, proof, number) of canonical texts that share a digest with another text.

    ``digests`` has (digest, proof, raw) of every canonical text, raw a hash of the text it
    was made from, or null if the text is not in ``texts`` (text). Digests that several
    proofs (SHA-256) share are found by sums; texts of equal digests are then compared byte
    by byte. Rows of a digest are reduced to the least and greatest text before they are
    shuffled, so a digest that holds a third of all rows is compared by all tasks.
    """
    per = materialise(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.min("proof").alias("_a"), F.max("proof").alias("_b")).where("_n > 1").select("digest", (F.col("_a") != F.col("_b")).alias("_apart")))
    shared = digests.where("raw is not null").join(narrow(per.select("digest")), "digest", "left_semi").select("raw").distinct()
    met = texts.where("text is not null").withColumn("raw", F.xxhash64("text")).join(narrow(materialise(shared)), "raw", "left_semi").select(canonical(F.col("text")).alias("_canon"))
    mixed = met.groupBy(digest(F.col("_canon")).alias("digest")).agg(F.min("_canon").alias("_a"), F.max("_canon").alias("_b")).where("_a <> _b").select("digest")
    mixed = materialise(mixed.union(per.where("_apart").select("digest")).distinct())
    number = F.dense_rank().over(Window.partitionBy("digest").orderBy("proof"))
    return digests.join(narrow(mixed), "digest", "left_semi").select("digest", "proof").distinct().select("digest", "proof", number.alias("number"))


def numbered(rows: DataFrame, mixed: DataFrame, name: str, proof: str) -> DataFrame:
    """Column ``name`` (a digest) with the number of its text behind it where digests collide."""
    other = mixed.select(F.col("digest").alias(name), F.col("proof").alias(proof), "number")
    joined = rows.join(other, [name, proof], "left")
    return joined.withColumn(name, F.when(F.col("number").isNull(), F.col(name)).otherwise(F.concat(name, F.lit("-"), F.col("number")))).drop("number")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``; an existing column of that name is replaced.

    Null text is empty, texts of any length count whole. Equal rows have equal fingerprints;
    all other columns stay, whatever their names; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != "fingerprint"]
    canon = docs.select(F.struct(*kept).alias("doc"), F.xxhash64("text").alias("raw"), canonical(F.col("text")).alias("canon"))
    out = canon.select("doc", "raw", digest(F.col("canon")).alias("fingerprint"), F.sha2("canon", 256).alias("proof"))
    out = materialise(out)
    mixed = materialise(collisions(docs.select("text"), out.select(F.col("fingerprint").alias("digest"), "proof", "raw")))
    out = numbered(out, mixed, "fingerprint", "proof") if not mixed.isEmpty() else out
    return out.select("doc.*", "fingerprint")


def range_blocks(rows: DataFrame, rows_per_block: int, most: int = 1 << 14) -> Column:
    """An expression that numbers blocks of about ``rows_per_block`` rows of (doc_id, _row) in ascending order of doc_id.

    Blocks end at quantiles of the ids, found by binary search in a list of at most ``most``
    numbers. An id that fills several blocks is dealt to them, and so are null ids, whose
    blocks come before all others.
    """
    count = rows.agg(F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    known, nulls = count["n"], count["all"] - count["n"]
    wanted = min(most - 1, known // rows_per_block)
    splits = []
    if wanted:
        at = F.lit([i / (wanted + 1) for i in range(1, wanted + 1)])
        splits = rows.agg(F.percentile_approx("doc_id", at, 10 * (wanted + 1)).alias("s")).first()["s"]
    steps = [1 << k for k in reversed(range(len(splits).bit_length()))]
    held = F.lit([int(x) for x in splits]) if splits else None

    def below(holds) -> Column:  # the number of splits that hold against the id
        if not steps:
            return F.lit(0)
        return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(splits)) & holds(F.element_at(held, F.least(at + step, F.lit(len(splits))))), at + step).otherwise(at))

    salt = F.xxhash64("_row")
    first, last = below(lambda s: s < F.col("doc_id")), below(lambda s: s <= F.col("doc_id"))
    place = first + F.pmod(salt, last - first + 1)
    apart = -1 - F.pmod(salt, F.lit(nulls // rows_per_block + 1))
    return F.when(F.col("doc_id").isNull(), apart).otherwise(place).cast("long")


def with_next(docs: DataFrame, rows_per_block: int = 512) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and others) with ``next``, a struct of them: the following document by descending id, after the last the first.

    A window per block (``range_blocks``) finds neighbours, and the first document of each
    block is handed to the block before it. Null ids come last; equal ids follow each other
    in any order; a document alone is its own next.
    """
    own = F.struct(*docs.columns)
    rows = docs.select(own.alias("own"), "doc_id", F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_block", range_blocks(docs.select("doc_id", F.lit(0).alias("_row")), rows_per_block))
    order = F.struct(F.col("doc_id").isNull().alias("_null"), (-F.col("doc_id").cast("decimal(20,0)")).alias("_down"), "_row")
    heads = materialise(rows.groupBy("_block").agg(F.min_by("own", order).alias("_head")))
    outer = F.shiftright("_block", 12)
    inner = Window.partitionBy(outer).orderBy(F.desc("_block"))
    chain = materialise(heads.select("_block").withColumn("_next", F.lead("_block").over(inner)).withColumn("_outer", outer))
    across = Window.orderBy(F.desc("_outer"))
    jumps = chain.groupBy("_outer").agg(F.max("_block").alias("_top"))
    start = F.lit(chain.agg(F.max("_block")).first()[0])
    jumps = jumps.select("_outer", F.coalesce(F.lead("_top").over(across), start).alias("_jump"))
    links = chain.join(jumps, "_outer").select("_block", F.coalesce("_next", "_jump").alias("_to"))
    heads = links.join(heads.select(F.col("_block").alias("_to"), "_head"), "_to").select("_block", "_head")
    per = Window.partitionBy("_block").orderBy(F.desc_nulls_last("doc_id"), "_row")
    rows = rows.withColumn("next", F.lead("own").over(per))
    return rows.join(heads, "_block").select("own.*", F.coalesce("next", "_head").alias("next"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third comes from the next document.

    The likeness of two exact digests is 1 where the canonical texts are equal (by digest
    and SHA-256), and else 0. Null text is empty; texts of any length count whole; repeated
    ids and equal rows give a row each; further columns are ignored; an empty table gives no
    rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), canonical(F.col("text")).alias("_canon"))
    rows = with_next(rows.select("doc_id", "text", F.sha2("_canon", 256).alias("_proof"), digest(F.col("_canon")).alias("fingerprint")))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next.text"), F.lit(1), third)))
    same = (F.col("fingerprint") == F.col("next.fingerprint")) & (F.col("_proof") == F.col("next._proof"))
    rows = rows.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "_proof", F.xxhash64("text").alias("_raw"), same.cast("double").alias("near_next"), canonical(F.col("_edited")).alias("_changed"))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "_proof", "_raw", "near_next", digest(F.col("_changed")).alias("edited_fingerprint"), F.sha2("_changed", 256).alias("_edited_proof"))
    rows = materialise(rows)
    digests = rows.select(F.col("fingerprint").alias("digest"), F.col("_proof").alias("proof"), F.col("_raw").alias("raw"))
    edited = rows.select(F.col("edited_fingerprint").alias("digest"), F.col("_edited_proof").alias("proof"), F.lit(None).cast("long").alias("raw"))
    mixed = materialise(collisions(docs.select(text.alias("text")), digests.union(edited)))
    if not mixed.isEmpty():
        rows = numbered(numbered(rows, mixed, "fingerprint", "_proof"), mixed, "edited_fingerprint", "_edited_proof")
    alike = (F.col("fingerprint") == F.col("edited_fingerprint")) & (F.col("_proof") == F.col("_edited_proof"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike.cast("double").alias("near_edited"), "near_next")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; cases as in ``compare_edited``."""
    return compare_edited(table(spark, sf_dir, "documents"))
