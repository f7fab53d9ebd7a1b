"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A text is a multiset of paragraphs (lines). Each paragraph is hashed to a wide vector, and the
fingerprint is the sum of these vectors, lane by lane modulo a power of two: paragraphs may come in
any order, and inserting or deleting one adds or subtracts its vector without looking at the rest.

The vector has two parts. EXACT lanes (32 bits each) are hashes of the whole paragraph: equal sums
mean equal multisets. SIGN lanes (16 bits each) add a sign per pair of neighbouring words of the
paragraph; the products of two such sums estimate how many word pairs two texts share, since a lane
read as a signed number is small although it is kept modulo 2**16.

Null texts count as empty, an empty text is one empty paragraph. Repeated rows (same ``doc_id`` and
text) count as one document when the next one is looked for, and each gives its row; documents that
share an id follow each other by a hash of their text; a null id comes last. Extra columns are not
looked at. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorquery.operators.series import global_positions
from sensorquery.session import scratch_path

EXACT_LANES, EXACT_BITS = 8, 32
SIGN_LANES, SIGN_BITS = 128, 16
_HALF = 1 << 32


def _hex(lanes: Column, bits: int) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), bits // 4, "0")), "")


def _paragraph_sums(paragraphs: Column) -> list[Column]:
    """EXACT lanes: the halves of seeded 64-bit hashes, summed modulo 2**32."""
    def lane(seed: int, shift: int) -> Column:
        parts = F.transform(
            paragraphs, lambda p: F.shiftright(F.xxhash64(F.lit(seed), p), shift).bitwiseAND(F.lit(_HALF - 1))
        )
        total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
        return total.bitwiseAND(F.lit(_HALF - 1))

    return [lane(seed, shift) for seed in range(EXACT_LANES // 2) for shift in (0, 32)]


def _pair_hashes(paragraphs: Column) -> Column:
    """A hash per word of each paragraph and its follower in the same paragraph."""

    def pairs(words: Column) -> Column:
        return F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))

    return F.flatten(F.transform(F.transform(paragraphs, lambda p: F.split(p, " ")), pairs))


def fingerprints(texts: DataFrame, key: list[str], text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, exact, signs, copies) per distinct key; rows with equal keys hold equal texts.

    ``carry`` are columns of type long. All buffers of the aggregation are numbers, which keeps it a
    hash aggregation. The word pairs of a row are summed before any shuffle. Two lanes share a 64-bit sum: a text has
    fewer than 2**31 words, so they cannot run into each other. Copies of a row multiply its sums,
    which the number of first pairs undoes.
    """
    paragraphs = F.split(F.col(text), "\n")
    exact = [f"exact_{i}" for i in range(EXACT_LANES)]
    # The lanes of the paragraphs are made before the pairs are spread, once per text.
    prepared = texts.select(
        *key, *carry, *[c.alias(e) for e, c in zip(exact, _paragraph_sums(paragraphs))],
        _pair_hashes(paragraphs).alias("pairs"),
    )
    pairs = prepared.select(*key, *carry, *exact, F.posexplode("pairs").alias("at", "h")).withColumn("h2", F.xxhash64("h"))
    both = F.lit(_HALF + 1)
    words = ("h", "h2")[:SIGN_LANES // 64]
    sums = [F.sum(F.shiftright(c, i).bitwiseAND(both)).alias(f"{c}_{i}") for c in words for i in range(32)]
    summed = pairs.groupBy(*key).agg(
        *[F.max(c).alias(c) for c in (*carry, *exact)], F.count("*").alias("n"),
        F.count_if(F.col("at") == 0).alias("copies"), *sums,
    )
    counts = [
        part for c in words for i in range(32)
        for part in (F.col(f"{c}_{i}").bitwiseAND(F.lit(_HALF - 1)), F.shiftright(f"{c}_{i}", 32))
    ]
    signs = F.transform(
        F.array(*counts),
        lambda c: ((2 * c - F.col("n")) / F.col("copies")).cast("long").bitwiseAND(F.lit((1 << SIGN_BITS) - 1)),
    )
    return summed.select(*key, *carry, F.array(*exact).alias("exact"), signs.alias("signs"), "copies")


def as_text(exact: Column, signs: Column) -> Column:
    """The fingerprint as hexadecimal digits."""
    return F.concat(_hex(exact, EXACT_BITS), F.lit("-"), _hex(signs, SIGN_BITS))


def combine(a: Column, b: Column, bits: int, sign: int = 1) -> Column:
    """Lanes of the union (sign 1) or of a without b (sign -1)."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit((1 << bits) - 1)))


def likeness(exact_a: Column, signs_a: Column, exact_b: Column, signs_b: Column) -> Column:
    """0 to 1: twice the estimated common word pairs over those of both; 1 for equal fingerprints."""
    half = 1 << (SIGN_BITS - 1)

    def signed(lanes: Column) -> Column:
        return F.transform(lanes, lambda x: F.when(x >= half, x - 2 * half).otherwise(x).cast("double"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    a, b = signed(signs_a), signed(signs_b)
    size = dot(a, a) + dot(b, b)
    raw = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * dot(a, b) / size))).otherwise(F.lit(0.0))
    return F.when((exact_a == exact_b) & (signs_a == signs_b), F.lit(1.0)).otherwise(raw)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key without nulls that tells different documents apart."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.select(
        F.coalesce("doc_id", F.lit(0)).alias("k1"),
        F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("k2"), "doc_id", "text",
    )


def successors(own: DataFrame) -> DataFrame:
    """(k1, k2, n_chars, next1, next2): each document's next one in descending doc_id, the last
    one's next being the first. Works on ids alone; positions come from range partitions."""
    ids = own.select("k1", "k2", "doc_id", F.char_length("text").cast("long").alias("n_chars")).distinct()
    placed = global_positions(ids, [F.col("doc_id").desc_nulls_last(), F.col("k2")], "pos")
    n = placed.count()
    follower = placed.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"), F.col("pos").alias("at"))
    return (
        placed.withColumn("at", F.pmod(F.col("pos") + 1, F.lit(max(n, 1))))
        .join(follower, "at").select("k1", "k2", "n_chars", "next1", "next2")
    )


def compare_edits(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many of the
    next document. Only these heads travel to their predecessor.
    """
    spark, key = docs.sparkSession, ["k1", "k2"]
    own = _keyed(docs)
    folder = scratch_path(spark, "fingerprints")
    fingerprints(own, key).drop("copies").write.parquet(folder)
    prints = spark.read.parquet(folder)
    linked = scratch_path(spark, "successors")
    successors(own).write.parquet(linked)
    links = spark.read.parquet(linked)

    half = F.floor(F.col("n_chars") / 2).cast("int")
    text = own.select(*key, "text")
    wanted = links.select(
        F.col("next1").alias("k1"), F.col("next2").alias("k2"), F.col("k1").alias("for1"), F.col("k2").alias("for2"),
        "n_chars",
    )
    heads = (
        text.join(wanted, key)
        .select("for1", "for2", "n_chars", F.substring("text", F.lit(1), half).alias("head"))
        .groupBy(F.col("for1").alias("k1"), F.col("for2").alias("k2"))
        .agg(F.first("n_chars").alias("n_chars"), F.first("head").alias("head"))
    )
    rest = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    edited = text.join(heads, key).select(*key, "n_chars", F.concat(rest, "head").alias("edited"))
    digest = F.sha2(F.col("edited").cast("binary"), 256)  # as eight numbers while it is carried along
    parts = {f"sha_{i}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)}
    mine = fingerprints(edited.withColumns(parts), key, "edited", ("n_chars", *parts))
    mine = mine.withColumn("edited_sha256", _hex(F.array(*parts), 32))

    after = links.join(prints.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"),
                                     F.col("exact").alias("next_exact"), F.col("signs").alias("next_signs")),
                       ["next1", "next2"]).select(*key, "next_exact", "next_signs")
    before = prints.select(*key, F.col("exact").alias("own_exact"), F.col("signs").alias("own_signs"))
    ids = own.select(*key, "doc_id").distinct()
    joined = mine.join(before, key).join(after, key).join(ids, key)
    return joined.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("own_exact"), F.col("own_signs")).alias("fingerprint"),
        as_text(F.col("exact"), F.col("signs")).alias("edited_fingerprint"),
        likeness(F.col("own_exact"), F.col("own_signs"), F.col("exact"), F.col("signs")).alias("near_edited"),
        likeness(F.col("own_exact"), F.col("own_signs"), F.col("next_exact"), F.col("next_signs")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
