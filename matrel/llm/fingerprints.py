"""SimHash fingerprints and the search for all fingerprints within a Hamming radius. DataFrame functions only.

A text's terms are its pairs of adjacent words. Each term's 128-bit hash votes, with the term's
weight, for the bits it has and against those it lacks; the fingerprint has the bits that won. Two votes
are counted in one sum: bit i in its low and bit i + 32 in its high half, so 128 votes take 64 sums.

The search permutes blocks of the fingerprint: with r + 2 blocks, two fingerprints within r bits agree in two
whole blocks at least, so a table for each pair of blocks, joined on those blocks, meets every such pair.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matrel.llm._io import table, written

BITS = 128
_LANES = 0x0000000100000001
_SPACE = r"[\x20\x09-\x0D]+"
#: Buckets of the key order a shuffle partition.
SPREAD = 8
#: Bits within which a fingerprint is found, and queries that one row of a block table holds at most, about.
RADIUS, QUERIES = 3, 512
#: Rows whose key leaves no rest by this are the queries of the search.
EVERY = 50


def _terms(text: Column) -> Column:
    """Adjacent word pairs of a text; a single word is paired with nothing, an empty text is one empty term."""
    words = F.split(text, _SPACE, -1)
    return F.when(
        F.size(words) > 1,
        F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("a"), F.slice(words, F.lit(2), F.size(words) - 1).alias("b")),
    ).otherwise(F.array(F.struct(words[0].alias("a"), F.lit("").alias("b"))))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows ``*keys, f0, f1``: the two halves of the fingerprint of each row's text, as longs.

    The keys must name a row. Nothing else is kept, and no column of ``rows`` clashes. A null text counts as empty;
    equal texts have equal fingerprints; texts of any length are taken whole; an empty table gives an empty one.
    """
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    terms = rows.select(*own, F.inline(_terms(F.coalesce(F.col(text), F.lit("")))).alias("a", "b"))
    # a term weighs 1 to 4, by its length
    weight = F.least(F.lit(4), F.lit(1) + ((F.octet_length("a") + F.octet_length("b")) / 6).cast("int")).cast("long")
    hashed = terms.select(*names, weight.alias("w"), F.xxhash64("a", "b").alias("h0"), F.xxhash64("a", "b", F.lit(1)).alias("h1"))
    sums = [F.sum(F.shiftrightunsigned(f"h{h}", i).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"v{h}_{i}") for h in (0, 1) for i in range(32)]
    voted = hashed.groupBy(*names).agg(F.sum("w").alias("all"), *sums)

    def half(h: int) -> Column:
        bits = []
        for i in range(32):
            low = F.col(f"v{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(f"v{h}_{i}", 32)
            bits.append(F.when(low * 2 > F.col("all"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
            top = (1 << (i + 32)) - (1 << 64 if i == 31 else 0)
            bits.append(F.when(high * 2 > F.col("all"), F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
        while len(bits) > 1:
            bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2], strict=True)]
        return bits[0]

    return voted.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], half(0).alias("f0"), half(1).alias("f1"))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The share of bits that agree."""
    return 1 - (F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))) / F.lit(float(BITS))


def text_form(f0: Column, f1: Column) -> Column:
    """32 lower-case hex digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f0, f1)])


def _rank(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most the value: first among every so many, then among those between two of these.

    The bounds are constants, so the expression stays as small with very many of them, and a row costs about twice their square root in steps.
    """
    width = max(1, math.isqrt(len(bounds)))
    lists = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    below = lambda list_: F.size(F.filter(list_, lambda x: x <= value))
    if len(lists) < 2:
        return below(F.array(*map(F.lit, bounds))) if bounds else F.lit(0)
    at = below(F.array(*[F.lit(x[0]) for x in lists[1:]]))
    return at * width + below(F.get(F.array(*[F.array(*map(F.lit, x)) for x in lists]), at))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``bucket, nth, key, text, next_text, guest`` in the order of the key; after the last row comes the first.

    The keys are cut at quantiles into buckets, ``SPREAD`` times as many as shuffle partitions so that these get about equally
    many, of which only the bounds and first keys come to the driver. Each bucket's first row is also a guest at the end of the bucket before, so the order
    is followed within buckets only and no task sees more than one. ``nth`` numbers a bucket's rows. Equal keys go by
    text. Rows without a key have no place in the order: they get buckets of their own (below 0) and a null next text.
    """
    spark = docs.sparkSession
    parts = SPREAD * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = own.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = _rank(F.col("key"), cuts)
    firsts = sorted((r["bucket"], r["low"]) for r in own.where("key IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.min("key").alias("low")).collect())
    home = F.struct(bucket.alias("bucket"), F.lit(0).alias("guest"))
    places = F.array(home)
    if firsts:
        before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
        top = max(before) + 1
        lows = F.array(*[F.lit(dict(firsts).get(b)).cast(own.schema["key"].dataType) for b in range(top)])
        hosts = F.array(*[F.lit(before.get(b, 0)) for b in range(top)])
        places = F.when(F.col("key") == F.get(lows, bucket), F.array(home, F.struct(F.get(hosts, bucket).alias("bucket"), F.lit(1).alias("guest")))).otherwise(places)
    lone = F.array(F.struct((-1 - F.pmod(F.xxhash64("text"), F.lit(parts))).cast("int").alias("bucket"), F.lit(0).alias("guest")))
    placed = own.select("key", "text", F.inline(F.when(F.col("key").isNull(), lone).otherwise(places)).alias("bucket", "guest"))
    order = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    out = placed.select("bucket", F.row_number().over(order).alias("nth"), "key", "text", F.lead("text").over(order).alias("next_text"), "guest")
    return out.withColumn("next_text", F.when(F.col("bucket") >= 0, F.col("next_text")))


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how alike they and the next text's are.

    The edited text has its last quarter (floor of the code points over 4) replaced by the first as many code points
    (or all) of the next row's text, rows going by ascending key and the first following the last. Returns ``key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, f0, f1`` (the fingerprint as two longs). A null text counts as empty. Rows without
    a key have a fingerprint and no neighbour: their other columns but ``n_chars`` are null. Rows that share a key are
    ordered by text; repeated rows stay. An empty table gives an empty one; further columns are ignored.
    """
    rows = with_next(docs, text, key)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    made = rows.select("bucket", "nth", "key", "guest", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    made = made.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))
    keys = ["bucket", "nth", "key", "guest", "n_chars", "edited_sha256", "which"]
    voted = fingerprints(made.select(*keys[:-1], F.inline(both).alias("which", "body")).where("body IS NOT NULL"), keys, "body")
    half = lambda which, f: F.max(F.when(F.col("which") == which, F.col(f)))
    # Still dealt out by bucket: neither this nor the window shuffles again.
    one = voted.groupBy(*keys[:-1]).agg(half(0, "f0").alias("f0"), half(0, "f1").alias("f1"), half(1, "f0").alias("e0"), half(1, "f1").alias("e1"))
    order = Window.partitionBy("bucket").orderBy("nth")
    one = one.withColumns({"n0": F.lead("f0").over(order), "n1": F.lead("f1").over(order)}).where("guest = 0")
    c = F.col
    placed = c("bucket") >= 0
    return one.select(
        c("key").alias(key),
        "n_chars",
        "edited_sha256",
        text_form(c("f0"), c("f1")).alias("fingerprint"),
        text_form(c("e0"), c("e1")).alias("edited_fingerprint"),
        likeness(c("f0"), c("f1"), c("e0"), c("e1")).alias("near_edited"),
        F.when(placed, likeness(c("f0"), c("f1"), c("n0"), c("n1"))).alias("near_next"),
        "f0",
        "f1",
    )


def _blocks(radius: int) -> list[tuple[int, int]]:
    """``radius + 2`` blocks of the bits, as masks of the two halves; whole hex digits."""
    if not 0 <= radius <= 30:
        raise ValueError("radius must be 0 to 30")
    n = radius + 2
    edges = [4 * round(k * BITS / 4 / n) for k in range(n + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        mask = (1 << (BITS - a)) - (1 << (BITS - b))
        out.append((signed(mask >> 64), signed(mask & (1 << 64) - 1)))
    return out


def _tables(rows: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint (``f0, f1``) once in each block table: ``f0, f1, table, k0, k1``, the last two its bits in the table's two blocks."""
    masks = _blocks(radius)
    made = []
    for t, (i, j) in enumerate(combinations(range(len(masks)), 2)):
        k0, k1 = (F.col(f).bitwiseAND(F.lit(masks[i][h] | masks[j][h]).cast("long")) for h, f in enumerate(("f0", "f1")))
        made.append(F.struct(F.lit(t).alias("table"), k0.alias("k0"), k1.alias("k1")))
    return rows.select("f0", "f1", F.inline(F.array(*made)).alias("table", "k0", "k1"))


def _first_table(x0: Column, x1: Column, radius: int) -> Column:
    """The number of the first table in which two fingerprints meet, of the exclusive or of their halves: their first two equal blocks."""
    masks = _blocks(radius)
    equal = [(x0.bitwiseAND(F.lit(a).cast("long")) == 0) & (x1.bitwiseAND(F.lit(b).cast("long")) == 0) for a, b in masks]
    out = F.lit(-1)
    for t, (i, j) in reversed(list(enumerate(combinations(range(len(masks)), 2)))):
        out = F.when(equal[i] & equal[j], t).otherwise(out)
    return out


def _matches(q0: Column, q1: Column, radius: int) -> Column:
    """Whether a query and the row's fingerprint differ in 1 to ``radius`` bits and first meet in the row's table."""
    x0, x1 = q0.bitwiseXOR(F.col("f0")), q1.bitwiseXOR(F.col("f1"))
    distance = F.bit_count(x0) + F.bit_count(x1)
    return (distance > 0) & (distance <= radius) & (_first_table(x0, x1, radius) == F.col("table"))


def count_within(queries: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows ``f0, f1, n``: the fingerprints of ``rows`` that differ in 1 to ``radius`` bits from ``n`` > 0 distinct ones of ``queries``.

    Both tables hold fingerprints as two longs ``f0, f1``; equal ones are one. Two fingerprints within the radius agree in two whole
    blocks of ``radius + 2`` at least, so they meet in the table of these blocks. The queries of a block stand there in lists of about
    ``QUERIES``; a fingerprint goes past the lists of its blocks and only counts, so a dense group gives no pairs. Each pair
    counts in its first table. Rows with a null half are left out; empty tables give an empty one; further columns are ignored.
    """
    own = lambda df: df.select("f0", "f1").where("f0 IS NOT NULL AND f1 IS NOT NULL").distinct()
    asked = _tables(own(queries), radius)
    by = ["table", "k0", "k1"]
    lists = asked.join(asked.groupBy(*by).agg(F.ceil(F.count("f0") / QUERIES).alias("lists")), by)
    lists = lists.groupBy(*by, F.pmod(F.xxhash64("f0", "f1"), F.col("lists")).alias("list")).agg(F.collect_list(F.struct(F.col("f0").alias("q0"), F.col("f1").alias("q1"))).alias("queries"))
    met = _tables(own(rows), radius).join(lists, by)
    n = F.size(F.filter("queries", lambda q: _matches(q["q0"], q["q1"], radius)))
    return met.select("f0", "f1", n.alias("n")).where("n > 0").groupBy("f0", "f1").agg(F.sum("n").alias("n"))


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, column: str = "fingerprint") -> DataFrame:
    """All pairs of different fingerprints within ``radius`` bits: rows ``query, found, distance``, each pair once.

    Both tables hold fingerprints as hex texts of 32 digits in ``column``; each distinct one is taken once (rows with equal
    fingerprints are found by joining on it), so a group of copies costs one row. The block tables are those of ``count_within``; a pair is
    verified on all bits where it first meets. The result is as large as there are pairs. Nulls are left out; empty tables give an empty one.
    """
    half = lambda k: F.conv(F.substring(column, k, 8), 16, 10).cast("long")  # noqa: E731  eight digits fit in a long without its sign
    whole = lambda k: F.shiftleft(half(k), 32).bitwiseOR(half(k + 8))
    sides = [_tables(df.where(F.col(column).isNotNull()).select(whole(1).alias("f0"), whole(17).alias("f1")).distinct(), radius) for df in (queries, fingerprints)]
    asked = sides[0].select("table", "k0", "k1", F.col("f0").alias("q0"), F.col("f1").alias("q1"))
    met = sides[1].join(asked, ["table", "k0", "k1"]).where(_matches(F.col("q0"), F.col("q1"), radius))
    distance = F.bit_count(F.col("q0").bitwiseXOR(F.col("f0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("f1")))
    return met.select(text_form(F.col("q0"), F.col("q1")).alias("query"), text_form(F.col("f0"), F.col("f1")).alias("found"), distance.cast("int").alias("distance"))


def with_found(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS, every: int = EVERY) -> DataFrame:
    """``prints`` (with ``f0, f1``) and ``n_found``: how many distinct fingerprints of the queries, the rows whose key ``every`` divides, differ
    from the row's own in 1 to ``radius`` bits. A row without a fingerprint has 0."""
    prints = written(prints, "fingerprints")
    found = count_within(prints.where(F.pmod(F.col(key), F.lit(every)) == 0), prints, radius)
    return prints.join(found, ["f0", "f1"], "left").withColumn("n_found", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with what the radius search finds."""
    return with_found(edited_fingerprints(table(spark, sf_dir, "documents"))).drop("f0", "f1")
