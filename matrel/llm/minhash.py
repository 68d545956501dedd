"""Near-duplicate documents by HyperMinHash.

A document's shingle set is hashed once. The top bits of a hash choose one of 128 registers; a register keeps
the least rest as its number of leading zeros and the ten bits after the first one, 16 bits in
all. Registers left empty borrow a full one by a fixed probe order before banding. Four
registers make a band: documents that share a band meet. Their Jaccard similarity is estimated from the
registers, less the matches expected by collision, and what may reach the threshold is verified on
the full sets.

What meets in a band is never expanded into all pairs. Equal sets are one class. Every member of a band is first
compared with the band's least member; links found make components; only where
a band still holds several components are its members compared further, in blocks of bounded
size, and only the links that connect components leave a block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.llm import _words
from matrel.llm._io import discard, table, tables_written, written
from matrel.llm.components import components

REGISTERS = 128
BANDS = 32
PER_BAND = REGISTERS // BANDS
MANTISSA = 10
_LOW = 64 - (REGISTERS.bit_length() - 1)
#: Members compared with each other in one block.
BLOCK = 128
#: Partners with which a text is verified in one row, about.
PARTNERS = 32


def registers(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The compressed registers (texts x 128, unsigned 16-bit, 0: empty) of ascending hash sets."""
    docs = len(first) - 1
    out = np.zeros((docs, REGISTERS), np.uint16)
    if not len(hashes):
        return out
    doc = np.repeat(np.arange(docs), np.diff(first))
    place = (hashes >> np.uint64(_LOW)).astype(np.int64)
    lead = np.ones(len(hashes), bool)
    lead[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    rest = hashes[lead] & np.uint64((1 << _LOW) - 1)
    bits = np.minimum(np.frexp(rest.astype(np.float64))[1], _LOW)
    over = bits - 1 - MANTISSA
    mantissa = np.where(over >= 0, rest >> np.maximum(over, 0).astype(np.uint64), rest << np.maximum(-over, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    code = ((_LOW - bits + 1).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    out[doc[lead], place[lead]] = code.astype(np.uint16)
    return out


@functools.cache
def _probes() -> np.ndarray:
    """For each register, the order in which it asks the others when it is empty."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


def densified(regs: np.ndarray) -> np.ndarray:
    """Empty registers filled from the first full one in their probe order; rows without any stay empty."""
    out = regs.copy()
    rows = np.flatnonzero((regs == 0).any(axis=1) & (regs != 0).any(axis=1))
    probes = _probes()
    for t in range(REGISTERS):
        if not len(rows):
            break
        part = out[rows]
        asked = regs[rows][:, probes[:, t]]
        part = np.where(part == 0, asked, part)
        out[rows] = part
        rows = rows[(part == 0).any(axis=1)]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text and band, of its four densified registers."""
    packed = np.ascontiguousarray(densified(regs)).view("<u8").reshape(len(regs), BANDS)
    return _words.mix64(packed ^ _words.mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]).view(np.int64)


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two unrelated sets of n and m elements that agree by chance (the approximation in the HyperMinHash paper)."""
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    return 0.169919487159739 * 2.0 ** ((REGISTERS.bit_length() - 1) - MANTISSA) * 4 * ratio / (1 + ratio) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of register rows, and the number of registers it rests on."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    return np.clip((same - expected_collisions(n, m)) / np.maximum(used, 1), 0, 1), used


def may_reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs that sizes and estimate (six standard errors below) allow to reach the threshold."""
    found, used = estimate(a, b, n, m)
    slack = 6 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1)) + 1 / np.maximum(used, 1)
    return (found >= threshold - slack) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)


def sketches(docs: DataFrame, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``id, n_shingles, h1, h2, regs``: set size, a 128-bit hash of the set, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                first, hashes = _words.shingle_sets(_words.Words(*_words.string_buffer(batch.column(1))), words)
                sums = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(_words.mix64(hashes ^ np.uint64(salt)))])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                regs = registers(first, hashes)
                binary = pa.array([r.tobytes() for r in regs], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(sums[0]), pa.array(sums[1]), binary], names=["id", "n_shingles", "h1", "h2", "regs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_words.tidy(run), f"id {kind}, n_shingles long, h1 long, h2 long, regs binary")


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` that the registers let through."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(k).to_numpy().astype(np.float64) for k in (2, 4))
                ok = may_reach(_regs(batch.column(3)), _regs(batch.column(5)), n, m, threshold)
                yield batch.select([0, 1]).filter(pa.array(ok))

    # b first: it is mostly another one in each pair; a may stand in very many
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "n_a", "regs_a", "n_b", "regs_b").mapInArrow(_words.tidy(run), f"a {kind}, b {kind}")


def _sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The shingle set of each text, made a slice at a time."""
    out = []
    for part in _words.slices(pa.record_batch([texts], names=["text"]), "text"):
        first, hashes = _words.shingle_sets(_words.Words(*_words.string_buffer(part.column(0))), words)
        out += [hashes[a:b].copy() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def _texts(own: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``own`` with an id of ``ids``, so that only these are moved by later joins.

    The ids are written first: if they are few, Spark knows it from the table and doesn't shuffle the texts at all.
    """
    return written(own.join(written(ids.select("id").distinct(), "needed"), "id", "left_semi"), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold: 100 * intersection >= percent * union.

    A text ``a`` that stands in very many pairs is moved once for every ``PARTNERS`` of them, not once a pair.
    """
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                others = batch.column(1)[k].values
                made, names = _sets_of(others.field("text"), words), others.field("b")
                own = [x for x, real in zip(made, names.is_valid().to_pylist(), strict=True) if not real]
                keep = [any(_reach(x, y, percent) for x in own) if real else False for y, real in zip(made, names.is_valid().to_pylist(), strict=True)]
                found = names.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(found), pa.int32())), found], names=["a", "b"])

    dealt = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("b") / PARTNERS).alias("parts")), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    text = F.coalesce("text", F.lit("")).alias("text")
    # the part's text a is one more row of the part, so all meet in one shuffle
    first = dealt.select("a", "part").distinct().join(docs.select(F.col("id").alias("a"), text), "a").select("a", "part", F.lit(None).cast(kind).alias("b"), "text")
    rest = dealt.join(docs.select(F.col("id").alias("b"), text), "b").select("a", "part", "b", "text")
    both = rest.unionByName(first).groupBy("a", "part").agg(F.collect_list(F.struct("b", "text")).alias("others")).select("a", "others")
    return both.mapInArrow(_words.tidy(run), f"a {kind}, b {kind}")


class _Members:
    """The members of one block, with their sets made when first asked for."""

    def __init__(self, rows: pa.StructArray, words: int):
        self.ids = rows.field("id").to_numpy(zero_copy_only=False)
        self.own = rows.field("component_id").to_numpy(zero_copy_only=False)
        self.n = rows.field("n_shingles").to_numpy(zero_copy_only=False).astype(np.float64)
        self.regs = _regs(rows.field("regs"))
        self.keys = band_keys(self.regs)
        self._texts = rows.field("text")
        self._words, self._sets = words, None

    def sets(self) -> list[np.ndarray]:
        if self._sets is None:
            self._sets = _sets_of(self._texts, self._words)
        return self._sets


def _reach(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets are as similar as asked."""
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _links_between(x: _Members, y: _Members, same: bool, key: int, percent: int) -> tuple[list, list]:
    """Verified links that connect different components of two blocks of a band: a spanning forest of them.

    A pair is looked at only in the first band it shares, if the registers let it through and its components
    aren't connected yet; likelier pairs come first, so most components meet at the first try.
    """
    root: dict = {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    band = int(np.flatnonzero((x.keys == key).any(axis=0))[0])
    met = np.zeros((len(x.ids), len(y.ids)), bool)
    for t in range(band):
        met |= x.keys[:, t][:, None] == y.keys[:, t][None, :]
    ok = (x.own[:, None] != y.own[None, :]) & ~met
    r, c = np.nonzero(np.triu(ok, 1) if same else ok)
    likely = [np.zeros(0, bool)]
    found = [np.zeros(0)]
    for at in range(0, len(r), BLOCK * BLOCK):
        i, j = r[at : at + BLOCK * BLOCK], c[at : at + BLOCK * BLOCK]
        likely.append(may_reach(x.regs[i], y.regs[j], x.n[i], y.n[j], percent / 100))
        found.append(estimate(x.regs[i], y.regs[j], x.n[i], y.n[j])[0])
    likely, found = np.concatenate(likely), np.concatenate(found)
    order = np.flatnonzero(likely)
    order = order[np.argsort(-found[order], kind="stable")]
    a, b = [], []
    for i, j in zip(r[order].tolist(), c[order].tolist(), strict=True):
        p, q = find(x.own[i]), find(y.own[j])
        if p != q and _reach(x.sets()[i], y.sets()[j], percent):
            root[p] = q
            a.append(x.ids[i])
            b.append(y.ids[j])
    return a, b


def _block_links(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links between different components that meet in a band.

    ``members``: ``key, id, component_id, n_shingles, regs, text``. A band's members are dealt into blocks of about
    ``BLOCK`` and about a megabyte of text; each pair of its blocks is one row and gives no more links than it has members.
    A component that fills more than one block has blocks of its own, which aren't paired with each other.
    """
    kind = members.schema["id"].dataType.simpleString()
    need = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / (1 << 20)), F.lit(1)).cast("int")
    sizes = members.groupBy("key", "component_id").agg(F.count("id").alias("n"), F.sum(F.octet_length("text")).alias("size")).withColumn("alone", need(F.col("n"), F.col("size")) > 1)
    of = lambda name: F.sum(F.when(~F.col("alone"), F.col(name)))
    owned = F.map_from_entries(F.collect_list(F.when(F.col("alone"), F.struct("component_id", need(F.col("n"), F.col("size"))))))
    sizes = sizes.groupBy("key").agg(need(of("n"), of("size")).alias("shared"), owned.alias("owned")).where("shared > 1 OR size(owned) > 0")
    # only bands of more than one block have a size, so that these are few and the texts aren't shuffled to meet them
    dealt = members.join(written(sizes, "sizes"), "key", "left").withColumn("owned", F.try_element_at("owned", "component_id")).withColumn("more", F.col("shared").isNotNull())
    block = F.pmod(F.xxhash64("id"), F.coalesce("owned", "shared", F.lit(1))).cast("string")
    dealt = dealt.withColumn("own", F.when(F.col("owned").isNotNull(), F.col("component_id"))).withColumn("block", F.coalesce(F.concat(F.col("own").cast("string"), F.lit(":"), block), block))
    blocks = dealt.groupBy("key", "own", "block", "more").agg(F.collect_list(F.struct("id", "component_id", "n_shingles", "regs", "text")).alias("rows"))
    blocks = written(blocks, "blocks", heavy=True)
    left, right = (blocks.where("more").select("key", F.col("own").alias(f"own_{x}"), F.col("block").alias(f"block_{x}"), F.col("rows").alias(f"rows_{x}")) for x in "ab")
    met = left.join(right, "key").where("block_a < block_b AND NOT coalesce(own_a = own_b, false)").select("key", F.lit(False).alias("same"), "rows_a", "rows_b")
    # only bands of more than one block are joined; a block is compared with itself where it is
    met = met.unionByName(blocks.where("own IS NULL").select("key", F.lit(True).alias("same"), F.col("rows").alias("rows_a"), F.slice("rows", 1, 0).alias("rows_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(1)[k].as_py()
                x = _Members(batch.column(2)[k].values, words)
                y = x if same else _Members(batch.column(3)[k].values, words)
                a, b = _links_between(x, y, same, batch.column(0)[k].as_py(), percent)
                ids = batch.column(2).type.value_type.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids)], names=["a", "b"])

    return met.mapInArrow(_words.tidy(run), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``key, n_shingles, component_id, kept``, one for each row of ``docs``.

    A document's set is that of its distinct shingles of ``words`` words (A-Z lower-cased words
    between white space); with fewer words, its whole sequence; without any, empty. Documents
    are linked where ``100 * intersection >= percent * union``. ``component_id`` is the least
    key reachable by links, ``kept`` whether that is the own key.

    Two sets at similarity s share a band with probability ``1 - (1 - s**4)**32`` (at 0.75: all but 5 in a
    million); every pair that does is compared or already connected. A pair at the threshold is lost as well where its registers' estimate
    falls six standard errors below it; a hash of 128 bits stands for a set where sets are called equal. Nulls and empty texts are linked with nothing.
    A null key is linked with nothing either: its component is null and it is kept. Rows that share a key are one
    document, linked by any of its texts. An empty table gives an empty one; further columns are ignored.
    """
    with tables_written() as made:
        out = _near_duplicates(docs, words, percent, text, key)
    # all but what the result is read from
    discard(docs.sparkSession, [p for p in made if not any(f"/matrel-{name}-" in p for name in ("sketches", "least", "components"))])
    return out


def _near_duplicates(docs: DataFrame, words: int, percent: int, text: str, key: str) -> DataFrame:
    threshold = percent / 100
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    made = written(sketches(own, words, key="id"), "sketches")
    whole = made.where("id IS NOT NULL AND n_shingles > 0")
    classes = written(whole.groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("rep"), F.count("id").alias("copies")), "classes")
    reps = written(whole.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "n_shingles", "regs"), "reps")
    kind = reps.schema["id"].dataType.simpleString()

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_regs(batch.column(1)))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), ids], names=["key", "id"])

    met = reps.select("id", "regs").mapInArrow(_words.tidy(bands), f"key long, id {kind}")
    firsts = written(met.groupBy("key").agg(F.min("id").alias("a"), F.count("id").alias("n")).where("n > 1").select("key", "a"), "bands")
    # Only members of bands with company go on.
    company = written(met.join(firsts, "key"), "company")
    stars = company.where("a <> id").select("a", F.col("id").alias("b")).distinct()
    likely = written(_likely(stars, reps, threshold), "likely")
    texts = _texts(own, likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))))
    linked = written(_verified(likely, texts, words, percent), "verified", heavy=True)
    # The classes that one key's texts belong to are one document: linked through the least.
    member = written(whole.join(classes, ["h1", "h2", "n_shingles"]).select("id", "rep").distinct(), "members")
    least = written(member.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")), "least")
    mixed = member.join(least.where("least <> most"), "id").where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    found = written(components(linked.unionByName(mixed)), "components")

    # Bands that still hold several components: compare the rest, in blocks.
    placed = company.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("component_id"))
    placed = written(placed, "placed")
    several = placed.groupBy("key").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.count("id").alias("n")).where("low <> high AND n > 2").select("key")
    open_ = written(placed.join(written(several, "several"), "key", "left_semi"), "open")
    if open_.head(1):
        further = _block_links(open_.join(reps, "id").join(_texts(own, open_), "id"), words, percent)
        # what is connected already stands for the links that connected it
        further = written(further, "further", heavy=True)
        found = written(components(further.unionByName(found.select(F.col("id").alias("a"), F.col("component_id").alias("b")))), "components")
    placed = least.select("id", F.col("least").alias("rep")).join(found.withColumnRenamed("id", "rep"), "rep", "left")
    out = made.select("id", "n_shingles").join(placed.select("id", F.coalesce("component_id", "rep").alias("component_id")), "id", "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, that are kept: one document of each component, and every one without a key."""
    kept = written(near_duplicates(docs, words, percent, text, key).where("kept").select(F.col(key).alias("kept_id")).where("kept_id IS NOT NULL").distinct(), "kept")
    return docs.join(kept, F.col(key) == F.col("kept_id"), "left_semi").unionByName(docs.where(F.col(key).isNull()))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


