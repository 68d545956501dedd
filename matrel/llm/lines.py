"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, to a leaf. Tokens
with a digit are variable at once. In a leaf, a token is constant where enough lines have it at that place;
any other is a variable field. Enough is a number of lines, and as well a share of the leaf's lines: the number finds templates
that are rare in their leaf, the shares keep a field variable however many lines hold each of its values. A line has a template
for each of these levels at which its constant share is high enough, its constants by place, and goes where one of them recurs
across documents.

A template recurs where it stands in texts of enough copy groups, whatever its neighbours: copies of one document repeat
its lines, which is for document dedup to judge, while boilerplate stands in texts of all kinds. A copy group is a connected
component of texts that resemble each other, found by bands of MinHash registers. A line counts once in each group, for constants
as for templates, so copies add nothing to a count, and take nothing from it. The longer a line, the fewer groups are enough.

Everything is counted by partial sums over the tree's nodes, so no leaf is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matrel.llm import _words, minhash
from matrel.llm._io import discard, table, tables_written, written
from matrel.llm.components import components

#: Copy groups in which a template of ordinary length must stand to recur.
LEAST = 5
#: Tokens from which a line is ordinary, long and very long: shorter ones need twice as many groups, long ones half, very long ones two.
ORDINARY, LONG, VERY_LONG = 5, 25, 50
#: Tokens a line must have (one or two words in a row recur by chance), leading tokens that choose the leaf, and the share of places that must be constant.
TOKENS, DEPTH, CONSTANT = 3, 3, 0.7
#: Shares of a leaf's lines from which a token is constant, besides the least number of lines.
SHARES = (0.0, 0.0625, 0.5)
#: Estimated similarity (of sets of five words in a row) from which a text is in another's copy group.
ALIKE = 0.5
#: Least and largest size of the bitmap of leaves, in bits, which is sent to all tasks: at most 32 MB. It has 32 bits
#: a leaf between these; with more leaves than that, more lines are looked up in the table of leaves, and the answer is the same.
BITMAP = 1 << 20, 1 << 28
_PART = 1 << 15
#: Into how many parts a recurring line's rows are dealt where they are looked up, so that one that stands everywhere isn't one task's.
SALTS = 16
#: Recurring kinds up to which they are sent to all tasks, 16 MB at most, and lines are cut where the texts are; with more, the texts are joined
#: with their lines. The answer is the same.
KINDS = 1 << 21
_VARIABLE = np.uint64(0x5851F42D4C957F2D)
_LEVELS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


class _Lines:
    """The lines of a batch of texts, with their tokens and leaves."""

    def __init__(self, column: pa.Array):
        off, data = _words.string_buffer(column)
        # each text begins a line, and so does what follows each line end
        starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], np.flatnonzero(data == 10) + 1]))
        starts = starts[starts < len(data)]
        self.doc = np.searchsorted(off, starts, side="right") - 1
        edges = np.concatenate([starts, [len(data)]]).astype(np.int64)
        words = _words.Words(edges, data)
        digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        self.token = np.where(digit[words.end] > digit[words.start], _VARIABLE, words.hash)
        self.first, self.count = words.first, words.counts()
        # the number of the line in its text: line ends of the text before it
        ends = np.concatenate([[0], np.cumsum(data == 10)])
        self.line = ends[starts] - ends[off[self.doc]]
        key = self.count.astype(np.uint64) * _LEVELS[0]
        for k in range(DEPTH):
            has = self.count > k
            key[has] += self.token[self.first[:-1][has] + k] * _LEVELS[1 + k]
        self.leaf = _words.mix64(key)

    def kinds(self, rows: np.ndarray) -> np.ndarray:
        """A hash of all tokens, in their places, of each of these lines, and of their leaf."""
        n = self.count[rows]
        ends = np.concatenate([[0], np.cumsum(n)])
        nth = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
        token = self.token[np.repeat(self.first[:-1][rows], n) + nth]
        mixed = np.concatenate([[np.uint64(0)], np.cumsum(_words.mix64(token + nth.astype(np.uint64) * _LEVELS[0]))])
        return _words.mix64((mixed[ends[1:]] - mixed[ends[:-1]]) ^ self.leaf[rows])


def needed(n: int, least: int = LEAST) -> int:
    """Copy groups in which a template of ``n`` tokens must stand."""
    return 2 * least if n < ORDINARY else least if n < LONG else max(2, (least + 1) // 2) if n < VERY_LONG else 2


def _needed(least: int) -> Column:
    """``needed`` of the column ``n``."""
    return F.when(F.col("n") < ORDINARY, needed(0, least)).when(F.col("n") < LONG, needed(ORDINARY, least)).when(F.col("n") < VERY_LONG, needed(LONG, least)).otherwise(needed(VERY_LONG, least))


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))


def _grouped(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with the copy group of its ``mark`` instead; a text that resembles no other is its own."""
    return df.join(groups, "mark", "left").withColumn("group", F.coalesce("group", "mark")).drop("mark")


def _leaves(rows: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """Leaves that lines of several copy groups reach, and of as many texts as a template there needs groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                found = _Lines(batch.column(1))
                long = found.count >= TOKENS
                mark = batch.column(0).to_numpy()[found.doc[long]]
                once = np.unique(np.stack([mark, found.leaf[long].view(np.int64), found.count[long].astype(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in once], names=["mark", "leaf", "n"])

    seen = rows.select("mark", "text").mapInArrow(_words.tidy(run), "mark long, leaf long, n long").distinct()
    met = _grouped(seen, groups).groupBy("leaf").agg(F.max("n").alias("n"), F.min("group").alias("low"), F.max("group").alias("high"), F.count("n").alias("texts"))
    return met.where((F.col("low") < F.col("high")) & (F.col("texts") >= _needed(least))).select("leaf")


def _bitmap(leaves: DataFrame) -> bytes:
    """A bit for each leaf's hash, in one piece of bounded size; other leaves may share bits and are sorted out later."""
    size = min(max(BITMAP[0], 1 << (32 * leaves.count()).bit_length()), BITMAP[1])
    at = F.pmod("leaf", F.lit(size))
    parts = leaves.groupBy(F.floor(at / _PART).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(_PART))).alias("bits")).collect()
    out = bytearray(size // 8)
    for r in parts:
        out[r["part"] * _PART // 8 : (r["part"] + 1) * _PART // 8] = r["bits"]
    return bytes(out)


def _candidates(rows: DataFrame, bits: bytes) -> DataFrame:
    """Rows ``id, mark, line, leaf, same, n, tokens`` for the lines whose leaf has its bit set; ``same`` is the hash of the line's kind."""
    held = rows.sparkSession.sparkContext.broadcast(bits)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.frombuffer(held.value, np.uint8)
        mask = np.uint64(8 * len(table_) - 1)
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                found = _Lines(batch.column(2))
                at = (found.leaf & mask).astype(np.int64)
                hit = np.flatnonzero((found.count >= TOKENS) & ((table_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))
                n = found.count[hit]
                offsets = np.concatenate([[0], np.cumsum(n)])
                place = np.repeat(found.first[:-1][hit] - offsets[:-1], n) + np.arange(offsets[-1])
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.token[place].view(np.int64)))
                doc = pa.array(found.doc[hit])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(found.line[hit].astype(np.int32)), pa.array(found.leaf[hit].view(np.int64)), pa.array(found.kinds(hit).view(np.int64)), pa.array(n.astype(np.int32)), tokens], names=["id", "mark", "line", "leaf", "same", "n", "tokens"])

    return rows.mapInArrow(_words.tidy(run), f"id {kind}, mark long, line int, leaf long, same long, n int, tokens array<long>")


def copy_groups(rows: DataFrame) -> DataFrame:
    """Rows ``mark, group`` for the texts (``mark, text``) that resemble others: the least mark of their connected component.

    Texts that share a band are each compared with the band's least; an estimate of at least ``ALIKE`` links them.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                first, hashes = _words.shingle_sets(_words.Words(*_words.string_buffer(batch.column(1))))
                some = np.flatnonzero(np.diff(first))
                regs = pa.array([r.tobytes() for r in minhash.registers(first, hashes)[some]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(np.diff(first)[some], pa.int64()), regs], names=["mark", "n", "regs"])

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = minhash.band_keys(minhash._regs(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), minhash.BANDS)), pa.array(keys.ravel())], names=["mark", "band"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.float64) for k in (2, 4))
            found, _ = minhash.estimate(minhash._regs(batch.column(3)), minhash._regs(batch.column(5)), n, m)
            yield batch.select([0, 1]).filter(pa.array(found >= ALIKE))

    sketches = rows.select("mark", "text").mapInArrow(_words.tidy(sketched), "mark long, n long, regs binary")
    sketches = written(sketches.groupBy("mark").agg(F.first("n").alias("n"), F.first("regs").alias("regs")), "sketches", heavy=True)
    bands = sketches.select("mark", "regs").mapInArrow(_words.tidy(banded), "mark long, band long")
    least = bands.groupBy("band").agg(F.min("mark").alias("group"), F.max("mark").alias("most")).where(F.col("group") < F.col("most"))
    least = written(least.select("band", "group"), "least")
    pairs = bands.join(least, "band").where(F.col("group") < F.col("mark")).select("mark", "group").distinct()
    both = pairs.join(sketches, "mark").join(sketches.select(F.col("mark").alias("group"), F.col("n").alias("n_g"), F.col("regs").alias("regs_g")), "group")
    linked = both.select("mark", "group", "n", "regs", "n_g", "regs_g").mapInArrow(_words.tidy(alike), "mark long, group long")
    return components(linked.select(F.col("mark").alias("a"), F.col("group").alias("b"))).select(F.col("id").alias("mark"), F.col("component_id").alias("group"))


def _recurring(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(candidate lines ``id, mark, line, leaf, same, ..``, recurring kinds ``leaf, same, template``)."""
    groups = copy_groups(rows)
    leaves = written(_leaves(rows, groups, least), "leaves")
    lines = _candidates(rows, _bitmap(leaves)).join(leaves, "leaf", "left_semi")
    lines = written(lines, "lines")
    # From here on a line is one of its kind: those of a leaf with the same tokens, with the copy groups it stands in.
    held = written(_grouped(lines.select("leaf", "same", "mark").distinct(), groups).distinct(), "held")
    kinds = lines.groupBy("leaf", "same").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    kinds = written(kinds.join(held.groupBy("leaf", "same").agg(F.count("group").alias("groups")), ["leaf", "same"]), "kinds")
    tokens = kinds.select("leaf", "same", "n", "groups", F.posexplode("tokens").alias("place", "token"))
    variable = int(_VARIABLE.astype(np.int64))
    constants = tokens.where(F.col("token") != variable).groupBy("leaf", "place", "token").agg(F.sum("groups").alias("count"), F.max("n").alias("n")).where(F.col("count") >= _needed(least))
    level = sum((F.col("count") >= F.col("size") * x).cast("int") for x in SHARES)
    constants = constants.join(kinds.groupBy("leaf").agg(F.sum("groups").alias("size")), "leaf").select("leaf", "place", "token", level.alias("level"))
    # Written, so that the join's two sides are both shuffled and a token that very many lines share can be split over tasks.
    constants = written(constants, "constants")
    fixed = tokens.join(constants, ["leaf", "place", "token"]).withColumn("bits", F.xxhash64("place", "token"))
    at = lambda k: F.when(F.col("level") > k, F.col("bits"))
    named = fixed.groupBy("leaf", "same", "n", "groups").agg(*[f for k in range(len(SHARES)) for f in (F.bit_xor(at(k)).alias(f"template{k}"), F.count(at(k)).alias(f"fixed{k}"))])
    templates = F.array(*[F.when(F.col(f"fixed{k}") >= CONSTANT * F.col("n"), F.col(f"template{k}")) for k in range(len(SHARES))])
    named = written(named.select("leaf", "same", "n", "groups", F.explode(F.array_distinct(F.array_compact(templates))).alias("template")), "named")
    # A group that holds several kinds of a template counts once.
    may = named.groupBy("leaf", "template").agg(F.sum("groups").alias("groups"), F.max("n").alias("n")).where(F.col("groups") >= _needed(least)).select("leaf", "template")
    each = held.join(named.join(may, ["leaf", "template"], "left_semi").select("leaf", "same", "n", "template"), ["leaf", "same"]).select("leaf", "template", "n", "group").distinct()
    recurring = each.groupBy("leaf", "template").agg(F.count("group").alias("groups"), F.max("n").alias("n")).where(F.col("groups") >= _needed(least)).select("leaf", "template")
    return lines, written(named.join(recurring, ["leaf", "template"]).groupBy("leaf", "same").agg(F.min("template").alias("template")), "recurring")


def recurring_lines(docs: DataFrame, least: int = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``id, mark, line, template``: the lines of which a template recurs, each once, with the least such template.

    ``mark`` is the text's hash, ``line`` counts from 0. Null and empty texts have no lines here; null keys are allowed; rows with equal
    key and text are one; an empty table gives none.
    """
    return _found_in(*_recurring(_rows(docs, text, key), least))


def _found_in(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The candidate lines of recurring kinds."""
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.select("id", "mark", "line", "leaf", "same", F.pmod(F.xxhash64("id", "line"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(found, ["leaf", "same", "salt"]).select("id", "mark", "line", "template")


def drop_recurring_lines(docs: DataFrame, least: int = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with recurring lines taken out of the text; all its columns stay, and ``n_lines``, ``n_dropped`` are added (replaced where they exist).

    Lines end at line feeds. Lines of fewer than ``TOKENS`` tokens are never dropped; ``needed`` says in how many copy groups a longer
    line's template must stand. A text that loses no line stays as it is, one that loses all becomes empty; null texts stay null and
    have no lines, an empty text has one. Rows with equal key and text are treated alike, each as one document; null keys are
    allowed. An empty table gives an empty one. Kinds of lines are known by 64-bit hashes.
    """
    with tables_written() as made:
        lines, found = _recurring(_rows(docs, text, key), least)
        kinds = found.select("same").limit(KINDS + 1).toArrow().column(0).to_numpy()
    if len(kinds) > KINDS:
        return _joined(docs, _found_in(lines, found), text, key)
    discard(docs.sparkSession, made)  # the kinds are all that is needed of them
    return _cut(docs, np.sort(kinds.view(np.uint64)), text)


def _out(docs: DataFrame, text: str) -> list[Column]:
    """The columns of the result, from ``rest``, ``text``, ``n_lines`` and ``n_dropped``."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return [(F.col("text") if c == text else F.col(f"rest.`{c}`")).alias(c) for c in names] + [F.col("n_lines"), F.col("n_dropped")]


def _rest(docs: DataFrame, text: str) -> Column:
    return F.struct(F.lit(True).alias("there"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest")


def _cut(docs: DataFrame, kinds: np.ndarray, text: str) -> DataFrame:
    """Lines of the given kinds (ascending hashes) taken out where the texts are: no text is moved."""
    held = docs.sparkSession.sparkContext.broadcast(kinds.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(held.value, np.uint64)
        # most lines miss this small table and aren't looked up
        sieve = np.zeros(1 << 16, bool)
        sieve[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        for whole in batches:
            for batch in _words.slices(whole, "text"):
                off, data = _words.string_buffer(batch.column(1))
                breaks = np.concatenate([[0], np.cumsum(data == 10)])
                valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
                n_lines = np.where(valid, np.diff(breaks[off]) + 1, 0)
                lines = _Lines(batch.column(1))
                rows = np.flatnonzero(lines.count >= TOKENS)
                same = lines.kinds(rows)
                maybe = np.flatnonzero(sieve[(same & np.uint64(0xFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, same[maybe]), max(len(known) - 1, 0))
                hit = rows[maybe[known[at] == same[maybe]]] if len(known) else rows[:0]
                dropped = np.bincount(lines.doc[hit], minlength=batch.num_rows)
                out = batch.column(1)
                if len(hit):
                    texts = out.to_pylist()
                    for d in np.flatnonzero(dropped).tolist():
                        gone = set(lines.line[hit[lines.doc[hit] == d]].tolist())
                        texts[d] = "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in gone)
                    out = pa.array(texts, out.type)
                yield pa.RecordBatch.from_arrays([batch.column(0), out, pa.array(n_lines.astype(np.int32)), pa.array(dropped.astype(np.int32))], names=["rest", "text", "n_lines", "n_dropped"])

    rows = docs.select(_rest(docs, text), F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_dropped", T.IntegerType())])
    return rows.mapInArrow(_words.tidy(run), schema).select(*_out(docs, text))


def _joined(docs: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """The same by a join of the texts with their recurring lines, for any number of kinds."""
    drops = written(found.groupBy("id", "mark").agg(F.collect_set("line").alias("lines")), "drops")
    marked = docs.select(_rest(docs, text), F.col(text).alias("text"), F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    joined = marked.join(drops.select(F.col("id").alias("id_d"), F.col("mark").alias("mark_d"), "lines"), F.col("id").eqNullSafe(F.col("id_d")) & (F.col("mark") == F.col("mark_d")), "left")
    parts = F.split("text", "\n", -1)
    # what is left by number, then looked up: both take a step a line. The array of one keeps the parts from being split anew each time
    left = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("lines"))
    kept = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(left(p), lambda i: F.get(p, i)), "\n")), F.lit(0))
    n_lines = F.when(F.col("text").isNotNull(), F.size(parts)).otherwise(0).alias("n_lines")
    out = joined.select("rest", F.when(F.col("lines").isNotNull(), kept).otherwise(F.col("text")).alias("text"), n_lines, F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(0).alias("n_dropped"))
    return out.select(*_out(docs, text))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their recurring lines: what was dropped, and digests of what is left."""
    out = drop_recurring_lines(table(spark, sf_dir, "documents"))
    left = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.length(left).cast("long").alias("n_chars"), F.sha2(left.cast("binary"), 256).alias("text_sha256"))
