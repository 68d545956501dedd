"""Best-fit packing of token sequences by bin completion.

The lengths to pack are 1..capacity, so the whole problem is a histogram of at
most ``capacity`` numbers, whatever the corpus. Bin completion solves it on the
driver: a best-fit packing is the incumbent, and while a waste bound leaves hope for a bin less, undominated
fillings around the largest length left are enumerated and branched over. A filling of the incumbent is
repeated while the counts allow, so the plan is a short list of (filling, times), and
each piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matrel.llm import _chunks, _words
from matrel.llm._io import table, written

CAPACITY = 1024
EOS = 2
#: Nodes of the search for one filling of the incumbent, steps of the search over bins, and bins it packs anew at once.
NODES, STEPS, WINDOW = 2000, 200_000, 48


def piece_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: all full but the first, which takes the rest."""
    if total <= capacity:
        return [total]
    rest = total % capacity
    return [rest] * (rest > 0) + [capacity] * (total // capacity)


def best_filling(room: int, sizes: list[int], counts: dict[int, int], budget: int = NODES) -> list[int]:
    """The undominated filling of ``room`` that wastes least.

    ``sizes``: ascending lengths with something left. Depth first from the largest
    that fits, so that the first filling met is the best-fit one (the incumbent); a branch is
    cut when even filling it to the brim with what fits cannot beat the incumbent, and
    the search ends at a filling without waste or after ``budget`` nodes, keeping the
    incumbent. A filling that leaves room for a further length is dominated by the one that
    has it, and a smaller length where a larger one fits with the same rest is dominated too:
    neither is ever returned.
    """
    best: list[int] = []
    best_waste = room + 1
    nodes = 0
    used: dict[int, int] = {}

    def go(left: int, top: int, chosen: list[int]) -> bool:
        nonlocal best, best_waste, nodes
        nodes += 1
        k = bisect_right(sizes, left, 0, top) - 1
        while k >= 0 and counts[sizes[k]] - used.get(sizes[k], 0) <= 0:
            k -= 1
        if k < 0:
            if left < best_waste:
                best, best_waste = chosen.copy(), left
            return best_waste == 0
        while k >= 0:
            s = sizes[k]
            have = counts[s] - used.get(s, 0)
            if have > 0:
                used[s] = used.get(s, 0) + 1
                chosen.append(s)
                done = go(left - s, k + 1, chosen)
                chosen.pop()
                used[s] -= 1
                if done:
                    return True
            if nodes > budget:
                return False
            k -= 1
            # everything from here on is at most sizes[k]: what it can reach at best
            if k >= 0:
                reach, most = 0, left
                for j in range(k, -1, -1):
                    reach += sizes[j] * (counts[sizes[j]] - used.get(sizes[j], 0))
                    if reach >= most:
                        break
                if reach < most and left - reach >= best_waste:
                    return False
        return False

    go(room, len(sizes), [])
    return best


def least_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """A number of bins that no packing goes below: the waste bound.

    For each threshold, lengths over ``capacity - threshold`` are alone, others over half share no bin, and what of the
    lengths from the threshold to the half exceeds the room beside these needs bins of its own.
    """
    n = np.zeros(capacity + 1, np.int64)
    for s, k in histogram.items():
        n[s] += k
    size = np.arange(capacity + 1)
    many, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])  # of lengths below
    half = capacity // 2
    best = 0
    for a in range(half + 1):
        large = int(many[-1] - many[half + 1])
        beside = int((many[capacity - a + 1] - many[half + 1]) * capacity - (total[capacity - a + 1] - total[half + 1]))
        small = int(total[half + 1] - total[a])
        best = max(best, large + max(0, -(-(small - beside) // capacity)))
    return best


class _Completion:
    """Bin completion as a depth-first search over bins: is there a packing into a given number of bins?

    The largest length left opens a bin; its undominated fillings are tried one after the other, those of largest
    lengths first. A filling whose waste, with that of the bins before, exceeds what the given number of bins can waste
    is cut. ``steps`` bounds the search; ``ended`` says whether it came to its end, so that no packing is a proof.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, steps: int):
        self.counts = {s: n for s, n in sorted(histogram.items()) if n > 0}
        self.capacity, self.steps, self.ended = capacity, steps, True
        self.total = sum(s * n for s, n in self.counts.items())

    def into(self, bins: int) -> list[list[int]] | None:
        self.spare = bins * self.capacity - self.total
        self.found: list[list[int]] = []
        return self.found if self.spare >= 0 and self._go(self.spare) else None

    def _go(self, spare: int) -> bool:
        top = max((s for s, n in self.counts.items() if n), default=0)
        if not top:
            return True
        self.counts[top] -= 1
        for filling in self._fillings(self.capacity - top, spare):
            if self.steps <= 0:
                break
            for s in filling:
                self.counts[s] -= 1
            self.found.append([top, *filling])
            if self._go(spare - (self.capacity - top - sum(filling))):
                return True
            self.found.pop()
            for s in filling:
                self.counts[s] += 1
        self.counts[top] += 1
        return False

    def _fillings(self, room: int, spare: int) -> Iterator[list[int]]:
        """The undominated fillings of ``room`` that waste at most ``spare``."""
        sizes = [s for s, n in self.counts.items() if n and s <= room]
        sums = np.concatenate([[0], np.cumsum([s * self.counts[s] for s in sizes])]).tolist()
        chosen: list[int] = []

        def go(left: int, k: int) -> Iterator[list[int]]:
            self.steps -= 1
            if self.steps <= 0:
                self.ended = False
                return
            if left - sums[k] > spare:
                return
            if k == 0:
                if not self._dominated(chosen, left, sizes):
                    yield list(chosen)
                return
            s = sizes[k - 1]
            most = min(self.counts[s], left // s)
            for n in range(most, -1, -1):
                chosen.extend([s] * n)
                yield from go(left - n * s, k - 1)
                del chosen[len(chosen) - n :]

        yield from go(room, len(sizes))

    def _dominated(self, chosen: list[int], left: int, sizes: list[int]) -> bool:
        """Whether a length that is left over could be added, or take the place of one or two of the filling and waste no more."""
        free = [s for s in sizes if self.counts[s] > chosen.count(s)]
        if not free:
            return False
        if free[0] <= left:
            return True
        own = sorted(set(chosen))
        two = {a + b for i, a in enumerate(own) for b in own[i if chosen.count(a) > 1 else i + 1 :]}
        for x, least in [*((s, s + 1) for s in own), *((s, s) for s in two)]:
            at = bisect_right(free, x + left)
            if at and free[at - 1] >= least:
                return True
        return False


def _greedy(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """The incumbent: around the largest length left the filling that wastes least, repeated while every length in it lasts."""
    counts = {s: n for s, n in sorted(histogram.items()) if n > 0}
    sizes = list(counts)
    out: list[tuple[list[int], int]] = []
    while sizes:
        top = sizes[-1]
        counts[top] -= 1
        rest = best_filling(capacity - top, sizes, counts) if capacity > top else []
        counts[top] += 1
        filling = [top, *rest]
        need: dict[int, int] = {}
        for s in filling:
            need[s] = need.get(s, 0) + 1
        times = min(counts[s] // n for s, n in need.items())
        out.append((filling, times))
        for s, n in need.items():
            counts[s] -= n * times
        sizes = [s for s in sizes if counts[s] > 0]
    return out


def _lengths(fillings: list[list[int]]) -> dict[int, int]:
    out: dict[int, int] = {}
    for filling in fillings:
        for s in filling:
            out[s] = out.get(s, 0) + 1
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used, so that all lengths of ``histogram`` are placed.

    ``_greedy`` gives the incumbent. While it has more bins than ``least_bins``, branch and bound looks for one bin fewer: over all bins
    where there are at most ``window``, else over the ``window`` bins that waste most, which are packed anew among themselves. Packing
    is NP-hard, so a search ends after ``steps`` steps; it is exact where it ends before. All lengths are placed in any case.
    """
    if any(not 0 < s <= capacity for s, n in histogram.items() if n > 0):
        raise ValueError(f"lengths must be 1..{capacity}")
    out = _greedy(histogram, capacity)
    bins, least = sum(n for _, n in out), least_bins({s: n for s, n in histogram.items() if n > 0}, capacity)
    while bins > least:
        out.sort(key=lambda x: sum(x[0]))  # stable: the most wasteful first
        taken: list[list[int]] = []
        rest: list[tuple[list[int], int]] = []
        for filling, n in out:
            k = min(n, window - len(taken))
            taken += [filling] * k
            if n > k:
                rest.append((filling, n - k))
        better = _Completion(_lengths(taken), capacity, steps).into(len(taken) - 1)
        if better is None:
            break
        out, bins = [*rest, *((x, 1) for x in better)], bins - 1
    return out


class Layout:
    """Where the r-th piece of a length goes: (sequence, offset)."""

    def __init__(self, fillings: list[tuple[list[int], int]]):
        spans: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        have: dict[int, int] = {}
        base = 0
        for filling, times in fillings:
            at, places = 0, {}
            for s in filling:
                places.setdefault(s, []).append(at)
                at += s
            for s, offsets in places.items():
                spans.setdefault(s, []).append((have.get(s, 0), base, len(offsets), offsets))
                have[s] = have.get(s, 0) + times * len(offsets)
            base += times
        self.sequences = base
        self._starts = {s: np.array([x[0] for x in v]) for s, v in spans.items()}
        self._spans = spans

    def place(self, length: int, rank: int) -> tuple[int, int]:
        k = int(np.searchsorted(self._starts[length], rank, side="right")) - 1
        start, base, per, offsets = self._spans[length][k]
        turn, slot = divmod(rank - start, per)
        return base + turn, offsets[slot]


def encode_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, eos: int = EOS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``key, piece, start, length, ids_crc32``: each document's ids, ended by ``eos``, cut into pieces.

    A null or empty text is the one id ``eos``; null keys and repeated rows stay; an empty table gives an empty one; further columns are ignored.
    """
    path = path or _chunks.default_path()
    end = int(eos).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _chunks.encoder(path)
        for batch in (part for whole in batches for part in _words.slices(whole, "text")):
            take, piece, start, length, crc = [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                ids = (encoder.ids(t) if t else b"") + end
                at = 0
                for k, n in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    take.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    at += n
            keys = batch.column(0).take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["key", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_words.tidy(run), f"key {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, eos: int = EOS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document's pieces with their sequence and offset, in as few sequences as bin completion finds.

    Returns ``key, piece, start, length, ids_crc32, sequence_id, offset``. Sequences
    hold at most ``capacity`` tokens and have no gaps. A null or empty text is the one token
    ``eos``. A null key stays null; repeated rows are packed as often as they come; an empty
    table gives an empty one; further columns are ignored.

    Only the histogram of lengths (at most ``capacity`` numbers) and the rank offsets
    leave the executors' tables. The rank of a piece among those of its length is the
    offset of its bucket, summed over counts by (length, bucket), plus its place in the
    bucket, so a length that most pieces share is spread like any other.
    """
    spark = docs.sparkSession
    pieces = written(encode_pieces(docs, path, capacity, eos, text, key), "pieces")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 2
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = spread.groupBy("length", "bucket").count()
    sums = written(sums, "lengths")
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    layout = Layout(plan(histogram, capacity))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("length", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("key", "piece", "ids_crc32")
    ranked = spread.withColumn("nth", F.row_number().over(within)).join(before, ["length", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layout.place(n, r) for n, r in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    out = ranked.select("key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
