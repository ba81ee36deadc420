"""Signal and moments of timelines of any length.

``signal`` and ``moments`` keep a group's bins together. Here a group is cut into chunks
of ``CHUNK`` bins, and rows are dealt by (group, chunk), so one long timeline spreads over
tasks. A chunk is one row that holds its bins as an array, so no bin is a row until the
end. A kernel's reach is handled by sending a bin to every chunk that it touches; a
neighbour's value by a halo of one bin on each side; what runs through the whole group
(island numbers, the nearest valley on each side) by carries: a chunk sums itself
up in one row, a window over these rows, of which a group has one for each chunk, gives
what comes before and after, and the carry is joined back by chunk.

``smooth``, ``normalise``, ``with_threshold`` and ``valleys`` take and give a row for each
bin; their namesakes with ``chunks`` a row for each chunk, which is read again by later
steps and so is written once. Results are those of ``signal`` and ``moments`` at any size of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelode.operators import moments as M
from timelode.sources.storage import stored

CHUNK = 1024
#: Bins that a task works on at once.
CELLS = 1 << 18


def _rows(chunks: DataFrame, keys: Sequence[str], *others: str) -> DataFrame:
    """A row for each bin."""
    return chunks.select(*keys, "n", "chunk", *others, F.posexplode("bins").alias("at_", "bin_"))


def _gathered(rows: DataFrame, keys: Sequence[str], *others: str) -> DataFrame:
    """Rows of bins (keys, n, chunk, idx, value, others: one value a group) -> chunks."""
    found = rows.groupBy(*keys, "n", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("b"), *[F.first(c).alias(c) for c in others])
    return found.select(*keys, "n", "chunk", F.col("b")[0]["idx"].alias("first"), F.col("b.value").alias("bins"), *others)


def _beside(chunks: DataFrame, figures: DataFrame, on: Sequence[str]) -> DataFrame:
    """chunks with figures of the same keys, nulls among them."""
    other = figures.select(*[F.col(c).alias(f"{c}_") if c in on else F.col(c) for c in figures.columns])
    meet = [chunks[c].eqNullSafe(other[f"{c}_"]) for c in on]
    cond = meet[0]
    for one in meet[1:]:
        cond = cond & one
    return chunks.join(other, cond).drop(*[f"{c}_" for c in on])


def _with_figures(chunks: DataFrame, keys: Sequence[str], figures: DataFrame) -> DataFrame:
    """A group's figures beside its chunks. They go to each chunk's row, so that chunks of a
    long timeline needn't come together."""
    places = _beside(chunks.select(*keys, "chunk"), figures, keys)
    return _beside(chunks, places, [*keys, "chunk"])


def smooth_chunks(binned: DataFrame, keys: Sequence[str], kernel: dict[int, float], chunk: int = CHUNK) -> DataFrame:
    """binned (keys, n, idx, score) -> keys, n, chunk, first, bins: the smoothed bins from ``first`` on."""
    radius, n = max(kernel), F.col("n")
    # an edge bin stands for all positions beyond it
    first = F.when(F.col("idx") == 0, F.lit(-radius)).otherwise(F.col("idx"))
    last = F.when(F.col("idx") == n - 1, n - 1 + radius).otherwise(F.col("idx"))
    within = lambda x: F.floor(F.greatest(F.lit(0), F.least(n - 1, x)) / chunk).cast("long")
    reached = F.sequence(within(first - radius), within(last + radius))
    full = binned.where("score > 0").select(*keys, "n", F.explode(reached).alias("chunk"), first.cast("long").alias("low"), last.cast("long").alias("high"), "score")
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / chunk).cast("long"))
    none = F.lit(None)
    # a chunk's first row, without a score, makes it whether it has scores or not
    grid = binned.select(*keys, "n").distinct().select(*keys, "n", F.explode(chunks).alias("chunk"), none.cast("long").alias("low"), none.cast("long").alias("high"), none.cast("double").alias("score"))
    order = [*keys, "n", "chunk"]
    dealt = full.unionByName(grid).repartition(*order).sortWithinPartitions(*order, F.col("low").asc_nulls_first())
    taps = np.array([kernel.get(k, 0.0) for k in range(-radius, radius + 1)])
    schema = T.StructType([dealt.schema[c] for c in order] + [T.StructField("first", T.LongType()), T.StructField("bins", T.ArrayType(T.DoubleType()))])

    def convolved(rows: pa.Table) -> pa.RecordBatch:
        """Whole chunks -> a row for each."""
        low, high, score = (rows[c].to_numpy() for c in ("low", "high", "score"))
        heads = np.flatnonzero(rows["score"].is_null().to_numpy())
        own, start = np.cumsum(rows["score"].is_null().to_numpy()) - 1, rows["chunk"].to_numpy()[heads] * chunk
        size = np.minimum(rows["n"].to_numpy()[heads] - start, chunk)
        real = np.flatnonzero(rows["score"].is_valid().to_numpy())
        a = np.maximum(low[real].astype(np.int64), start[own[real]] - radius) - start[own[real]] + radius
        b = np.minimum(high[real].astype(np.int64), start[own[real]] + size[own[real]] - 1 + radius) - start[own[real]] + radius
        times = np.maximum(0, b - a + 1)
        at = np.repeat(a - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
        wide = int(size.max(initial=0))
        dense = np.zeros((len(heads), wide + 2 * radius))
        np.add.at(dense, (np.repeat(own[real], times), at), np.repeat(score[real], times))
        out = np.zeros((len(heads), wide))
        with np.errstate(invalid="ignore"):
            for k, weight in enumerate(taps):
                # a bin adds to the one ``radius - k`` places before it
                out += dense[:, 2 * radius - k : 2 * radius - k + wide] * weight if weight else 0.0
        kept = np.arange(wide) < size[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(out[kept]))
        take = pa.array(heads)
        return pa.RecordBatch.from_arrays([*(rows[c].take(take).combine_chunks() for c in order), pa.array(start), lists], names=[*order, "first", "bins"])

    most = max(1, CELLS // (chunk + 2 * radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            heads = np.flatnonzero(rows["score"].is_null().to_numpy())
            # the last chunk may go on in the next batch
            edges = [*heads[:-1:most].tolist(), int(heads[-1])] if len(heads) > 1 else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield convolved(rows.slice(a, b - a))
            held = rows.slice(int(heads[-1]))
        if held is not None:
            yield convolved(held)
        pa.default_memory_pool().release_unused()

    return dealt.mapInArrow(run, schema)


def smooth(binned: DataFrame, keys: Sequence[str], kernel: dict[int, float], chunk: int = CHUNK) -> DataFrame:
    """binned (keys, n, idx, score) -> keys, n, chunk, idx, smoothed for every bin."""
    found = _rows(smooth_chunks(binned, keys, kernel, chunk), keys, "first")
    return found.select(*keys, "n", "chunk", (F.col("first") + F.col("at_")).alias("idx"), F.col("bin_").alias("smoothed"))


def normalise_chunks(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """chunks (written ones) with their bins scaled to [0, 1] by the group's range."""
    whole = stored(chunks.groupBy(*keys).agg(F.min(F.array_min("bins")).alias("low"), F.max(F.array_max("bins")).alias("high")), "timeline-ranges")
    low, high = F.col("low"), F.col("high")
    value = lambda x: F.round(F.when(high > low, (x - low) / (high - low)).otherwise(x), 9)
    return _with_figures(chunks, keys, whole).withColumn("bins", F.transform("bins", value)).drop("low", "high")


def normalise(smoothed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, chunk, idx, smoothed, value: scaled to [0, 1] by the group's range."""
    rows = stored(smoothed, "timeline-smoothed")
    whole = stored(rows.groupBy(*keys).agg(F.min("smoothed").alias("low"), F.max("smoothed").alias("high")), "timeline-ranges")
    value = F.when(F.col("high") > F.col("low"), (F.col("smoothed") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.col("smoothed"))
    return _beside(rows, whole, keys).select(*keys, "n", "chunk", "idx", "smoothed", F.round(value, 9).alias("value"))


def _thresholds(values: DataFrame, keys: Sequence[str], factor: float) -> DataFrame:
    stats = values.groupBy(*keys).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))
    return stored(stats.select(*keys, F.round(F.col("mu") + factor * F.col("sigma"), 9).alias("theta")), "timeline-thresholds")


def with_threshold_chunks(chunks: DataFrame, keys: Sequence[str], factor: float = M.THRESHOLD_FACTOR) -> DataFrame:
    """chunks (written ones) with theta, over all bins of a group."""
    return _with_figures(chunks, keys, _thresholds(chunks.select(*keys, F.explode("bins").alias("value")), keys, factor))


def with_threshold(signal: DataFrame, keys: Sequence[str], factor: float = M.THRESHOLD_FACTOR) -> DataFrame:
    rows = stored(signal, "timeline-signal")
    return _beside(rows, _thresholds(rows, keys, factor), keys)


def _walked(bins: np.ndarray, first: int, theta: float, before: float, after: float, gap: int) -> dict[str, np.ndarray]:
    """Flags of a chunk's bins, and what is nearest to each within it; -1 and LAST for none."""
    at = np.arange(first, first + len(bins))
    low, deep, above = bins <= theta, bins < M.VALLEY * theta, bins >= theta
    rise_left = low & (np.append(before, bins[:-1]) > bins)
    rise_right = low & (np.append(bins[1:], after) > bins)
    mark = lambda flag, none: np.where(flag, at, none)
    past = lambda x: np.maximum.accumulate(x) if len(x) else x
    future = lambda x: np.minimum.accumulate(x[::-1])[::-1] if len(x) else x
    last_above = np.append(-1, past(mark(above, -1))[:-1])
    starts = above & (last_above >= 0) & (at - last_above > gap)
    left = np.maximum(past(mark(rise_left, -1)), np.append(-1, past(mark(deep, -1))[:-1]))
    right = np.minimum(future(mark(rise_right, LAST)), np.append(future(mark(deep, LAST))[1:], LAST))
    return {"at": at, "above": above, "starts": starts, "island": np.cumsum(starts), "left": left, "right": right, "lefts": rise_left | deep, "rights": rise_right | deep}


LAST = np.iinfo(np.int64).max


def _each(rows: pa.RecordBatch, gap: int) -> Iterator[dict[str, np.ndarray]]:
    lists = rows.column("bins")
    values, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    number = lambda c: rows.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    theta, before, after, first = number("theta"), number("before"), number("after"), rows.column("first").to_numpy()
    for i in range(rows.num_rows):
        yield _walked(values[edges[i] : edges[i + 1]], int(first[i]), theta[i], before[i], after[i], gap)


SUMS = ("first_above", "last_above", "starts", "lefts", "rights")


def valleys_chunks(chunks: DataFrame, keys: Sequence[str], gap: int = M.GAP) -> DataFrame:
    """chunks (written ones) with theta -> keys, n, cluster, peak, score, left, right, as ``moments.valleys``."""
    place = ["n", "chunk"]
    along = Window.partitionBy(*keys).orderBy("chunk")
    ends = chunks.select(*keys, "chunk", F.col("bins")[0].alias("head"), F.element_at("bins", -1).alias("tail"))
    halo = ends.select(*keys, "chunk", F.lag("tail").over(along).alias("before"), F.lead("head").over(along).alias("after"))
    halo = stored(halo, "timeline-halos")
    long = lambda names: [T.StructField(c, T.LongType()) for c in names]
    own = [chunks.schema[c] for c in (*keys, *place)]

    # a row for each chunk, and what runs through a group
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for w in _each(rows, gap):
                top = lambda flag, w=w: w["at"][w[flag]]
                a, lefts, rights = top("above"), top("lefts"), top("rights")
                out.append((a[0] if len(a) else None, a[-1] if len(a) else None, int(w["starts"].sum()), lefts[-1] if len(lefts) else None, rights[0] if len(rights) else None))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (*keys, *place)), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], names=[*keys, *place, *SUMS]) if out else rows.select([*keys, *place]).slice(0, 0)

    sums = _beside(chunks, halo, [*keys, "chunk"]).mapInArrow(summed, T.StructType(own + long(SUMS)))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("first_above") - F.max("last_above").over(earlier) > gap, 1).otherwise(0)
    carry = sums.select(*keys, "chunk", "first_above", "starts", opens.alias("opens"), F.max("lefts").over(earlier).alias("left_before"), F.min("rights").over(later).alias("right_after"))
    islands = F.coalesce(F.sum(F.col("starts") + F.col("opens")).over(earlier), F.lit(0))
    carry = carry.select(*keys, "chunk", (islands + F.col("opens")).cast("long").alias("islands"), "left_before", "right_after", F.col("first_above").isNotNull().alias("some"))
    carry = stored(_beside(carry.where("some").drop("some"), halo, [*keys, "chunk"]), "timeline-carries")

    # the best bin of each island of a chunk
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n, islands_, before, after = (rows.column(c).fill_null(-1 if c == "left_before" else LAST).to_numpy() for c in ("n", "islands", "left_before", "right_after"))
            values, edges = rows.column("bins").values.to_numpy(zero_copy_only=False), rows.column("bins").offsets.to_numpy()
            found: list[tuple] = []
            for i, w in enumerate(_each(rows, gap)):
                bins, up = values[edges[i] : edges[i + 1]], np.flatnonzero(w["above"])
                order = up[np.lexsort((up, -bins[up], w["island"][up]))]
                for j in order[np.append(True, np.diff(w["island"][order]) > 0)] if len(order) else ():
                    found.append((i, islands_[i] + w["island"][j], w["at"][j], bins[j], max(w["left"][j], before[i], 0), min(w["right"][j], after[i], n[i] - 1)))
            row, *rest = zip(*found, strict=True) if found else ([], [], [], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(take) for c in (*keys, "n")), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names=[*keys, "n", "cluster", "idx", "value", "left", "right"])

    schema = T.StructType([chunks.schema[c] for c in (*keys, "n")] + long(["cluster", "idx"]) + [T.StructField("value", T.DoubleType())] + long(["left", "right"]))
    some = _beside(chunks, carry, [*keys, "chunk"]).mapInArrow(best, schema)
    found = some.groupBy(*keys, "n", "cluster").agg(F.min_by(F.struct("idx", "value", "left", "right"), F.struct(-F.col("value"), F.col("idx"))).alias("at"))
    return found.select(*keys, "n", "cluster", F.col("at.idx").alias("peak"), F.col("at.value").alias("score"), F.col("at.left").alias("left"), F.col("at.right").alias("right"))


def valleys(signal: DataFrame, keys: Sequence[str], chunk: int = CHUNK, gap: int = M.GAP) -> DataFrame:
    """signal (keys, n, chunk, idx, value, theta) -> keys, n, cluster, peak, score, left, right,
    as ``moments.valleys``. chunk: its size in the signal."""
    return valleys_chunks(stored(_gathered(signal, keys, "theta"), "timeline-chunks"), keys, gap)


def moments(binned: DataFrame, keys: Sequence[str], kernel: dict[int, float], chunk: int = CHUNK) -> DataFrame:
    """binned (keys, n, idx, score) -> the valleys of its smoothed and scaled signal, at its own thresholds."""
    smoothed = stored(smooth_chunks(binned, keys, kernel, chunk), "timeline-smoothed")
    scaled = stored(normalise_chunks(smoothed, keys), "timeline-scaled")
    return valleys_chunks(stored(with_threshold_chunks(scaled, keys), "timeline-chunks"), keys)
