"""Spikes, stuck series and impossible values in measurements.

Each series (one item of one entity) is followed by a local-level state-space model
on the logarithm of its readings, once forwards and once backwards in time. Readings
whose standardised innovation is large both ways, with the level before and after in
agreement, are spikes; their updates are withheld. Beside it runs the same model without
noise, whose innovation is the step from the reading before: a series is stuck where the
variance of these innovations vanishes over more updates than the item's own readings
make credible. Noise scales, run lengths and the range of each item come from all of its
readings, as histograms that add up map-side.

Readings are sorted by series once and written to the shared checkpoint folder packed
into one row a series, beside the histograms of each item; the filter then reads the
packed series. Work on a series is bounded whatever its length: a task cuts what it
reads into chunks with overlapping ends, and a series that holds more than a two
thousandth of all readings is spread over tasks by time. The filter forgets within a few
dozen readings, far fewer than the overlap, so neither changes the outcome.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.session import broadcast_if_small, cut_lineage

# What a living patient can show, by unit of the item (lower bound, upper bound).
UNIT_LIMITS = {
    "%": (0.0, 100.0),
    "bpm": (10.0, 350.0),
    "mmhg": (5.0, 330.0),
    "insp/min": (1.0, 120.0),
    "f": (70.0, 115.0),
    "c": (21.0, 46.0),
}

#: Width of the histograms' bins on the log scale, of values and of steps.
VALUE_BIN, STEP_BIN = 0.005, 0.02
#: Bin of steps of nothing.
NO_STEP = -(1 << 20)
#: Run lengths that are counted apart; longer ones count as the last.
RUNS = 8


@dataclass(frozen=True)
class Layout:
    """How the work is cut; this decides where it runs, not what it finds.

    Readings of a series that are filtered together, and those repeated on either side of
    them; readings a task holds before it packs or judges them. One reading in
    `hot_sample` shows which series are hot: those with more than `hot_part` of all
    readings, which so number fewer than its inverse, are spread over tasks.
    """

    chunk_rows: int = 4096
    halo_rows: int = 512
    held_rows: int = 40_000
    hot_sample: int = 64
    hot_part: float = 1 / 2000


@dataclass(frozen=True)
class Tuning:
    """Thresholds of the detector; all are scale-free and hold at any size."""

    spike_z: float = 6.0
    level_z: float = 5.0
    run_p: float = 1e-5
    run_least: int = 6
    soft_power: float = 3.0
    hard_power: float = 6.0
    least_ratio: float = 2.0
    least_rows: int = 30


def bad_readings(readings: DataFrame, tuning: Tuning = Tuning(), layout: Layout = Layout()) -> DataFrame:
    """Rows (source, row_id, reason) that are impossible, spikes or stuck.

    `readings`: source, row_id, entity, item, ts, value, unit. Null and NaN values are no
    readings. Rows without item are judged on sign and unit alone; rows without entity
    or ts against their item only. Readings alike in series, time and value are one to
    the filter and all come out. An item with fewer than `least_rows` readings borrows
    the pooled scale of its source. Empty input gives no rows.
    """
    rows = readings.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(
        "source", F.col("row_id").cast("long").alias("row_id"), F.col("entity").cast("long").alias("entity"), F.col("item").cast("long").alias("item"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").cast("double").alias("value"), "unit",
    )
    limits = F.create_map(*[x for u, (a, b) in UNIT_LIMITS.items() for x in (F.lit(u), F.array(F.lit(a), F.lit(b)))])
    fix = F.try_element_at(limits, F.lower(F.trim("unit")))
    never = (F.col("value") < 0) | F.coalesce((F.col("value") < fix[0]) | (F.col("value") > fix[1]), F.lit(False))
    loose = F.col("entity").isNull() | F.col("t").isNull() | F.col("item").isNull()
    marked = rows.withColumn("never", never).withColumn("loose", loose).drop("unit")
    placed = _placed(marked, layout)
    # The hash comes first in the sort, so rows are ordered by its eight-byte prefix; the keys behind it keep series apart.
    ordered = placed.repartition("k").sortWithinPartitions(*SERIES, "t", "value", "row_id")
    packed = cut_lineage(ordered.mapInArrow(_packer(layout), PACKED))
    scales = broadcast_if_small(_scales(packed.filter("bins is not null"), tuning))
    series = packed.filter("bins is null").drop("bins", "counts").join(scales, ["source", "item"], "left")
    cols = ["source", "loose", "t", "value", "row_id", "own", "never", "floor", "soft_hi", "soft_lo", "hard_hi", "hard_lo", "r", "q", "run_limit"]
    return series.select(*cols).mapInArrow(_judge_packed(tuning, layout), "source string, row_id long, reason string")


SERIES = ["k", "source", "item", "entity", "loose", "block"]
PACKED = "source string, item long, loose boolean, t array<long>, value array<double>, row_id array<long>, own array<boolean>, never array<boolean>, bins array<long>, counts array<long>"
_PACKED = pa.schema(
    [("source", pa.string()), ("item", pa.int64()), ("loose", pa.bool_()), ("t", pa.list_(pa.int64())), ("value", pa.list_(pa.float64())), ("row_id", pa.list_(pa.int64())), ("own", pa.list_(pa.bool_())), ("never", pa.list_(pa.bool_())), ("bins", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)


def _placed(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows with block, own and the key `k` that sends them to a task.

    Hot series have one block for each two thousandth of all readings, by time; the
    eighth of a block next to its neighbour is repeated there with own = false. Loose
    rows belong to no series and are spread by their ids.
    """
    series = ["source", "item", "entity"]
    some = rows.filter((F.pmod(F.xxhash64("row_id"), F.lit(layout.hot_sample)) == 0) & ~F.col("loose"))
    per = some.groupBy(*series).agg(F.count(F.lit(1)).alias("_c"), F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    per = per.withColumn("_all", F.sum("_c").over(Window.partitionBy()))
    block_rows = F.greatest(F.lit(4 * layout.chunk_rows / layout.hot_sample), F.col("_all") * layout.hot_part)
    # Fewer than 1 / hot_part series can hold more than hot_part of the readings each.
    hot = per.filter(F.col("_c") > block_rows).withColumn("_n", F.ceil(F.col("_c") / block_rows)).select(*series, "_n", "_t0", ((F.col("_t1") - F.col("_t0")) / (8 * F.col("_n")) + 1).alias("_width"))
    at = rows.join(broadcast_if_small(hot), series, "left")
    part = F.greatest(F.lit(0), F.least(F.floor((F.col("t") - F.col("_t0")) / F.col("_width")), 8 * F.col("_n") - 1))
    block = F.floor(F.col("_part") / 8)
    here = lambda b, own: F.struct(b.cast("long").alias("block"), F.lit(own).alias("own"))
    around = F.filter(
        F.array(
            here(block, True),
            F.when((F.col("_part") % 8 == 7) & (block < F.col("_n") - 1), here(block + 1, False)),
            F.when((F.col("_part") % 8 == 0) & (block > 0), here(block - 1, False)),
        ),
        lambda s: s.isNotNull(),
    )
    alone = F.array(here(F.when(F.col("loose"), F.pmod(F.xxhash64("row_id"), F.lit(4096))).otherwise(F.lit(0)), True))
    spread = at.withColumn("_part", part).withColumn("_to", F.explode(F.when(F.col("_n").isNull(), alone).otherwise(around)))
    spread = spread.select(*rows.columns, "_to.block", "_to.own")
    return spread.withColumn("k", F.xxhash64("source", "item", "entity", "loose", "block"))


def _log_bins(x: np.ndarray, width: float) -> np.ndarray:
    """Bins of log x; NO_STEP where x is 0."""
    with np.errstate(divide="ignore"):
        b = np.floor(np.log(x) / width)
    return np.where(x > 0, b, NO_STEP).astype(np.int64)


def _histograms(source: np.ndarray, item: np.ndarray, group: np.ndarray, t: np.ndarray, value: np.ndarray, own: np.ndarray, loose: np.ndarray) -> pa.Table:
    """Counts by item: kind 0 values, 1 steps to the next time, 2 steps over two times, 3 runs of at least so many equal readings.

    A bin is packed with its kind into one number. Readings alike in series, time and value count once, except as values.
    """
    kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    name, of = np.unique(source, return_inverse=True)
    ok = own & (value > 0)
    kinds.append((np.zeros(int(ok.sum()), np.int64), np.flatnonzero(ok), _log_bins(value[ok], VALUE_BIN)))
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.log(np.where(value > 0, value, np.nan))
    fresh = np.r_[True, (group[1:] != group[:-1]) | (t[1:] != t[:-1]) | (value[1:] != value[:-1])] & ~loose
    u = np.flatnonzero(fresh)
    for lag in (1, 2):
        a, b = u[lag:], u[:-lag]
        fine = own[a] & (group[a] == group[b]) & ~np.isnan(x[a]) & ~np.isnan(x[b])
        for k in range(lag):
            fine &= t[u[lag - k :][: len(a)]] > t[u[lag - k - 1 :][: len(a)]]
        kinds.append((np.full(int(fine.sum()), lag, np.int64), a[fine], _log_bins(np.abs(x[a[fine]] - x[b[fine]]), STEP_BIN)))
    if len(u):
        change = np.flatnonzero(np.r_[True, (group[u[1:]] != group[u[:-1]]) | (value[u[1:]] != value[u[:-1]])])
        size = np.minimum(np.diff(np.r_[change, len(u)]), RUNS)
        counted = own[u[change]]
        kinds.append((np.full(int(counted.sum()), 3, np.int64), u[change][counted], size[counted]))
    kind, at, b = (np.concatenate(c) for c in zip(*kinds))
    keep = ~np.isnan(item[at])
    keys, n = np.unique(np.stack([of[at][keep], item[at][keep].astype(np.int64), kind[keep], b[keep]]), axis=1, return_counts=True)
    if not keys.shape[1]:
        return _PACKED.empty_table()
    heads = np.flatnonzero(np.r_[True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])])
    ends = pa.array(np.r_[heads, keys.shape[1]].astype(np.int32))
    made = {"source": pa.array(name[keys[0][heads]].astype(object), pa.string()), "item": pa.array(keys[1][heads]), "bins": pa.ListArray.from_arrays(ends, pa.array((keys[3] << 2) | keys[2])), "counts": pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int64)))}
    return pa.table({f.name: made.get(f.name, pa.nulls(len(heads), f.type)) for f in _PACKED})


def _packer(layout: Layout):
    """mapInArrow function over sorted partitions: rows of one series become one row of arrays, chunk by chunk; histograms follow."""
    chunk, halo = layout.chunk_rows, layout.halo_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = lead = 0

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, lead
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.num_rows
            start = np.zeros(n, bool)
            start[0] = True
            for c in SERIES:
                v = table.column(c)
                v = (pc.dictionary_encode(v).combine_chunks().indices if c == "source" else v).to_numpy()
                start[1:] |= (v[1:] != v[:-1]) & ~((v[1:] != v[1:]) & (v[:-1] != v[:-1]))  # nulls are NaN and equal
            heads = np.flatnonzero(start)
            sizes = np.diff(np.r_[heads, n])
            own = table.column("own").to_numpy().copy()
            own[:lead] = False
            # Pieces (from, to, first own, end of own) of all series that are complete, and of the last as far as it can be cut.
            long = sizes > chunk + halo
            pieces = [np.stack([heads[~long], heads[~long] + sizes[~long]] * 2)]
            if not last and not long[-1]:
                pieces[0] = pieces[0][:, :-1]
            rest = n if last else int(heads[-1])
            rest_lead = 0 if last or len(heads) > 1 else lead
            for i in np.flatnonzero(long):
                at, end = int(heads[i]), int(heads[i] + sizes[i])
                begin = at + (lead if i == 0 else 0)
                open_ = not last and end == n
                while end - begin > chunk + halo or (not open_ and begin < end):
                    stop = min(begin + chunk, end)
                    pieces.append(np.array([[max(at, begin - halo)], [min(stop + halo, end)], [begin], [stop]]))
                    begin = stop
                if open_:
                    rest = max(at, begin - halo)
                    rest_lead = begin - rest
            held, rows, lead = (table.slice(rest).to_batches(), n - rest, rest_lead) if rest < n else ([], 0, 0)
            a, b, first, end = np.concatenate(pieces, axis=1)
            if not len(a):
                return
            size = b - a
            take = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
            mine = own[take] & (take >= np.repeat(first, size)) & (take < np.repeat(end, size))
            flat = table.select(["t", "value", "row_id", "never"]).take(pa.array(take)).combine_chunks()
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            lists = {c: pa.ListArray.from_arrays(offsets, flat.column(c).chunk(0)) for c in ("t", "value", "row_id", "never")}
            one = table.select(["source", "item", "loose"]).take(pa.array(a)).combine_chunks()
            made = {c: one.column(c).chunk(0) for c in one.column_names} | lists | {"own": pa.ListArray.from_arrays(offsets, pa.array(mine))}
            yield from pa.table({f.name: made.get(f.name, pa.nulls(len(a), f.type)) for f in _PACKED}).to_batches(max_chunksize=5000)
            each = np.repeat(np.arange(len(a)), size)
            spread = lambda c: one.column(c).to_numpy()[each]
            t = pc.fill_null(flat.column("t"), 0).to_numpy()
            yield from _histograms(spread("source"), spread("item").astype(float), each, t, flat.column("value").to_numpy(), mine, spread("loose")).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= layout.held_rows:
                    yield from work(False)
        if held:
            yield from work(True)

    return run


def _scales(stats: DataFrame, tuning: Tuning) -> DataFrame:
    """Per item: range beyond which a reading is out of the ordinary, noise scale r, drift variance q (in units of r squared) and the run length that is no longer credible."""
    each = stats.select("source", "item", F.explode(F.arrays_zip("bins", "counts")).alias("z"))
    bins = each.groupBy("source", "item", F.col("z.bins").alias("key")).agg(F.sum("z.counts").alias("n"))
    bins = bins.select("source", "item", F.expr("cast(key & 3 as int)").alias("kind"), F.shiftright("key", 2).alias("bin"), "n")
    w = Window.partitionBy("source", "item", "kind")
    up = bins.withColumn("cum", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    at_least = lambda kind, p: F.min(F.when((F.col("kind") == kind) & (F.col("cum") >= F.col("all") * p), F.col("bin")))
    middle = lambda c, width: F.when(c == NO_STEP, 0.0).otherwise(F.exp((c + 0.5) * width))
    aggs = [middle(at_least(0, p), VALUE_BIN).alias(f"v{i}") for i, p in enumerate((0.01, 0.5, 0.99))]
    aggs += [middle(at_least(k, p), STEP_BIN).alias(f"d{k}_{i}") for k in (1, 2) for i, p in enumerate((0.8, 0.95))]
    aggs += [F.max(F.when(F.col("kind") == k, F.col("all"))).alias(c) for k, c in ((0, "n"), (1, "m"))]
    aggs += [F.coalesce(F.sum(F.when((F.col("kind") == 3) & (F.col("bin") >= k), F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(1, RUNS + 1)]
    per_item = up.groupBy("source", "item").agg(*aggs)

    enough = F.col("n") >= tuning.least_rows
    rise, fall = F.col("v2") / F.col("v1"), F.col("v1") / F.col("v0")

    def bound(ratio: Column, power: float) -> Column:
        return F.greatest(F.pow(ratio, F.lit(power)), F.lit(tuning.least_ratio ** (power / tuning.soft_power)))

    many = F.coalesce(F.col("m") >= tuning.least_rows, F.lit(False))
    sd = lambda k: F.greatest(F.col(f"d{k}_0") / 1.2816, F.when(F.col(f"d{k}_0") == 0, F.col(f"d{k}_1") / 1.96))
    scaled = per_item.withColumn("s1", sd(1)).withColumn("s2", F.coalesce(sd(2), sd(1)))
    pooled = F.percentile_approx(F.when(many, F.col("s1")), 0.75, 1000).over(Window.partitionBy("source"))
    scaled = scaled.withColumn("s1", F.when(many & (F.col("s1") > 0), F.col("s1")).otherwise(F.coalesce(pooled, F.lit(0.1))))
    var1, var2 = F.pow("s1", F.lit(2)), F.pow(F.coalesce("s2", "s1"), F.lit(2))
    drift = F.least(F.greatest(F.when(many, var2 - var1).otherwise(F.lit(0.0)), var1 * 0.005), var1 * 0.3)
    ratio = F.lit(0.0)
    for k in range(1, RUNS):
        ok = (F.col(f"n{k}") >= F.greatest(F.lit(30), F.col("n1") * 0.01)) & (F.col(f"n{k}") > 0)
        ratio = F.greatest(ratio, F.when(ok, F.col(f"n{k + 1}") / F.col(f"n{k}")))
    ratio = F.least(F.greatest(ratio, F.lit(0.02)), F.lit(0.995))
    run = F.greatest(F.lit(tuning.run_least), F.ceil(F.log(F.lit(tuning.run_p)) / F.log(ratio)) + 1)
    noise = F.greatest(F.sqrt((var1 - drift) / 2), F.lit(1e-6))
    return scaled.select(
        "source", "item", (F.col("v0") / 20).alias("floor"),
        F.when(enough, F.col("v1") * bound(rise, tuning.soft_power)).alias("soft_hi"),
        F.when(enough, F.col("v1") / bound(fall, tuning.soft_power)).alias("soft_lo"),
        F.when(enough, F.col("v1") * bound(rise, tuning.hard_power)).alias("hard_hi"),
        F.when(enough, F.col("v1") / bound(fall, tuning.hard_power)).alias("hard_lo"),
        noise.alias("r"), (drift / F.pow(noise, F.lit(2))).alias("q"), F.when(F.col("n1") > 0, run).cast("double").alias("run_limit"),
    )


def _one_way(x: np.ndarray, first: np.ndarray, last: np.ndarray, q: np.ndarray, step: int, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filter series side by side; returns standardised innovation, predicted level and its variance per reading (NaN at a start)."""
    n = len(x)
    inn, level_at, var_at = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
    size = last - first + 1
    order = np.argsort(-size, kind="stable")
    size, q = size[order], q[order]
    pos = (first if step > 0 else last)[order].copy()
    level, var = x[pos].copy(), np.ones(len(pos))
    var += q
    waiting = np.full(len(pos), np.nan)
    for k in range(1, int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, side="left"))
        at = pos[:m] + step * k
        v, lv, pv = x[at], level[:m], var[:m]
        total = pv + 1.0
        gap = v - lv
        score = gap / np.sqrt(total)
        inn[at], level_at[at], var_at[at] = score, lv, pv
        odd = np.abs(score) > z
        gain = pv / total
        moved = np.where(odd, lv, lv + gain * gap)
        spread = np.where(odd, pv, (1 - gain) * pv) + q[:m]
        anew = odd & (np.abs(v - waiting[:m]) < z * 1.5)
        level[:m] = np.where(anew, v, moved)
        var[:m] = np.where(anew, 1.0 + q[:m], spread)
        waiting[:m] = np.where(odd & ~anew, v, np.nan)
    return inn, level_at, var_at


def _judge(x: np.ndarray, t: np.ndarray, soft: np.ndarray, q: np.ndarray, run_limit: np.ndarray, start: np.ndarray, tuning: Tuning) -> tuple[np.ndarray, np.ndarray]:
    """Spikes and stuck rows of whole series; `start` marks the first row of each."""
    group = np.cumsum(start) - 1
    fresh = start.copy()
    fresh[1:] |= (t[1:] != t[:-1]) | (x[1:] != x[:-1])
    to = np.cumsum(fresh) - 1
    u, ug = x[fresh], group[fresh]
    heads = np.flatnonzero(np.r_[True, ug[1:] != ug[:-1]])
    ends = np.r_[heads[1:] - 1, len(u) - 1]
    drift = q[fresh][heads]
    fi, fl, fv = _one_way(u, heads, ends, drift, 1, tuning.spike_z)
    bi, bl, bv = _one_way(u, heads, ends, drift, -1, tuning.spike_z)
    with np.errstate(invalid="ignore"):
        spike = (np.abs(fi) > tuning.spike_z) & (np.abs(bi) > tuning.spike_z) & (fi * bi > 0) & (np.abs(fl - bl) < tuning.level_z * np.sqrt(fv + bv + 1))
    # A reading out of the item's range is bad unless its series keeps to such values; a lone one has no series to keep to.
    size = ends - heads + 1
    odd = soft[fresh]
    outside = np.add.reduceat(odd.astype(np.int64), heads)
    spike |= odd & ((size == 1) | (outside * 2 <= size))[ug - ug[0]]
    return spike[to], _still(u, ug, run_limit[fresh])[to]


def _still(u: np.ndarray, group: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Readings of windows of `limit` updates in which the innovations of the noise-free model have no variance.

    That model's prediction is the reading before, so its innovations are the steps. Their
    variance over a window vanishes exactly when no step differs from nothing; counting
    steps that do keeps rounding out of the sums.
    """
    step = np.r_[np.inf, np.diff(u)]
    step[1:][group[1:] != group[:-1]] = np.inf
    moved = np.cumsum(step != 0)
    n = np.arange(len(u))
    # The window of `limit` readings that ends here has limit - 1 innovations of its own.
    wide = np.where(np.isnan(limit), len(u) + 1, limit).astype(np.int64)
    first = n - wide + 1
    quiet = (first >= 0) & (moved == moved[np.maximum(first, 0)])
    # Every reading of such a window is stuck.
    edge = np.zeros(len(u) + 1, np.int64)
    np.add.at(edge, first[quiet], 1)
    np.add.at(edge, n[quiet] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _judge_packed(tuning: Tuning, layout: Layout):
    """mapInArrow function over packed series with their item's scales."""

    def judge(table: pa.Table) -> pa.Table:
        lists = {c: table.column(c).combine_chunks() for c in ("t", "value", "row_id", "own", "never")}
        lists = {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in lists.items()}
        size = np.diff(lists["value"].offsets.to_numpy())
        t, value, row_id, own, never = (pc.fill_null(v.flatten(), 0).to_numpy(zero_copy_only=False) if c == "t" else v.flatten().to_numpy(zero_copy_only=False) for c, v in lists.items())
        each = np.repeat(np.arange(len(size)), size)
        of = lambda c: pc.fill_null(table.column(c), np.nan).to_numpy()[each]
        hard = never | (value > of("hard_hi")) | (value < of("hard_lo"))
        reason = np.where(hard, 1, 0)
        alive = np.flatnonzero(~hard & ~table.column("loose").to_numpy()[each])
        if len(alive):
            v, r = value[alive], of("r")[alive]
            x = np.log(np.fmax(v, np.where(np.isnan(of("floor")[alive]), 1e-6, of("floor")[alive]))) / np.where(np.isnan(r), 0.1, r)
            soft = (v > of("soft_hi")[alive]) | (v < of("soft_lo")[alive])
            q = of("q")[alive]
            start = np.r_[True, each[alive][1:] != each[alive][:-1]]
            spike, stuck = _judge(x, t[alive], soft, np.where(np.isnan(q), 0.01, q), of("run_limit")[alive], start, tuning)
            reason[alive] = np.where(stuck, 3, np.where(spike, 2, 0))
        bad = np.flatnonzero((reason > 0) & own)
        source = table.column("source").take(pa.array(each[bad]))
        return pa.table({"source": source, "row_id": pa.array(row_id[bad]), "reason": pa.array(np.array(["", "impossible", "spike", "stuck"], object)[reason[bad]], pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            # A batch holds up to ten thousand series, so its readings are counted, and it is cut where they are many.
            ends = np.cumsum(pc.list_value_length(batch.column("t")).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + layout.held_rows)))
                held.append(batch.slice(at, to - at))
                rows += int(ends[min(to, batch.num_rows) - 1] - (ends[at - 1] if at else 0))
                at = to
                if rows >= layout.held_rows:
                    yield from judge(pa.Table.from_batches(held)).to_batches()
                    held, rows = [], 0
        if held:
            yield from judge(pa.Table.from_batches(held)).to_batches()

    return run
