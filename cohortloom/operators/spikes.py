"""Spikes, stuck values and impossible readings, per source against that source's own behaviour.

Readings are sorted by source and time and pass through NumPy a block of whole sources at a time: features (level,
difference, season, run length), then an isolation forest per source, grown for all sources of a block at once, and a
score for every reading. The forest decides which readings are singled out; explicit limits then say what a spike or a
stuck value must at least be, and which readings are impossible. Sources of more readings than `chunk` are cut along
time: their level, scatter and seasons are counted over all of the source before, and each part carries a margin of
neighbouring readings, so that no task ever holds a hot source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.functions.common import entity_key, exact, sealed
from cohortloom.operators.impute import missing_number
from cohortloom.operators.timestamps import normalise_timestamps

# Readings no living person can have, and the least jump, by scale.
LIMITS_F, LIMITS_C = (75.0, 120.0), (24.0, 49.0)
JUMP_F, JUMP_C = 4.0, 2.2
CELSIUS_BELOW = 60.0
SCATTERS, LONGEST_SPIKE, SHORTEST_RUN, LEAST_READINGS = 8.0, 2, 8, 20
#: Readings of a neighbouring chunk that a chunk sees.
MARGIN = 32
#: Trees of a forest, their depth, readings that a tree sees, steps of a feature; scores from which a reading is singled out.
TREES, DEPTH, SEEN, GRID = 48, 6, 8, 32
CUTOFF, STUCK_CUTOFF = 0.27, 0.15
#: Hot sources up to this number are sent to the tasks; beyond that they are joined.
HOT_LIMIT = 100_000

OUT = pa.schema([("source", pa.string()), ("id", pa.string()), ("utc_us", pa.int64()), ("value", pa.float64()), ("level", pa.float64()), ("scatter", pa.float64()), ("score", pa.float64()), ("reason", pa.string())])
OUT_DDL = "source string, id string, utc_us bigint, value double, level double, scatter double, score double, reason string"


def _starts(*cols: np.ndarray) -> np.ndarray:
    n = len(cols[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new


def _quartiles(group: np.ndarray, value: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quartiles of value per group; groups are numbered 0..n_groups-1."""
    order = np.lexsort((value, group))
    v, counts = value[order], np.bincount(group, minlength=n_groups)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    out = []
    for q in (0.25, 0.5, 0.75):
        at = first + q * np.maximum(counts - 1, 0)
        low = np.minimum(np.floor(at).astype(int), max(len(v) - 1, 0))
        high = np.minimum(low + 1, np.minimum(first + np.maximum(counts - 1, 0), max(len(v) - 1, 0)))
        out.append(v[low] + (at - np.floor(at)) * (v[high] - v[low]) if len(v) else np.zeros(n_groups))
    return tuple(out)


@cache
def _tree(seed: int, weights: tuple[float, ...], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, place of the split) of all nodes of a tree, level by level: each node halves its own box at a uniform place."""
    rng = np.random.default_rng(seed)
    n = (1 << depth) - 1
    feature = rng.choice(len(weights), n, p=np.array(weights) / sum(weights))
    low, high = np.zeros((2 * n + 1, len(weights))), np.full((2 * n + 1, len(weights)), float(GRID))
    at = np.zeros(n)
    for node in range(n):
        f = feature[node]
        at[node] = rng.uniform(low[node, f], high[node, f])
        for child in (2 * node + 1, 2 * node + 2):
            low[child], high[child] = low[node], high[node]
        high[2 * node + 1, f] = low[2 * node + 2, f] = at[node]
    return feature, at


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def forest_scores(group: np.ndarray, features: np.ndarray, weight: np.ndarray, n_groups: int, weights: tuple[float, ...], trees: int = TREES, depth: int = DEPTH, seen: int = SEEN) -> np.ndarray:
    """Isolation scores in (0, 1) of all rows (features are whole numbers from 0 to GRID), by one forest for each group.

    Features are on scales of their own source, so trees cut the same boxes for all; what a cut isolates depends on
    the group's rows. A tree sees `seen` random rows of its group; instead of drawing them, each level counts with the
    probability that a row isn't alone yet, that is, that one of the seen rows lies in its box, too: the mean over all
    draws. `weight` says how often a row counts among those that may be seen. Equal rows are computed once.
    """
    if not len(group):
        return np.zeros(0)
    base, code = GRID + 1, np.zeros(len(group), np.int64)
    for f in range(features.shape[1]):
        code = code * base + features[:, f]
    size = base ** features.shape[1]
    key, back = np.unique(group.astype(np.int64) * size + code, return_inverse=True)
    g, code = key // size, key % size
    x = np.empty((len(key), features.shape[1]), np.int64)
    for f in reversed(range(features.shape[1])):
        x[:, f], code = code % base, code // base
    mass = np.bincount(back, weights=weight)
    own = np.minimum(mass, 1)
    others = np.maximum(np.bincount(g, weights=mass, minlength=n_groups)[g] - own, 1)
    path, rows = np.zeros(len(key)), np.arange(len(key))
    for t in range(trees):
        feature, at = _tree(t, weights, depth)
        node, place = np.zeros(len(key), np.int64), g.copy()
        for _ in range(depth):
            right = x[rows, feature[node]] > at[node]
            node, place = 2 * node + 1 + right, 2 * place + right
            there = np.bincount(place, weights=mass)[place] - own
            alone = (1 - np.clip(there / others, 0, 1)) ** seen
            path += 1 - alone
        path += (1 - alone) * _average_path(seen)
    return (2.0 ** (-(1 + path / trees) / _average_path(seen)))[back]


# Of a deviation, the part that must be gone within two readings on both sides for the difference to count, and for it to count in full.
GONE = (0.67, 0.74)
#: How often the trees ask for level, difference, season and run length.
ASKED = (0.25, 4.0, 0.25, 1.0)


def _apart(g: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How far each value lies from those within two places, on the side where it lies nearer; 0 for a value without neighbours."""

    def away(k: int) -> np.ndarray:
        out = np.full(len(v), np.nan)
        if len(v) > abs(k):
            here, there = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
            out[here] = np.where(g[here] == g[there], np.abs(v[here] - v[there]), np.nan)
        return out

    return np.nan_to_num(np.fmin(np.fmax(away(1), away(2)), np.fmax(away(-1), away(-2))))


def hundredths(value: np.ndarray) -> np.ndarray:
    return np.floor(value * 100 + 0.5) / 100


def score_block(source: np.ndarray, chunk: np.ndarray, utc: np.ndarray, value: np.ndarray, known: np.ndarray, cutoff: float = CUTOFF, stuck_cutoff: float = STUCK_CUTOFF) -> dict[str, np.ndarray]:
    """Level, scatter, score and reason of each reading of whole groups, sorted by group and time, without repeated ids.

    `known` has the quartiles of the source and the medians of its four seasons where they were counted before, else
    NaN. Both count values in hundredths. Readings of one source with the same time and value are one reading sent
    again: they share their features.
    """
    n = len(value)
    head = _starts(source, chunk)
    group = np.cumsum(head) - 1
    n_groups = int(group[-1]) + 1 if n else 0
    count = np.bincount(group, minlength=n_groups)
    given = ~np.isnan(known[head, 0]) if n else np.zeros(0, bool)
    rounded = hundredths(value)
    q1, level, q3 = (np.where(given, known[head, i], q) for i, q in enumerate(_quartiles(group, rounded, n_groups)))
    slot = (utc // 21_600_000_000) % 4
    season = _quartiles(group * 4 + slot, rounded, n_groups * 4)[1].reshape(-1, 4)
    season = np.where(given[:, None], known[head, 3:], season)
    scatter = (q3 - q1) / 1.349
    celsius = level < CELSIUS_BELOW
    low, high = np.where(celsius, LIMITS_C[0], LIMITS_F[0]), np.where(celsius, LIMITS_C[1], LIMITS_F[1])
    impossible = (value < low[group]) | (value > high[group])
    jump = np.maximum(np.where(celsius, JUMP_C, JUMP_F), SCATTERS * scatter)

    # One row for each different reading; impossible ones are no neighbours of others, but scored like them.
    again = ~_starts(group, utc, value)
    lead = np.flatnonzero(~again)[np.cumsum(~again) - 1] if n else np.zeros(0, np.int64)  # a reading sent again stands right after the first
    one = np.flatnonzero(~again & ~impossible)
    g, v = group[one], value[one]
    dev, j = value - level[group], jump[group]
    apart = np.abs(dev)
    apart[one] = _apart(g, v)
    run = np.cumsum(_starts(g, v)) - 1 if len(g) else np.zeros(0, int)
    run_length = np.ones(n, np.int64)
    run_length[one] = np.bincount(run)[run] if len(g) else run
    weight = np.zeros(n)
    weight[one] = _starts(g, v)
    share = apart / np.maximum(j, np.abs(dev))
    parts = (np.abs(dev) / j, (share - GONE[0]) / (GONE[1] - GONE[0]), np.abs(value - season[group, slot]) / j, np.log2(run_length) / np.log2(SHORTEST_RUN))
    features = np.column_stack([(np.clip(np.nan_to_num(x, nan=1.0), 0, 1) * GRID).astype(np.int64) for x in parts])
    first = np.flatnonzero(~again)
    score = np.zeros(n)
    score[first] = forest_scores(group[first], features[first], weight[first], n_groups, ASKED)

    # What the forest singles out is a spike or stuck if it is as far or as long as one must be at least.
    off = np.abs(dev[one]) >= j[one] - 1e-6
    stretch = np.cumsum(_starts(g, off)) - 1 if len(g) else run
    brief = (np.bincount(stretch)[stretch] if len(g) else run) <= LONGEST_SPIKE
    enough = (count >= LEAST_READINGS) | given
    reason = np.full(n, "", object)
    reason[one[(score[one] >= stuck_cutoff) & (run_length[one] >= SHORTEST_RUN) & enough[g]]] = "stuck"
    reason[one[(score[one] >= cutoff) & off & brief & enough[g]]] = "spike"
    reason[impossible & enough[group]] = "impossible"
    return {"level": level[group], "scatter": scatter[group], "score": score[lead], "reason": reason[lead]}


KNOWN = ("q1", "q2", "q3", "s0", "s1", "s2", "s3")


def _pass(block: int, flagged_only: bool, cutoff: float, stuck_cutoff: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        names = t.column("source").combine_chunks().dictionary_encode()
        source = names.indices.to_numpy(zero_copy_only=False)
        chunk, utc, value = (t.column(c).to_numpy() for c in ("chunk", "utc_us", "value"))
        ids = t.column("id").combine_chunks()
        new_id = _starts(source, chunk, utc, np.asarray(ids.dictionary_encode().indices))
        if not new_id.all():
            yield from work(t.filter(pa.array(new_id)))
            return
        known = np.column_stack([t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in KNOWN])
        got = score_block(source, chunk, utc, value, known, cutoff, stuck_cutoff)
        keep = t.column("own").to_numpy(zero_copy_only=False).astype(bool)
        if flagged_only:
            keep &= got["reason"] != ""
        out = pa.table([t.column("source"), ids, t.column("utc_us"), t.column("value"), got["level"], got["scatter"], got["score"], pa.array(got["reason"], pa.string())], schema=OUT).filter(pa.array(keep))
        yield from out.to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < block:
                continue
            t = pa.Table.from_batches(held)
            last = t.slice(rows - 1).to_pylist()[0]
            source, chunk = t.column("source").combine_chunks(), t.column("chunk").to_numpy()
            own = (np.asarray(pa.compute.equal(source, last["source"]))) & (chunk == last["chunk"])
            cut = int(np.argmax(own))
            if cut:
                yield from work(t.slice(0, cut))
                held, rows = t.slice(cut).combine_chunks().to_batches(), rows - cut
        if rows:
            yield from work(pa.Table.from_batches(held))

    return run


def _chunks(own: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """For the readings of hot sources: (source, hour) with the chunks an hour belongs to or borders, and (source) with what KNOWN names."""
    per_hour = own.groupBy("source", F.expr("utc_us div 3600000000").alias("hour")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("hour")
    so_far = F.sum("n").over(w)
    per_hour = per_hour.withColumn("upto", so_far).withColumn("from", F.col("upto") - F.col("n"))
    per_hour = per_hour.withColumn("_cut", F.expr(f"`from` div {chunk}"))
    per_hour = per_hour.withColumn("chunk", F.dense_rank().over(Window.partitionBy("source").orderBy("_cut")))
    by_chunk = Window.partitionBy("source", "chunk")
    per_hour = per_hour.withColumn("first", F.min("from").over(by_chunk)).withColumn("end", F.max("upto").over(by_chunk))
    places = F.array_compact(F.array(F.struct(F.col("chunk"), F.lit(True).alias("own")), F.when(F.col("end") - F.col("upto") < MARGIN, F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(False).alias("own"))), F.when(F.col("from") - F.col("first") < MARGIN, F.struct((F.col("chunk") - 1).alias("chunk"), F.lit(False).alias("own")))))
    # Different values in hundredths: however many readings, there are no more of them than the thermometer's range has.
    counts = own.groupBy("source", F.expr("pmod(utc_us div 21600000000, 4)").alias("slot"), (F.floor(F.col("value") * 100 + 0.5) / 100).alias("v")).agg(F.count("*").alias("n"))
    seasons = counts.groupBy("source").pivot("slot", [0, 1, 2, 3]).agg(F.percentile("v", F.lit(0.5), F.col("n")))
    seasons = seasons.select(F.col("source").alias("_s"), *[F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"s{k}") for k in range(4)])
    q = F.percentile("v", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]), F.col("n"))
    stats = counts.groupBy("source").agg(q.alias("q")).join(seasons, F.col("source") == F.col("_s"))
    return per_hour.select("source", "hour", places.alias("places")), stats.select("source", *[F.col("q")[k].alias(f"q{k + 1}") for k in range(3)], *[f"s{k}" for k in range(4)])


def score_readings(readings: DataFrame, sizes: DataFrame | None = None, chunk: int = 20_000, block: int = 60_000, flagged_only: bool = False, cutoff: float = CUTOFF, stuck_cutoff: float = STUCK_CUTOFF) -> DataFrame:
    """Scores of readings (id string, source string, utc_us bigint, value double), with a reason where one is flagged.

    `score` is that of the source's isolation forest. `reason` is 'spike' where the forest singles a reading out
    (`cutoff`) that lies a jump away from the level in a stretch of at most two, which readings of a fever do as well:
    those the forest tells by how the neighbours follow; 'stuck' where it singles out (`stuck_cutoff`) a reading of a
    long enough run; 'impossible' by the limits of the source's scale; else ''. Sources with fewer than 20 readings
    have no reasons. `sizes` (source, n) are bounds on the numbers of readings, which are counted where they are not given.
    Sources beyond `chunk` are cut into parts of about that size; a part grows its own forest on what its trees see, on
    features that use all of the source. Defined results: rows with a null in any of the four columns take no part;
    repeated ids count once; ties in time are ordered by value and id; no readings give no rows.
    """
    readings = exact(readings, ("id", "source", "utc_us", "value")).select("id", "source", "utc_us", F.col("value").cast("double").alias("value")).dropna()
    spark = readings.sparkSession
    sizes = sizes if sizes is not None else readings.groupBy("source").agg(F.count("*").alias("n"))
    hot = sizes.filter((F.col("n") > chunk) & F.col("source").isNotNull()).select("source")
    names = hot.limit(HOT_LIMIT + 1).collect()
    score = _pass(block, flagged_only, cutoff, stuck_cutoff)
    order = ("source", "chunk", "utc_us", "value", "id")
    alone = [F.lit(0).alias("chunk"), F.lit(True).alias("own"), *[F.lit(None).cast("double").alias(c) for c in KNOWN]]
    columns = ["source", "id", "utc_us", "value", "chunk", "own", *KNOWN]
    if not names:
        laid = readings.repartition("source").select("source", "id", "utc_us", "value", *alone)
        return laid.sortWithinPartitions(*order).mapInArrow(score, OUT_DDL)
    if len(names) <= HOT_LIMIT:
        hot = F.broadcast(spark.createDataFrame(names, "source string"))
    # One exchange for all uses of the readings: by source, and those of a hot one by day, too.
    marked = readings.join(hot.withColumn("_hot", F.lit(True)), "source", "left")
    laid = sealed(marked.repartition("source", F.when(F.col("_hot"), F.expr("utc_us div 86400000000"))))
    cold = laid.filter(F.col("_hot").isNull()).select("source", "id", "utc_us", "value", *alone)
    own = laid.filter(F.col("_hot").isNotNull()).select("source", "id", "utc_us", "value")
    places, stats = _chunks(own, chunk)
    spread = own.withColumn("hour", F.expr("utc_us div 3600000000")).join(places.join(stats, "source"), ["source", "hour"])
    spread = spread.withColumn("p", F.explode("places")).withColumns({"chunk": F.col("p.chunk"), "own": F.col("p.own")}).select(*columns)
    spread = spread.repartition("source", "chunk")
    return cold.sortWithinPartitions(*order).mapInArrow(score, OUT_DDL).union(spread.sortWithinPartitions(*order).mapInArrow(score, OUT_DDL))


def usable_temperatures(assessments: DataFrame) -> DataFrame:
    """The assessments with a user, a date text and a temperature, with the user as compared."""
    assessments = exact(assessments, ("id", "date", "time_zone", "locale", "received_at", "user_id", "temperature_f"))
    return assessments.select("id", "date", "time_zone", "locale", "received_at", entity_key(F.col("user_id")).alias("user_id"), "temperature_f").filter(~F.coalesce(missing_number(F.col("temperature_f")), F.lit(True)) & F.col("user_id").isNotNull() & F.col("date").isNotNull())


def temperature_readings(assessments: DataFrame) -> DataFrame:
    """(id, source, utc_us, value) of assessments with a usable user, date and temperature."""
    at = normalise_timestamps(usable_temperatures(assessments)).filter(F.col("utc_us").isNotNull())
    return at.select("id", F.col("user_id").alias("source"), "utc_us", F.col("temperature_f").cast("double").alias("value"))


def score_temperatures(assessments: DataFrame, **more) -> DataFrame:
    """Scores of all temperatures. Users' readings are counted before any date is parsed."""
    sizes = usable_temperatures(assessments).groupBy(F.col("user_id").alias("source")).agg(F.count("*").alias("n"))
    return score_readings(temperature_readings(assessments), sizes, **more)


def disturbed(scores: DataFrame, reason: Column | None = None) -> DataFrame:
    """The ids that are flagged, once each."""
    return scores.filter((reason if reason is not None else F.col("reason")) != "").select("id").distinct()
