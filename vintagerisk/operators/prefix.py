"""Global running totals and equal-count buckets without a single-task window.

An ordered window with no partition sends every row to one task.  Here the order key is
cut into ranges at approximate quantiles (a handful of doubles on the driver, then plain
literals, so a recomputed task always lands rows in the same range).  Each range is
cumulated on its own and shifted by the totals of the ranges before it.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk.sources.storage import materialise

MIN_RANGES = 8
ROWS_PER_RANGE = 1_000_000


def range_count(n: int) -> int:
    """Ranges for n rows: none is meant to hold more than ROWS_PER_RANGE, however many rows there are."""
    return max(MIN_RANGES, -(-n // ROWS_PER_RANGE))


def range_splits(df: DataFrame, key: str) -> list[float]:
    """Cut points that leave about ROWS_PER_RANGE rows in each range (a heavy tie stays whole).

    One number per million rows reaches the driver.  The first pass is enough for up to
    MIN_RANGES million rows; more rows are cut finer in a second one.
    """
    keys = df.selectExpr(f"cast({key} as double) AS k")

    def cuts(ranges: int):
        probabilities = [i / ranges for i in range(1, ranges)]
        return F.percentile_approx("k", probabilities, max(10_000, 10 * ranges)).alias("cuts")

    found = keys.agg(F.count("k").alias("n"), cuts(MIN_RANGES)).first()
    if found.n and range_count(found.n) > MIN_RANGES:
        found = keys.agg(F.count("k").alias("n"), cuts(range_count(found.n))).first()
    return sorted(set(found.cuts)) if found.n else []


def with_range(df: DataFrame, key: str, splits: list[float]) -> DataFrame:
    """Attach `range_id`, the index of the range the key falls in (binary search on the JVM)."""
    if not splits:
        return df.withColumn("range_id", F.lit(0.0))
    cutter = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="range_key", outputCol="range_id")
    return cutter.transform(df.withColumn("range_key", F.col(key).cast("double"))).drop("range_key")


def running_totals(counted: DataFrame, key: str, sums: list[str], splits: list[float], by: list[str] | None = None, order: str | None = None) -> DataFrame:
    """For a frame with one row per key: exclusive running sums `<s>_before` in key order, and `<s>_total`.

    `order` refines the order inside a range (ties of the key); `by` restarts the totals
    per group; groups must be few.  The broadcast offsets have one row per (group, range),
    that is, one for some million rows of the input.
    """
    by = by or []
    ranged = with_range(counted, key, splits)
    totals = ranged.groupBy(*by, "range_id").agg(*[F.sum(s).alias(s) for s in sums])
    # a row per group and range from here to the broadcast
    groups = f"PARTITION BY {', '.join(by)}" if by else ""
    earlier = f"({groups} ORDER BY range_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = totals.selectExpr(
        *by, "range_id",
        *[f"coalesce(sum({s}) OVER {earlier}, 0) AS {s}_offset" for s in sums],
        *[f"sum({s}) OVER ({groups}) AS {s}_total" for s in sums],
    )
    inner = f"(PARTITION BY {', '.join([*by, 'range_id'])} ORDER BY {order or key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    within = ranged.selectExpr("*", *[f"coalesce(sum({s}) OVER {inner}, 0) AS {s}_before" for s in sums])
    return (
        within.join(F.broadcast(offsets), [*by, "range_id"])
        .withColumns({f"{s}_before": F.col(f"{s}_before") + F.col(f"{s}_offset") for s in sums})
        .drop("range_id", *[f"{s}_offset" for s in sums])
    )


def bucket_of(rank: str, total: str, k: int) -> str:
    """Index of the equal-count bucket of a zero-based rank; the first `total % k` buckets hold one more."""
    big = f"({total} DIV {k} + 1)"
    head = f"({total} % {k}) * {big}"
    return (
        f"cast(CASE WHEN {rank} < {head} THEN {rank} DIV {big} "
        f"ELSE {total} % {k} + ({rank} - {head}) DIV greatest({total} DIV {k}, 1) END + 1 as int)"
    )


def score_ladder(scored: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    """One row per distinct score: rows, positives and negatives here (`n`, `pos`, `neg`), below (`_before`) and in all (`_total`).

    The rows are read once; the counts per score are stored, so all that is asked of the ladder reads the store.
    NULL and NaN scores take no part.
    """
    rows = scored.select(F.expr(f"nanvl(cast({score} as double), NULL)").alias("score"), F.col(y).cast("bigint").alias("y")).where("score IS NOT NULL")
    levels = materialise(rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    return running_totals(levels, "score", ["n", "pos", "neg"], range_splits(levels, "score"))


def equal_count_buckets(scored: DataFrame, k: int, p: str = "p", y: str = "y", key: str = "id") -> DataFrame:
    """Split rows ordered by (p, key) into `k` buckets of equal count; returns n, sum_p, sum_y per bucket.

    Rows are read twice.  The ladder of distinct p adds a p whose whole run of ranks falls in one
    bucket as it stands; the rows of the at most k - 1 values that straddle a boundary are stored
    and ranked one by one on the key, again in ranges, so even a p shared by a third of
    the rows is spread over tasks.  NULL and NaN values of p take no part.
    """
    placed = score_ladder(scored, p, y).selectExpr(
        "score AS p", "n", "pos AS sum_y", "n_before", "n_total",
        f"{bucket_of('n_before', 'n_total', k)} AS first_bucket",
        f"{bucket_of('(n_before + n - 1)', 'n_total', k)} AS last_bucket",
    )
    whole = placed.where("first_bucket = last_bucket").selectExpr("first_bucket AS bucket", "n", "p * n AS sum_p", "sum_y")

    rows = scored.select(F.expr(f"nanvl(cast({p} as double), NULL)").alias("p"), F.col(y).cast("bigint").alias("y"), F.col(key).cast("bigint").alias("key"))
    split_values = placed.where("first_bucket < last_bucket").selectExpr("p", "n_before AS p_start", "n_total AS all_rows")  # at most k - 1
    split_rows = materialise(rows.where("p IS NOT NULL").join(F.broadcast(split_values), "p").withColumn("one", F.lit(1).cast("bigint")))
    ranked = running_totals(split_rows, "key", ["one"], range_splits(split_rows, "key"), by=["p"])
    parts = ranked.selectExpr(
        f"{bucket_of('(p_start + one_before)', 'all_rows', k)} AS bucket", "one AS n", "p AS sum_p", "y AS sum_y"
    )
    return whole.unionByName(parts).groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("sum_p").alias("sum_p"), F.sum("sum_y").alias("sum_y")
    )


def values_near_ranks(
    long: DataFrame, keys: list[str], value: str, probabilities: list[float], slack: int = 0, accuracy: int = 10000, small: int = 20000, widen: float = 1.0
) -> DataFrame:
    """Distinct values around the wanted quantiles of each group, with exact counts up to each value.

    The built-in `percentile` holds every distinct value of a group in one task.  Here a
    mergeable sketch first brackets each wanted rank (widened by `slack` ranks); a second
    pass counts what lies below a bracket, combined map-side into one row with a NULL
    value, and sorts only the values inside it.  A group of up to `small` values is one
    bracket (i = -1).  Groups must be few: brackets are broadcast, one row per (group, probability).
    `widen` multiplies the margin around each rank.
    """
    present = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    margin = (3.0 / accuracy + (slack + 2) / small) * widen
    m = len(probabilities)
    edges = [max(0.0, q - margin) for q in probabilities] + [min(1.0, q + margin) for q in probabilities]
    sketched = present.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest"),
        F.percentile_approx("v", edges, accuracy).alias("edges"),
    )
    picks = ", ".join(f"struct({i} AS i, edges[{i}] AS low, edges[{m + i}] AS high)" for i in range(m))
    brackets = sketched.selectExpr(
        *keys, "n", f"inline(CASE WHEN n <= {small} THEN array(struct(-1 AS i, lowest AS low, highest AS high)) ELSE array({picks}) END)"
    )
    near = present.join(F.broadcast(brackets), keys).where("v <= high")
    counts = near.withColumn("v", F.expr("CASE WHEN v >= low THEN v END")).groupBy(*keys, "i", "n", "v").agg(F.count("*").alias("c"))
    order = f"(PARTITION BY {', '.join([*keys, 'i'])} ORDER BY v NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return counts.selectExpr(*keys, "i", "n", "v", "c", f"sum(c) OVER {order} AS upto")


def exact_quantiles(
    long: DataFrame, keys: list[str], value: str, probabilities: list[float], accuracy: int = 10000, small: int = 20000
) -> DataFrame:
    """Exact interpolated quantiles per group (NULLs skipped): (keys, i, quantile) per wanted probability.

    The input is read a few times, so it is stored in between.
    """
    present = materialise(long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")))
    picks = ", ".join(f"struct({i} AS i, (n - 1) * {q!r}D AS position)" for i, q in enumerate(probabilities))
    wanted = _sketched(present, keys, accuracy).selectExpr("*", f"inline(array({picks}))").withColumn("rank", F.expr("cast(floor(position) as bigint)"))
    started = _held(_first_brackets(wanted, keys, accuracy, small, "position"))
    ends = _selected(present, keys, started.drop("position"), accuracy, small)
    share = "(position - floor(position))"
    return ends.join(F.broadcast(started.select(*keys, "i", "position")), [*keys, "i"]).selectExpr(
        *keys, "i",
        f"CASE WHEN a = b OR {share} = 0 THEN a WHEN {share} < 0.5D THEN a + (b - a) * {share} "
        f"ELSE b - (b - a) * (1D - {share}) END AS quantile",
    )


def order_statistics(present: DataFrame, keys: list[str], wanted: DataFrame, accuracy: int = 10000, small: int = 20000) -> DataFrame:
    """(keys, i, a, b): the value `v` of each wanted zero-based rank (keys, i, rank) of its group, and the value of the next rank.

    Each rank has a bracket of values.  A pass counts, map-side, what the inside of the bracket holds, and sketches it; the
    sketch proposes a bracket some hundred times narrower, whose counts the next pass takes, and so on for all ranks together
    until none has more than `small` rows between its ends, whatever the size of the table: three passes at 10^9 rows.
    Counts decide where a rank lies, so a poor proposal costs a pass but no wrong value can come out.  The ends of a
    bracket are counted apart from its inside: values shared by very many rows never stop the narrowing.  Groups must
    be few: brackets, one row per wanted rank, pass through the driver and are broadcast.  `b` is NULL at the last rank.
    """
    sketched = wanted.join(_sketched(present, keys, accuracy), keys)
    return _selected(present, keys, _held(_first_brackets(sketched, keys, accuracy, small)), accuracy, small)


def _steps(accuracy: int) -> int:
    return max(4, min(2048, accuracy // 4))


def _grid(value: str, accuracy: int) -> Column:
    """Sketch of the values at evenly spaced shares of their ranks."""
    return F.percentile_approx(value, [g / _steps(accuracy) for g in range(_steps(accuracy) + 1)], accuracy).alias("grid")


def _proposed(rank: str, n: str, accuracy: int) -> tuple[str, str]:
    """Two values of the grid that should lie on both sides of a rank."""
    steps = _steps(accuracy)
    at = f"cast(floor({rank} * {steps}D / {n}) as int)"
    return f"grid[greatest({at} - 1, 0)]", f"grid[least({at} + 2, {steps})]"


def _sketched(present: DataFrame, keys: list[str], accuracy: int) -> DataFrame:
    return present.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), _grid("v", accuracy))


def _first_brackets(sketched: DataFrame, keys: list[str], accuracy: int, small: int, *further: str) -> DataFrame:
    from_v, to_v = _proposed("rank", "n", accuracy)
    return sketched.selectExpr(
        *keys, "i", "rank", "low", "high", "0L AS base", "cast(NULL as double) AS above", f"n > {small} AND low < high AS open",
        f"{from_v} AS from_v", f"{to_v} AS to_v", *further,
    )


def _held(state: DataFrame) -> DataFrame:
    """A small table, computed once and kept on the driver."""
    return state.sparkSession.createDataFrame(state.toArrow(), state.schema)


def _selected(present: DataFrame, keys: list[str], state: DataFrame, accuracy: int, small: int) -> DataFrame:
    while not state.where("open").isEmpty():
        state = _held(state.where("NOT open").unionByName(_narrowed(present, keys, state.where("open"), accuracy, small)))
    near = present.join(F.broadcast(state.select(*keys, "i", "rank", "low", "high", "base", "above")), keys).where("v BETWEEN low AND high")
    counts = near.groupBy(*keys, "i", "rank", "base", "above", "v").agg(F.count("*").alias("c"))
    order = f"(PARTITION BY {', '.join([*keys, 'i'])} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return counts.selectExpr(*keys, "i", "rank", "above", "v", "c", f"base + sum(c) OVER {order} AS upto").groupBy(*keys, "i").agg(
        F.expr("min(CASE WHEN upto > rank THEN v END)").alias("a"),
        F.expr("coalesce(min(CASE WHEN upto > rank + 1 THEN v END), max(above))").alias("b"),
    )


def _narrowed(present: DataFrame, keys: list[str], state: DataFrame, accuracy: int, small: int) -> DataFrame:
    """The open brackets after one more pass: each takes the zone of its proposal that holds its rank."""
    ends = F.broadcast(state.select(*keys, "i", "low", "high", "from_v", "to_v"))
    within = "v > from_v AND v < to_v"
    zones = (
        present.join(ends, keys).where("v BETWEEN low AND high")
        .withColumn("inner", F.expr(f"CASE WHEN {within} THEN v END"))
        .groupBy(*keys, "i").agg(
            F.count_if(F.expr("v < from_v")).alias("n_less"), F.count_if(F.expr("v = from_v")).alias("n_from"), F.count("inner").alias("n_inner"),
            F.count_if(F.expr("v = to_v AND to_v > from_v")).alias("n_to"),
            F.max(F.expr("CASE WHEN v < from_v THEN v END")).alias("last_less"), F.min(F.expr("CASE WHEN v > to_v THEN v END")).alias("first_more"),
            F.min("inner").alias("first_inner"), F.max("inner").alias("last_inner"), _grid("inner", accuracy),
        )
    )
    placed = state.join(zones, [*keys, "i"]).selectExpr(
        "*", "n_less + n_from AS upto_from", "n_less + n_from + n_inner AS upto_inner", "n_less + n_from + n_inner + n_to AS upto_to", "rank - base AS place"
    ).withColumn("zone", F.expr("CASE WHEN place < n_less THEN 0 WHEN place < upto_from THEN 1 WHEN place < upto_inner THEN 2 WHEN place < upto_to THEN 3 ELSE 4 END"))
    pick = lambda *of: f"element_at(array({', '.join(of)}), zone + 1)"
    next_from = "coalesce(first_inner, CASE WHEN n_to > 0 THEN to_v END, first_more, above)"
    inner_from, inner_to = _proposed("(place - upto_from)", "nullif(n_inner, 0)", accuracy)
    moved = placed.selectExpr(
        *keys, "i", "rank", "zone", "n_inner", "grid", "place", "upto_from",
        f"{pick('low', 'from_v', 'first_inner', 'to_v', 'first_more')} AS low", f"{pick('last_less', 'from_v', 'last_inner', 'to_v', 'high')} AS high",
        f"base + {pick('0L', 'n_less', 'upto_from', 'upto_inner', 'upto_to')} AS base",
        f"{pick(f'CASE WHEN n_from > 0 THEN from_v ELSE {next_from} END', next_from, 'CASE WHEN n_to > 0 THEN to_v ELSE coalesce(first_more, above) END', 'coalesce(first_more, above)', 'above')} AS above",
    )
    return moved.selectExpr(
        *keys, "i", "rank", "low", "high", "base", "above", f"low < high AND (zone IN (0, 4) OR n_inner > {small}) AS open",
        f"CASE WHEN zone = 2 THEN {inner_from} ELSE low END AS from_v", f"CASE WHEN zone = 2 THEN {inner_to} ELSE high END AS to_v",
    )
