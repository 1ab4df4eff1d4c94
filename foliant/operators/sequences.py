"""Operators over sequences: batches, service order, training runs, splits, and the response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.operators.prefix import numbered, running_sum


def batches(df: DataFrame, keys: list[str], bucket: Column, order: list, size: int) -> DataFrame:
    """``df`` with ``batch``: rows of a key in order, ``size`` to a batch, from 0."""
    return numbered(df, keys, bucket, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def fifo_service(jobs: DataFrame, keys: list[str], bucket: Column, order: list, arrival: Column, duration: Column) -> DataFrame:
    """``jobs`` with ``begins`` and ``ends`` (whole numbers): one server a key takes them in order, each when it has come and
    the one before is done.

    The end of a job is the running sum of durations plus the largest lead that any job up to it had over that sum; both
    are prefix results in two levels, so no task gets a whole key.
    """
    timed = jobs.withColumn("_a", arrival.cast("long")).withColumn("_d", duration.cast("long")).withColumn("_b", bucket)
    summed = running_sum(timed, keys, F.col("_b"), order, F.col("_d"), "_before", inclusive=False)
    lead = summed.withColumn("_lead", F.col("_a") - F.col("_before"))
    up_to = Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    tops = lead.groupBy(*keys, "_b").agg(F.max("_lead").alias("_own")).withColumn("_earlier", F.max("_own").over(up_to)).drop("_own")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = lead.withColumn("_local", F.max("_lead").over(inside)).alias("l")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "_b"]]
    wait = F.greatest("_local", F.coalesce("_earlier", F.col("_local")))
    done = local.join(tops.alias("t"), on).select("l.*", (wait + F.col("_before")).alias("begins"))
    return done.withColumn("ends", F.col("begins") + F.col("_d")).drop("_a", "_d", "_b", "_before", "_lead", "_local")


def early_stopping(losses: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """(run, best_epoch, best_loss, stopped_at): where training ends after ``patience`` epochs without a new least loss.

    ``stopped_at`` is null for a run that came to its last epoch. Of equal losses the first counts. ``losses`` has one row
    an epoch, so a run's rows are as many as its epochs.
    """
    order = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = losses.where(F.col(loss).isNotNull()).select(run, epoch, loss, before.alias("_best"), F.row_number().over(order).alias("_n"))
    better = F.col("_best").isNull() | (F.col(loss) < F.col("_best"))
    rows = rows.withColumn("_last", F.max(F.when(better, F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_stop", F.min(F.when(F.col("_n") - F.col("_last") >= patience, F.col("_n"))).over(Window.partitionBy(run)))
    kept = rows.where(F.col("_stop").isNull() | (F.col("_n") <= F.col("_stop")))
    best = F.min(F.struct(F.col(loss), F.col(epoch)))
    return kept.groupBy(run).agg(best[epoch].alias("best_epoch"), best[loss].alias("best_loss"), F.max(F.when(F.col("_n") == F.col("_stop"), F.col(epoch))).alias("stopped_at"))


def train_val_split(df: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: ``val`` for max(1, floor(n * share)) rows in an order drawn by hash, ``train`` for the others."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    placed = numbered(df.withColumn("_h", h), [], F.shiftright("_h", 52), ["_h", id_col], "_n")
    n_val = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("_v"))
    return placed.crossJoin(F.broadcast(n_val)).withColumn("part", F.when(F.col("_n") <= F.col("_v"), "val").otherwise("train")).drop("_h", "_n", "_v")


def page(df: DataFrame, order: list, number: int, size: int = 10) -> DataFrame:
    """Page ``number`` (from 1) of the rows in order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def subset_or_all(df: DataFrame, key: str, chosen: Column) -> DataFrame:
    """Rows whose key is in ``chosen`` (an array, of the row or a literal); all rows where it is null or empty."""
    return df.where(F.coalesce(F.size(chosen) < 1, F.lit(True)) | F.array_contains(chosen, F.col(key).cast("long")))


def without(order: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """``order`` without the rows whose key was removed; places stay in order."""
    return order.join(removed.select(key).distinct(), key, "left_anti")


# --- the response cache --------------------------------------------------------------------------------------------


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` (with ``key``) with the cached ``response``, null where there is none. ``cache``: key, response."""
    held = cache.where("response IS NOT NULL").groupBy("key").agg(F.max("response").alias("response"))
    return requests.join(held, "key", "left")


def stored(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with answers (key, response, seq) put in: the last of a key wins, over what was there."""
    rows = cache.select("key", "response", F.lit(None).cast("long").alias("seq")).unionByName(answers.select("key", "response", F.col("seq").cast("long")))
    return rows.groupBy("key").agg(F.max(F.struct("seq", "response"))["response"].alias("response"))


#: Events of one bucket of a state fold.
FOLDED = 1024


def fold_states(log: DataFrame, key: str, bucket: Column, order: list, event: str, transitions: dict[tuple[str, str], str], start: str) -> DataFrame:
    """(key, state, n): where each key's events, in order, lead from ``start``; an event without a transition changes nothing.

    ``transitions``: (state, event) to state. Events are folded in buckets of FOLDED rows, each into what it makes of every
    state; those are then applied one after the other, so a key of any length is spread over its buckets.
    """
    states = sorted({start, *transitions.values(), *(s for s, _ in transitions)})
    table = F.create_map(*(F.lit(x) for (s, e), to in transitions.items() for x in (f"{s}\n{e}", to)))
    placed = numbered(log, [key], bucket, order, "_n").withColumn("_b", F.floor((F.col("_n") - 1) / FOLDED))
    parts = placed.groupBy(key, "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(event).alias("e")))), lambda x: x["e"]).alias("events"))
    into = F.create_map(*(x for s in states for x in (F.lit(s), F.aggregate("events", F.lit(s), lambda a, e: F.coalesce(table[F.concat(a, F.lit("\n"), e)], a)))))
    folded = parts.select(key, "_b", F.size("events").alias("m"), into.alias("into")).groupBy(key)
    got = folded.agg(F.array_sort(F.collect_list(F.struct("_b", F.map_entries("into").alias("x")))).alias("parts"), F.sum("m").alias("n"))
    state = F.aggregate("parts", F.lit(start), lambda a, p: F.map_from_entries(p["x"])[a])
    return got.select(key, state.alias("state"), "n")
