"""Playback queues as folds of their write log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.operators.prefix import numbered


def last_locations(stored: DataFrame, log: DataFrame) -> DataFrame:
    """The last location of each user: the last one written in ``log`` (user_id, uri, logged_time, log_id), else the stored one.

    A second delivery of a write is the same write, so the log needn't be made distinct.
    """
    writes = log.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max(F.struct("logged_time", "log_id", "uri"))["uri"].alias("written"), F.lit(True).alias("hit"))
    return stored.join(writes, "user_id", "full").select("user_id", F.when(F.col("hit"), F.col("written")).otherwise(F.col("uri")).alias("uri"))


def replay(log: DataFrame) -> DataFrame:
    """State of every queue: an entry per (user, pod, episode) at its order of arrival, with the values written last.

    First and last of a key are the same with second deliveries in, so the log needn't be made distinct.
    """
    rows = log.select("log_id", "user_id", "pod_id", "episode_idx", "start_pos", "is_current", F.coalesce("model_name", F.lit("")).alias("model_name"), "logged_time").where("user_id IS NOT NULL AND episode_idx IS NOT NULL")
    last = F.max(F.struct("logged_time", "log_id", "start_pos", "is_current", "model_name"))
    state = rows.groupBy("user_id", "pod_id", "episode_idx").agg(F.min(F.struct("logged_time", "log_id")).alias("first"), last.alias("last"))
    flat = state.select("user_id", "pod_id", "episode_idx", F.col("first.logged_time").alias("t"), F.col("first.log_id").alias("i"), "last.start_pos", "last.is_current", "last.model_name")
    placed = numbered(flat, ["user_id"], F.to_date("t"), ["t", "i"], "idx")
    return placed.select("user_id", "idx", "pod_id", "episode_idx", "start_pos", "is_current", "model_name")


def next_ordinal(queue: DataFrame) -> DataFrame:
    return queue.groupBy("user_id").agg((F.coalesce(F.max("idx"), F.lit(0)) + 1).alias("next_idx"))


def delete_at(queue: DataFrame, at: Column) -> DataFrame:
    """Without the entry at an index, later ones moved up."""
    return queue.where(F.col("idx") != at).withColumn("idx", F.col("idx") - F.when(F.col("idx") > at, 1).otherwise(0))


def swap_at(queue: DataFrame, at: int) -> DataFrame:
    """Entries ``at`` and ``at`` + 1 of each queue change places where both are there."""
    both = queue.where(F.col("idx").isin(at, at + 1)).groupBy("user_id").agg((F.count("*") == 2).alias("both"))
    j = queue.join(both, "user_id", "left")
    idx = F.when(F.col("both") & (F.col("idx") == at), F.col("idx") + 1).when(F.col("both") & (F.col("idx") == at + 1), F.col("idx") - 1).otherwise(F.col("idx"))
    return j.withColumn("idx", idx).drop("both")


def insertions(log: DataFrame) -> DataFrame:
    """(log_id, inserted): whether each write added an entry to its queue or updated the one that was there."""
    rows = log.where("user_id IS NOT NULL AND episode_idx IS NOT NULL").groupBy("log_id", "user_id", "pod_id", "episode_idx").agg(F.min("logged_time").alias("logged_time"))
    first = rows.groupBy("user_id", "pod_id", "episode_idx").agg(F.min(F.struct("logged_time", "log_id"))["log_id"].alias("first"))
    on = rows["user_id"].eqNullSafe(first["user_id"]) & rows["pod_id"].eqNullSafe(first["pod_id"]) & rows["episode_idx"].eqNullSafe(first["episode_idx"])
    return rows.join(first, on).select("log_id", (F.col("log_id") == F.col("first")).alias("inserted"))


def current_item(queue: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The flagged entry of each queue (the lowest of several), else the previous one if it is still queued, else the first.

    ``previous``: (user_id, pod_id, episode_idx), at most one a user.
    """
    if previous is not None:
        before = previous.select("user_id", "pod_id", "episode_idx", F.lit(True).alias("was"))
        queue = queue.join(before, ["user_id", "pod_id", "episode_idx"], "left")
    else:
        queue = queue.withColumn("was", F.lit(False))
    rank = F.struct(F.when(F.col("is_current"), 0).when(F.col("was"), 1).otherwise(2).alias("r"), "idx", "pod_id", "episode_idx")
    best = queue.groupBy("user_id").agg(F.min(rank).alias("b"))
    return best.select("user_id", F.col("b.idx").alias("idx"), F.col("b.pod_id").alias("pod_id"), F.col("b.episode_idx").alias("episode_idx"))


def set_current(queue: DataFrame, at: Column) -> DataFrame:
    """The queues with entry ``at`` flagged and no other; queues without that entry stay, a single entry gets the flag."""
    n = queue.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.col("idx") == at).alias("there"))
    flag = F.when(F.col("there"), F.col("idx") == at).when(F.col("n") == 1, True).otherwise(F.col("is_current"))
    return queue.join(n, "user_id").withColumn("is_current", flag).drop("n", "there")


def resolve_items(queue: DataFrame, pods: DataFrame, episodes: DataFrame) -> DataFrame:
    """(user_id, idx, title, pod_title, duration): each item's episode by number, else by place in its pod, with defaults.

    ``pods``: (pod_id, pod_title); ``episodes``: (pod_id, number, place, title, duration), one row a number and a place.
    """
    by_number = episodes.where("number IS NOT NULL").select("pod_id", F.col("number").alias("episode_idx"), F.lit(True).alias("hit"), F.col("title").alias("t1"), F.col("duration").alias("d1"))
    by_place = episodes.select("pod_id", F.col("place").alias("episode_idx"), F.col("title").alias("t2"), F.col("duration").alias("d2"))
    x = queue.select("user_id", "idx", "pod_id", "episode_idx").join(pods, "pod_id", "left").join(by_number, ["pod_id", "episode_idx"], "left").join(by_place, ["pod_id", "episode_idx"], "left")
    pick = lambda a, b: F.nullif(F.when(F.col("hit"), F.col(a)).otherwise(F.col(b)), F.lit(""))
    title = F.coalesce(pick("t1", "t2"), F.concat(F.lit("Episode "), F.col("episode_idx").cast("string")))
    return x.select("user_id", "idx", title.alias("title"), F.coalesce(F.nullif("pod_title", F.lit("")), "pod_id").alias("pod_title"), F.coalesce(pick("d1", "d2"), F.lit("--:--")).alias("duration"))


def ordered(queue: DataFrame, key: str = "user_id") -> DataFrame:
    """The entries of each queue in order."""
    return queue.orderBy(key, "idx")


def delete_owned(books: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books without those their owner asks to delete, (id, folder_path) of the deleted). ``requests``: user_id, id."""
    asked = requests.select("user_id", "id").distinct()
    return books.join(asked, ["user_id", "id"], "left_anti"), books.join(asked, ["user_id", "id"], "left_semi").select("id", "folder_path")


def insert_clips(clips: DataFrame, new: DataFrame) -> DataFrame:
    """``clips`` with ``new`` ones (words as an array of structs), whose ids go on behind the highest, in the order of ``seq``."""
    top = clips.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    placed = numbered(new, [], F.floor(F.col("seq") / 4096), ["seq"], "n").crossJoin(F.broadcast(top))
    rows = placed.where("user_id IS NOT NULL AND pod_title IS NOT NULL").withColumn("id", F.col("top") + F.col("n")).withColumn("transcript", F.to_json("words"))
    return clips.unionByName(rows.select(*(c for c in clips.columns if c in rows.columns)), allowMissingColumns=True)


def upsert_books(writes: DataFrame) -> DataFrame:
    """Last state per (user, title): the first id, the latest time, the visibility written last."""
    t = F.coalesce("modified_time", "created_time")
    rows = writes.where("user_id IS NOT NULL AND book_title IS NOT NULL").select("id", "user_id", "book_title", t.alias("t"), "visibility")
    return rows.groupBy("user_id", "book_title").agg(F.min("id").alias("id"), F.max("t").alias("modified_time"), F.max(F.struct("t", "id", "visibility"))["visibility"].alias("visibility"))


def preferred_book(books: DataFrame, user: DataFrame) -> DataFrame:
    """Per title the user's own book, else the public one with the lowest id. ``user``: one row (me)."""
    books = books.crossJoin(F.broadcast(user.select("me").limit(1)))
    mine = F.col("user_id") == F.col("me")
    rank = F.struct(F.when(mine, 0).otherwise(1).alias("r"), "id")
    best = books.where(mine | (F.col("visibility") == 1)).where("book_title IS NOT NULL").groupBy("book_title").agg(F.min(rank)["id"].alias("id"))
    return best


def prune(jobs: DataFrame, most: int = 1000, cut: int = 500) -> DataFrame:
    """Ids of the oldest jobs that aren't running, at most ``cut``, where there are more than ``most``."""
    many = jobs.agg((F.count("*") > most).alias("many")).where("many").select(F.lit(1).alias("_one"))
    idle = jobs.where("status <> 'running'").join(F.broadcast(many), F.lit(1) == F.col("_one"), "left_semi")
    return idle.orderBy("id").limit(cut).select("id")


def normalised_params(jobs: DataFrame) -> DataFrame:
    """(id, name, value) from bags of maps: a map with ``key`` and ``value``, or of one entry, sets its name, later ones over
    earlier; a map of several entries sets only names that aren't set by then, and a later single entry overrides it."""
    bag = F.coalesce("params", F.array().cast("array<map<string,string>>"))
    each = jobs.select("id", F.posexplode(bag).alias("i", "m"))
    pair = F.map_contains_key("m", "key") & F.map_contains_key("m", "value")
    entries = F.when(pair, F.array(F.struct(F.col("m")["key"].alias("key"), F.col("m")["value"].alias("value")))).otherwise(F.map_entries("m"))
    rows = each.select("id", "i", (~pair & (F.size("m") > 1)).alias("weak"), F.explode(entries).alias("e")).select("id", "i", "weak", F.col("e.key").alias("name"), F.col("e.value").alias("value")).where("name <> ''")
    strong = F.max(F.when(~F.col("weak"), F.struct("i", "value")))
    got = rows.groupBy("id", "name").agg(strong.alias("strong"), F.min(F.struct("i", "value")).alias("first"))
    return got.select("id", "name", F.when(F.col("strong").isNotNull(), F.col("strong.value")).otherwise(F.col("first.value")).alias("value"))
