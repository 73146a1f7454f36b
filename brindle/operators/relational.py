"""Lookups, lists, counts and key-based writes over users, posts, interactions, tasks and logs.

Every function takes and returns DataFrames and stays lazy; filters reach the scan. Writes return the table after the write, to be
saved by the caller: Parquet has no row updates.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; a value of None sets no condition."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), [x for x in equal.items() if x[1] is not None], df)


def within(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows with start <= column <= end; either end may be open."""
    df = df if start is None else df.where(F.col(column) >= F.lit(start))
    return df if end is None else df.where(F.col(column) <= F.lit(end))


def page(df: DataFrame, *order: Column | str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the rows in the given order; give enough columns to break ties."""
    df = df.orderBy(*order)
    return (df.offset(offset) if offset else df).limit(limit)


def list_users(users: DataFrame, platform=None, is_suspicious=None, limit: int = 100, offset: int = 0, newest: str = "first_seen", key: str = "user_id") -> DataFrame:
    return page(matching(users, platform=platform or None, is_suspicious=is_suspicious), F.desc(newest), key, limit=limit, offset=offset)


def list_posts(posts: DataFrame, user_id=None, platform=None, start=None, end=None, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(within(matching(posts, user_id=user_id, platform=platform), "posted_at", start, end), F.desc("posted_at"), "post_id", limit=limit, offset=offset)


def count_rows(df: DataFrame, key: str, name: str = "n", **equal) -> DataFrame:
    return matching(df, **equal).agg(F.count(key).alias(name))


def posts_by_hashtag(posts: DataFrame, tag: str, platform=None, limit: int = 100, whole: bool = False) -> DataFrame:
    """By a part of the tags' JSON text, as a text column is searched; whole=True takes only equal tags."""
    hit = F.array_contains("hashtags", tag) if whole else F.to_json("hashtags").contains(tag)
    return page(matching(posts, platform=platform).where(hit), F.desc("posted_at"), "post_id", limit=limit)


def search_content(posts: DataFrame, query: str, platform=None, limit: int = 100, newest: str = "posted_at") -> DataFrame:
    """Case-insensitive LIKE %query%, in which % and _ keep their meaning; an empty query takes every non-null text."""
    return page(matching(posts, platform=platform).where(F.col("content").ilike(f"%{query}%")), F.desc(newest), "post_id", limit=limit)


def pending_tasks(tasks: DataFrame, platform=None, limit: int = 10) -> DataFrame:
    open_ = matching(tasks, platform=platform).where((F.col("status") == "pending") & (F.col("retry_count") < F.col("max_retries")))
    return page(open_, F.desc("priority"), "created_at", "task_id", limit=limit)


def with_status(tasks: DataFrame, task_id, status: str, now, result_count=None, error=None) -> DataFrame:
    """Set a task's status; running stamps started_at, completed and failed stamp completed_at."""
    mine = F.col("task_id") == F.lit(task_id)
    put = lambda name, value, kind: F.when(mine, F.lit(value)).otherwise(F.col(name) if name in tasks.columns else F.lit(None).cast(kind))
    changed = {"status": put("status", status, "string")}
    if status in ("running", "completed", "failed"):
        name = "started_at" if status == "running" else "completed_at"
        changed[name] = put(name, now, "timestamp_ntz")
    if result_count is not None:
        changed["result_count"] = put("result_count", result_count, "long")
    if error is not None:
        changed["error_message"] = put("error_message", error, "string")
    return tasks.withColumns(changed)


def with_retry(tasks: DataFrame, task_id) -> DataFrame:
    return tasks.withColumn("retry_count", F.when(F.col("task_id") == F.lit(task_id), F.col("retry_count") + 1).otherwise(F.col("retry_count")))


def without_old(df: DataFrame, column: str, as_of: Column, days: int, only: Column | None = None) -> DataFrame:
    """Delete the rows (of those that `only` holds for) whose column is more than `days` before as_of; null stays."""
    old = F.col(column) < as_of - F.expr(f"INTERVAL {days} DAYS")
    return df.where(~F.coalesce(old if only is None else old & only, F.lit(False)))


def marked(users: DataFrame, user_id, score: float, is_suspicious: bool = True) -> DataFrame:
    mine = F.col("user_id") == F.lit(user_id)
    return users.withColumns({"is_suspicious": F.when(mine, F.lit(is_suspicious)).otherwise(F.col("is_suspicious")), "suspicious_score": F.when(mine, F.lit(score)).otherwise(F.lit(None) if "suspicious_score" not in users.columns else F.col("suspicious_score"))})


def top_scored(df: DataFrame, score: str, threshold: float, key: str, limit: int = 100) -> DataFrame:
    return page(df.where(F.col(score) >= threshold), F.desc(score), key, limit=limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str] | None = None, arrival: str | None = None) -> DataFrame:
    """old after inserting new rows or, where the key is there, taking `updated` columns (all, if None) from the new row.

    Of several new rows with one key the last by `arrival` counts. One full outer join on the key.
    """
    if arrival:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(arrival)))).where("_n = 1").drop("_n")
    taken = set(old.columns if updated is None else updated) - set(keys)
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, keys, "full")
    pick = lambda c: F.when(F.col("_new") & (F.col("_old").isNull() | F.lit(c in taken)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*keys, *(pick(c) for c in old.columns if c not in keys))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """old with the rows of new whose key is not there yet; of several new rows with one key the first by `arrival`."""
    if arrival:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(arrival))).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(keys)
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def with_values(df: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Update: columns of `values` beside the keys replace those of df where the key matches."""
    mine = [c for c in values.columns if c not in keys]
    found = values.select(*keys, *(F.col(c).alias(f"_{c}") for c in mine), F.lit(True).alias("_hit"))
    out = df.join(found, keys, "left").withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c in mine})
    return out.drop("_hit", *(f"_{c}" for c in mine))


def first_of_each(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Deduplicate: the first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def filtered(df: DataFrame, platforms=None, user_ids=None, start=None, end=None, hashtags=None, mentions=None, least_likes=None, language=None, sentiment=None, null_time_passes: bool = True) -> DataFrame:
    """A conjunction of optional conditions; tags match any-of in lower case, mentions any-of as written."""
    when = lambda ok: (F.col("posted_at").isNull() | ok) if null_time_passes else ok
    checks = [
        platforms and F.col("platform").isin(platforms),
        user_ids and F.col("user_id").isin(user_ids),
        start is not None and when(F.col("posted_at") >= F.lit(start)),
        end is not None and when(F.col("posted_at") <= F.lit(end)),
        hashtags and F.arrays_overlap(F.transform("hashtags", F.lower), F.array(*(F.lit(t.lstrip("#").lower()) for t in hashtags))),
        mentions and F.arrays_overlap("mentions", F.array(*map(F.lit, mentions))),
        least_likes is not None and F.col("likes_count") >= least_likes,
        language and F.col("language") == language,
        sentiment and F.col("sentiment_score").between(*sentiment),
    ]
    return reduce(lambda d, c: d.where(c), [c for c in checks if isinstance(c, Column)], df)


#: The five orders of search results; each breaks ties by time, then by id.
ORDERS = {"relevance": "score", "time_desc": None, "time_asc": None, "likes": "likes_count", "comments": "comments_count"}


def sorted_posts(df: DataFrame, order: str, key: str = "post_id") -> DataFrame:
    if order not in ORDERS:
        raise ValueError(f"unknown order {order}")
    if order == "time_asc":
        return df.orderBy(F.asc_nulls_last("posted_at"), key)
    first = [F.desc_nulls_last(ORDERS[order])] if ORDERS[order] else []
    return df.orderBy(*first, F.desc_nulls_last("posted_at"), key)
