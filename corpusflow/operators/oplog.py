"""Sessions, audit statistics, hash chains and rate limits over event tables."""

from __future__ import annotations

import hashlib
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json


def audit_stats(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 4).alias("avg_value"), F.round(F.max("value"), 4).alias("max_value")
    )


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def chained(previous: Column, entry: Column) -> Column:
    return F.sha2(F.concat(previous, entry), 256)


#: The hash before the first entry of a chain.
GENESIS = "0" * 64


def linked_entry(fields: dict[str, Column], previous: Column) -> Column:
    """The JSON of an entry that is hashed: its fields and the hash of the entry before, keys in order."""
    return canonical_json(fields | {"previous_audit_hash": previous})


def entry_parts(fields: dict[str, Column]) -> tuple[Column, Column]:
    """What stands before and after the hash of the entry before in an entry's JSON, whose keys are in order."""
    before = {k: c for k, c in fields.items() if k < "previous_audit_hash"}
    after = {k: c for k, c in fields.items() if k > "previous_audit_hash"}
    head = F.concat(F.regexp_replace(canonical_json(before), r"\}$", ", " if before else ""), F.lit('"previous_audit_hash": "'))
    return head, F.concat(F.lit('", ' if after else '"'), F.substr(canonical_json(after), F.lit(2)))


def hash_chain(rows: DataFrame, key: str, order: str, fields: dict[str, Column], heads: DataFrame | None = None) -> DataFrame:
    """(key, order, previous_audit_hash, audit_hash) of rows, each key's entries chained in order from 64 zeros; with heads (k, last_hash, length) from
    its key's head, and with n, the entry's place in the chain.

    The JSON of an entry has the hash before at a fixed place, so its parts around are made by Spark and the fold only
    hashes, a batch at a time. A chain is sequential by nature; keys are parallel. Entries without a key are left out.
    """
    head, tail = entry_parts(fields)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, order)}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, n = object(), GENESIS, 0
        for frame in batches:
            previous, own, place = [], [], []
            for k, start, stop, first, length in zip(frame["k"], frame["head"], frame["tail"], frame["last_hash"], frame["length"], strict=True):
                if k != now:
                    now, last, n = k, first, length
                previous.append(last)
                last = hashlib.sha256((start + last + stop).encode()).hexdigest()
                n += 1
                own.append(last)
                place.append(n)
            yield pd.DataFrame({"k": frame["k"], "o": frame["o"], "n": place, "previous_audit_hash": previous, "audit_hash": own})

    parts = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), head.alias("head"), tail.alias("tail")).where("k is not null")
    first = (F.lit(GENESIS), F.lit(0).cast("long"))
    if heads is not None:
        parts = parts.join(heads.select("k", "last_hash", "length"), "k", "left")
        first = (F.coalesce("last_hash", first[0]), F.coalesce("length", first[1]))
    parts = parts.withColumn("last_hash", first[0]).withColumn("length", first[1])
    made = parts.repartition("k").sortWithinPartitions("k", "o").mapInPandas(work, f"k {kinds[key]}, o {kinds[order]}, n long, previous_audit_hash string, audit_hash string")
    made = made.withColumnRenamed("k", key).withColumnRenamed("o", order)
    return made


def verify_chain(entries: DataFrame, key: str, order: str, fields: dict[str, Column]) -> DataFrame:
    """entries with `ok`: whether the hash is that of the entry, and the one before is that of the entry before. All entries at once."""
    before = F.coalesce(F.lag("audit_hash").over(Window.partitionBy(key).orderBy(order)), F.lit(GENESIS))
    own = F.sha2(linked_entry(fields, F.col("previous_audit_hash")), 256)
    return entries.withColumn("ok", (F.col("audit_hash") == own) & (F.col("previous_audit_hash") == before))


def offered_load(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Requests of the key in the trailing seconds, strictly, this one and others of its time included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("load", F.count("*").over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)))


def folded(events: DataFrame, key: str, ts: str, limiter: Callable) -> DataFrame:
    """(k, event_id, t, accepted): a new limiter over each key's events in order of time and id, a batch at a time; only its state is held.
    Events without a key are left out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for frame in batches:
            out = []
            for k, t in zip(frame["k"], frame["t"], strict=True):
                if k != now:
                    now, state = k, limiter()
                out.append(state.accept(int(t)))
            yield frame.assign(accepted=out)

    rows = events.select(F.col(key).alias("k"), "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("k is not null")
    kind = events.schema[key].dataType.simpleString()
    return rows.repartition("k").sortWithinPartitions("k", "t", "event_id").mapInPandas(work, f"k {kind}, event_id long, t long, accepted boolean")


class Log:
    """At most `most` accepted in the trailing seconds, strictly; rejected ones don't count. Holds `most` times."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds, self.kept = most, seconds, deque()

    def accept(self, t: int) -> bool:
        kept = self.kept
        while kept and t - kept[0] >= self.seconds * 1_000_000:
            kept.popleft()
        if len(kept) >= self.most:
            return False
        kept.append(t)
        return True


class Bucket:
    """A leaky bucket: `rate` requests a minute flow out, up to `burst` may wait."""

    def __init__(self, rate: float, burst: int):
        self.rate, self.burst, self.level, self.last = rate, burst, 0.0, 0

    def accept(self, t: int) -> bool:
        self.level, self.last = max(0.0, self.level - (t - self.last) / 60e6 * self.rate), t
        if self.level > self.burst:
            return False
        self.level += 1
        return True


class Cache:
    """Accepts what it doesn't hold, and then holds it for so many seconds."""

    def __init__(self, seconds: int):
        self.seconds, self.since = seconds, None

    def accept(self, t: int) -> bool:
        if self.since is not None and t - self.since < self.seconds * 1_000_000:
            return False
        self.since = t
        return True


def cached(events: DataFrame, cache: str, key: str, ts: str, most: int = 200, seconds: int = 3600) -> DataFrame:
    """(event_id, hit): whether a cache answers each event. There is one for each value of `cache` (a server, say), all in parallel.

    An entry is put in by the event that misses it and lives for `seconds`, whatever is asked meanwhile; of more than `most` living entries the least
    recently used one goes. Events are taken in order of time and id; a cache's state is its entries, so no task holds
    more. Events without a cache or a key are left out.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), OrderedDict()
        for frame in batches:
            out = []
            for c, k, t in zip(frame["c"], frame["k"], frame["t"], strict=True):
                if c != now:
                    now, held = c, OrderedDict()
                since = held.get(k)
                hit = since is not None and t - since < seconds * 1_000_000
                if hit:
                    held.move_to_end(k)
                else:
                    held.pop(k, None)
                    if len(held) >= most:  # entries whose time is over make room first
                        for old in [x for x, s in held.items() if t - s >= seconds * 1_000_000]:
                            del held[old]
                    if len(held) >= most:
                        held.popitem(last=False)
                    held[k] = t
                out.append(hit)
            yield pd.DataFrame({"event_id": frame["event_id"], "hit": out})

    rows = events.select(F.col(cache).alias("c"), F.col(key).alias("k"), "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("c is not null and k is not null")
    return rows.repartition("c").sortWithinPartitions("c", "t", "event_id").mapInPandas(work, "event_id long, hit boolean")


def limited(events: DataFrame, key: str, ts: str, most: int = 15, seconds: int = 60) -> DataFrame:
    """Each event with `accepted`: at most `most` accepted ones of a key in the trailing seconds."""
    return folded(events, key, ts, lambda: Log(most, seconds))


def leaky(events: DataFrame, key: str, ts: str, rate: float = 10.0, burst: int = 5) -> DataFrame:
    """Each event with `accepted`: a proxy's limit of `rate` a minute and bursts of `burst` more."""
    return folded(events, key, ts, lambda: Bucket(rate, burst))


def ttl_misses(events: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Events that a cache answers anew: the first of its key, and the first when `seconds` have passed since the last such one.
    A hit doesn't prolong an entry's life."""
    whole = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    return folded(events.withColumn("_key", whole), "_key", ts, lambda: Cache(seconds)).where("accepted").select("event_id")


def sessions(events: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    at = F.col(ts).cast("timestamp").cast("double")
    order = Window.partitionBy(key).orderBy(at, "event_id")
    new = F.coalesce((at - F.lag(at).over(order) > gap).cast("int"), F.lit(0))
    rows = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


