"""Applies numbered changes in order, late ones held back in paged state, by a stateful stream."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .common import Scratch

#: Numbers of a page of held changes, and pages that a task keeps loaded for one bucket of clients.
PAGE, LOADED = 512, 32
#: A day is a millisecond of event time, counted from a day before all dates; the last row's day is beyond all.
ZERO, BEYOND = 10**7, 2 * 10**7
#: Batches, the first day and the days they share; days that a held change waits.
BATCHES, FIRST_DAY, SPAN, WAIT = 12, 19723, 160, 3
#: Clients of a bucket, on average; keys that share the later copies of numbers.
CLIENTS, SALTS = 256, 64
HELD = pa.schema([("client", pa.string()), ("n", pa.int64()), ("day", pa.int64()), ("change", pa.string()), ("op", pa.string()), ("city", pa.string()), ("cents", pa.int64())])
HEADS = pa.schema([("client", pa.string()), ("next", pa.int64()), ("city", pa.string()), ("cents", pa.int64()), ("pages", pa.list_(pa.int64()))])
OUT = "change string, client string, n long, op string, status string, batch int, missed long, city string, cents long, valued boolean"


def batch_of(day: int) -> int:
    return max(1, min(BATCHES, 1 + (day - FIRST_DAY) * BATCHES // SPAN))


def packed(rows: list[tuple], schema: pa.Schema) -> bytes:
    sink = io.BytesIO()
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
    return sink.getvalue()


def unpacked(blob: bytes) -> Iterator[tuple]:
    with pa.ipc.open_stream(blob) as reader:
        return zip(*(c.to_pylist() for c in reader.read_all().columns), strict=True)


class Client:
    """Where a client stands: the next number, city and cents, and the pages that hold changes of it."""

    __slots__ = ("cents", "city", "next", "pages")

    def __init__(self, next_n: int = 1, city: str | None = None, cents: int | None = None, pages: list[int] | None = None):
        self.next, self.city, self.cents, self.pages = next_n, city, cents, set(pages or ())


class Bucket:
    """The state of one bucket of clients while a call lasts.

    heads: where each client stands, and of each page of numbers the least day held in it. pages: a map from a page to an Arrow blob
    of the changes whose numbers lie in it, with that least day. Only pages that a call touches are read and written: small clients share the
    first, a huge one's numbers go on through many.
    """

    def __init__(self, heads, pages):
        self.heads, self.pages = heads, pages
        found = heads.get()
        self.clients: dict[str | None, Client] = {}
        self.days: dict[int, int] = {}
        if found is not None:
            self.clients = {c: Client(*rest) for c, *rest in unpacked(bytes(found[0]))}
            self.days = dict(zip(found[1], found[2], strict=True))
        self.open: dict[int, dict[tuple, tuple]] = {}
        self.dirty: set[int] = set()

    def page(self, number: int) -> dict[tuple, tuple]:
        """The changes of a page by client and number; the page that was loaded first makes room."""
        rows = self.open.get(number)
        if rows is None:
            if len(self.open) >= LOADED:
                self.close(next(iter(self.open)))
            rows = {(r[0], r[1]): r for r in unpacked(bytes(self.pages.getValue((number,))[0]))} if number in self.days else {}
            self.open[number] = rows
        return rows

    def close(self, number: int) -> None:
        rows = self.open.pop(number)
        if number not in self.dirty:
            return
        self.dirty.discard(number)
        if rows:
            self.days[number] = day = min(r[2] for r in rows.values())
            self.pages.updateValue((number,), (packed(list(rows.values()), HELD), day))
        elif self.days.pop(number, None) is not None:
            self.pages.removeKey((number,))

    def flush(self) -> None:
        for number in list(self.open):
            self.close(number)

    def save(self) -> None:
        self.flush()
        rows = [(c, x.next, x.city, x.cents, sorted(x.pages)) for c, x in self.clients.items()]
        self.heads.update((packed(rows, HEADS), list(self.days), list(self.days.values())))

    def hold(self, row: tuple, client: Client) -> bool:
        """Whether the change's number was free: it is held then."""
        number = row[1] // PAGE
        rows = self.page(number)
        if row[:2] in rows:
            return False
        rows[row[:2]] = row
        client.pages.add(number)
        self.dirty.add(number)
        return True

    def least(self, name: str | None, client: Client) -> int | None:
        """The client's smallest held number."""
        while client.pages:
            first = min(client.pages)
            found = [n for c, n in self.page(first) if c == name]
            if found:
                return min(found)
            client.pages.discard(first)
        return None

    def run(self, name: str | None, client: Client, batch: int, missed: int, out: list) -> None:
        """Applies the client's held changes from its next number on."""
        while client.next // PAGE in client.pages:
            row = self.page(client.next // PAGE).pop((name, client.next), None)
            if row is None:
                break
            self.dirty.add(client.next // PAGE)
            _, n, _, change, op, city, cents = row
            if op == "I":
                client.city, client.cents = city, cents
            elif op == "U":
                client.city, client.cents = client.city if city is None else city, client.cents if cents is None else cents
            elif op == "D":
                client.city = client.cents = None
            out.append((change, name, n, op, "applied", batch, missed, client.city, client.cents or 0, client.cents is not None))
            client.next, missed = n + 1, 0
            if client.next % PAGE == 0:
                client.pages.discard(n // PAGE)

    def due(self, largest: int, batch: int) -> Iterator[list]:
        """Jumps of the clients whose earliest change has waited enough, and what they let go; pages with such a change are searched, others
        are not read."""
        out: list = []
        late = [number for number, day in self.days.items() if day + WAIT <= largest]
        for number in late:
            names = {r[0] for r in self.page(number).values() if r[2] + WAIT <= largest}
            for name in names:
                client = self.clients[name]
                while any(r[0] == name and r[2] + WAIT <= largest for r in self.page(number).values()):
                    first = self.least(name, client)
                    missed, client.next = first - client.next, first
                    self.run(name, client, batch, missed, out)
                    if len(out) > 10_000:
                        yield out
                        out = []
        yield out


class Applier(StatefulProcessor):
    """Applies the changes of a bucket of clients. Its timer is the day on which the earliest held change has waited enough."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getValueState("heads", "clients binary, pages array<long>, days array<long>")
        self.pages = handle.getMapState("pages", "page long", "changes binary, day long")

    def frame(self, out: list) -> pd.DataFrame:
        names = ("change", "client", "n", "op", "status", "batch", "missed", "city", "cents", "valued")
        return pd.DataFrame(dict(zip(names, zip(*out, strict=True), strict=True))).astype({"batch": "int32"})

    def wake(self, bucket: Bucket) -> None:
        if bucket.days:  # a timer fires once the watermark, the largest day of earlier batches, has reached it
            self.handle.registerTimer(min(bucket.days.values()) + WAIT + ZERO)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket = Bucket(self.heads, self.pages) if key[0] >= 0 else None
        if bucket is not None:  # the batch's start comes before its rows
            yield from self.started(bucket, timerValues)
        for frame in rows:
            out: list = []
            for change, name, n, day, op, city, cents, valued in zip(*(frame[c].tolist() for c in ("change", "client", "n", "day", "op", "city", "cents", "valued")), strict=True):
                if bucket is not None:
                    client = bucket.clients.get(name) or bucket.clients.setdefault(name, Client())
                    if n >= client.next and bucket.hold((name, n, day, change, op, city, cents if valued else None), client):
                        if n == client.next:
                            bucket.run(name, client, batch_of(day), 0, out)
                        continue
                out.append((change, name, n, op, "rejected", batch_of(day), 0, None, 0, False))
            if out:
                yield self.frame(out)
        if bucket is not None:
            bucket.save()
            self.wake(bucket)

    def started(self, bucket: Bucket, timerValues) -> Iterator[pd.DataFrame]:
        """What a batch's start lets go: the watermark is the largest day of earlier batches."""
        largest = timerValues.getCurrentWatermarkInMs() - ZERO
        if largest > -ZERO:  # not before the first batch
            for out in bucket.due(largest, batch_of(largest) + 1):
                if out:
                    yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket = Bucket(self.heads, self.pages)
        if any(day + WAIT + ZERO <= timerValues.getCurrentWatermarkInMs() for day in bucket.days.values()):  # else the batch's rows came first
            yield from self.started(bucket, timerValues)
            bucket.save()
            self.wake(bucket)

    def close(self) -> None:
        pass


def folded(change_id: Column) -> Column:
    return F.crc32(change_id.cast("string"))


def numbered(scratch: Scratch, changes: DataFrame) -> DataFrame:
    """Distinct (client_id, seq) with n, the dense rank of seq in its client, null first.

    Pairs are dealt by ranges and numbered there. Only a range's first client can have begun in earlier ranges: what
    is broadcast is a row for each range.
    """
    pairs = changes.select("client_id", "seq").distinct().repartitionByRange("client_id", "seq").withColumn("part", F.spark_partition_id())
    pairs = scratch.save(pairs)
    sizes = pairs.groupBy("part").agg(F.min(F.struct("client_id")).alias("low"), F.max(F.struct("client_id")).alias("high"))
    ends = pairs.join(F.broadcast(sizes), "part").where(F.struct("client_id").eqNullSafe(F.col("low")) | F.struct("client_id").eqNullSafe(F.col("high")))
    ends = ends.groupBy("part", "client_id").agg(F.count("*").alias("size"))  # at most two rows for each range
    before = F.sum("size").over(Window.partitionBy("client_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col("part").alias("p"), F.col("client_id").alias("c"), before.alias("before")).where("before > 0")
    at = F.row_number().over(Window.partitionBy("part", "client_id").orderBy("seq"))
    found = pairs.withColumn("at", at).join(F.broadcast(ends), (F.col("part") == F.col("p")) & F.col("client_id").eqNullSafe(F.col("c")), "left")
    return found.select(F.col("client_id").alias("c"), F.col("seq").alias("s"), (F.col("at") + F.coalesce("before", F.lit(0))).cast("long").alias("n"))


def prepared(scratch: Scratch, changes: DataFrame) -> tuple[DataFrame, int]:
    """The number of buckets, and the distinct rows with number, day and batch that take part; bucket: below 0 where one of the batch's changes of the same number comes before it."""
    rows = changes.select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").distinct()
    rows = scratch.save(rows)
    n = numbered(scratch, rows)
    h = folded(F.col("change_id"))
    day = F.unix_date(F.col("valid_at").cast("date")) + 9 * F.pmod(h, F.lit(4))
    kept = rows.where("valid_at is not null").where(F.coalesce(F.pmod(h, F.lit(11)) != 0, F.lit(True)))
    kept = kept.join(n, F.col("client_id").eqNullSafe(F.col("c")) & F.col("seq").eqNullSafe(F.col("s")))
    kept = kept.withColumn("day", F.coalesce(day, F.unix_date(F.col("valid_at").cast("date"))).cast("long"))
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / SPAN)))
    cents = F.when(~F.isnan("balance"), F.floor(F.col("balance") * 100 + 0.5)).cast("long")
    first = Window.partitionBy("client_id", "n", "batch").orderBy("day", "change_id", "op", "city", "cents", "tie")
    kept = kept.withColumn("cents", cents).withColumn("batch", batch.cast("int")).withColumn("tie", F.xxhash64("seq", "source", "segment", "valid_at"))
    kept = kept.withColumn("copy", F.row_number().over(first) > 1)
    buckets = 1 + rows.agg(F.approx_count_distinct("client_id")).first()[0] // CLIENTS
    bucket = F.when(F.col("copy"), -1 - F.pmod(F.xxhash64("change_id"), F.lit(SALTS))).otherwise(F.pmod(F.xxhash64("client_id"), F.lit(buckets)))
    text = {"change": "change_id", "client": "client_id"}
    out = kept.select(bucket.cast("long").alias("bucket"), *(F.col(c).cast("string").alias(k) for k, c in text.items()), "n", "day", "op", "city", F.coalesce("cents", F.lit(0)).cast("long").alias("cents"), F.col("cents").isNotNull().alias("valued"), "batch")
    return out, buckets


def apply_changes(changes: DataFrame) -> DataFrame:
    """change_id, client_id, status, batch, missed, city, cents, current for each distinct row of changes that takes part.

    Rows (change_id, client_id, seq, op, valid_at, source, segment, city, balance) come in BATCHES batches by day. Each is written to a
    folder that a streaming query with state reads, started anew for each batch on one checkpoint. Within a client the changes
    are applied by number; those that come early are held in pages of PAGE numbers until the numbers before them came or,
    at a batch's start, until the largest day of earlier batches is WAIT days after them: an event-time timer, as the watermark is
    that day. A last row, with a day beyond all, lets what is still held go.

    Of changes of one client, number and batch only the first by (day, change_id) can be held; the others are
    rejected whatever the state is, and are dealt apart from their client. So a client's task reads each number once a batch and
    needs no order. Of rows with equal day and change_id the first by op, city, balance counts.
    The state's keys are buckets of some CLIENTS clients: one read and one write of the state serve them all.

    Null client_ids are one client; null change_ids have no hash: they stay, without delay. Null seqs are the first number.
    Other ops than I, U, D change nothing but are applied; a balance that isn't a number counts as null. Days before the first batch come in
    it. An empty table gives no rows. Other columns are not read. What is broadcast is a row for each range of numbers; the driver gets one count.
    """
    spark = changes.sparkSession
    scratch = Scratch(spark, "changes")
    kinds = {c: changes.schema[c].dataType for c in ("change_id", "client_id")}
    root = scratch.path()
    staged, feed, out = (f"{root}/{x}" for x in ("staged", "feed", "out"))
    ready, buckets = prepared(scratch, changes)
    ready.withColumn("file", F.col("batch")).repartition("file", F.pmod(F.xxhash64("change"), F.lit(8))).write.partitionBy("file").parquet(staged)
    schema = ready.schema
    last = spark.range(1).select(*(F.lit(BEYOND if c.name == "day" else None).cast(c.dataType).alias(c.name) for c in schema))
    last.write.parquet(f"{staged}/file={BATCHES + 1}")

    session = spark.newSession()  # its settings are for this query alone
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # fixed for the checkpoint's life: the session's own number, or fewer where there are few buckets
    session.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 + buckets // 8)))
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(feed))
    for batch in range(1, BATCHES + 2):
        if not files.exists(path(f"{staged}/file={batch}")):
            continue  # an empty batch: the largest day is as before, so nothing more is due
        files.rename(path(f"{staged}/file={batch}"), path(f"{feed}/file={batch}"))
        # a batch's start is told with its rows, or by a timer; only the last row is followed by a batch without any
        session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(batch > BATCHES).lower())
        rows = session.readStream.schema(schema).parquet(f"{feed}/file=*")
        rows = rows.withColumn("at", F.timestamp_millis(F.col("day") + ZERO)).withWatermark("at", "0 seconds")
        rows = rows.where(F.col("n").isNotNull() | F.col("at").isNull())  # not the last row; by `at` too, so that the watermark sees it first
        done = rows.groupBy("bucket").transformWithStateInPandas(Applier(), OUT, "append", "eventTime")
        query = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
    found = spark.read.schema(OUT).parquet(out)
    ends = found.where("status = 'applied'").groupBy("client").agg(F.max("n").alias("n")).select(F.col("client").alias("c"), F.col("n").alias("last"))
    final = found.join(ends, F.col("client").eqNullSafe(F.col("c")) & (F.col("n") == F.col("last")), "left")
    current = F.col("last").isNotNull() & (F.col("status") == "applied") & ~F.col("op").eqNullSafe("D")
    return final.select(
        F.col("change").cast(kinds["change_id"]).alias("change_id"), F.col("client").cast(kinds["client_id"]).alias("client_id"), "status", "batch", "missed", "city", F.when(F.col("valued"), F.col("cents")).alias("cents"), current.alias("current")
    )


def _crc32_sql(value: str) -> str:
    """DuckDB SQL of the CRC-32 of a number's decimal digits, a digit by two lookups in the polynomial's table of nibbles."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    step = lambda x: f"xor(({x}) >> 4, {table}[(({x}) & 15) + 1])"
    digits = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda crc, d: {step(step('xor(crc, d)'))}), 4294967295)"


#: A client's batches one after another, each a row of the recursion: a jump over numbers that waited enough, or the batch's changes.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT DISTINCT * FROM client_changes), h AS (
  SELECT *, dense_rank() OVER (PARTITION BY client_id ORDER BY seq NULLS FIRST) AS n, {_crc32_sql("change_id")} AS h FROM d
), k AS (
  SELECT *, row_number() OVER (ORDER BY change_id, day, op, city, balance) AS rid, least({BATCHES}, 1 + (day - {FIRST_DAY}) * {BATCHES} // {SPAN}) AS b,
         CAST(floor(100 * balance + 0.5) AS BIGINT) AS own
  FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + 9 * (h % 4) AS day FROM h WHERE valid_at IS NOT NULL AND h % 11 <> 0)
), f AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY client_id, n, b ORDER BY day, change_id, op, city, own) = 1
), arrivals AS (
  SELECT client_id AS c, b AS ab, list({{'n': n, 'day': day, 'rid': rid}}) AS rows FROM f GROUP BY ALL
), largest AS (
  SELECT b AS lb, CASE WHEN b > {BATCHES} THEN 1000000 ELSE (SELECT max(day) FROM k WHERE k.b < g.b) END AS m FROM range(1, {BATCHES + 2}) g(b)
), s AS (
  SELECT DISTINCT client_id, CAST(1 AS BIGINT) AS b, CAST(1 AS BIGINT) AS nx, CAST([] AS STRUCT(n BIGINT, day BIGINT, rid BIGINT)[]) AS held,
         CAST([] AS STRUCT(n BIGINT, day BIGINT, rid BIGINT)[]) AS applied, CAST(0 AS BIGINT) AS missed, CAST(0 AS BIGINT) AS step FROM k
  UNION ALL
  SELECT client_id, CASE WHEN due THEN b ELSE b + 1 END, start + done, list_filter(pool, lambda x: x.n >= start + done), list_filter(pool, lambda x: x.n < start + done),
         start - nx, b
  FROM (
    SELECT *, len(list_filter(sorted, lambda x, i: x = start + i - 1)) AS done
    FROM (
      SELECT *, list_sort(list_transform(pool, lambda x: x.n)) AS sorted, CASE WHEN due THEN list_min(list_transform(pool, lambda x: x.n)) ELSE nx END AS start
      FROM (
        SELECT *, CASE WHEN due THEN held ELSE list_concat(held, list_filter(rows, lambda x: x.n >= nx AND NOT list_contains(list_transform(held, lambda y: y.n), x.n))) END AS pool
        FROM (
          SELECT s.client_id, s.b, s.nx, s.held, coalesce(arrivals.rows, []) AS rows,
                 coalesce(list_min(list_transform(s.held, lambda x: x.day)) + {WAIT} <= m, false) AS due
          FROM s JOIN largest ON lb = s.b LEFT JOIN arrivals ON c IS NOT DISTINCT FROM s.client_id AND ab = s.b
        ) WHERE due OR b <= {BATCHES}
      )
    )
  )
), a AS (
  SELECT client_id, step, missed, unnest(list_transform(applied, lambda x: x.rid)) AS rid, unnest(list_transform(applied, lambda x: x.n)) AS n,
         list_min(list_transform(applied, lambda x: x.n)) AS first FROM s
), v AS (
  SELECT k.rid, a.step, CASE WHEN a.n = first THEN missed ELSE 0 END AS missed, op,
         last_value(CASE WHEN op IN ('I', 'D') OR op = 'U' AND city IS NOT NULL THEN {{'x': CASE WHEN op <> 'D' THEN city END}} END IGNORE NULLS) OVER w AS city,
         last_value(CASE WHEN op IN ('I', 'D') OR op = 'U' AND own IS NOT NULL THEN {{'x': CASE WHEN op <> 'D' THEN own END}} END IGNORE NULLS) OVER w AS cents,
         a.n = max(a.n) OVER (PARTITION BY a.client_id) AND op IS DISTINCT FROM 'D' AS current
  FROM a JOIN k ON a.rid = k.rid WINDOW w AS (PARTITION BY a.client_id ORDER BY a.n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT change_id, client_id, CASE WHEN v.rid IS NULL THEN 'rejected' ELSE 'applied' END AS status, CAST(coalesce(step, b) AS INTEGER) AS batch,
       CAST(coalesce(missed, 0) AS BIGINT) AS missed, v.city.x AS city, v.cents.x AS cents, coalesce(current, false) AS current
FROM k LEFT JOIN v ON v.rid = k.rid
"""
