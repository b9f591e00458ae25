"""Removal of repeated substrings by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ranked

#: Bytes of the grams whose hashes choose where strings meet; of text transformed at once.
GRAM, TEXT = 32, 1 << 17
#: Differing segments of one gram beyond which they are cut again by the strings' next grams.
CROWD = 20_000
#: Entries of a table of letter counts; a longer text is searched instead.
COUNTS = 1 << 24
NONE = np.uint64(2**64 - 1)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    a = np.zeros(n, np.uint64)
    for i, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
        a += np.ndarray((n,), "<u8", data, 8 * i, (1,)) * np.uint64(odd)
        a ^= a >> np.uint64(29)
    a *= np.uint64(0x165667B19E3779F9)
    a ^= a >> np.uint64(32)
    return a


def chosen(hashes: np.ndarray, window: int) -> np.ndarray:
    """The place of the least hash of each window, the last of equal ones."""
    least, place, size = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while size < window:
        by = min(size, window - size)
        n = len(least) - by
        right = least[by:] <= least[:n]
        least, place = np.where(right, least[by:], least[:n]), np.where(right, place[by:], place[:n])
        size += by
    return place


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts the strings of `length` bytes in the texts between offsets into runs whose strings have the same gram
    with the least hash: (text, first start in the text, number of starts, hash). Equal strings have
    that gram at the same place, so they are only found in segments of one hash."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    hashes = grams(data)
    place = chosen(hashes, length - GRAM + 1)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(text):
        return empty, empty, empty, np.zeros(0, np.uint64)
    counts = np.maximum(sizes - length + 1, 0)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    spot = place[start]
    cut = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (text[1:] != text[:-1]))))
    ends = np.concatenate((cut[1:], [len(text)]))
    return text[cut], start[cut] - offsets[text[cut]], ends - cut, hashes[spot[cut]]


def segments_again(part: np.ndarray, length: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts one segment, whose strings share their `level` least gram hashes, into runs that share the next one too: (first start,
    number of starts, next hash; the largest number where a string has no further gram)."""
    hashes, window = grams(part), length - GRAM + 1
    for _ in range(level):
        hashes = np.where(hashes == hashes[:window].min(), NONE, hashes)
    spot = chosen(hashes, window)
    cut = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1])))
    return cut, np.diff(np.concatenate((cut, [len(spot)]))), hashes[spot[cut]]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling from prefixes of seven symbols (0 to 256)."""
    n = len(symbols)
    packed = np.zeros(n, np.int64)
    for i in range(7):
        packed <<= 9
        packed[: n - i] |= symbols[i:]
    size = 7
    while True:
        order = np.argsort(packed)  # equal ones are told apart by the next round
        seen = packed[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], seen[1:] != seen[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        if size < n:
            after[: n - size] = rank[size:] + 1
        packed = (rank << 32) | after
        size *= 2


def expand(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Where neighbours in suffix order share fewer than `least` symbols (true at place 0).

    Breadth-first backward extension on the Burrows-Wheeler transform: an interval is the suffixes that
    begin with one string; a letter before it gives the interval of the longer string. The first interval
    to end at a place, by increasing string length, tells the prefix that is common across that
    place. It stops at the least length of interest: places not met by then share that much.
    """
    n = len(order)
    bwt = symbols[order - 1]  # of suffix 0 the last symbol: a rotation
    used = np.unique(symbols)
    code = np.zeros(int(used[-1]) + 1, np.int64)
    code[used] = np.arange(len(used))
    letter = code[bwt]
    counts = np.bincount(letter, minlength=len(used))
    before = np.cumsum(counts) - counts
    place = np.argsort(letter, kind="stable")  # the places of each letter, in order
    step = np.empty(n, np.int64)
    step[place] = np.arange(n)
    if len(used) * (n + 1) <= COUNTS:
        seen = np.zeros((len(used), n + 1), np.int32)
        seen[letter, np.arange(1, n + 1)] = 1
        np.cumsum(seen, axis=1, out=seen)
        begin = lambda at: (before[:, None] + seen[:, at]).ravel()
    else:  # a search instead of a table, for bounded memory
        sorted_places = letter[place] * (n + 1) + place
        bases = np.arange(len(used)) * (n + 1)
        begin = lambda at: np.searchsorted(sorted_places, (bases[:, None] + at[None, :]).ravel())
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        one = high - low == 1
        single = step[low[one]]
        wide_low, wide_high = low[~one], high[~one]
        found_low, found_high = [single], [single + 1]
        for i in range(0, len(wide_low), 1 << 13):
            a, b = begin(wide_low[i : i + (1 << 13)]), begin(wide_high[i : i + (1 << 13)])
            some = b > a
            found_low.append(a[some])
            found_high.append(b[some])
        low, high = np.concatenate(found_low), np.concatenate(found_high)
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        high, first = np.unique(high, return_index=True)
        low = low[first]
        if not len(low):
            break
        known[high] = True
    return known[:n]


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part the starts, all before len - length + 1, whose `length` bytes start earlier too: in an earlier part or earlier in it."""
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(parts), np.int64)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    inside = np.repeat(begins, sizes) + (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    symbols[inside] = flat.astype(np.int64) + 1
    order = suffix_order(symbols)
    group = np.cumsum(expand(symbols, order, length)) - 1
    valid = np.zeros(len(symbols), bool)
    at = np.repeat(begins, sizes - length + 1)
    at = at + (np.arange(len(at)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1))
    valid[at] = True
    keep = valid[order]
    order, group = order[keep], group[keep]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, len(symbols))
    np.minimum.at(least, group, order)
    again = np.zeros(len(symbols), bool)
    again[order[order != least[group]]] = True
    return [np.flatnonzero(again[b : b + s - length + 1]) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]


def _string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8), offsets


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(sizes):
        stop, held = begin, 0
        while stop < len(sizes) and (stop == begin or held + sizes[stop] < most):
            held += sizes[stop]
            stop += 1
        yield begin, stop
        begin = stop


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (bytes), spans (array of from, to) for each document.

    Removes each byte covered by a string of `length` bytes that also starts earlier: in a smaller id, or earlier in
    the text. Strings are judged on the input and never cross documents.

    Every string belongs to the gram in it with the least hash, and a run of strings with one gram is a segment (some 40 strings). Of
    equal segments (known by gram and 88 bits of XXH3, 152 bits in all), met within a batch or by gram, only the first is looked at further; the
    others are removed whole. A gram with more than CROWD differing segments has them cut again by the next least gram
    of their strings, and so on: equal strings share all their grams. Segments of
    one gram that differ meet in a text of about TEXT bytes, whose transform is expanded to `length`.

    Null texts count as empty. Ids that are null (larger than all others), repeated or not integers are ranked first;
    equal ones are ordered as read. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    plain = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType))
    if plain:
        plain = rows.groupBy("id").count().where("id is null or count > 1").isEmpty()
    if plain:
        rows = rows.withColumn("key", F.col("id").cast("long"))
    else:
        rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
        place = ranked(scratch, rows.select("id", "row"), [F.col("id").asc_nulls_last(), F.col("row")], "key")
        rows = scratch.save(rows.join(place.select("row", F.col("key").cast("long").alias("key")), "row"))

    # a span is one number: whether it is a repeat, bits of the second half of the hash, the first start, the number of starts
    low = (length - GRAM + 1).bit_length()
    high = low + 31
    more, starts = (1 << (62 - high)) - 1, (1 << low) - 1
    names = ["gram", "hash", "key", "span"]
    schema = ", ".join(f"{x} long" for x in names)

    def known(body: np.ndarray, at: np.ndarray, sizes: np.ndarray, key: np.ndarray, lo: np.ndarray, n: np.ndarray, gram: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of segments at places of body; those equal to an earlier one of the batch are marked as such."""
        digest, view = xxhash.xxh3_128_digest, memoryview(body)
        both = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(at.tolist(), (at + sizes).tolist(), strict=True)]), np.int64).reshape(-1, 2)
        h, h2 = both[:, 0], both[:, 1] & more
        gram = gram.view(np.int64)
        order = np.lexsort((lo, key, h))
        h, h2, key, lo, n, gram = h[order], h2[order], key[order], lo[order], n[order], gram[order]
        dup = np.concatenate(([False], (h[1:] == h[:-1]) & (h2[1:] == h2[:-1]) & (gram[1:] == gram[:-1])))
        span = (dup.astype(np.int64) << 62) | (np.where(dup, 0, h2) << high) | (lo.astype(np.int64) << low) | n
        # repeats need not meet
        gram, h = np.where(dup, key & 0xFFFFF, gram), np.where(dup, 0, h)
        for i in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (gram, h, key, span)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = _string_parts(batch.column("text"))
            keys = np.asarray(batch.column("key"))
            for begin, stop in _groups(np.diff(offsets), 1 << 21):
                low, high = int(offsets[begin]), int(offsets[stop])
                data = body[low:high]
                step = 1 << 21
                found = []
                if stop - begin == 1 and high - low > 2 * step:  # a long text, piece by piece
                    for i in range(0, high - low - length + 1, step):
                        piece = data[i : i + step + length - 1]
                        t, lo, n, g = segments(piece, np.array([0, len(piece)]), length)
                        found.append((t, lo + i, n, g))
                else:
                    found.append(segments(data, offsets[begin : stop + 1] - low, length))
                t, lo, n, g = (np.concatenate([x[i] for x in found]) for i in range(4))
                if len(t):
                    yield from known(data, offsets[begin:stop][t] - low + lo, n + length - 1, keys[begin:stop][t], lo, n, g)

    def cut_again(level: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                body, offsets = _string_parts(batch.column("text"))
                out: list[tuple] = []
                for i, (key, want) in enumerate(zip(batch.column("key").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                    for x in want:
                        a = int(offsets[i]) + x["lo"]
                        lo, n, g = segments_again(body[a : a + x["n"] + length - 1], length, level)
                        mixed = (np.uint64(x["gram"] * 0x9E3779B97F4A7C15 & (2**64 - 1)) ^ g) * np.uint64(0xC2B2AE3D27D4EB4F)
                        out.append((lo + a, n + length - 1, np.full(len(lo), key), lo + x["lo"], n, mixed ^ (mixed >> np.uint64(31))))
                    if len(out) > 20_000 or (out and i == batch.num_rows - 1):
                        yield from known(body, *(np.concatenate(c) for c in zip(*out, strict=True)))
                        out = []

        return work

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted segments: repeats, and those whose gram has others that differ."""
        last = None  # gram and hashes of the row before
        alone = None  # the gram's only segment so far
        for batch in batches:
            c = {f: np.asarray(batch.column(f)) for f in names}
            again = c["span"] >> 62 == 1
            live = np.flatnonzero(~again)
            again = again.copy()
            cand = np.zeros(len(again), bool)
            extra = []
            if len(live):
                g, h, h2 = c["gram"][live], c["hash"][live], c["span"][live] >> high
                pg, ph, ph2 = (np.concatenate(([0 if last is None else last[i]], x[:-1])) for i, x in enumerate((g, h, h2)))
                same_gram = g == pg
                if last is None:
                    same_gram[0] = False
                same = same_gram & (h == ph) & (h2 == ph2)
                again[live[same]] = True
                firsts = np.flatnonzero(~same)
                if len(firsts):
                    follows = same_gram[firsts]  # an earlier segment of this gram differs
                    leads = np.concatenate((follows[1:], [False]))
                    cand[live[firsts[follows | leads]]] = True
                    if follows[0] and alone is not None:
                        extra.append(alone)
                    i = live[firsts[-1]]
                    alone = None if follows[-1] else tuple(int(c[f][i]) for f in ("gram", "key", "span"))
                last = int(g[-1]), int(h[-1]), int(h2[-1])
            pick = np.flatnonzero(again | cand)
            gram, key, span = (np.concatenate((c[f][pick], np.array([x[i] for x in extra], np.int64))) for i, f in enumerate(("gram", "key", "span")))
            flag = np.concatenate((again[pick], np.zeros(len(extra), bool)))
            lo, n = (span >> low) & 0x7FFFFFFF, span & starts
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(key), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(flag)], names=["gram", "key", "lo", "n", "dup"])

    def met_of(cutted: DataFrame) -> DataFrame:
        dealt = cutted.repartition("gram").sortWithinPartitions("gram", F.col("span") >= (1 << 62), "hash", "key", "span")
        return scratch.save(dealt.mapInArrow(meet, "gram long, key long, lo int, n int, dup boolean"))

    size = F.col("n") + (length - 1)

    def wanted(some: DataFrame) -> DataFrame:
        """The texts of segments, with a list of these."""
        return rows.select("key", "text").join(some.groupBy("key").agg(F.collect_list(F.struct("gram", "lo", "n")).alias("wanted")), "key")

    met = met_of(rows.select("key", "text").mapInArrow(cut, schema))
    scratch.free()
    repeats = [met.where("dup")]
    todo = [met.where("not dup")]
    level = 0
    while True:
        level += 1
        sizes = todo[-1].groupBy("gram").agg(F.count("*").alias("segments"))
        hot = sizes.where(F.col("segments") > CROWD).select("gram")
        if level > length - GRAM or hot.isEmpty():  # a string has no more grams than that
            break
        hot = scratch.save(hot)
        some = todo[-1].join(hot, "gram", "left_semi")
        todo[-1] = todo[-1].join(hot, "gram", "left_anti")
        met = met_of(wanted(some).mapInArrow(cut_again(level), schema))
        repeats.append(met.where("dup"))
        todo.append(met.where("not dup"))
    todo, repeats = reduce(DataFrame.unionByName, todo), reduce(DataFrame.unionByName, repeats)

    # the bytes of segments that must be compared
    total = todo.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, total // TEXT)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = _string_parts(batch.column("text"))
            keys = batch.column("key").to_pylist()
            out: list[tuple] = []
            for i, (key, want) in enumerate(zip(keys, batch.column("wanted").to_pylist(), strict=True)):
                for x in want:
                    a = int(offsets[i]) + x["lo"]
                    out.append((x["gram"], key, x["lo"], body[a : a + x["n"] + length - 1].tobytes()))
                if len(out) > 20_000 or (out and i == len(keys) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["gram", "key", "lo", "part"])
                    out = []

    found = compare(wanted(todo).mapInArrow(extract, "gram long, key long, lo int, part binary"), buckets, length)
    covers = repeats.select("key", F.col("lo").alias("a"), (F.col("lo") + size).alias("b")).unionByName(found)
    covers = scratch.save(covers.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("covers")))
    del found
    scratch.free()

    kind = docs.schema[id_col].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
        spans_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            body, offsets = _string_parts(batch.column("text"))
            covers = batch.column("covers")
            a, b = (np.asarray(covers.flatten().field(i)) for i in (0, 1)) if covers.null_count < len(covers) else (np.zeros(0, int), np.zeros(0, int))
            counts = np.asarray(covers.value_lengths().fill_null(0))
            at = np.cumsum(counts) - counts
            for begin, stop in _groups(np.diff(offsets), 4 << 20):
                out: list[list] = [[], [], [], [], []]
                for i in range(begin, stop):
                    data = body[offsets[i] : offsets[i + 1]]
                    if counts[i]:
                        edge = np.zeros(len(data) + 1, np.int32)
                        own = slice(at[i], at[i] + counts[i])
                        np.add.at(edge, a[own], 1)
                        np.add.at(edge, b[own], -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        first, last = runs(np.flatnonzero(gone))
                        spans = [{"from": x, "to": y + 1} for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                        kept = data[~gone].tobytes()
                    else:
                        spans, kept = [], data.tobytes()
                    for column, x in zip(out, (len(data), len(data) - len(kept), len(spans), kept, spans), strict=True):
                        column.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), spans_type)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, stop - begin), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    both = rows.join(covers, "key", "left").select("id", "text", "covers")
    out = both.mapInArrow(remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<from: long, to: long>>")
    return out.withColumnRenamed("id", id_col)


def compare(parts: DataFrame, buckets: int, length: int) -> DataFrame:
    """(key, a, b): the bytes of parts that strings which start earlier cover; grams are dealt out to texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, bucket, size = None, None, 0

        def done() -> pa.RecordBatch:
            held.sort()
            made = repeated([x[2] for x in held], length)
            keys, a, b = [], [], []
            for (key, lo, _), starts in zip(held, made, strict=True):
                if len(starts):
                    first, last = runs(starts)
                    keys += [key] * len(first)
                    a += (first + lo).tolist()
                    b += (last + lo + length).tolist()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["key", "a", "b"])

        for batch in batches:
            columns = [batch.column(f).to_pylist() for f in ("bucket", "gram", "key", "lo", "part")]
            for k, gram, key, lo, part in zip(*columns, strict=True):
                if held and gram != now and (k != bucket or size > TEXT):
                    yield done()
                    held.clear()
                    size = 0
                now, bucket = gram, k
                held.append((key, lo, part))
                size += len(part)
        if held:
            yield done()

    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(max(1, buckets))))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "gram").mapInArrow(work, "key long, a int, b int")


def digests(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return out.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """What remove_repeats gives for texts in order, string by string; for tests."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
