"""Alignment of two tokenizers' tokens, and counts of the pairs that overlap, from postings dealt by side id."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import Scratch, large_types_off, trimmed

#: Bytes of texts aligned at once (and one text more); documents of them at most, as 16 bits number them.
PIECE, DOCS = 2 << 20, 1 << 16
#: Stretches between spaces, and pairs of them, that a task remembers before it starts anew (no effect on results).
REMEMBERED, PAIRS = 250_000, 1 << 22
#: Bytes of postings of one side id that one task reads, about; further tasks take the rest.
LOAD = 4 << 20
#: Counts that a task sums before it passes them on, and documents whose sums it holds.
HELD = 1 << 21

CUT = regex.compile(r"(?<=\S) (?=\S)")
#: Added to an id where a mark other than a comma follows it.
BAR, GROUP, STRETCH = 1 << 16, 2 << 16, 3 << 16


class Sides:
    """Two vocabularies: A byte-level (a JSON file of the tokenizers library), B pieces (a sentencepiece model).

    Both start a token at a single space between two characters that are no white space: A's pattern does, and no piece of
    B has a space after another character (checked). So a text is cut there, and each distinct stretch is
    encoded and aligned once.
    """

    def __init__(self, a: bytes, b: bytes):
        self.a = tokenizers.Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letter = {c: i for i, c in enumerate(byte_letters())}
        spec = json.loads(a)
        entries = {i: t for t, i in spec["model"]["vocab"].items()}
        self.a_bytes = [bytes(letter[c] for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.b_bytes = []
        self.cut = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            self.cut &= "▁" not in piece.lstrip("▁")
            self.b_bytes.append(piece.replace("▁", " ").encode())
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("vocabularies of at most 65,536 entries")
        ids = range(1 << 16)
        self.marked = [f"{i}{mark}" for mark in ",|;\n" for i in ids]
        self.forget()

    def forget(self) -> None:
        """known: the number of each stretch; of each number its counts (tokens of A and B, groups, links), groups as text, pairs."""
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = np.zeros((1024, 4), np.int64)
        self.bad = np.zeros(1024, bool)
        self.begin = np.zeros(1025, np.int64)
        self.pairs = np.zeros(1 << 16, np.uint32)

    def learn(self, new: list[str]) -> None:
        """Aligns stretches, each with a space before it. One whose tokens don't give back its bytes is bad."""
        first, total = len(self.text), len(self.text) + len(new)
        side_a = [e.ids for e in self.a.encode_batch([" " + x for x in new], add_special_tokens=False)]
        side_b = self.b.encode(new, num_threads=1)
        bad = np.zeros(len(new), bool)
        want = "".join([" " + x for x in new]).encode()
        if self.joined(side_a, self.a_bytes) != want or self.joined(side_b, self.b_bytes) != want:
            for i, x in enumerate(new):
                one = (" " + x).encode()
                bad[i] = self.joined(side_a[i : i + 1], self.a_bytes) != one or self.joined(side_b[i : i + 1], self.b_bytes) != one
                if bad[i]:
                    side_a[i] = side_b[i] = []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(new)) for x in (side_a, side_b))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((side_a, n_a), (side_b, n_b)))
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # each stretch of bytes between neighbouring ends of either side is one link
        every = np.sort(np.concatenate((end_a, end_b)), kind="stable")
        same = np.concatenate((every[1:] == every[:-1], [False])) if len(every) else np.zeros(0, bool)
        common = every[same]
        every = every[~same]
        pairs = (a[np.searchsorted(end_a, every)] << 16 | b[np.searchsorted(end_b, every)]).astype(np.uint32)
        last = np.concatenate(([0], end_a))[np.cumsum(n_a)]  # where each stretch ends
        stops = np.searchsorted(every, last, "right")
        groups = np.diff(np.searchsorted(common, last, "right"), prepend=0)
        links = np.diff(stops, prepend=0)
        # the groups as text: A's ids of a group, then B's; each id with the mark after it
        in_a, in_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        marked_a = a + (np.diff(in_a, append=-1) != 0) * BAR
        marked_b = b + (np.diff(in_b, append=-1) != 0) * GROUP
        ended = np.cumsum(n_b)[n_b > 0] - 1
        marked_b[ended] = b[ended] + STRETCH
        made = np.zeros(len(a) + len(b), np.int64)
        made[np.arange(len(a)) + np.searchsorted(in_b, in_a, "left")] = marked_a
        made[np.arange(len(b)) + np.searchsorted(in_a, in_b, "right")] = marked_b
        said = iter("".join(map(self.marked.__getitem__, made.tolist())).split("\n"))
        self.text += [next(said) + ";" if n else "" for n in n_b.tolist()]
        while len(self.counts) < total:
            self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)))
            self.bad = np.concatenate((self.bad, np.zeros_like(self.bad)))
            self.begin = np.concatenate((self.begin, np.zeros(len(self.begin) - 1, np.int64)))
        self.counts[first:total] = np.stack((n_a, n_b, groups, links), 1)
        self.bad[first:total] = bad
        used = int(self.begin[first])
        while len(self.pairs) < used + len(pairs):
            self.pairs = np.concatenate((self.pairs, np.zeros_like(self.pairs)))
        self.pairs[used : used + len(pairs)] = pairs
        self.begin[first + 1 : total + 1] = used + stops
        self.known.update(zip(new, range(first, total), strict=True))

    @staticmethod
    def joined(ids: list[list[int]], table: list[bytes]) -> bytes:
        return b"".join(map(table.__getitem__, chain.from_iterable(ids)))

    def stretches(self, text: str) -> list[str]:
        if not text or not self.cut:
            return [text] if text else []
        parts = text.split(" ")
        # spaces beside other white space, or at an end, are no cuts
        return CUT.split(text) if "" in parts or list(map(str.strip, parts)) != parts else parts

    def align(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its groups' digest ('' without tokens) and counts; and of all links the document and the pair (A's id, B's id)."""
        if len(self.text) > REMEMBERED or self.begin[len(self.text)] > PAIRS:
            self.forget()
        parts = list(map(self.stretches, texts))
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        size = begin = 0
        for stop, w in enumerate(new, 1):
            size += len(w)
            if size > 1 << 18 or stop == len(new):
                self.learn(new[begin:stop])
                begin, size = stop, 0
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        every = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        digests, counts, keep = [], np.zeros((len(texts), 4), np.int64), np.ones(len(every), bool)
        for i, (x, y) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
            place = every[x:y]
            if x == y or self.bad[place].any():
                digests.append("")
                keep[x:y] = False
                continue
            digests.append(hashlib.sha256("".join(map(self.text.__getitem__, place.tolist()))[:-1].encode()).hexdigest())
            counts[i] = self.counts[place].sum(0)
        doc = np.repeat(np.arange(len(texts)), lengths)[keep]
        flat = every[keep]
        starts, n = self.begin[flat], self.begin[flat + 1] - self.begin[flat]
        total = int(n.sum())
        where = np.arange(total) + np.repeat(starts - (np.cumsum(n) - n), n)
        return digests, counts, np.repeat(doc, n), self.pairs[where]


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of integers as bytes, the low ones of all rows first, compressed."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns]
    raw = b"".join(planes)
    return len(columns[0]).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def loose(data: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(data[4:], n * sum(sizes), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return (keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values))


KINDS = ("u2", "u2", "u4")  # of a posting: A's id, document, multiplicity


def aligned(scratch: Scratch, docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of three kinds, written: documents (b null), postings of a B id in one piece of texts (body: A's ids, documents,
    multiplicities; piece: its number), and counts of a B id in one task (body: A's ids, counts; piece null)."""
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("doc", pa.int32()), ("b", pa.int32()), ("body", pa.binary())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sides, part, piece = Sides(*shared.value), TaskContext.get().partitionId(), -1
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def rows(schema: pa.Schema, n: int, **given: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

        def counted(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            pairs, n = grouped(np.concatenate([x for x, _ in sums]), np.concatenate([x for _, x in sums]))
            b = (pairs & 0xFFFF).astype(np.int64)
            order = np.argsort(b, kind="stable")
            b, a, n = b[order], (pairs[order] >> 16).astype("u2"), n[order].astype("u8")
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            for i in range(0, len(cut), 2000):
                some = [*cut[i : i + 2001].tolist(), len(b)][:2001]
                made = [squeezed(a[x:y], n[x:y]) for x, y in zip(some, some[1:], strict=False)]
                yield rows(schema, len(made), part=[part] * len(made), b=b[cut[i : i + 2000]], body=made)

        schema = None
        for batch in batches:
            schema = pa.schema([pa.field("id", batch.schema.field("id").type), *(pa.field(*f) for f in fields)])
            texts = batch.column("text")
            sizes = np.asarray(batch.column("size"))
            begin = 0
            while begin < len(texts):
                stop, size = begin, 0
                while stop < len(texts) and stop - begin < DOCS and (stop == begin or size + sizes[stop] < PIECE):
                    size += int(sizes[stop])
                    stop += 1
                some = [x or "" for x in texts.slice(begin, stop - begin).to_pylist()]
                piece += 1
                digests, counts, doc, pairs = sides.align(some)
                n = stop - begin
                yield rows(schema, n, id=batch.column("id").slice(begin, n), n_a=counts[:, 0], n_b=counts[:, 1], n_groups=counts[:, 2], n_links=counts[:, 3], groups_sha256=digests, part=[part] * n, piece=[piece] * n, doc=np.arange(n))
                # b, a, document in one number
                key = (pairs & 0xFFFF).astype(np.uint64) << 32 | (pairs >> 16).astype(np.uint64) << 16 | doc.astype(np.uint64)
                key.sort()
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                m, key = np.diff(at, append=len(key)), key[at]
                b, a, doc = (key >> 32).astype(np.int64), (key >> 16 & 0xFFFF).astype("u2"), (key & 0xFFFF).astype("u2")
                cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
                for i in range(0, len(cut), 2000):
                    ends = [*cut[i : i + 2001].tolist(), len(b)][:2001]
                    made = [squeezed(a[x:y], doc[x:y], m[x:y].astype("u4")) for x, y in zip(ends, ends[1:], strict=False)]
                    yield rows(schema, len(made), part=[part] * len(made), piece=[piece] * len(made), b=b[cut[i : i + 2000]], body=made)
                one = (key >> 16).astype(np.uint64)
                pair = ((one & 0xFFFF) << 16 | one >> 16).astype(np.uint32)
                sums.append(grouped(pair, m))
                held += len(sums[-1][0])
                if held > HELD:
                    sums = [grouped(np.concatenate([x for x, _ in sums]), np.concatenate([x for _, x in sums]))]
                    held = len(sums[0][0])
                    if held > HELD // 2:
                        yield from counted(schema)
                        sums, held = [], 0
                begin = stop
        if sums:
            yield from counted(schema)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("size"))
    return scratch.save(rows.mapInArrow(trimmed(work), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, part int, piece int, doc int, b int, body binary"))


def summed(counts: DataFrame) -> DataFrame:
    """(b, body): counts (b, part, body) added up, first by B id and a part of the tasks, then by B id. A stream sorted by
    key adds to one array of A's ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << 16, np.uint64)

        def out() -> pa.RecordBatch:
            a = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([squeezed(a.astype("u2"), total[a])], pa.binary())], names=["b", "body"])

        for batch in batches:
            for b, body in zip(batch.column("b").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if b != now:
                    if now is not None:
                        yield out()
                    now = b
                    total[:] = 0
                a, n = loose(body, "u2", "u8")
                total[a] += n  # ids of one body differ
        if now is not None:
            yield out()

    half = counts.withColumn("salt", F.pmod("part", F.lit(32))).repartition("b", "salt").sortWithinPartitions("b", "salt").select("b", "body").mapInArrow(work, "b int, body binary")
    return half.repartition("b").sortWithinPartitions("b").mapInArrow(work, "b int, body binary")


def contributions(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, piece, body): documents' numbers, links with the B id's highest count and sums of counts, from postings cogrouped with
    the counts of their B id.

    Both are dealt by B id, a frequent id's postings over as many tasks as their bytes ask for, each with the id's counts before
    them: a sorted stream, which Spark spills. Sums of a piece's documents are held until they are too many, then passed on.
    """
    load = postings.groupBy("b").agg(F.sum(F.octet_length("body").cast("long")).alias("bytes")).select(F.col("b").alias("of"), (1 + F.floor(F.col("bytes") / LOAD)).cast("int").alias("salts"))
    load = F.broadcast(load)  # a row for each id of a vocabulary of at most 65,536
    first = counts.join(load, F.col("b") == F.col("of")).select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("int").alias("part"), F.lit(-1).alias("piece"), "body")
    rest = postings.join(load, F.col("b") == F.col("of")).select("b", F.pmod(F.hash("part", "piece"), F.col("salts")).cast("int").alias("salt"), "part", "piece", "body")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best = np.zeros(1 << 16, np.uint64), 0
        held: dict[tuple[int, int], list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            made = [(*k, squeezed(*(x.astype(t) for x, t in zip(total(v), ("u2", "u8", "u8"), strict=True)))) for k, v in held.items()]
            for i in range(0, len(made), 500):
                some = list(zip(*made[i : i + 500], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), pa.array(some[1], pa.int32()), pa.array(some[2], pa.binary())], names=["part", "piece", "body"])

        for batch in batches:
            for part, piece, body in zip(*(batch.column(x).to_pylist() for x in ("part", "piece", "body")), strict=True):
                if piece < 0:
                    a, n = loose(body, "u2", "u8")
                    table[:] = 0
                    table[a] = n
                    best = n.max()
                    continue
                a, doc, m = loose(body, *KINDS)
                n = table[a]
                doc, first, more = grouped(doc, np.where(n == best, m, 0).astype(np.uint64), n * m)
                mine = held.setdefault((part, piece), [])
                mine.append((doc, first, more))
                size += len(doc)
                if len(mine) > 50:
                    size -= sum(len(x[0]) for x in mine)
                    mine[:] = [total(mine)]
                    size += len(mine[0][0])
                if size > HELD:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    both = first.unionByName(rest).repartition("b", "salt").sortWithinPartitions("b", "salt", "piece")
    return both.select("part", "piece", "body").mapInArrow(trimmed(work), "part int, piece int, body binary")


def total(some: list) -> tuple[np.ndarray, ...]:
    return grouped(*(np.concatenate([x[i] for x in some]) for i in range(3)))


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each document.

    a_path: a byte-level vocabulary of the tokenizers library; b_path: a sentencepiece model whose texts begin with a space. The
    text with a space before it is encoded by A, the text by B; special tokens' strings are plain text. Where tokens of both end,
    groups end (`a1,a2|b1;...`); tokens that share bytes are linked; a pair's count is its links in the whole corpus.
    n_best: links of pairs whose count is the highest of their B id; count_sum: the sum of counts over links.

    Null and empty texts, and texts that either side doesn't give back byte by byte, have no tokens: zeros and ''.
    Repeated rows and null ids are kept and counted as they are; other columns are not read. A vocabulary's ids are bounded, so what is broadcast is; the
    driver gets nothing. A task holds the links of 2 MB of texts, or of one longer text.
    """
    large_types_off(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "align")
    made = aligned(scratch, docs, a_path, b_path, id_col, text_col)
    counts = scratch.save(summed(made.where("b is not null and piece is null").select("b", "part", "body")), "uncompressed")
    shares = contributions(made.where("b is not null and piece is not null").select("b", "part", "piece", "body"), counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, more = None, np.zeros(DOCS, np.uint64), np.zeros(DOCS, np.uint64)

        def out() -> pa.RecordBatch:
            doc = np.flatnonzero(more)
            return pa.RecordBatch.from_arrays([pa.array([x] * len(doc), pa.int32()) for x in now] + [pa.array(x[doc].astype(np.int64)) for x in (np.arange(DOCS), best, more)], names=["part", "piece", "doc", "n_best", "count_sum"])

        for batch in batches:
            for part, piece, body in zip(*(batch.column(x).to_pylist() for x in ("part", "piece", "body")), strict=True):
                if (part, piece) != now:
                    if now:
                        yield out()
                    now = (part, piece)
                    best[:] = 0
                    more[:] = 0
                doc, x, y = loose(body, "u2", "u8", "u8")
                best[doc] += x
                more[doc] += y
        if now:
            yield out()

    by_doc = shares.repartition("part", "piece").sortWithinPartitions("part", "piece").mapInArrow(trimmed(work), "part int, piece int, doc long, n_best long, count_sum long")
    own = made.where("b is null")
    found = own.join(by_doc, ["part", "piece", "doc"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
