"""BPE encoding and decoding through an index of pair occurrences."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Runs without white space whose tokens a task remembers before it starts anew (no effect on results).
REMEMBERED = 300_000
#: Letters of new words that are learned at once, and one word more.
LEARNED = 1 << 19


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    out |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return [out[b] for b in range(256)]


#: Below it the interpreter, the regex module and the vocabularies' library agree on every code point.
HIGH = regex.compile("[\u0558-\U0010FFFF]").search


#: White space is that of the pattern; four control characters are so to str.split alone.
SPACES = regex.compile(r"\S+").findall
NOT_SPACES = regex.compile("[\x1c-\x1f]").search


def unknown(text: str) -> bool:
    """Whether the text holds code points newer than the interpreter's Unicode tables."""
    return HIGH(text) is not None and any(unicodedata.category(c) == "Cn" for c in set(text))


class Tokenizer:
    """A word-end byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, data: bytes):
        self.data, self.library = data, None
        spec = json.loads(data)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.cuts = regex.compile("|".join(map(regex.escape, self.special))).findall if self.special else None
        letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in letters], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.base = len(self.tokens) + 1
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.base + right
        by = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[by], by.astype(np.int64)
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, list[str]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; -1 where there is no merge."""
        keys = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def runs(self, text: str) -> list[str]:
        """The normal form of a text (NFC, lower case letter by letter; a final sigma is no special
        case), cut at white space, which no word crosses. Texts with code points that the tables
        here don't know go to the library's own functions."""
        if unknown(text):
            if self.library is None:
                self.library = tokenizers.Tokenizer.from_str(self.data.decode())
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            out = [bytes(self.bytes[c] for c in x).decode() for x, _ in pieces]
            self.odd.update({x: [x] for x in out})
            return out
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return SPACES(text) if NOT_SPACES(text) else text.split()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The tokens of distinct words, all words at once.

        The symbols of all words lie in one array. The index holds for each rank the
        positions at which its pair occurs. Active ranks are taken in ascending order; each is
        applied to all its positions, and the pairs that arise beside them enter the index. As words don't
        interact, every word sees its merges in the order it would see them alone.
        """
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        n = len(sym)
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = n  # no neighbour
        prv[ends - sizes] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        odd: set[int] = set()

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            by = np.argsort(ranks, kind="stable")
            at, ranks = at[by], ranks[by]
            stops = np.flatnonzero(np.diff(ranks)) + 1
            for r, some in zip(ranks[np.concatenate(([0], stops))].tolist(), np.split(at, stops), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(some)

        first = np.flatnonzero(nxt < n)
        enter(first, self.rank(sym[first], sym[nxt[first]]))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.left[r], self.right[r], self.made[r]
            at = at[(sym[at] == a) & (nxt[at] < n)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # of overlapping pairs the leftmost goes first
                keep, busy = [], -1
                for p in at.tolist():
                    if p != busy:
                        keep.append(p)
                        busy = int(nxt[p])
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = new
            sym[gone] = -1
            nxt[at] = after
            inside = after < n
            prv[after[inside]] = at[inside]
            right = self.rank(sym[at[inside]], sym[after[inside]])
            before = prv[at]
            has = before >= 0
            left = self.rank(sym[before[has]], sym[at[has]])
            lower = np.concatenate((at[inside][(right >= 0) & (right < r)], at[has][(left >= 0) & (left < r)]))
            if len(lower):  # an earlier merge turned up: the order within these words matters
                odd.update(word[lower].tolist())
            enter(at[inside], right)
            enter(before[has], left)
        live = sym >= 0
        ids, counts = sym[live].astype("<u4"), np.bincount(word[live], minlength=len(raw))
        blob, stops = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
        out = {w: blob[i:j] for w, i, j in zip(words, [0, *stops], stops, strict=False)}
        out.update({words[i]: self.alone(raw[i]) for i in odd})
        return out

    def alone(self, raw: bytes) -> bytes:
        """The tokens of one word, a merge at a time: the least rank, the leftmost of it."""
        sym = [int(self.inner[b]) for b in raw[:-1]] + [int(self.last[raw[-1]])]
        while len(sym) > 1:
            s = np.array(sym, np.int64)
            ranks = self.rank(s[:-1], s[1:])
            if not (ranks >= 0).any():
                break
            at = int(np.argmin(np.where(ranks >= 0, ranks, np.iinfo(np.int64).max)))
            sym[at : at + 2] = [int(self.made[ranks[at]])]
        return np.array(sym, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. The words of all
        texts that are new are learned together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut, fresh = [], {}
        self.odd: dict[str, list[str]] = {}
        for text in texts:
            plain, between = [text], []
            if self.special and any(x in text for x in self.special):
                plain, between = self.cut(text), self.cuts(text)
            cut.append(([self.runs(x) for x in plain], between))
            for runs in cut[-1][0]:
                fresh.update(dict.fromkeys(runs))
        todo = {x: self.odd.get(x) or self.words(x) for x in fresh if x not in self.known}
        words = list({w: None for some in todo.values() for w in some})
        learned: dict[str, bytes] = {}
        begin = size = 0
        for stop, w in enumerate(words, 1):
            size += len(w)
            if size > LEARNED or stop == len(words):
                learned |= self.learn(words[begin:stop])
                begin, size = stop, 0
        for x, some in todo.items():
            self.known[x] = learned[some[0]] if len(some) == 1 else b"".join(map(learned.__getitem__, some))
        out = []
        for plain, between in cut:
            parts = [b"".join(map(self.known.__getitem__, plain[0]))]
            for special, runs in zip(between, plain[1:], strict=True):
                parts += [self.special[special].to_bytes(4, "little"), b"".join(map(self.known.__getitem__, runs))]
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens, with a space between: the vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """id_col, n_tokens, ids (little-endian unsigned 32-bit integers) and, if asked for, decoded.

    path: a vocabulary file of the tokenizers library (BPE with word ends). The driver reads
    it and broadcasts it; its size is that of a vocabulary, whatever the data.

    Null and empty texts have no tokens and decode to the empty text. Rows are independent:
    repeated rows and null ids are kept as they are, and no rows move. Other columns are not
    read. A task holds one Arrow batch, the runs of 3 MB of it, and 500 rows of the output.
    """
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary())] + [pa.field("decoded", pa.string())] * decode

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(shared.value)
        for batch in batches:
            texts = batch.column("text")
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)) if len(texts) else np.zeros(0, int)
            begin = 0
            while begin < len(texts):
                stop, held = begin, 0
                while stop < len(texts) and (stop == begin or held + sizes[stop] < 3 << 20):
                    held += sizes[stop]
                    stop += 1
                some = [x or "" for x in texts.slice(begin, stop - begin).to_pylist()]
                ids = tok.encode(some)
                for i in range(0, len(ids), 500):
                    part = ids[i : i + 500]
                    columns = [batch.column("id").slice(begin + i, len(part)), pa.array([len(x) // 4 for x in part], pa.int64()), pa.array(part, pa.binary())]
                    if decode:
                        columns.append(pa.array([tok.decode(x) for x in part], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field("id", batch.schema.field("id").type), *fields]))
                begin = stop

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(work), f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decode).withColumnRenamed("id", id_col)
