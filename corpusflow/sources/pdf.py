"""PDF documents as pages of text, for files with text in simple or Unicode-mapped fonts; others need a library."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def inflated(body: bytes) -> bytes:
    found = STREAM.search(body)
    data = found.group(1) if found else b""
    if b"FlateDecode" in body[: found.start()] if found else False:
        try:
            return zlib.decompressobj().decompress(data)
        except zlib.error:
            return b""
    return data


def objects(data: bytes) -> dict[int, bytes]:
    """The numbered objects of a file, those in object streams too."""
    out = {int(m.group(1)): m.group(2) for m in OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            inner = inflated(body)
            first = re.search(rb"/First\s+(\d+)", body)
            if first:
                start = int(first.group(1))
                numbers = list(map(int, inner[:start].split()))
                places = list(zip(numbers[::2], numbers[1::2], strict=False))
                for i, (number, at) in enumerate(places):
                    stop = places[i + 1][1] if i + 1 < len(places) else len(inner) - start
                    out.setdefault(number, inner[start + at : start + stop])
    return out


def references(body: bytes, key: bytes) -> list[int]:
    found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body, re.S)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", found.group(1))] if found else []


def leaves(found: dict[int, bytes], number: int, seen: set[int]) -> Iterator[int]:
    """The pages below a node of the page tree, in order."""
    if number in seen or number not in found:
        return
    seen.add(number)
    if b"/Kids" in found[number]:
        for kid in references(found[number], b"Kids"):
            yield from leaves(found, kid, seen)
    else:
        yield number


def mapping(found: dict[int, bytes], page: bytes) -> dict[bytes, dict[int, str]]:
    """The Unicode maps of the page's fonts, by the fonts' names."""
    out = {}
    resources = b" ".join([page, *(found.get(r, b"") for r in references(page, b"Resources"))])
    fonts = re.search(rb"/Font\s*<<(.*?)>>", resources, re.S) or re.search(rb"<<(.*?)>>", b" ".join(found.get(r, b"") for r in references(resources, b"Font")), re.S)
    for name, number in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", fonts.group(1)) if fonts else ():
        unicode = references(found.get(int(number), b""), b"ToUnicode")
        if unicode:
            table: dict[int, str] = {}
            cmap = inflated(found.get(unicode[0], b""))
            for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
                for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                    table[int(a, 16)] = bytes.fromhex(b.decode()).decode("utf-16-be", "ignore")
            for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
                for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                    for i in range(int(z, 16) - int(a, 16) + 1):
                        table[int(a, 16) + i] = chr(int(b, 16) + i)
            out[name] = table
    return out


def string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m.group(1), 8) & 255]), token[1:-1])
    return re.sub(rb"\\(.)", lambda m: ESCAPES.get(m.group(1), m.group(1)), plain, flags=re.S)


def page_text(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """The strings that a page shows, with new lines where the position is set anew."""
    out, stack, table = [], [], None
    for m in TOKEN.finditer(content):
        token = m.group(0)
        if token[:1] in b"(<":
            raw = string(token)
            stack.append("".join(table.get(int.from_bytes(raw[i : i + 2]), "") for i in range(0, len(raw), 2)) if table else raw.decode("latin-1"))
        elif token == b"Tf" and len(stack) >= 2:
            table, stack = fonts.get(str(stack[-2]).encode().lstrip(b"/")), []
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            out.append(("\n" if token in (b"'", b'"') else "") + "".join(x if isinstance(x, str) and not x.startswith("/") else " " if isinstance(x, float) and x < -200 else "" for x in stack))
            stack = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
            stack = []
        elif token[:1] == b"/":
            stack.append(token.decode("latin-1"))
        elif token[:1] in b"-+.0123456789":
            stack.append(float(token))
        elif token not in (b"[", b"]"):
            stack = []
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def pages(data: bytes) -> list[str]:
    found = objects(data)
    roots = [n for n, body in found.items() if re.search(rb"/Type\s*/Pages\b", body) and b"/Parent" not in body]
    out = []
    for number in [n for root in roots for n in leaves(found, root, set())]:
        content = b"\n".join(inflated(found.get(r, b"")) for r in references(found[number], b"Contents"))
        out.append(page_text(content, mapping(found, found[number])))
    return out


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, page_number, text) of the PDF files below a folder, pages from 1, those without text left out; unreadable files give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = pages(bytes(content))
                except (ValueError, IndexError, RecursionError):
                    continue
                rows = [(path, i, t) for i, t in enumerate(found, 1) if t]
                yield pd.DataFrame(rows, columns=["path", "page_number", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", "content").mapInPandas(read, "path string, page_number int, text string")


def whole_text(rows: DataFrame) -> DataFrame:
    """(path, text): all pages of a document, an empty line between."""
    listed = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("l"))
    return listed.select("path", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("text"))
