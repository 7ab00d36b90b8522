"""ELF64 objects as rows: sections, symbols and relocations of ``binaryFile`` content."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KINDS = {0: "NOTYPE", 1: "OBJECT", 2: "FUNC", 3: "SECTION", 4: "FILE"}
BINDS = {0: "LOCAL", 1: "GLOBAL", 2: "WEAK"}
ROWS = "path string, kind string, section string, name string, offset long, size long, type string, bind string, addend long"


def _name(table: bytes, at: int) -> str:
    return table[at : table.index(b"\0", at)].decode("utf-8", "replace") if at < len(table) else ""


def parse(data: bytes) -> list[tuple]:
    """(kind, section, name, offset, size, type, bind, addend) rows; anything but an ELF64 file, of either byte order, is an error."""
    if data[:5] != b"\x7fELF\x02" or data[5] not in (1, 2):
        raise ValueError("not an ELF64 file")
    order = "<" if data[5] == 1 else ">"
    table, = struct.unpack_from(f"{order}Q", data, 40)
    entry, count, names_at = struct.unpack_from(f"{order}3H", data, 58)
    heads = [struct.unpack_from(f"{order}2I4Q2I2Q", data, table + i * entry) for i in range(count)]
    body = [b"" if h[1] == 8 else data[h[4] : h[4] + h[5]] for h in heads]
    titles = [_name(body[names_at], h[0]) for h in heads]
    rows = [("section", None, t, h[4], h[5], str(h[1]), None, None) for t, h in zip(titles, heads, strict=True)]
    symbols: dict[int, list[str]] = {}
    for i, h in enumerate(heads):
        if h[1] in (2, 11):
            symbols[i] = []
            for at in range(0, len(body[i]) - 23, 24):
                name, info, _, shndx, value, size = struct.unpack_from(f"{order}IBBHQQ", body[i], at)
                text = _name(body[h[6]], name) or (titles[shndx] if info & 15 == 3 and shndx < count else "")
                symbols[i].append(text)
                where = None if shndx == 0 else titles[shndx] if shndx < count else "ABS"
                rows.append(("symbol", where, text, value, size, KINDS.get(info & 15, str(info & 15)), BINDS.get(info >> 4, str(info >> 4)), None))
    for i, h in enumerate(heads):
        if h[1] in (4, 9):
            step, form = (24, f"{order}QQq") if h[1] == 4 else (16, f"{order}QQ")
            for at in range(0, len(body[i]) - step + 1, step):
                offset, info, *addend = struct.unpack_from(form, body[i], at)
                held = symbols.get(h[6], [])
                name = held[info >> 32] if info >> 32 < len(held) else ""
                rows.append(("relocation", titles[h[7]] if h[7] < count else None, name, offset, None, str(info & 0xFFFFFFFF), None, addend[0] if addend else None))
    return rows


def facts(files: DataFrame) -> DataFrame:
    """Rows of every file of a ``binaryFile`` read (path, content); a broken file gives one row of kind ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out.extend((path, *row) for row in parse(bytes(content)))
                except (ValueError, struct.error, IndexError) as why:
                    out.append((path, "error", None, str(why), None, None, None, None, None))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])
            yield frame.astype({c: "Int64" for c in ("offset", "size", "addend")})

    return files.select("path", "content").mapInPandas(run, ROWS)
