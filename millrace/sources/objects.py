"""Object files: the function and line tables of 32-bit COFF objects.

Objects are read with ``binaryFile``, one row per file, and parsed in tasks; a file is the unit of
work and nothing but its rows leaves the task. Layouts follow the published COFF format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_HEADER = struct.Struct("<HHIIIHH")  # machine, sections, time, symbol table, symbols, optional header, flags
_SECTION = struct.Struct("<8sIIIIIIHHI")  # name, virtual size and address, raw size and place, relocations, lines, counts, flags
_SYMBOL = struct.Struct("<8sIhHBB")  # name, value, section, type, class, auxiliary records
FUNCTION, EXTERNAL, STATIC = 0x20, 2, 3
#: Bytes that compilers fill the end of a function with.
PADDING = b"\x90\xcc"


class Coff:
    def __init__(self, data: bytes) -> None:
        self.data = data
        _, n_sections, _, at, n_symbols, optional, _ = _HEADER.unpack_from(data)
        self.strings = at + n_symbols * _SYMBOL.size
        first = _HEADER.size + optional
        self.sections = [_SECTION.unpack_from(data, first + i * _SECTION.size) for i in range(n_sections)]
        self.symbols: list[tuple[int, str, int, int, int, int]] = []  # index, name, value, section, type, class
        self.opening: dict[int, int] = {}  # by a function's index: the line of its opening brace
        i = 0
        while i < n_symbols:
            raw, value, section, kind, storage, extra = _SYMBOL.unpack_from(data, at + i * _SYMBOL.size)
            self.symbols.append((i, self._name(raw), value, section, kind, storage))
            if kind == FUNCTION and extra:
                begins = struct.unpack_from("<I", data, at + (i + 1) * _SYMBOL.size)[0]  # its .bf symbol, whose auxiliary record has the line
                if 0 < begins < n_symbols - 1:
                    self.opening[i] = struct.unpack_from("<H", data, at + (begins + 1) * _SYMBOL.size + 4)[0]
            i += 1 + extra

    def _name(self, raw: bytes) -> str:
        if raw[:4] == b"\0\0\0\0":
            start = self.strings + struct.unpack("<I", raw[4:])[0]
            raw = self.data[start : self.data.index(b"\0", start)]
        return raw.rstrip(b"\0").decode("latin-1")

    def functions(self) -> list[tuple[str, str, int, int, bytes]]:
        """(name, section, start, size, code): a function ends where the section's next one starts, less padding; the first of a name counts."""
        out, seen = [], set()
        for number, section in enumerate(self.sections, 1):
            size, place = section[3], section[4]
            own = sorted((s[2], s[1]) for s in self.symbols if s[3] == number and s[4] == FUNCTION and s[5] in (EXTERNAL, STATIC))
            for k, (start, name) in enumerate(own):
                if name in seen:
                    continue
                seen.add(name)
                end = own[k + 1][0] if k + 1 < len(own) else size
                code = self.data[place + start : place + end].rstrip(PADDING)
                out.append((name, section[0].rstrip(b"\0").decode("latin-1"), start, len(code), code))
        return out

    def lines(self) -> list[tuple[str, int, int]]:
        """(function, offset, line): a function's records follow the one that names it and count from its opening brace, where that is known.

        Code before the first record then stands on the line after the brace.
        """
        of = {s[0]: s for s in self.symbols}
        out: list[tuple[str, int, int]] = []
        for section in self.sections:
            at, count, name, start, first = section[6], section[8], None, 0, 0
            for i in range(count):
                value, line = struct.unpack_from("<IH", self.data, at + 6 * i)
                if line == 0:
                    symbol = of.get(value)
                    name, start, first = (symbol[1], symbol[2], self.opening.get(value)) if symbol else (None, 0, None)
                    begun = first is None
                elif name is not None:
                    if not begun and value != start:
                        out.append((name, 0, first + 1))
                    begun = True
                    out.append((name, value - start, line + (first or 0)))
        return out


def coff_functions(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *f) for p, c in zip(frame["path"], frame["content"]) for f in Coff(bytes(c)).functions()]
            yield pd.DataFrame(rows, columns=["path", "name", "section", "start", "size", "code"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, section string, start long, size long, code binary")


def coff_lines(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *f) for p, c in zip(frame["path"], frame["content"]) for f in Coff(bytes(c)).lines()]
            yield pd.DataFrame(rows, columns=["path", "name", "offset", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, offset long, line int")
