"""Compound files (legacy .doc): their streams, the prose and the pictures in them."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from sievemark.sources.documents import PICTURES, parsed

_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA
#: Bytes of a stream below which it is no picture.
LEAST_PICTURE = 1024
#: Bytes of a stream in which a picture begins, behind a descriptor.
DESCRIPTOR = 256


class Compound:
    """The streams of a compound file by name; chains that leave the file or run in circles end there."""

    def __init__(self, data: bytes):
        if not data.startswith(_MAGIC) or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        self.sector, self.mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        if not 64 <= self.sector <= 1 << 16 or not 8 <= self.mini <= self.sector:
            raise ValueError("no compound file")
        directory, self.cutoff, mini_fat, _, difat = struct.unpack_from("<I4xIIII", data, 48)
        places = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while difat < _END and difat not in seen:
            seen.add(difat)
            more = self._numbers(self._sector(difat))
            places, difat = places + more[:-1], more[-1] if more else _END
        self.fat = [n for p in places if p < _END for n in self._numbers(self._sector(p))]
        self.mini_fat = self._numbers(self._chain(mini_fat, self.fat, self._sector))
        entries = self._chain(directory, self.fat, self._sector)
        self.names: dict[str, tuple[int, int]] = {}
        self.root = b""
        for at in range(0, len(entries) - 127, 128):
            size, kind = struct.unpack_from("<HB", entries, at + 64)
            start, length = struct.unpack_from("<II", entries, at + 116)
            name = entries[at : at + max(0, min(size, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                self.root = self._chain(start, self.fat, self._sector)[:length]
            elif kind == 2:
                self.names[name] = (start, length)

    def _sector(self, k: int) -> bytes:
        return self.data[(k + 1) * self.sector : (k + 2) * self.sector]

    @staticmethod
    def _numbers(part: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(part) // 4}I", part[: len(part) // 4 * 4]))

    @staticmethod
    def _chain(k: int, table: list[int], part) -> bytes:
        out, seen = [], set()
        while k < len(table) and k not in seen:
            seen.add(k)
            out.append(part(k))
            k = table[k]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        start, length = self.names[name]
        if length < self.cutoff:
            return self._chain(start, self.mini_fat, lambda k: self.root[k * self.mini : (k + 1) * self.mini])[:length]
        return self._chain(start, self.fat, self._sector)[:length]


def prose(blob: bytes) -> str:
    """The reading, of UTF-16 and of printable ASCII, in which more of the characters are letters; white space collapsed."""
    readings = (blob.decode("utf-16-le", "ignore"), bytes(b for b in blob if 32 <= b < 127 or b in (9, 10, 13)).decode("ascii"))
    share = lambda s: sum(map(str.isalpha, s)) / len(s) if s else 0.0
    return re.sub(r"\s+", " ", max(readings, key=share)).strip()


def doc_text(rows: DataFrame) -> DataFrame:
    """path and text of legacy Word files, as far as it can be told without their formatting."""

    def read(content: bytes) -> Iterator[tuple]:
        file = Compound(content)
        yield (prose(file.stream("WordDocument")) if "WordDocument" in file.names else "",)

    return parsed(rows, read, "text string")


def doc_pictures(rows: DataFrame) -> DataFrame:
    """path, name, kind and picture of the streams of legacy files that hold one, behind a descriptor at most."""

    def read(content: bytes) -> Iterator[tuple]:
        file = Compound(content)
        for name in file.names:
            blob = file.stream(name)
            if len(blob) < LEAST_PICTURE:
                continue
            found = [(blob.find(magic, 0, DESCRIPTOR), kind) for magic, kind in PICTURES]
            start, kind = min((x for x in found if x[0] >= 0), default=(-1, ""))
            if start >= 0:
                yield name, kind, blob[start:]

    return parsed(rows, read, "name string, kind string, picture binary")
