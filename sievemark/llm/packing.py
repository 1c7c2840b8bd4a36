"""Best-fit packing of documents into sequences by exact-complement hashing.

Token counts of pieces are summarised in a histogram with one entry per length, so the plan is made
from at most `capacity` numbers whatever the size of the corpus. The planner takes the longest piece
left, looks up the gap in the indexes of single, pair and triple length sums, and consumes the
combination that fills the gap exactly, as many times as the counts allow. Where no combination is
exact, the best-fitting (longest) piece goes in and the smaller gap is looked up again. Every entry of
the plan exhausts a length, so the plan has a few thousand entries at most. Pieces then take their
places by rank within their length; ranks are counted in salted groups, so that a hot length is never
numbered by one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.common import checkpointed

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker remembers; then it starts anew.
REMEMBERED = 200_000
#: Pieces of one length and salt that one task may number.
RANKED_ROWS = 250_000
_SHIFT = 44


class Encoder:
    """Ids of a byte-level BPE tokenizer file, equal to those of its own library.

    Text splits before a single space that follows a non-space, where the tokenizer's pattern splits
    too; the parts repeat, so their ids are remembered. A text with longer runs of white space before a
    word is encoded whole. Before that, a text is split at the file's added tokens (a literal
    <|endoftext|>, say), which have ids of their own. Texts with added tokens that take white space or
    whole words only are left to the library.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        self._added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self._split = re.compile("|".join(map(re.escape, sorted(self._added, key=len, reverse=True))))
        self._library = None
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(path)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self._added}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not any(x in text for x in self._added):
            return self.plain(text)
        if self._library:
            return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, at = [], 0
        for m in self._split.finditer(text):
            out += [self.plain(text[at : m.start()]), self._added[m[0]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        first, *rest = text.split(" ")
        if first[-1:].isspace() or (not first and rest):
            return self.whole(text)
        out, known = [self.whole(first)], self._known
        for word in rest:
            ids = known.get(word)
            if ids is None:
                if not word or word[-1].isspace():
                    return self.whole(text)
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[word] = self.whole(" " + word)
            out.append(ids)
        return b"".join(out)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all are full but the first, which may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as binary, if wanted) of each document's pieces.

    A null text counts as empty and gives the one piece that holds the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows, held = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(part), *([part] * with_ids)))
                    held += len(part) * with_ids
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids)]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] * with_ids)]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class _Sums:
    """Indexes of the length sums that one, two and three pieces left can have."""

    def __init__(self, left: np.ndarray, most: int):
        self.left, self.most, self.fresh, self._pairs = left, most, 0, None

    def pairs(self) -> np.ndarray:
        """Whether two lengths that had pieces when it was last built have the sum; the pair itself is looked up anew."""
        if self._pairs is None or self.fresh >= 64:
            there = (self.left > 0).astype(np.int32)
            self._pairs, self.fresh = np.convolve(there, there)[: len(there)] > 0, 0
        return self._pairs

    def pair(self, gap: int, most: int) -> list[int] | None:
        """The pair with the longest first length of `most` at most."""
        top = min(gap - 1, most)
        a = np.arange(top, (gap + 1) // 2 - 1, -1)
        good = (self.left[a] > 0) & (self.left[gap - a] > (2 * a == gap))
        return [int(a[k]), int(gap - a[k])] if len(a) and good[k := int(np.argmax(good))] else None

    def exact(self, gap: int) -> list[int] | None:
        if self.left[gap] > 0:
            return [gap]
        if self.most > 1 and (found := self.pair(gap, gap)):
            return found
        if self.most < 3:
            return None
        a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for x in a[(self.left[a] > 0) & self.pairs()[gap - a]] if len(a) else ():
            self.left[x] -= 1
            found = self.pair(gap - int(x), int(x))
            self.left[x] += 1
            if found:
                return [int(x), *found]
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), together holding every piece once.

    Filling gaps with triples or pairs can use up short pieces that later gaps need, so plans with exact
    combinations of up to three, two and one pieces are made, and the one of fewest sequences is taken.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda bins: sum(times for _, times in bins))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[list[int], int]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, out = _Sums(left, most), []
    for longest in range(capacity, 0, -1):
        while left[longest] > 0:
            items, gap = [longest], capacity - longest
            left[longest] -= 1
            while gap:
                found = sums.exact(gap)
                if not found:
                    fits = np.flatnonzero(left[1 : gap + 1])
                    if not len(fits):
                        break
                    found = [int(fits[-1]) + 1]
                for x in found:
                    left[x] -= 1
                items += found
                gap -= sum(found)
            use = Counter(items)
            for x, n in use.items():
                left[x] += n
            times = min(int(left[x]) // n for x, n in use.items())
            for x, n in use.items():
                left[x] -= n * times
                sums.fresh += left[x] == 0
            out.append((items, times))
    return out


def places(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each slot of the plan: its key (length and first rank), first sequence and offset, sorted by key."""
    rows, ranked, sequence = [], Counter(), 0
    for items, times in bins:
        offset = 0
        for x in items:
            rows.append((x << _SHIFT | ranked[x], ranked[x], sequence, offset))
            ranked[x] += times
            offset += x
        sequence += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return dict(zip(("key", "low", "sequence", "offset"), cols, strict=True))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (as pieces() gives them) with sequence_id and offset.

    Repeated rows are pieces of their own; an empty table gives no rows. parts is checkpointed, so the
    text is tokenized once.
    """
    parts = checkpointed(parts)
    total = parts.count()
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(8, total // RANKED_ROWS + 1))).cast("int"))
    groups = checkpointed(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("_n")).collect()}  # capacity rows at most
    where = places(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    ranked = salted.join(groups, ["length", "_salt"]).select(*parts.columns, (F.col("_before") + within - 1).alias("_rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, length = b.column(b.num_columns - 1).to_numpy(), b.column(at).to_numpy()
            k = np.searchsorted(where["key"], length << _SHIFT | rank, "right") - 1
            own = [pa.array(where["sequence"][k] + rank - where["low"][k]), pa.array(where["offset"][k])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    at = parts.columns.index("length")
    schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(assign, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A null text counts as empty; repeated rows are packed each; an empty table gives no rows; other
    columns of docs are left out. Which of equal pieces takes which place is told by doc_id and piece.
    """
    return pack(pieces(docs, tokenizer or default_tokenizer(), capacity, id_col, text_col), capacity)
