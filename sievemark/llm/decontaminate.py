"""Benchmark decontamination with suffix arrays of the training side.

The documents of a task are read in shards of whole texts. Each shard gets a suffix array over its
words (prefix doubling; words that no benchmark item has end a suffix, as nothing matches across them).
Every suffix of every item is binary-searched in it, word by word, as far as the item's 8-word window
that starts there, which gives all locations of that window. Windows of one item at consecutive words of
a document make its longer matches; the longest is given with its places in document and item. Shards
need nothing of one another, so documents are not shuffled, and what is found in a document doesn't
depend on the others in its shard. The benchmark goes to the workers as one block of bounded size; a
larger benchmark is searched block by block in passes of their own, since a worker keeps a broadcast as
long as its task may ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import checkpointed, texts_of

WINDOW = 8
SHARD_WORDS = 1_000_000
#: Bytes of benchmark text in a broadcast block.
BLOCK_BYTES = 8_000_000
#: A word is a run of digits, letters a-z and characters from U+0080 on.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Block:
    """Items of the benchmark as word ids (0 ends an item) with the suffixes and windows to look up."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str | None] = []
        ids, item, need, place = [], [], [], []
        for name, text in items:
            w = words(text)
            if not w:
                continue
            ids += [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w] + [0]
            item += [len(self.items)] * (len(w) + 1)
            own = min(window, len(w))
            need += [own if own <= len(w) - k and (k == 0 or own == window) else 0 for k in range(len(w) + 1)]
            place += range(len(w) + 1)
            self.items.append(None if name is None else str(name))
        self.deepest = max(need, default=0)
        self.ids = np.array(ids + [0] * (self.deepest + 1), np.int32)
        self.starts = np.flatnonzero(self.ids)
        self.item = np.array(item, np.int64)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        #: Words of the item before the suffix.
        self.place = np.array(place, np.int64)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        #: Words of the window that starts with the suffix; 0 where none does.
        self.need = np.array(need, np.int64)[self.starts] if len(self.starts) else np.zeros(0, np.int64)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the non-zero ids, sorted by the ids that follow, as far as the next 0 or about depth."""
    n = len(ids)
    padded = np.r_[ids, np.zeros(1, ids.dtype)]
    ends = np.flatnonzero(padded == 0)
    at = np.flatnonzero(ids)
    run = np.zeros(n, np.int64)
    run[at] = ends[np.searchsorted(ends, at)] - at
    rank = np.zeros(n + 1, np.int64)
    key = ids[at].astype(np.int64)
    order = np.argsort(key, kind="stable")
    sa, key = at[order], key[order]
    first = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(sa) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(sa)])
    rank[sa] = np.repeat(first, sizes) + 1
    todo, k = np.flatnonzero(np.repeat(sizes > 1, sizes)), 1
    while k < depth:
        todo = todo[run[sa[todo]] >= k]
        if not len(todo):
            break
        sub = sa[todo]
        key = rank[sub] << 32 | rank[np.minimum(sub + k, n)]
        order = np.argsort(key, kind="stable")
        sa[todo], key = sub[order], key[order]
        first = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        sizes = np.diff(np.r_[first, len(todo)])
        rank[sa[todo]] = np.repeat(todo[first], sizes) + 1
        todo = todo[np.repeat(sizes > 1, sizes)]
        k *= 2
    return sa


def _bound(column, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """First place in [low, high) whose value is at least (right: above) the wanted one; all rows at once."""
    low, high = low.copy(), high.copy()
    while len(go := np.flatnonzero(low < high)):
        middle = (low[go] + high[go]) >> 1
        seen = column(middle)
        left = seen <= value[go] if right else seen < value[go]
        low[go[left]] = middle[left] + 1
        high[go[~left]] = middle[~left]
    return low


def search(ids: np.ndarray, sa: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix of the block, the range in sa of the window that starts with it (empty if it doesn't occur)."""
    m = len(block.starts)
    padded = np.r_[ids, np.zeros(block.deepest + 1, ids.dtype)]
    low, high = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
    wlow, whigh = np.zeros(m, np.int64), np.zeros(m, np.int64)
    active = np.flatnonzero(block.need)
    for d in range(block.deepest):
        value = block.ids[block.starts[active] + d]
        column = lambda at, d=d: padded[sa[at] + d]
        lo = _bound(column, low[active], high[active], value, False)
        hi = _bound(column, lo, high[active], value, True)
        found = lo < hi
        active = active[found]
        low[active], high[active] = lo[found], hi[found]
        whole = block.need[active] == d + 1
        wlow[active[whole]], whigh[active[whole]] = low[active[whole]], high[active[whole]]
        active = active[~whole]
        if not len(active):
            break
    return wlow, whigh


class Shard:
    """Whole documents and, for each, what the blocks searched so far found in it."""

    def __init__(self) -> None:
        self.docs: list[object] = []
        self.sizes: list[int] = []
        self.words: list[bytes] = []

    def add(self, doc: object, text: bytes) -> None:
        w = words(text)
        self.docs.append(doc)
        self.sizes.append(len(w))
        self.words += w
        self.words.append(b"")

    def found(self, block: Block) -> list[tuple]:
        """(doc_id, n_words, items, spans, match) of each document; match: (words, place, item, place in it) of the longest or None."""
        sizes = np.array(self.sizes, np.int64)
        starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
        covered = np.zeros(len(self.words) + 1, bool)
        items: list[set[str]] = [set() for _ in self.docs]
        match: list[tuple | None] = [None] * len(self.docs)
        ids = np.fromiter(map(block.vocabulary.get, self.words, repeat(0)), np.int32, len(self.words))
        sa = suffix_array(ids, block.deepest)
        wlow, whigh = search(ids, sa, block)
        windows: dict[tuple[int, int, int], dict[int, int]] = {}  # its items, and where it first comes in each
        for k in np.flatnonzero(wlow < whigh).tolist():
            windows.setdefault((int(wlow[k]), int(whigh[k]), int(block.need[k])), {}).setdefault(int(block.item[k]), int(block.place[k]))
        ranges: dict[int, list[tuple[int, int, int]]] = {}
        for window, where in windows.items():
            a, b, need = window
            at = sa[a:b]
            for k in range(need):
                covered[at + k] = True
            names = {name for x in where if (name := block.items[x]) is not None}
            for doc in np.unique(np.searchsorted(starts, at, "right") - 1):
                items[doc].update(names)
            for x in where:
                ranges.setdefault(x, []).append(window)
        alike: dict[tuple, list[int]] = {}  # items with the same windows are followed once
        for x, own in ranges.items():
            alike.setdefault(tuple(own), []).append(x)
        for own, same in alike.items():
            x = min(same, key=lambda k: (block.items[k] is None, block.items[k] or ""))
            at = np.concatenate([sa[a:b] for a, b, _ in own])
            place = np.concatenate([np.full(b - a, windows[a, b, n][x]) for a, b, n in own])
            order = np.argsort(at, kind="stable")
            at, place = at[order], place[order]
            runs = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            size = np.diff(np.r_[runs, len(at)]) + own[0][2] - 1
            doc = np.searchsorted(starts, at[runs], "right") - 1
            order = np.lexsort((at[runs], -size, doc))
            first = order[np.r_[True, np.diff(doc[order]) != 0]]
            for d, n, p, q in zip(doc[first].tolist(), size[first].tolist(), at[runs][first].tolist(), place[runs][first].tolist(), strict=True):
                match[d] = longer(match[d], (n, p - int(starts[d]), block.items[x], q))
        edges = np.flatnonzero(np.diff(np.r_[False, covered].astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        owner = np.searchsorted(starts, begin, "right") - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in self.docs]
        for doc, a, b in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
            spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
        return [(d, n, sorted(i), s, m) for d, n, i, s, m in zip(self.docs, self.sizes, items, spans, match, strict=True)]


def longer(a: tuple | None, b: tuple | None) -> tuple | None:
    """Of two matches the longer, then the earlier, then that of the smaller item name."""
    key = lambda m: (-m[0], m[1], m[2] is None, m[2] or "", m[3])
    return min((m for m in (a, b) if m), key=key, default=None)


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> list:
    """The benchmark as broadcasts of bounded size; one of nothing if it is empty."""
    context = docs.sparkSession.sparkContext
    blocks, held, size = [], [], 0
    for name, text in benchmark.select(F.col(item_col), F.col(item_text_col).cast("string")).toLocalIterator():
        held.append((name, (text or "").encode()))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            blocks.append(context.broadcast(Block(held, window)))
            held, size = [], 0
    if held or not blocks:
        blocks.append(context.broadcast(Block(held, window)))
    return blocks


_MATCH = "struct<words:long,start:long,item:string,item_start:long>"
_FOUND = f"doc_id long, n_words long, items array<string>, spans array<struct<start:long,end:long>>, match {_MATCH}"
_COLUMNS = ["doc_id", "n_words", "n_hit", "items", "spans", "longest", "match"]


def _searched(docs: DataFrame, block, keyed: bool) -> DataFrame:
    """_FOUND of each row of docs (doc_id, text); with the text's digest if keyed."""
    names = ["doc_id", "n_words", "items", "spans", "match", *(["digest"] * keyed)]
    match = pa.struct([("words", pa.int64()), ("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), match, *([pa.binary()] * keyed)]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: Shard, digests: list[bytes]) -> pa.RecordBatch:
            cols = [*zip(*shard.found(block.value), strict=True), *([digests] * keyed)]
            cols[4] = [m and dict(zip(("words", "start", "item", "item_start"), m, strict=True)) for m in cols[4]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema=schema)

        shard, digests = Shard(), []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                shard.add(doc, text)
                if keyed:
                    digests.append(sha256(text).digest())
                if len(shard.words) >= SHARD_WORDS:
                    yield out(shard, digests)
                    shard, digests = Shard(), []
        if shard.docs:
            yield out(shard, digests)

    return docs.mapInArrow(run, _FOUND + ", digest binary" * keyed)


def _union(spans: Column) -> Column:
    """Spans in order, those that touch or overlap as one."""
    ordered = F.sort_array(spans)

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["start"]), grown).otherwise(F.array_append(done, x))

    return F.aggregate(ordered, F.array().cast("array<struct<start:long,end:long>>"), add)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, items (sorted as strings), spans of words hit, longest and match.

    A document word is hit inside any occurrence of `window` consecutive words of an item (a shorter
    item: all of its words). longest is the number of words of the longest stretch that consecutive
    windows of one item cover, 0 without a window; match has its start, the item and its start there.
    Null and wordless texts have no words; items without words, and an empty benchmark, match nothing;
    an item without an id hits words but has no name to list; repeated items count once, repeated
    documents come out each.
    """
    blocks = _blocks(docs, benchmark, item_col, item_text_col, window)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if len(blocks) == 1:
        found = _searched(rows, blocks[0], False)
    else:
        parts = [_searched(rows, b, True) for b in blocks]
        every = reduce(DataFrame.unionByName, parts)
        # Equal rows are found equally, as often in each pass as they come; small rows are all that is shuffled.
        m = F.col("match")
        order = F.struct(-m["words"], m["start"], m["item"].isNull(), m["item"], m["item_start"])
        g = every.groupBy("doc_id", "digest").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _union(F.flatten(F.collect_list("spans"))).alias("spans"), F.min_by("match", F.when(m.isNotNull(), order)).alias("match"), F.count("*").alias("n"))
        found = g.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("n") / len(blocks)).cast("int")))).drop("_copy", "n", "digest")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumns({"n_hit": hit, "longest": F.coalesce(F.col("match")["words"], F.lit(0).cast("long"))}).select(_COLUMNS)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs, with all their columns, without the rows that hold `window` or more words of an item verbatim.

    A match of an item of fewer words is no evidence against a document. Null and wordless texts stay,
    and so does everything if the benchmark is empty; repeated rows stay or go together.
    """
    at = docs.columns.index(text_col)

    def without(rows: DataFrame, block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shard, first = Shard(), 0
                for k, text in enumerate(texts_of(b.column(at))):
                    shard.add(k, text)
                    if len(shard.words) >= SHARD_WORDS or k + 1 == b.num_rows:
                        stays = pa.array([m is None or m[0] < window for *_, m in shard.found(block.value)])
                        yield b.slice(first, k + 1 - first).filter(stays)
                        shard, first = Shard(), k + 1

        return rows.mapInArrow(run, rows.schema)

    left = docs
    for k, block in enumerate(_blocks(docs, benchmark, item_col, item_text_col, window)):
        left = without(checkpointed(left) if k else left, block)
    return left
