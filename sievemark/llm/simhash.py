"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the product of two perfect binary Golay codes [23, 12] over
the lowest 46 fingerprint bits. Each factor covers its 23 bits with radius 3. A fingerprint is at home
at the one anchor within that radius, and is replicated to every anchor that lies within covering
radius plus threshold (per factor, the excess over 3 summing to the threshold at most: about 61
anchors of 2^24). Of two fingerprints that differ in at most 2 bits, either meets the other at the
other's home, so comparing per anchor finds every such pair.

Equal fingerprints become one before they are replicated, so the size of a group of copies doesn't
matter. At an anchor with few members all pairs are compared; at a larger one the members' radius-1
neighbourhoods are sorted, a range of them at a time, which finds the same links in time that is linear
in the members and in bounded memory beside them, and only one link per member leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.llm.common import checkpointed, own_name, slices, texts_of
from sievemark.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
#: Bytes of text whose shingle bits are held at a time.
HASHED_BYTES = 1_500_000
THRESHOLD = 2
_N, _RADIUS, _GENERATOR = 23, 3, 0b110001110101
#: Members of an anchor up to which all pairs are compared; links are the same either way.
PAIRWISE = 16
#: Neighbours of an anchor's members that are sorted at a time.
SORTED_KEYS = 4_000_000


def text_fingerprints(texts: list[bytes]) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each UTF-8 text; without words: 0."""
    out = np.zeros(len(texts), np.uint64)
    for i, j in slices(texts, HASHED_BYTES):
        hashes, sizes = [], np.zeros(j - i, np.int64)
        for k, text in enumerate(texts[i:j]):
            words = text.lower().split()  # bytes: A-Z and ASCII white space only
            if len(words) < SHINGLE_WORDS:
                grams = [b" ".join(words)] if words else []
            else:
                grams = map(b" ".join, zip(*(words[s:] for s in range(SHINGLE_WORDS)), strict=False))
            before = len(hashes)
            hashes.extend(map(xxhash.xxh64_intdigest, grams, repeat(SEED)))
            sizes[k] = len(hashes) - before
        if not hashes:
            continue
        full = np.flatnonzero(sizes)
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        majority = 2 * ones > sizes[full][:, None]
        out[i + full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = text_fingerprints(texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; for each syndrome, error patterns of weight <= radius + threshold and their excess over the radius (9: padding)."""

    def syndrome(v: int) -> int:
        for bit in range(_N - 1, 10, -1):
            if v >> bit & 1:
                v ^= _GENERATOR << (bit - 11)
        return v

    one = [syndrome(1 << b) for b in range(_N)]

    def of(bits: tuple[int, ...]) -> int:
        s = 0
        for b in bits:
            s ^= one[b]
        return s

    low = np.array([of(tuple(b for b in range(12) if v >> b & 1)) for v in range(1 << 12)], np.int64)
    high = np.array([of(tuple(b + 12 for b in range(11) if v >> b & 1)) for v in range(1 << 11)], np.int64)
    found: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for weight in range(_RADIUS + THRESHOLD + 1):
        for bits in combinations(range(_N), weight):
            found[of(bits)].append((max(0, weight - _RADIUS), sum(1 << b for b in bits)))
    most = max(map(len, found))
    patterns, excess = np.zeros((1 << 11, most), np.int64), np.full((1 << 11, most), 9, np.int8)
    for s, cell in enumerate(found):
        for k, (e, p) in enumerate(cell):
            patterns[s, k], excess[s, k] = p, e
    return low, high, patterns, excess


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of every replica of the signed fingerprints."""
    low, high, patterns, excess = _code()
    mask = (1 << _N) - 1
    parts = [fp & mask, (fp >> _N) & mask]
    cosets = [low[p & 4095] ^ high[p >> 12] for p in parts]
    total = excess[cosets[0]][:, :, None] + excess[cosets[1]][:, None, :]
    row, a, b = np.nonzero(total <= THRESHOLD)
    first = parts[0][row] ^ patterns[cosets[0][row], a]
    second = parts[1][row] ^ patterns[cosets[1][row], b]
    return row, first << _N | second, total[row, a, b] == 0


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            fp = b.column(0).slice(i, 2000).to_numpy(zero_copy_only=False)
            row, anchor, home = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"])


def _links_of_one(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of an anchor with many members: each with the least member that it reaches.

    Two members within two bits have a neighbour in common. Neighbours are sorted by ranges of their
    upper bits; a member is joined with the one before it of each neighbour.
    """
    n = len(fp)
    flips = [np.int64(0), *(np.uint64(1 << j).view(np.int64) for j in range(64))]
    ranges = 1 << max(0, (65 * n // SORTED_KEYS)).bit_length()
    shift = np.uint64(64 - ranges.bit_length() + 1) if ranges > 1 else None
    us, vs = [], []
    for r in range(ranges):
        keys, who = [], []
        for flip in flips:
            key = fp ^ flip
            at = np.arange(n) if shift is None else np.flatnonzero(key.view(np.uint64) >> shift == r)
            keys.append(key[at])
            who.append(at)
        key, at = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        us.append(at[same])
        vs.append(at[same + 1])
    u, v = np.concatenate(us), np.concatenate(vs)
    label = np.arange(n)
    while len(u):  # labels fall to the least over every link, then to the label of the label
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, fp)
    least = least[label]
    moved = least != fp
    return fp[moved], least[moved]


def anchor_links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the anchors, whose rows stand together."""
    starts = np.flatnonzero(np.r_[True, np.diff(anchor) != 0])
    sizes = np.diff(np.r_[starts, len(anchor)])
    useful = (sizes > 1) & np.logical_or.reduceat(home, starts)
    few = np.repeat(useful & (sizes <= PAIRWISE), sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)[few]
    f, h = fp[few], home[few]
    us, vs = [], []
    for k in range(1, PAIRWISE):
        if len(f) <= k:
            break
        hit = (group[k:] == group[:-k]) & (h[k:] | h[:-k]) & (np.bitwise_count((f[k:] ^ f[:-k]).view(np.uint64)) <= THRESHOLD)
        us.append(f[k:][hit])
        vs.append(f[:-k][hit])
    for g in np.flatnonzero(useful & (sizes > PAIRWISE)):
        u, v = _links_of_one(fp[starts[g] : starts[g] + sizes[g]])
        us.append(u)
        vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; an anchor that goes on in the next batch waits for it."""
    held: list[list[np.ndarray]] = []

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        u, v = anchor_links(*rows)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held and held[0][0][0] == rows[0][-1]:
            held.append(rows)
            continue
        rows = [np.concatenate(c) for c in zip(*held, rows, strict=True)] if held else rows
        last = np.searchsorted(rows[0], rows[0][-1])
        if last:
            yield links([c[:last] for c in rows])
        held = [[c[last:] for c in rows]]
    if held:
        yield links([np.concatenate(c) for c in zip(*held, strict=True)])


def classes(prints: DataFrame) -> DataFrame:
    """fp, group (the smallest fingerprint reachable) and first (the smallest doc_id of the fingerprint) of each distinct fingerprint of prints(doc_id, fp)."""
    unique = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    replicas = unique.select("fp").mapInArrow(_replicas, "anchor long, fp long, home boolean")
    links = replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "u long, v long")
    parts = connected_components(links).withColumnRenamed("node", "fp")
    return unique.join(parts, "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"), "first")


def _components(prints: DataFrame) -> DataFrame:
    found = checkpointed(classes(prints))
    smallest = found.groupBy("group").agg(F.min("first").alias("component_id"))
    named = found.join(smallest, "group").select("fp", "group", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "group")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over fingerprints within 2 bits) of each row.

    Null and wordless texts have fingerprint 0 and are linked like any other; repeated rows come out as
    often as they go in; an empty table gives no rows; further columns of any name are left out. Rows
    with a null id get their fingerprint and no component.
    """
    return _components(checkpointed(fingerprints(docs, id_col, text_col))).drop("group")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, keeping of each group of near duplicates the document with the smallest id.

    Rows that repeat an id are documents of their own: of those that are near duplicates of each other
    one stays (the smallest text, so that reruns agree), and rows with other texts stay beside it. Rows
    without an id stay. Only ids are joined with docs; texts of repeated ids alone are read again.
    """
    found = checkpointed(_components(checkpointed(fingerprints(docs, id_col, text_col))).where("doc_id is not null"))
    many = checkpointed(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    key = F.col(id_col).cast("long")
    other = own_name("other", docs.columns)
    meets = lambda ids, how: docs.join(ids.select(F.col("doc_id").alias(other)).distinct(), key == F.col(other), how).select(docs.columns)
    # A group's document is its smallest id; where that id comes in several groups, in each of them.
    gone = found.where("component_id < doc_id").select("doc_id")
    if many.isEmpty():
        return meets(gone, "left_anti")
    single = meets(gone.unionByName(many), "left_anti")
    again = meets(many, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _with_fingerprints(again.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), key.alias("doc_id"), row.alias("row")))
    named = found.select("fp", "group", "component_id").distinct()
    kept = rows.join(named, "fp").where("component_id = doc_id").groupBy("group").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return single.unionByName(kept.select("row.*").select(docs.columns))


def _with_fingerprints(rows: DataFrame) -> DataFrame:
    """rows, whose first column is a text, with fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = text_fingerprints(texts_of(b.column(0)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, "fp"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())]))
