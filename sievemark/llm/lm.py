"""Scoring texts with a probabilistic suffix tree.

Symbols are the bytes of a text's words, a space after every word but the last, and an end mark.
Contexts of up to DEPTH symbols grow the inner tree: a context is a candidate if its probability in the
training texts is P_MIN at least, which bounds the inner tree at DEPTH / P_MIN contexts whatever the
corpus, and it is retained if its next-symbol distribution diverges from that of its longest proper
suffix by enough evidence. Retained distributions are smoothed towards their suffix's. For scoring, the
inner tree becomes an automaton whose state is the longest suffix of the history that the tree has; long
texts are cut into pieces that start DEPTH symbols early, so all pieces of a chunk move on one symbol at
a time together.

Below it hang the contexts of whole words, as long as their word: what follows them grows with the corpus
and stays distributed. Every word is a candidate, or every one too rare for the workers' list; it is
retained if the words that have followed it twice or more diverge from the words' own distribution by as
much evidence. Its distribution is that of the next word as a whole, smoothed towards what the inner tree
gives the word's symbols.

Beside it stands a unigram model of words. Its counts cover the whole training corpus and stay
distributed; only words whose probability is FREQUENT at least (so 1 / FREQUENT words at most) go to the
workers, with their totals as contexts. Chunks of texts ask the distributed counts, in buckets, for every
other word and every pair of words that they have.
"""

from __future__ import annotations

import gc
import math
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sievemark.llm.common import scratch, slices, texts_of

DEPTH = 5
P_MIN = 1e-5
#: Nats of evidence (occurrences times divergence) for which a context is retained.
EVIDENCE = 8.0
#: Weight of the suffix's distribution in a context's, in occurrences.
SMOOTHING = 6.0
FREQUENT = 1e-6
PIECE = 512
#: Bytes of text that are counted or scored together.
SCORED_BYTES = 2_500_000
#: Tokens whose words and pairs are looked up together.
BUCKET = 1_000_000
END = b"\n"
_PAD = END * DEPTH
_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: First bits of a rare word's key that the keys of its pairs begin with, so that a bucket has all of them.
SHARED = 16


def tokens(text: bytes) -> list[bytes]:
    """The tokens of one text but its end; split() has them of many."""
    return text.lower().split()


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The tokens of the texts one after the other; how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    words, sizes = lists.flatten().view(pa.large_binary()), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    empty = pc.binary_length(words).to_numpy() == 0  # before or behind white space
    if empty.any():
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        words = words.filter(pa.array(~empty))
    return words, sizes


def _raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words one after the other, and where each begins, and the end."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _joined(words: pa.Array, sizes: np.ndarray, by: bytes) -> pa.Array:
    """Runs of so many words, each run as one."""
    runs = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int64)), words)
    return pc.binary_join(runs, pa.scalar(by, pa.large_binary()))


def _listed(words: pa.Array) -> list[bytes]:
    """The words as a list; none is empty or holds white space."""
    return _joined(words, np.array([len(words)]), END)[0].as_py().split()


def _stream(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts, which begin in these places of data, each after DEPTH end marks; first symbol and end mark of each."""
    first = np.cumsum(np.r_[0, size + DEPTH])[:-1] + DEPTH
    symbols = np.full(int(size.sum()) + DEPTH * len(size) + 1, END[0], np.uint8)
    for at, k, n in zip(first.tolist(), start.tolist(), size.tolist(), strict=True):
        symbols[at : at + n] = data[k : k + n]
    return symbols, first, first + size


def _grams(words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context of DEPTH symbols, next symbol), packed, and their counts."""
    data, offsets = _raw(_joined(words, sizes, b" "))
    symbols, _, ends = _stream(data, offsets[:-1], np.diff(offsets))
    real = symbols[DEPTH:] != END[0]
    real[ends - DEPTH] = True
    packed = np.zeros(len(symbols) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        packed = packed << 8 | symbols[k : len(symbols) - DEPTH + k]
    return _distinct(packed[real])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often they come. np.unique hashes or sorts stably, which takes several times as long."""
    keys = np.sort(keys)
    new = _new(keys)
    return keys[new], np.diff(np.r_[new, len(keys)])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted; the sums of n; a place of each."""
    order = np.argsort(keys)
    keys = keys[order]
    new = _new(keys)
    return keys[new], np.add.reduceat(n[order], new) if len(new) else n[:0], order[new]


def _new(keys: np.ndarray) -> np.ndarray:
    """Places of sorted keys that differ from the one before."""
    return np.flatnonzero(np.r_[np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, null, count) and (null, gram, count)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    most = 1_000_000

    def merge() -> None:
        held[:] = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))[:2]]

    def rows(words, grams, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words, grams, pa.array(n, pa.int64())], names=["word", "gram", "n"])

    for b in batches:
        texts = texts_of(b.column(0))
        for i, j in slices(texts, SCORED_BYTES):
            words, sizes = split(texts[i:j])
            found = words.value_counts()
            yield rows(found.field(0).cast(pa.binary()), pa.nulls(len(found), pa.int64()), found.field(1).to_numpy())
            yield rows(pa.array([END], pa.binary()), pa.nulls(1, pa.int64()), [j - i])
            held.append(_grams(words, sizes))
            if sum(len(k) for k, _ in held) > most:
                merge()
                most = 2 * len(held[0][0]) + 1_000_000
    if held:
        merge()
        keys, n = held[0]
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield rows(pa.nulls(len(part), pa.binary()), pa.array(part), n[k : k + 50_000])


def counted(training: DataFrame, text_col: str = "text") -> DataFrame:
    """word, gram, n: counts over all rows, written to the shared folder. A null text counts as empty."""
    rows = training.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "word binary, gram long, n long")
    folder = f"{scratch(training.sparkSession, 'lm')}/counts"
    rows.groupBy("word", "gram").agg(F.sum("n").alias("n")).write.parquet(folder)
    return training.sparkSession.read.parquet(folder)


@dataclass
class Tree:
    #: For each state and symbol class: next state, log10 probability.
    step: np.ndarray
    logp: np.ndarray
    #: Class of each byte.
    symbol: np.ndarray
    start: int
    retained: int

    def symbols(self, symbols: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of every symbol of a stream of texts."""
        classes = self.symbol[symbols]
        n = ends - first + 1
        pieces = -(-n // PIECE)
        doc = np.repeat(np.arange(len(n)), pieces)
        at = first[doc] + PIECE * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(at + PIECE, ends[doc] + 1)
        order = np.argsort(at - stop, kind="stable")
        at, size = at[order], (stop - at)[order]
        # Tables in one dimension are taken from faster; a state is where its row begins.
        width = self.step.shape[1]
        step, logp, classes = (self.step * np.int32(width)).ravel(), self.logp.ravel(), classes.astype(np.int32)
        state = np.zeros(len(at), np.int32)
        for k in range(DEPTH):
            state = step.take(state + classes.take(at - DEPTH + k))
        out = np.zeros(len(symbols), np.float32)
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for t, k in enumerate(active):
            here = at[:k] + t
            s = state[:k] + classes.take(here)
            out[here] = logp.take(s)
            state[:k] = step.take(s)
        return out


def _contexts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """code (a leading 1, then the context's bytes), next symbol and count, of the candidate contexts; sorted."""
    grams = counts.where("gram is not null")
    n = grams.agg(F.sum("n")).first()[0] or 0
    code = lambda d: F.col("gram").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).bitwiseOR(F.lit(1 << 8 * (d + 1)))
    every = grams.select(F.explode(F.array(*[code(d) for d in range(DEPTH + 1)])).alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n"))
    every = every.select(F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND(F.lit(255)).alias("next"), "n")
    frequent = every.groupBy("context").agg(F.sum("n").alias("total")).where(F.col("total") >= max(1.0, P_MIN * n)).select("context")
    found = every.join(frequent, "context", "left_semi").toArrow()
    context, symbol, count = (found.column(c).to_numpy() for c in ("context", "next", "n"))
    order = np.lexsort((symbol, context))
    return context[order], symbol[order], count[order]


def _depth(code: np.ndarray) -> np.ndarray:
    return np.searchsorted(1 << 8 * np.arange(DEPTH + 2), code, "right") - 1


def _suffix(code: np.ndarray) -> np.ndarray:
    """The context without its oldest symbol."""
    top = np.int64(1) << 8 * (np.maximum(_depth(code), 1) - 1)
    return code & (top - 1) | top


def grow(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> Tree:
    """The automaton of the contexts that pass the divergence test."""
    seen = np.unique(np.r_[symbol, END[0], 32])
    classes = np.full(256, len(seen), np.int32)
    classes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    codes = np.unique(np.r_[context, 1])
    depth = _depth(codes)
    table = np.zeros((len(codes), width))
    np.add.at(table, (np.searchsorted(codes, context), classes[symbol]), count)
    total = table.sum(axis=1)
    parent = np.searchsorted(codes, _suffix(codes))
    p = np.zeros_like(table)
    p[0] = (table[0] + 0.5) / (total[0] + 0.5 * 256)
    p[0, -1] = 0.5 / (total[0] + 0.5 * 256)
    keep = np.zeros(len(codes), bool)
    keep[0] = True
    for d in range(1, DEPTH + 1):
        own = np.flatnonzero(depth == d)
        above = p[parent[own]]
        p[own] = (table[own] + SMOOTHING * above) / (total[own] + SMOOTHING)[:, None]
        raw = table[own] / np.maximum(1, total[own])[:, None]
        divergence = np.where(raw > 0, raw * np.log(np.maximum(raw, 1e-300) / np.maximum(above, 1e-300)), 0).sum(axis=1)
        keep[own] = total[own] * divergence >= EVIDENCE
    for d in range(DEPTH, 0, -1):
        keep[parent[(depth == d) & keep]] = True  # suffixes of what is retained
    in_tree = keep.copy()
    for d in range(DEPTH, 0, -1):  # and their prefixes, so that one state leads to the next
        for x in (codes >> 8, _suffix(codes)):
            in_tree[np.searchsorted(codes, x[(depth == d) & in_tree])] = True
    states = np.flatnonzero(in_tree)
    index = np.full(len(codes), -1, np.int32)
    index[states] = np.arange(len(states))
    step = np.zeros((len(states), width), np.int32)
    logp = np.zeros((len(states), width), np.float32)
    smoothed = np.zeros((len(states), width))
    for d in range(DEPTH + 1):
        own = states[depth[states] == d]
        if d:
            step[index[own]] = step[index[parent[own]]]
            mixed = (table[own] + SMOOTHING * smoothed[index[parent[own]]]) / (total[own] + SMOOTHING)[:, None]
            smoothed[index[own]] = np.where(keep[own][:, None], mixed, smoothed[index[parent[own]]])
        else:
            smoothed[0] = p[0]
        longer = states[depth[states] == d + 1]
        step[index[np.searchsorted(codes, codes[longer] >> 8)], classes[codes[longer] & 255]] = index[longer]
    logp[:] = np.log10(smoothed)
    return Tree(step, logp, classes, 0, int(keep.sum()))


@dataclass
class Known:
    """What workers have of the frequent words; each array's last place is that of the rare ones."""

    index: dict[bytes, int]
    #: The words, each with a space behind it.
    spaced: pa.Array
    #: log10(c + 0.5), NaN for rare words; total of the context if it is retained, else 0.
    values: np.ndarray
    totals: np.ndarray
    #: Keys of the words as contexts; as next words before a space, and before the end.
    own: np.ndarray
    following: tuple[np.ndarray, np.ndarray]


def _hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64)


def known(frequent: dict[bytes, float], totals: dict[bytes, int]) -> Known:
    padded = [*frequent, b""]
    return Known(
        dict(zip(frequent, range(len(frequent)), strict=True)),
        pa.array([w + b" " for w in frequent], pa.large_binary()),
        np.array([*frequent.values(), math.nan]),
        np.array([totals.get(w, 0) for w in frequent] + [0], np.int64),
        _hashes(padded),
        (_hashes(w + b" " for w in padded), _hashes(w + END for w in padded)),
    )


@dataclass
class Model:
    tree: Tree
    counts: DataFrame
    #: log10(c + 0.5) of the frequent words.
    frequent: dict[bytes, float]
    train_tokens: int
    vocabulary: int
    #: Totals of the retained contexts: of rare words by the word's key, of frequent words.
    contexts: DataFrame
    totals: dict[bytes, int]
    #: What follows contexts, in a bucket for each beginning of so many bits: keys and n of pairs of words, keys and totals of rare contexts.
    pairs: DataFrame
    bits: int


def coded(texts: list[bytes], known: Known) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of the texts one after the other, each as its place among the frequent ones and then the rare ones of these texts; how many each text has; the rare ones."""
    words, sizes = split(texts)
    found = words.dictionary_encode()
    distinct = _listed(found.dictionary)
    places = np.fromiter(map(known.index.get, distinct, repeat(-1)), np.int64, len(distinct))
    rare = np.flatnonzero(places < 0)
    places[rare] = len(known.index) + np.arange(len(rare))
    return places[found.indices.to_numpy()], sizes, [distinct[k] for k in rare.tolist()]


@dataclass
class Flat:
    """The words of some texts one after the other, and keys of those that follow another."""

    #: Place of each word, among the frequent ones or behind them; words of each text; distinct rare words.
    places: np.ndarray
    sizes: np.ndarray
    odd: list[bytes]
    #: Place of each word among the frequent ones, their number for rare ones; places of the rare ones and which each is.
    at: np.ndarray
    rare: np.ndarray
    which: np.ndarray
    #: Which words aren't the last of their text; keys of the words as contexts, and with the symbol that ends them as next words.
    inner: np.ndarray
    own: np.ndarray
    next: np.ndarray
    #: How many words are frequent.
    frequent: int

    def pairs(self, here: np.ndarray) -> np.ndarray:
        """Keys of the words in these places with those after them: of frequent ones even, made of their places; of others odd, hashes."""
        keys = np.empty(len(here), np.uint64)
        first, second = self.at[here], self.at[here + 1]
        both = (first < self.frequent) & (second < self.frequent)
        other, both = here[~both], np.flatnonzero(both)
        hashed = self.own[other] * _MIX + self.next[other + 1]
        rare = np.flatnonzero(self.at[other] == self.frequent)
        own = self.own[other[rare]]
        hashed[rare] = own >> np.uint64(64 - SHARED) << np.uint64(64 - SHARED) | hashed[rare] >> np.uint64(SHARED)
        mask = np.ones(len(here), bool)
        mask[both] = False
        keys[mask] = hashed | np.uint64(1)
        places = (first[both] * self.frequent + second[both]) * 2 + self.inner[here[both] + 1]
        keys[both] = (places.astype(np.uint64) << _shift(self.frequent)) * _MIX
        return keys


def _shift(frequent: int) -> np.uint64:
    return np.uint64(64 - (2 * frequent**2).bit_length())


def _both(keys: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the frequent words that even keys are made of."""
    return np.divmod((keys * _UNMIX >> _shift(frequent)).astype(np.int64) >> 1, max(1, frequent))


def flat(places: np.ndarray, sizes: np.ndarray, odd: list[bytes], known: Known) -> Flat:
    frequent = len(known.index)
    at = np.minimum(places, frequent)
    rare = np.flatnonzero(places >= frequent)
    inner = np.ones(len(places), bool)
    inner[np.cumsum(sizes)[sizes > 0] - 1] = False
    last = np.flatnonzero(~inner)
    own, following = (np.r_[x[:-1], y][places] for x, y in ((known.own, _hashes(odd)), (known.following[0], _hashes(w + b" " for w in odd))))
    following[last] = known.following[1][at[last]]
    last = last[at[last] == frequent]
    following[last] = _hashes(odd[k] + END for k in (places[last] - frequent).tolist())
    return Flat(places, sizes, odd, at, rare, places[rare] - frequent, inner, own, following, frequent)


def _released(spark: SparkSession) -> None:
    """Lets go of the files of shuffles that nothing will read.

    They go when the driver's JVM collects what refers to them, which after a query lasts until its
    listeners have run; so it is asked to twice.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def _packed(x: np.ndarray) -> bytes:
    """Numbers of no sign in as many bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _planes(*parts: np.ndarray) -> bytes:
    """Sorted keys, or sorted even and odd ones: their first bytes first, which are much alike, as are the last of the even ones."""
    even, odd = parts if len(parts) == 2 else [parts[0][(parts[0] & np.uint64(1)) == k] for k in (0, 1)]
    parts = [x.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (even, odd)]
    return len(parts[0]).to_bytes(8) + b"".join(parts)


def _parted(planes: bytes) -> np.ndarray:
    """The even keys and then the odd ones."""
    size = int.from_bytes(planes[:8])
    parts = [np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(">u8").ravel() for x in (planes[8 : 8 + size], planes[8 + size :])]
    return np.concatenate(parts).astype(np.uint64)


def _keys(planes: bytes) -> np.ndarray:
    return np.sort(_parted(planes))


def _cuts(keys: np.ndarray, bits: int) -> list[int]:
    """Where each bucket, which has the keys of equal first bits, begins among sorted keys, and the end."""
    return [*np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(keys)]


def _bits(n: int) -> int:
    """Bits for buckets that n tokens fill by about BUCKET each."""
    return min(SHARED, max(1, math.ceil(math.log2(max(1, n) / BUCKET))))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


_FOLLOWED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("context", pa.binary()), ("rare", pa.binary()), ("m", pa.binary()), ("own", pa.binary()), ("next", pa.binary())])
_SUMS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("total", pa.binary()), ("k", pa.binary()), ("e", pa.binary()), ("context", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])


def followed(training: DataFrame, frequent: dict[bytes, float], n: int, bits: int, text_col: str = "text", every_word: bool = False) -> tuple[DataFrame, dict[bytes, int], DataFrame]:
    """Totals of the retained contexts, of rare words by key and of frequent words; keys and n of what follows, in buckets.

    Pairs are dealt by their key, which is a rare word's own in its first bits, so that a bucket has all that
    follows a rare word. What follows a frequent word is in all buckets, and what each adds to the evidence is
    summed over them.
    """
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(known(frequent, {}))
    rarest, size = math.log(FREQUENT), len(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in slices(texts, SCORED_BYTES):
                f = flat(*coded(texts[i:j], have), have)
                here = f.rare[f.inner[f.rare]]
                rare, m, at = _summed(f.pairs(here), np.ones(len(here), np.int64))
                own, after = f.own[here[at]], f.at[here[at] + 1].astype(np.int32)
                here = np.flatnonzero(f.inner & (f.at < size)) if every_word else here[:0]
                mixed = f.at[here + 1] == size
                even, odd = here[~mixed], here[mixed]
                even, count = _distinct(f.pairs(even))
                keys, more, at = _summed(f.pairs(odd), np.ones(len(odd), np.int64))
                context = f.at[odd[at]].astype(np.int32)
                cuts = zip(*(pairwise(_cuts(x, bits)) for x in (even, keys, rare)), strict=True)
                yield _batch([(x, _planes(even[a:b], keys[c:d]), _packed(np.r_[count[a:b], more[c:d]]), context[c:d].tobytes(), _planes(even[:0], rare[s:e]), _packed(m[s:e]), own[s:e].tobytes(), after[s:e].tobytes()) for x, ((a, b), (c, d), (s, e)) in enumerate(cuts) if b > a or d > c or e > s], _FOLLOWED)

    def merge(table: pa.Table) -> pa.Table:
        # log10(c + 0.5) to nats of c / n, which a rare word's are below.
        prior = np.fmax(math.log(10) * shared.value.values - math.log(n), rarest)
        columns = {c: table.column(c).to_pylist() for c in table.column_names}

        def parts(keys: str, count: str) -> tuple[np.ndarray, np.ndarray]:
            each = [_parted(x) for x in columns[keys]]
            return np.concatenate(each), np.concatenate([_unpacked(x, len(k)) for x, k in zip(columns[count], each, strict=True)])

        keys, count = parts("keys", "n")
        even = (keys & np.uint64(1)) == 0
        pairs = [_summed(keys[even], count[even])[:2]]
        context, after = _both(pairs[0][0], size)
        more, count, at = _summed(keys[~even], count[~even])
        pairs.append((more, count))
        context = np.r_[context, np.frombuffer(b"".join(columns["context"]), np.int32)[at]]
        after = np.r_[after, np.full(len(more), size)]
        count = np.concatenate([x for _, x in pairs])
        twice = np.where(count > 1, count, 0)
        sums = [np.bincount(context, x, size) for x in (count, twice, twice * (np.log(count) - prior[after]))] if every_word else [np.zeros(0)] * 3
        # Sum of n log(n / total / prior) over what follows twice or more.
        rare, m, at = _summed(*parts("rare", "m"))
        own, after = np.frombuffer(b"".join(columns["own"]), np.uint64)[at], np.frombuffer(b"".join(columns["next"]), np.int32)[at]
        words, which = np.unique(own, return_inverse=True)
        twice = np.where(m > 1, m, 0)
        total, k, e = (np.bincount(which, x, len(words)) for x in (m, twice, twice * (np.log(m) - prior[after])))
        keep = e - k * np.log(total) >= EVIDENCE
        pairs.append((rare[keep[which]], m[keep[which]]))
        keys, count, _ = _summed(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        total, (seen, k, e) = total[keep].astype(np.int64), sums
        return pa.Table.from_batches([_batch([(columns["bucket"][0], _planes(keys), _packed(count), _packed(seen.astype(np.int64)), _packed(k.astype(np.int64)), e[k > 0].tobytes(), words[keep].view(np.int64), total)], _SUMS)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, k, e = (np.zeros(size, t) for t in (np.int64, np.int64, float))
        for b in batches:
            for more, twice, evidence in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total += _unpacked(more, size)
                twice = _unpacked(twice, size)
                k += twice
                e[twice > 0] += np.frombuffer(evidence)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total), pa.array(k), pa.array(e)], names=["context", "total", "k", "e"])

    folder = f"{scratch(spark, 'lm')}/pairs"
    schema = "bucket int, keys binary, n binary, total binary, k binary, e binary, context array<long>, totals array<long>"
    rows = training.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, keys binary, n binary, context binary, rare binary, m binary, own binary, next binary")
    rows.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(merge, schema).write.parquet(folder)
    written = spark.read.schema(schema).parquet(folder)
    contexts = written.select(F.inline(F.arrays_zip("context", "totals")))
    totals = {}
    if every_word:
        found = written.select("total", "k", "e").mapInArrow(summed, "context int, total long, k long, e double").groupBy("context").agg(*(F.sum(c).alias(c) for c in ("total", "k", "e")))
        kept = found.where(F.col("e") - F.col("k") * F.log("total") >= EVIDENCE).select("context", "total").toArrow()
        words = list(frequent)
        totals = {words[i]: t for i, t in zip(kept.column(0).to_pylist(), kept.column(1).to_pylist(), strict=True)}
    return contexts, totals, written.select("bucket", "keys", "n", "context", "totals")


def fit(training: DataFrame, text_col: str = "text", every_word: bool = False) -> Model:
    """The model of all training rows; a null text counts as empty, repeated rows count as often as they come.

    With every_word, contexts of whole words are those of every word, otherwise those of the rare ones alone.
    """
    counts = counted(training, text_col)
    words = counts.where("word is not null").select("word", "n")
    n, v = words.agg(F.sum("n"), F.count("*")).first()
    n = n or 0
    # The most frequent first, so that places of most words are small numbers.
    common = words.where(F.col("n") >= max(1.0, FREQUENT * n)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    frequent = dict(zip(common.column("word").to_pylist(), np.log10(common.column("n").to_numpy() + 0.5).tolist(), strict=True))
    tree = grow(*_contexts(counts))
    if every_word:
        _released(training.sparkSession)
    bits = _bits(n)
    contexts, totals, pairs = followed(training, frequent, max(1, n), bits, text_col, every_word)
    if every_word:
        _released(training.sparkSession)
    return Model(tree, words, frequent, n, v, contexts, totals, pairs, bits)


_CHUNKS = "chunk long, ids array<long>, sizes array<long>, places binary, odd binary, size long"
_ASKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("m", pa.int64()), ("keys", pa.binary())])
_DEALT = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("m", pa.int64()), ("seen", pa.binary()), ("keys", pa.binary()), ("n", pa.binary()), ("context", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])
_TOLD = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("m", pa.int64()), ("seen", pa.binary()), ("total", pa.binary()), ("k", pa.int64()), ("n", pa.binary())])
_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


@dataclass
class Question:
    """What a chunk has to ask the distributed counts: distinct rare words and pairs of words, each in the order of their keys."""

    words: list[bytes]
    own: np.ndarray
    #: Which of them each rare word of the chunk is.
    word: np.ndarray
    #: Places of the contexts; keys of their pairs.
    here: np.ndarray
    pairs: np.ndarray


def question(f: Flat, known: Known) -> Question:
    own = np.zeros(len(f.odd), np.uint64)
    own[f.which] = f.own[f.rare]
    order = np.argsort(own)
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    here = np.flatnonzero(f.inner & ((f.at == f.frequent) | (known.totals[f.at] > 0)))
    return Question([f.odd[k] for k in order.tolist()], own[order], rank[f.which], here, f.pairs(here))


def _words(data: list[bytes], sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))])


def _lengths(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


def _dealt(model: Model, bits: int) -> DataFrame:
    """The model's distributed counts in buckets: words with their counts, pairs of words, contexts of rare words."""
    nothing = np.zeros(0, np.uint64)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in joined(batches):
            words, seen = b.column(0).to_pylist(), b.column(1).to_numpy()
            own = _hashes(words)
            order = np.argsort(own)
            words, own, seen = [words[k] for k in order.tolist()], own[order], seen[order]
            cuts = [(x, i, words[i:j], seen[i:j]) for x, (i, j) in enumerate(pairwise(_cuts(own, bits))) if i < j]
            yield _batch([(x, b"".join(p), _packed(_lengths(p)), len(p), _packed(n), _planes(nothing), b"", [], []) for x, _, p, n in cuts], _DEALT)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What follows contexts in finer buckets."""
        for b in batches:
            for planes, n, context, totals in zip(*b.columns, strict=True):
                keys, own = _keys(planes.as_py()), np.array(context.as_py(), np.int64).view(np.uint64)
                n, totals = _unpacked(n.as_py(), len(keys)), totals.as_py()
                cuts = zip(pairwise(_cuts(keys, bits)), pairwise(_cuts(own, bits)), strict=True)
                yield _batch([(x, b"", b"", 0, b"", _planes(keys[i:j]), _packed(n[i:j]), own[s:e].view(np.int64), totals[s:e]) for x, ((i, j), (s, e)) in enumerate(cuts) if i < j or s < e], _DEALT)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Batches by about 100,000 rows together, so that a bucket's part of them isn't small."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 100_000:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    schema = "bucket int, words binary, sizes binary, m long, seen binary, keys binary, n binary, context array<long>, totals array<long>"
    none = F.lit(b"")
    if bits == model.bits:
        pairs = model.pairs.select("bucket", none.alias("words"), none.alias("sizes"), F.lit(0).cast("long").alias("m"), none.alias("seen"), "keys", "n", "context", "totals")
    else:
        pairs = model.pairs.select("keys", "n", "context", "totals").mapInArrow(again, schema)
    return model.counts.where(F.col("word") != F.lit(END)).mapInArrow(of_words, schema).unionByName(pairs)


def _told(asked: pa.Table, dealt: pa.Table) -> pa.Table:
    """Counts of a bucket for every chunk that asks for some: 0 for what training texts don't have."""

    def columns(table: pa.Table, *names: str) -> list[list]:
        return [table.column(c).to_pylist() for c in names]

    def words(table: pa.Table) -> pa.Array:
        data, sizes, m = columns(table, "words", "sizes", "m")
        return _words(data, np.concatenate([np.zeros(0, np.int64), *map(_unpacked, sizes, m)]))

    m, seen, n = columns(dealt, "m", "seen", "n")
    seen = np.concatenate([[0], *map(_unpacked, seen, m)]).astype(np.int64)
    counted = words(dealt)
    context, totals = (pc.list_flatten(dealt.column(c)).to_numpy() for c in ("context", "totals"))
    # Total of each word as a context: 0 where it isn't retained.
    total = np.zeros(len(seen), np.int64)
    if len(context):
        order = np.argsort(context)
        own = _hashes(_listed(counted)).view(np.int64)
        place = order[np.minimum(np.searchsorted(context, own, sorter=order), len(order) - 1)]
        total[1:] = np.where(context[place] == own, totals[place], 0)
    at = pc.fill_null(pc.index_in(words(asked), counted), -1).to_numpy() + 1
    seen, total = seen[at], total[at]
    parts = [_keys(x) for x in dealt.column("keys").to_pylist()]
    keys, count = np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([np.zeros(0, np.int64), *map(_unpacked, n, map(len, parts))])
    order = np.argsort(keys)
    keys, count = keys[order], np.r_[count[order], 0]
    keys = np.r_[keys, keys[-1:]] if len(keys) else np.zeros(1, np.uint64)
    chunk, bucket, m = columns(asked, "chunk", "bucket", "m")
    cuts = pairwise(np.cumsum([0, *m]).tolist())
    told = []
    for x, (i, j) in enumerate(cuts):
        want = _keys(asked.column("keys")[x].as_py())
        place = np.searchsorted(keys[:-1], want)
        n = np.where(keys[place] == want, count[place], 0)
        told.append((chunk[x], bucket[x], m[x], _packed(seen[i:j]), _packed(total[i:j]), len(want), _packed(n)))
    return pa.Table.from_batches([_batch(told, _TOLD)])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row, over its whole text.

    A null text is empty: its one token is the end. Repeated rows are scored each; a model of no
    training texts gives every symbol the same probability; other columns of docs are left out.

    Texts are written in chunks to the shared folder. Each asks once for every rare word and every pair of
    words that it has; buckets of the counts answer, and the chunks are scored with their answers. Words are
    matched as they are, so are pairs of frequent words; rare words as contexts are by keys of 64 bits,
    other pairs by keys of 63.
    """
    spark = docs.sparkSession
    end = model.frequent.get(END)
    ends_known = end is not None
    if end is None:
        n_ends = model.counts.where(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
        end, ends_known = math.log10(n_ends + 0.5), n_ends > 0
    tree_of, known_of = spark.sparkContext.broadcast(model.tree), spark.sparkContext.broadcast(known(model.frequent, model.totals))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = known_of.value
        chunk = TaskContext.get().partitionId() << 36
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in slices(texts, SCORED_BYTES):
                places, sizes, odd = coded(texts[i:j], have)
                zstd = pa.Codec("zstd")
                data = END.join(odd)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([b.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([zstd.compress(places.astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)], pa.binary()), pa.array([zstd.compress(data, asbytes=True)], pa.binary()), pa.array([len(data)], pa.int64())], names=["chunk", "ids", "sizes", "places", "odd", "size"])
                chunk += 1

    def flat_of(sizes: list[int], places: bytes, odd: bytes, size: int) -> Flat:
        zstd, n = pa.Codec("zstd"), sum(sizes)
        at = np.frombuffer(zstd.decompress(places, 4 * n, asbytes=True) if n else b"", np.uint8).reshape(4, -1).T.copy().view(">u4").ravel()
        return flat(at.astype(np.int64), np.array(sizes, np.int64), zstd.decompress(odd, size, asbytes=True).split() if size else [], known_of.value)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = known_of.value
        for b in batches:
            for chunk, *texts in ([x.as_py() for x in r] for r in zip(*b.columns, strict=True)):
                q = question(flat_of(*texts), have)
                keys, _ = _distinct(q.pairs)
                w, k = _cuts(q.own, bits), _cuts(keys, bits)
                parts = [(x, q.words[w[x] : w[x + 1]], keys[k[x] : k[x + 1]]) for x in range(1 << bits) if w[x] < w[x + 1] or k[x] < k[x + 1]]
                yield _batch([(chunk, x, b"".join(p), _packed(_lengths(p)), len(p), _planes(keys)) for x, p, keys in parts], _ASKED)

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        tree, have = tree_of.value, known_of.value
        ids, *texts = (own.column(c)[0].as_py() for c in ("ids", "sizes", "places", "odd", "size"))
        f = flat_of(*texts)
        m, doc = len(f.sizes), np.repeat(np.arange(len(f.sizes)), f.sizes)
        q = question(f, have)
        told = told.sort_by("bucket").to_pydict()
        seen, total = (np.concatenate([np.zeros(0, np.int64), *map(_unpacked, told[c], told["m"])])[q.word] for c in ("seen", "total"))
        order = np.argsort(q.pairs)
        keys = q.pairs[order]
        n = np.empty(len(keys), np.int64)
        n[order] = np.concatenate([np.zeros(0, np.int64), *map(_unpacked, told["n"], told["k"])])[np.cumsum(np.r_[np.zeros(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]
        values = have.values[f.at]
        values[f.rare] = np.log10(seen + 0.5)
        unseen = np.bincount(doc[f.rare[seen == 0]], minlength=m)
        # The words, each with a space behind it; the last of a text ends with an end mark, as does an empty text.
        data, offsets = _raw(pa.concat_arrays([have.spaced, pa.array([w + b" " for w in f.odd], pa.large_binary())]).take(pa.array(f.places)))
        ends = np.cumsum(f.sizes)
        start, stop = offsets[ends - f.sizes], offsets[ends]
        symbols, first, ends = _stream(data, start, np.maximum(stop - start - 1, 0))
        summed = np.r_[0.0, np.cumsum(tree.symbols(symbols, first, ends), dtype=float)]
        # Where words begin: behind a space, or at the first symbol; each ends with a space or the text.
        long = np.diff(offsets)
        begin = offsets[:-1] + np.repeat(first - start, f.sizes)
        # The inner tree's probability of a word gives way to that of the context, where it is retained.
        totals = have.totals[f.at]
        totals[f.rare] = total
        kept = totals[q.here] > 0
        here, n = q.here[kept], n[kept]
        chance = summed[begin[here + 1] + long[here + 1]] - summed[begin[here + 1]]
        gain = math.log10(SMOOTHING) - np.log10(totals[here] + SMOOTHING)
        some = n > 0
        gain[some] += np.logaddexp(0.0, np.log(n[some] / SMOOTHING) - math.log(10) * chance[some]) / math.log(10)
        base = np.bincount(doc, values, m) + end - (f.sizes + 1) * norm
        scores = summed[ends + 1] - summed[first] + np.bincount(doc[here], gain, m)
        return pa.table([pa.array(ids, pa.int64()), pa.array(f.sizes + 1), pa.array(f.sizes - unseen + ends_known), pa.array(base), pa.array(scores)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    norm = math.log10(model.train_tokens + 0.5 * (model.vocabulary + 1))
    folder = scratch(spark, "lm")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(chunks, _CHUNKS).write.parquet(f"{folder}/chunks")
    texts = spark.read.schema(_CHUNKS).parquet(f"{folder}/chunks")
    number, size = texts.agg(F.count("*"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    # Finer buckets than the model's only for far more tokens than it has seen.
    bits = max(model.bits, _bits(size or 0) - 1)
    asked = texts.select("chunk", "sizes", "places", "odd", "size").mapInArrow(ask, "chunk long, bucket int, words binary, sizes binary, m long, keys binary")
    told = "chunk long, bucket int, m long, seen binary, total binary, k long, n binary"
    # A bucket or a few chunks to a task.
    dealt = lambda df, by, tasks: df.repartition(tasks, by).groupBy(by)
    dealt(asked, "bucket", 1 << bits).cogroup(dealt(_dealt(model, bits), "bucket", 1 << bits)).applyInArrow(_told, told).write.parquet(f"{folder}/told")
    if model.totals:
        _released(spark)
    answers = spark.read.schema(told).parquet(f"{folder}/told")
    tasks = max(1, number // 8)
    return dealt(texts, "chunk", tasks).cogroup(dealt(answers, "chunk", tasks)).applyInArrow(score, _SCORED)
