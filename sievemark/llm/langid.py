"""Language identification of mixed text: script ranges, word scores and Viterbi with a switching penalty.

A word is a run of letters. Its script, told by code point ranges, narrows the candidate languages to
those that were seen to use the script; its score under a candidate is the log-likelihood ratio of its
letter trigrams. Viterbi then labels the words of each text, paying a penalty for every change of
language, so that a foreign name doesn't split a sentence and a foreign paragraph gets its own span.
The languages and their statistics come from labelled documents only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import no_clash, own_name, slices, texts_of

UNKNOWN = "und"
#: Labelled documents of a language that its statistics are taken from, about.
FIT_DOCS = 4_000
BUCKETS = 1 << 16
SWITCH = 12.0
#: Share of a language's letters that a script needs for the language to be its candidate.
SCRIPT_SHARE = 0.01
LETTERS_AT_ONCE = 1_000_000
#: Bytes of text whose words are labelled together.
LABELLED_BYTES = 2_000_000

# First and last code points of scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF),
    ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x323AF),
)


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Whether a code point is a letter; its script's number (0: another)."""
    letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    names = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
    script = np.zeros(0x110000, np.int8)
    for s, a, b in SCRIPTS:
        script[a : b + 1] = names.index(s)
    return letter, script, names


@dataclass
class Words:
    """The letters of some texts: trigram bucket of each, and where words begin."""

    bucket: np.ndarray
    script: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def words(texts: list[str]) -> Words:
    letter, script, _ = _characters()
    lowered = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    cps = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(np.r_[1, [len(t) + 1 for t in lowered[:-1]]])
    is_letter = letter[cps]
    at = np.flatnonzero(is_letter)
    near = np.where(is_letter, cps, 32).astype(np.uint32)
    mixed = near[at - 1] * np.uint32(0x9E3779B1) + near[at] * np.uint32(0x85EBCA77) + near[at + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    starts = np.flatnonzero(~is_letter[at - 1])
    begin = at[starts]
    end = at[np.r_[starts[1:] - 1, len(at) - 1]] + 1 if len(starts) else begin
    doc = np.searchsorted(first, begin, "right") - 1
    return Words((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16), script[cps[at]], starts, doc, begin - first[doc], end - first[doc])


def runs_of(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, x in enumerate(texts):
        if j > i and size + len(x) > limit:
            yield i, j
            i, size = j, 0
        size += len(x)
    if texts:
        yield i, len(texts)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    #: BUCKETS x languages: log-likelihood of a trigram less its mean over the languages.
    score: np.ndarray
    #: scripts x languages
    candidate: np.ndarray

    def word_scores(self, w: Words) -> np.ndarray:
        if not len(w.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        ends = np.r_[w.starts[1:], len(w.bucket)]
        out = np.empty((len(w.starts), len(self.languages)), np.float32)
        step = max(1, LETTERS_AT_ONCE // max(1, len(self.languages) // 4))
        i = 0
        while i < len(w.starts):  # whole words, about `step` letters at a time
            j = max(i + 1, int(np.searchsorted(w.starts, w.starts[i] + step)))
            a, b = w.starts[i], ends[j - 1]
            out[i:j] = np.add.reduceat(self.score[w.bucket[a:b]], w.starts[i:j] - a, axis=0)
            i = j
        can = self.candidate[w.script[w.starts]]
        return np.where(can, out, np.where(can.any(axis=1, keepdims=True), np.float32(-1e3), np.float32(0)))


def viterbi(scores: np.ndarray, sizes: np.ndarray, prior: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of every word; scores hold the texts' words one text after the other. All texts move on a word at a time."""
    label = np.zeros(len(scores), np.int16)
    order = np.argsort(-sizes, kind="stable")
    starts = np.r_[0, np.cumsum(sizes)[:-1]][order]
    sizes = sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t words
    stay = np.zeros(scores.shape, bool)
    best = np.zeros(len(scores), np.int16)  # best label at the word, were a switch to follow
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(longest):
        k = active[t]
        at = starts[:k] + t
        v = value[:k]
        if t:
            change = v[np.arange(k), best[at - 1]][:, None] - np.float32(penalty)
            stay[at] = v >= change
            np.maximum(v, change, out=v)
            v += scores[at]
        else:
            v[:] = scores[at] + prior
        v -= v.max(axis=1, keepdims=True)
        best[at] = v.argmax(axis=1)
    state = np.zeros(len(sizes), np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        ends = sizes[:k] == t + 1
        if t + 1 < longest:
            going = np.flatnonzero(~ends)
            state[going] = np.where(stay[at[going] + 1, state[going]], state[going], best[at[going]])
        state[:k][ends] = best[at[ends]]
        label[at] = state[:k]
    return label


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = FIT_DOCS) -> Model:
    """Model of the languages of the rows with a language and a text.

    About `sample` documents of each language, chosen by a hash of the id, are used whole.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)).alias("h")).where("lang is not null and text is not null")
    n = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(n)
    scripts = len(_characters()[2])
    if not languages:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32), np.zeros((scripts, 0), bool))
    index = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(1.0, sample / n[name]) * 2**32))])
    chosen = rows.where(F.col("h") < share[F.col("lang")]).select(index[F.col("lang")].alias("k"), "text")
    width = BUCKETS + scripts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * width, np.int64)
        for b in batches:
            ks, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i, j in runs_of(texts, LETTERS_AT_ONCE):
                w = words(texts[i:j])
                if len(w.starts):
                    k = np.repeat(ks[i:j][w.doc].astype(np.int64), np.diff(np.r_[w.starts, len(w.bucket)])) * width
                    total += np.bincount(k + w.bucket, minlength=len(total)) + np.bincount(k + BUCKETS + w.script, minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["key", "n"])

    counts = np.zeros(len(languages) * width)
    for key, c in chosen.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n")).toLocalIterator():
        counts[key] = c
    counts = counts.reshape(len(languages), width).T
    grams, used = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    score = np.log(grams / grams.sum(axis=0))
    prior = np.log(np.array([n[x] for x in languages]) / sum(n.values()))
    candidate = used > SCRIPT_SHARE * np.maximum(1, used.sum(axis=0))
    return Model(languages, prior.astype(np.float32), (score - score.mean(axis=1, keepdims=True)).astype(np.float32), candidate)


def _labels(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, begin, end and label of every word of the texts."""
    parts, scores = [], []
    for i, j in runs_of(texts, LETTERS_AT_ONCE):
        w = words(texts[i:j])
        scores.append(model.word_scores(w))
        parts.append((w.doc + i, w.begin, w.end))
    doc, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    return doc, begin, end, viterbi(np.concatenate(scores), np.bincount(doc, minlength=len(texts)), model.prior)


_SPANS = "array<struct<lang:string,start:long,end:long>>"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of each row, and the language spans in code points if wanted.

    lang_pred is the language of most letters, score its share of them. A null text, one without
    letters, and every text under a model without languages get 'und' and 0. Repeated rows come out
    each; columns named in keep are passed through, others of any name left out; keep can't name a result.
    """
    no_clash(tuple(c for c in keep if c != text_col), ("doc_id", "lang_pred", "score", *(["spans"] * spans)))
    own = own_name("text", list(keep))
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def labelled(texts: list[str]) -> tuple[list[str], np.ndarray, list[list]]:
        names, score, found = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        if not model.languages:
            return names, score, found
        doc, begin, end, label = _labels(texts, model)
        n = len(model.languages)
        letters = np.bincount(doc * n + label, end - begin, minlength=len(texts) * n).reshape(-1, n)
        total, top = letters.sum(axis=1), letters.argmax(axis=1)
        full = np.flatnonzero(total)
        score[full] = letters[full, top[full]] / total[full]
        for k in full:
            names[k] = model.languages[top[k]]
        if spans and len(doc):
            new = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(label) != 0)])
            last = np.r_[new[1:], len(doc)] - 1
            for d, a, z, x in zip(doc[new].tolist(), begin[new].tolist(), end[last].tolist(), label[new].tolist(), strict=True):
                found[d].append((model.languages[x], a, z))
        return names, score, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = texts_of(b.column(1))
            names, scores, found = [], [np.zeros(0)], []
            for i, j in slices(raw, LABELLED_BYTES):
                part = labelled([x.decode() for x in raw[i:j]])
                names += part[0]
                scores.append(part[1])
                found += part[2]
            new, new_names = [pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"]
            if spans:
                new, new_names = [*new, pa.array(found, span)], [*new_names, "spans"]
            kept = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != own]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*(n for n in b.schema.names if n != own), *new_names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias(text_col if text_col in keep else own), *(c for c in keep if c != text_col))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != own) + ", lang_pred string, score double" + f", spans {_SPANS}" * spans
    return rows.mapInArrow(run, schema)
