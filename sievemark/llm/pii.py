"""Personal data: patterns, and a skip-chain conditional random field that makes labels consistent.

Variables of the field are units: tokens that hold an at sign or digits, adjoining ones joined as far as
a number may go, and spelled-out addresses (name [at] host [dot] org). What a pattern has found is
observed; the other units are free. Node potentials are a maximum entropy model over a unit's normal
form, in which separators and spellings don't matter. Two kinds of edges share potentials: chain edges
between units that touch, and skip edges between distant units that are equal or similar (the same
address, local part or last seven digits), each occurrence linked with the next, so that a unit that
comes k times gives k - 1 edges. Loopy sum-product runs over all documents of a chunk at once, and so
carries the label of a found entity to its other forms in the document. Units that the field labels with
confidence, and that no pattern has found, become further spans.

The field is fitted on a sample of documents whose size is a parameter. What the patterns find is
positive; a unit that they miss is negative, unless its normal form would pass or it is similar to a
found one: such labels count as hidden and aren't learnt from. Every positive also gives a spoilt copy (a
wrong check digit, too large a part, no domain) as a negative.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import no_clash, own_name, slices, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on, about.
FIT_DOCS = 20_000
#: Distinct (features, label) that the node model is fitted on, the commonest.
FIT_FORMS = 20_000
CONFIDENCE = 0.95
ROUNDS = 12
#: Most digits of a unit that is joined from several tokens.
JOINED_DIGITS = 19
#: Lead of the observed label of a unit, in nats.
OBSERVED = 20.0
_NOT_MARKS = bytes(b for b in range(256) if not (48 <= b <= 57 or b == 64))
_MARK = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_TRIM = "()[]{}<>\"'`.,;:!?|=*#$%&~^"
_JOINS = re.compile(r"[\x20().-]{0,3}")


_AT, _DOT = r"[\[({]\x20?(?:at|@)\x20?[\])}]", r"[\[({]\x20?(?:dot|\.)\x20?[\])}]"
_NAME, _PART = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}", r"[A-Za-z0-9-]{1,63}"
_SPELLED = re.compile(rf"(?i){_NAME}\x20{{0,2}}{_AT}\x20{{0,2}}{_PART}(?:\x20{{0,2}}(?:{_DOT}|\x20dot\x20|\.)\x20{{0,2}}{_PART}){{1,8}}|{_NAME}\x20at\x20{_PART}(?:\x20dot\x20{_PART}){{1,8}}")
_DOTS, _ATS = re.compile(rf"(?i)\x20*(?:{_DOT}|\x20dot\x20)\x20*"), re.compile(rf"(?i)\x20*(?:{_AT}|\x20at\x20)\x20*")
_HEX = re.compile("[0-9a-fA-F]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, in time linear in the text: a local part is the run before an at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the patterns find, by start and then kind."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@dataclass
class Unit:
    start: int
    end: int
    text: str

    def __post_init__(self) -> None:
        self.plain = _ATS.sub("@", _DOTS.sub(".", self.text)) if any(c in self.text for c in "[({ ") else self.text
        self.digits = _digits(self.text)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _MARK.search(text, at):
        a, b = m.start(), _TOKEN.match(text, m.start()).end()
        while a > at and not text[a - 1].isspace():
            a -= 1
        at = b
        inner = text[a:b].rstrip(_TRIM)
        a += len(inner) - len(inner.lstrip(_TRIM))
        if inner.lstrip(_TRIM):
            yield a, a + len(inner.lstrip(_TRIM))


def units(text: str) -> list[Unit]:
    """The units of a text, in order and apart from each other; in time linear in the text."""
    spelled = [m.span() for m in _SPELLED.finditer(text)] if _has_spelled(text.encode("utf-8", "replace")) else []
    out: list[tuple[int, int]] = []
    held, k = 0, 0  # digits of the unit that still may grow; 0: none may
    for a, b in _tokens(text):
        while k < len(spelled) and spelled[k][1] <= a:
            k += 1
        if k < len(spelled) and spelled[k][0] < b:
            continue
        word = text[a:b]
        n = len(_digits(word))
        number = n > 0 and not any(c.isalpha() or c == "@" for c in word)
        grows = held and number and word[0] != "+" and held + n <= JOINED_DIGITS and _JOINS.fullmatch(text, out[-1][1], a)
        if grows:
            out[-1] = (out[-1][0], b)
            held += n
        else:
            out.append((a, b))
            held = n if number else 0
    out = [(a - (a > 0 and text[a - 1] == "(" and ")" in text[a:b] and "(" not in text[a:b]), b) for a, b in out]
    return [Unit(a, b, text[a:b]) for a, b in sorted(out + spelled)]


def _valid(kind: str, plain: str) -> bool:
    """Whether a normal form passes for the kind, whatever its separators."""
    d = _digits(plain)
    if kind == "email":
        local, _, host = plain.partition("@")
        return bool(local) and set(local) <= _LOCAL and bool(_DOMAIN.fullmatch(host))
    if any(c.isalpha() or c == "@" for c in plain):
        return False
    parts = plain.split(".")
    if kind == "ip":
        return len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts) and _octets(plain)
    return 14 <= len(d) <= 19 and luhn(d) if kind == "card" else plain.startswith("+") and 10 <= len(d) <= 15


def _features(u: Unit, before: str) -> str:
    """Bits of the unit's normal form and of what stands before it."""
    s, n = u.plain, len(u.digits)
    letters = sum(c.isalpha() for c in s)
    groups = len(re.findall("[0-9]+", s))
    valid = [_valid(k, s) for k in KINDS]
    bits = [
        True, *valid, "@" in s, s.startswith("+") or before.rstrip(" (").endswith("+"), n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n >= 20,
        letters == 0, letters > n, groups == 1, groups == 4, groups > 4, "." in s, "-" in s, " " in s, bool(_HEX.search(s)), before.rstrip().endswith("="), before.endswith('"'), bool(before) and before[-1] in "$€£#",
    ]
    return "".join("01"[bool(b)] for b in bits)


def _keys(u: Unit) -> list[str]:
    """Units with a key in common are equal or similar."""
    plain, d = u.plain.lower(), u.digits
    if "@" in plain:
        local = plain.partition("@")[0]
        return [f"e{plain}"] + [f"l{local}"] * (len(local) >= 5)
    if any(c.isalpha() for c in plain):
        return [f"w{plain}"] * (len(plain) >= 5)
    return [f"n{plain}"] * (len(d) >= 5) + [f"d{d[-7:]}"] * (len(d) >= 7)


class Graph:
    """Units of many documents as one factor graph; observed holds the labels that patterns give, -1 for none."""

    def __init__(self) -> None:
        self.features: list[str] = []
        self.observed: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, text: str, us: list[Unit], spans: list[tuple[str, int, int]]) -> None:
        first, last = len(self.features), {}
        self.observed += labels(us, spans)
        for k, u in enumerate(us):
            self.features.append(_features(u, text[max(0, u.start - 4) : u.start]))
            if k and _JOINS.fullmatch(text, us[k - 1].end, u.start):
                self.chain.append((first + k - 1, first + k))
            near = set()
            for key in _keys(u):
                if key in last and last[key] not in near:
                    near.add(last[key])
                    self.skip.append((last[key], first + k))
                last[key] = first + k


@dataclass
class Field:
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def posteriors(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Marginals of each unit's labels (none, then KINDS) after loopy sum-product."""
        x = np.frombuffer("".join(graph.features).encode(), np.uint8).reshape(-1, self.weights.shape[0]) - 48.0
        node = x @ self.weights
        node -= np.logaddexp.reduce(node, axis=1, keepdims=True)
        seen = np.array(graph.observed)
        at = np.flatnonzero(seen >= 0)
        node[at] -= OBSERVED
        node[at, seen[at]] += OBSERVED
        parts = [(np.array(e, np.int64).reshape(-1, 2), p) for e, p in ((graph.chain, self.chain), (graph.skip, self.skip)) if e]
        if parts:
            tail = np.concatenate([np.r_[e[:, 0], e[:, 1]] for e, _ in parts])
            head = np.concatenate([np.r_[e[:, 1], e[:, 0]] for e, _ in parts])
            pot = np.concatenate([np.concatenate([np.broadcast_to(p, (len(e), *p.shape)), np.broadcast_to(p.T, (len(e), *p.shape))]) for e, p in parts])
            back = np.concatenate([np.r_[at + len(e) : at + 2 * len(e), at : at + len(e)] for at, (e, _) in zip(np.cumsum([0, *(2 * len(e) for e, _ in parts[:-1])]), parts, strict=True)])
            message = np.zeros((len(tail), node.shape[1]))
            for _ in range(rounds):
                belief = node.copy()
                np.add.at(belief, head, message)
                new = np.logaddexp.reduce((belief[tail] - message[back])[:, :, None] + pot, axis=1)
                message = 0.5 * message + 0.5 * (new - np.logaddexp.reduce(new, axis=1, keepdims=True))
            np.add.at(node, head, message)
        node -= node.max(axis=1, keepdims=True)
        p = np.exp(node)
        return p / p.sum(axis=1, keepdims=True)


def labels(us: list[Unit], spans: list[tuple[str, int, int]]) -> list[int]:
    """The label of the first span that meets each unit, -1 where none does; spans come by start."""
    out, k = [], 0
    for u in us:
        while k < len(spans) and spans[k][2] <= u.start:
            k += 1
        met = next((1 + KINDS.index(kind) for kind, a, z in spans[k : k + 8] if a < u.end and u.start < z), -1)
        out.append(met)
    return out


def _association(joint: np.ndarray) -> np.ndarray:
    """Log ratio of how often two labels meet over an edge to how often they would by chance."""
    n = len(joint)
    joint = joint + np.full((n, n), 0.05) + np.eye(n) * 0.5
    joint = (joint + joint.T) / 2
    joint /= joint.sum()
    p = joint.sum(axis=1)
    return np.clip(np.log(joint / np.outer(p, p)), -6, 6)


def fit_field(forms: dict[tuple[str, int], int], chain: np.ndarray, skip: np.ndarray) -> Field:
    """Maximum entropy by gradient steps over weighted (features, label), smoothed association for both kinds of edges."""
    n = 1 + len(KINDS)
    width = len(_features(Unit(0, 1, "0"), ""))
    w = np.zeros((width, n))
    if forms:
        x = np.array([[c == "1" for c in f] for f, _ in forms], float)
        one = np.eye(n)[[y for _, y in forms]]
        weight = np.sqrt(np.array(list(forms.values()), float))  # common forms shouldn't drown the others
        weight = (weight / weight.sum())[:, None]
        for _ in range(3000):
            z = x @ w
            p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
            w += 2.0 * (x.T @ (weight * (one - p)) - 1e-3 * w)
    return Field(w, _association(chain), _association(skip))


def _spoilt(u: Unit, label: int) -> Unit:
    """A copy that its kind's rules don't pass."""
    s = u.text
    kind = KINDS[label - 1]
    if kind == "card":
        k = max(j for j, c in enumerate(s) if c in "0123456789")
        s = s[:k] + str((int(s[k]) + 1) % 10) + s[k + 1 :]
    elif kind == "ip":
        s = "7" + s
        s = s if int(s.split(".")[0]) > 255 else "77" + s
    elif kind == "phone":
        s = re.match("(?:[^0-9]*[0-9]){7}", s)[0]
    else:
        s = s.partition("@")[0] + "@" + s.partition("@")[2].partition(".")[0]
    return Unit(0, len(s), s)


def learnt(text: str, us: list[Unit], spans: list[tuple[str, int, int]]) -> Iterator[str]:
    """What a document teaches: lines of the kind of count and its key."""
    graph = Graph()
    graph.add(text, us, spans)
    y = graph.observed
    hidden = {k for k, u in enumerate(us) if y[k] < 0 and any(_valid(kind, u.plain) for kind in KINDS)}
    hidden |= {k for e in graph.skip for k, other in (e, e[::-1]) if y[k] < 0 <= y[other]}
    for k, u in enumerate(us):
        if k not in hidden:
            yield f"u {graph.features[k]} {max(0, y[k])}"
        if y[k] > 0 and _valid(KINDS[y[k] - 1], u.plain):
            yield f"u {_features(_spoilt(u, y[k]), text[max(0, u.start - 4) : u.start])} 0"
    for name, edges in (("c", graph.chain), ("s", graph.skip)):
        for a, b in edges:
            if a not in hidden and b not in hidden:
                yield f"{name} {max(0, y[a])} {max(0, y[b])}"


def _has_spelled(text: bytes) -> bool:
    low = text.lower()
    return b" dot " in low or b"at]" in low or b"at)" in low or b"at}" in low or b"at ]" in low or b"at )" in low


def _has_marks(text: bytes) -> bool:
    return bool(text.translate(None, _NOT_MARKS)) or _has_spelled(text)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = FIT_DOCS) -> Field:
    """Field of about `sample` documents, chosen by a hash of the id; rows without an id count as one id.

    Only counts of distinct forms come to the driver, the FIT_FORMS commonest of them. Without
    documents every unit is as likely to have any label, and none becomes a span.
    """
    share = min(1.0, sample / max(1, docs.count()))
    rows = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("text")).where(F.coalesce(F.crc32(F.col("k").cast("binary")), F.lit(0)) < int(share * 2**32)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter[str] = Counter()
            for raw in texts_of(b.column(0)):
                if _has_marks(raw):
                    text = raw.decode()
                    count.update(learnt(text, units(text), base_spans(text)))
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["key", "n"])

    found = rows.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    forms, joint = {}, {k: np.zeros((1 + len(KINDS),) * 2) for k in "cs"}
    for key, n in found.orderBy(F.desc("n"), "key").limit(FIT_FORMS + 2 * (1 + len(KINDS)) ** 2).collect():
        kind, a, b = key.split(" ")
        if kind == "u":
            forms[a, int(b)] = n
        else:
            joint[kind][int(a), int(b)] += n
    return fit_field(forms, joint["c"], joint["s"])


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(spans of the patterns, all spans) of each text."""
    graph, held = Graph(), []
    for text in texts:
        us = units(text)
        spans = base_spans(text) if us else []
        held.append((spans, us, len(graph.features)))
        graph.add(text, us, spans)
    p = field.posteriors(graph) if graph.features else np.zeros((0, 1))
    top, sure = p.argmax(axis=1), p.max(axis=1, initial=0) >= CONFIDENCE
    out = []
    for spans, us, at in held:
        more = [(KINDS[top[k] - 1], u.start, u.end) for k, u in enumerate(us, at) if top[k] and sure[k] and graph.observed[k] < 0]
        out.append((spans, sorted(spans + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base (spans of the patterns) and spans (all) of each row, in code points.

    Null and empty texts have none; repeated rows come out each; an empty table gives no rows. Columns
    named in keep are passed through; others, of any name, are left out; keep can't name a result.
    """
    no_clash(keep, ("doc_id", "base", "spans"))
    at = own_name("text", list(keep))
    field = field or fit(docs, id_col, text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = texts_of(b.column(1))
            found: list = [([], [])] * len(raw)
            for i, j in slices(raw):
                some = [k for k in range(i, j) if _has_marks(raw[k])]
                for k, f in zip(some, find([raw[k].decode() for k in some], field), strict=True):
                    found[k] = f
            own = [pa.array([f[k] for f in found], span) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], *own], names=[*b.schema.names[:1], *b.schema.names[2:], "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias(at), *keep)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != at) + f", base {_SPANS}, spans {_SPANS}"
    return rows.mapInArrow(run, schema)


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """docs with every span in text_col replaced by its kind in brackets; columns and order of columns stay. A null text stays null."""
    field = field or fit(docs, id_col, text_col)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, null = texts_of(b.column(at)), b.column(at).is_null().to_pylist()
            new: list = [None if n else x for x, n in zip(raw, null, strict=True)]
            for i, j in slices(raw):
                some = [k for k in range(i, j) if _has_marks(raw[k])]
                texts = [raw[k].decode() for k in some]
                for k, text, (_, spans) in zip(some, texts, find(texts, field), strict=True):
                    parts, done = [], 0
                    for kind, a, z in spans:
                        if z > done:
                            parts += [text[done : max(a, done)], f"[{kind}]"]
                            done = z
                    new[k] = "".join([*parts, text[done:]]).encode()
            cols = [pa.array(new, pa.binary()).cast(pa.string()) if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
