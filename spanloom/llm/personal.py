"""Personal information inside free text (problem 1).

A linear-chain conditional random field over word-shape features, trained from a bounded sample of the notes with gold
spans, decoded by Viterbi in numpy batches. The path of labels alone decides where mentions are, of which type, and
where they end: tokens are runs of letters, runs of digits and single signs, so every end is an end of a token. Gold is
noisy (missing, shifted, mistyped spans), so it is cleaned before training: spans are moved to the ends of words, and two
fields, each trained on one half, correct the other half.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.crf import Chain
from spanloom.llm.hashing import codes_of, prefix_sums, range_hashes

TYPES = ("NAME", "EMAIL", "PHONE", "ID", "STREET")
#: Gold types that stand for the types found here; others are no mentions.
GOLD = {"PATIENT": "NAME", "DOCTOR": "NAME", "NAME": "NAME", "EMAIL": "EMAIL", "PHONE": "PHONE", "FAX": "PHONE", "IDNUM": "ID", "MEDICALRECORD": "ID", "ID": "ID", "STREET": "STREET"}
#: Most gold notes in training, chosen by a hash of their key.
TRAIN_NOTES = 2600
#: Times that the training goes through so many notes, at most; smaller samples are gone through more often, up to MOST_ROUNDS.
ROUNDS, MOST_ROUNDS = 2, 4
#: Most names of the fixed name list, which every worker holds.
MOST_NAMES = 1_000_000
LABELS = 1 + 2 * len(TYPES)  # 0: none; 1 + 2k: first token of type k; 2 + 2k: a further one
BITS = 18
PAD = 5
SPACE, LETTER, DIGIT, UNDER, SIGN = range(5)


def _h(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) | (zlib.adler32("\x1e".join(map(str, parts)).encode()) << 32)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point: white space, letter, digit, underscore, sign."""
    out = np.full(sys.maxunicode + 1, SIGN, np.uint8)
    for c in range(0x40000):
        x = chr(c)
        if x.isalnum():
            out[c] = DIGIT if unicodedata.category(x) == "Nd" else LETTER
        elif x.isspace():
            out[c] = SPACE
    out[ord("_")] = UNDER
    return out


class Tokens:
    """Tokens of several texts laid end to end, PAD empty ones before the first and after each text.

    `at`: start and stop of the real tokens in code points of their text; `real`: their places among all; `sizes`: real
    tokens of each text; `gap`: what stands before a token: 0 nothing, 1 a blank, 2 a line end, 3 the text's start or
    more line ends, 4 an empty token; `ids`: types in the lexicon. A type is a token with its digits as 0.
    """

    def __init__(self, texts: list[str], lexicon: Lexicon):
        kind = _classes()
        joined = "\n".join(texts)
        c = codes_of(joined)
        k = kind[c]
        c = np.where(k == DIGIT, np.uint32(ord("0")), c)
        new = np.ones(len(c), bool)
        new[1:] = (k[1:] != k[:-1]) | (k[1:] >= UNDER)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(c)) if len(first) else first
        real = k[first] != SPACE
        a, b = first[real], last[real]
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(a, ends)
        self.sizes = np.diff(upto, prepend=0).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), self.sizes)
        self.at = np.stack([a, b], axis=1).astype(np.int64) - (np.concatenate([[0], ends[:-1]])[row] if len(row) else np.zeros(0, np.int64))[:, None]
        lines = np.concatenate([[0], np.cumsum((c == 10) | (c == 13))])
        gap = np.full(len(a), 3, np.uint64)
        if len(a) > 1:
            n = lines[a[1:]] - lines[b[:-1]]
            gap[1:] = np.where(n > 1, 3, np.where(n == 1, 2, a[1:] > b[:-1]))
            gap[1:][row[1:] != row[:-1]] = 3
        self.real = np.arange(len(a)) + PAD * (row + 1)
        total = len(a) + PAD * (len(texts) + 1)
        self.gap = np.full(total, 4, np.uint64)
        self.gap[self.real] = gap
        self.ids = np.zeros(total, np.int64)
        self.signs = k[a] == SIGN
        if len(a):
            h, one, inverse = np.unique(range_hashes(prefix_sums(c), a, b), return_index=True, return_inverse=True)
            self.ids[self.real] = lexicon.types(h, lambda i: joined[a[one[i]] : b[one[i]]])[inverse]


#: Features of one token at an offset, as (offset, column, number): word and shape and name kind around, parts of the
#: word itself, and the words of the four places on either side whatever their order, which share a number.
#: Columns: 0 word, 1 shape, 2 and 3 prefixes, 4 to 6 suffixes, 7 name kind, 8 short shape.
_AT = [*[(o, 0) for o in range(-2, 3)], *[(o, c) for o in range(-2, 3) for c in (1, 7)], *[(0, c) for c in (2, 3, 4, 5, 6)], (-1, 5), (1, 5)]
SINGLE = [*[(o, c, i) for i, (o, c) in enumerate(_AT)], *[(o, 0, 90) for o in range(-4, 0)], *[(o, 0, 91) for o in range(1, 5)]]
GAP = 9
#: Features of several tokens, as (column, offset) each; GAP is the gap before a token.
CROSSED = [
    ((GAP, 0), (GAP, 1), (1, 0)),
    ((GAP, 0), (0, -1), (1, 0)),
    *[((0, a), (0, a + 1)) for a in (-3, -2, -1, 0, 1)],
    *[((1, a), (1, a + 1), (GAP, a + 1)) for a in (-1, 0)],
    *[((7, a), (7, a + 1)) for a in (-1, 0)],
    ((1, -1), (1, 0), (1, 1)),
    ((1, -2), (1, -1), (1, 0)),
    ((1, 0), (1, 1), (1, 2)),
    ((0, -1), (1, 0)),
    ((0, -2), (0, -1), (1, 0)),
    ((0, -3), (0, -2), (0, -1), (8, 0)),
    ((1, 0), (0, 1)),
    ((1, 0), (0, 1), (0, 2)),
    ((8, 0), (0, 1), (0, 2), (0, 3)),
    ((0, -2), (1, -1), (1, 0)),
]
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SHIFT = np.uint64(64 - BITS)


def _row(h: np.ndarray, salt: int) -> np.ndarray:
    """The weight row of a feature from the sum of its parts."""
    with np.errstate(over="ignore"):
        return (((h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD * (2 * salt + 1) % 2**64 | 1)) >> _SHIFT).astype(np.int32)


class Lexicon:
    """Codes of token types, remembered per worker; with `weights`, also the summed weights of their single features."""

    COLS = 9
    MOST = 150_000

    def __init__(self, names: dict[str, str], weights: np.ndarray | None = None):
        self.names, self.weights = names, weights
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[int, int] = {}
        self.codes = np.zeros((4096, self.COLS), np.uint64)
        self.n = 0
        if self.weights is not None:
            self.sums = np.zeros((9, 4096, self.weights.shape[1]), np.float32)
        self._add(["\x00"])

    def _add(self, tokens: list[str]) -> None:
        lo, hi = self.n, self.n + len(tokens)
        while hi > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
            if self.weights is not None:
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)], axis=1)
        for n, token in enumerate(tokens, lo):
            low = token.lower()
            shape = re.sub(r"[^\W\d_a-z]", lambda m: "X" if m.group().isupper() else "x", re.sub("[a-z]", "x", token))
            short = re.sub(r"(.)\1+", r"\1+", shape)
            shape = shape if len(shape) <= 3 or shape[0] == "0" else short
            kind = self.names.get(low, "-") if len(low) > 1 else "-"
            parts = (("w", low), ("s", shape), ("p2", low[:2]), ("p3", low[:3]), ("q2", low[-2:]), ("q3", low[-3:]), ("q4", low[-4:]), ("n", kind, short), ("k", short))
            self.codes[n] = [_h(*p) for p in parts]
        self.n = hi
        if self.weights is not None:
            for o, c, i in SINGLE:
                self.sums[o + 4, lo:hi] += self.weights[_row(self.codes[lo:hi, c], i)]

    def types(self, hashes: np.ndarray, token: object) -> np.ndarray:
        """Ids of the types with these hashes; `token(i)` is the text of the i-th, asked for where it is new."""
        if self.n > self.MOST:
            self._clear()
        keys = hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.ids]
        self.ids.update(zip((keys[i] for i in new), range(self.n, self.n + len(new))))
        self._add([re.sub(r"\d", "0", token(i)) for i in new])
        return np.fromiter((self.ids[h] for h in keys), np.int64, len(keys))


def _crossed(t: Tokens, lexicon: Lexicon) -> Iterator[np.ndarray]:
    """Weight rows of the crossed features for all places but the outer PAD ones, one array a feature."""
    n = len(t.ids) - 2 * PAD
    codes = {c: lexicon.codes[t.ids, c] for c in (0, 1, 7, 8)}
    codes[GAP] = t.gap * np.uint64(0x9FB21C651E98DF25)
    for i, parts in enumerate(CROSSED):
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k, (c, o) in enumerate(parts):
                h += codes[c][PAD + o : PAD + o + n] * _ODD[k]
        yield _row(h, 1000 + i)


def features(t: Tokens, lexicon: Lexicon) -> np.ndarray:
    """Feature rows (real tokens, features) for training."""
    inner = t.real - PAD
    single = [_row(lexicon.codes[t.ids[t.real + o], c], i) for o, c, i in SINGLE]
    return np.ascontiguousarray(np.stack([*single, *[r[inner] for r in _crossed(t, lexicon)]], axis=1))


def scores(t: Tokens, lexicon: Lexicon, chain: Chain) -> np.ndarray:
    """Emission scores of the real tokens: single features by type, crossed ones by weight row."""
    n = len(t.ids) - 2 * PAD
    e = np.zeros((max(n, 0), LABELS), np.float32)
    if n <= 0:
        return e
    part = np.empty_like(e)
    for o in range(-4, 5):
        e += np.take(lexicon.sums[o + 4], t.ids[PAD + o : PAD + o + n], axis=0, out=part, mode="clip")
    place, weights = chain.packed()
    for r in _crossed(t, lexicon):
        p = place[r]
        known = np.flatnonzero(p)
        if 3 * len(known) < n:
            e[known] += weights[p[known]]
        else:
            e += np.take(weights, p, axis=0, out=part, mode="clip")
    return e[t.real - PAD]


def spans_of(labels: np.ndarray, at: np.ndarray, signs: np.ndarray, text: str) -> list[tuple[str, int, int]]:
    """Mentions (type, start, stop) of a label path, in order, disjoint. A mention starts and ends with a letter or digit;
    signs at its ends stay only where the type may have them there: ( and + before a phone number, . after a street."""
    out = []
    for i, j in _runs(labels) if labels.any() else ():
        kind = TYPES[(labels[i] - 1) // 2]
        while i < j and signs[i] and not (kind == "PHONE" and text[at[i, 0]] in "(+"):
            i += 1
        while j > i and signs[j - 1] and not (kind == "STREET" and text[at[j - 1, 0]] == "." and j - i > 1):
            j -= 1
        if i < j and not signs[i:j].all():
            out.append((kind, int(at[i, 0]), int(at[j - 1, 1])))
    return out


#: Signs that hold a mention of each type together where no white space is; only gold is moved by them.
_INNER = {"NAME": "'’-", "EMAIL": "@._+-", "PHONE": "-–.()+", "ID": "-/", "STREET": "-."}


def snapped(kind: str, a: int, b: int, text: str, points: frozenset[str] = frozenset()) -> tuple[int, int]:
    """The ends of a gold span moved out to the ends of the words they cut, without signs around and possessive s. A
    street keeps the point after it if its last word is one of `points`."""
    inner, n = _INNER[kind], len(text)
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    if a >= b:
        return a, a
    while a and (text[a - 1].isalnum() or (text[a - 1] in inner and a > 1 and text[a - 2].isalnum())):
        a -= 1
    while b < n and (text[b].isalnum() or (text[b] in inner and b + 1 < n and text[b + 1].isalnum())):
        b += 1
    if kind == "NAME" and b - a > 2 and text[b - 1] in "sS" and text[b - 2] in "'’":
        b -= 2
    if kind == "PHONE":
        if a and text[a - 1] == "(" and ")" in text[a:b]:
            a -= 1
        if a and text[a - 1] == "+":
            a -= 1
    return a, b + (kind == "STREET" and text[b : b + 1] == "." and _last_word(text, a, b) in points)


def _last_word(text: str, a: int, b: int) -> str:
    m = re.search(r"[^\W\d_]+$", text[a:b])
    return m.group().lower() if m else ""


def pointed_words(texts: list[str], gold: list[list[tuple[int, int, str]]]) -> frozenset[str]:
    """The words at the end of gold streets whose point, where one follows, most of that gold includes: abbreviations."""
    seen: dict[str, list[int]] = {}
    for text, spans in zip(texts, gold):
        for a, b, kind in spans:
            with_point = text[b - 1 : b] == "."
            if kind == "STREET" and (with_point or text[b : b + 1] == "."):
                seen.setdefault(_last_word(text, a, b - with_point), []).append(with_point)
    return frozenset(w for w, x in seen.items() if w and 2 * sum(x) >= len(x))


def gold_labels(text: str, at: np.ndarray, spans: list[tuple[int, int, str]], points: frozenset[str] = frozenset()) -> np.ndarray:
    """Labels of the tokens of gold spans (start, stop, type); longer spans win over shorter ones. A span is first cut to
    the tokens that lie at least half within it, since gold is shifted by a few characters now and then."""
    y = np.zeros(len(at), np.int8)
    for a, b, kind in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        if kind not in TYPES or not len(at):
            continue
        over = np.minimum(at[:, 1], b) - np.maximum(at[:, 0], a)
        hit = np.flatnonzero((2 * over >= at[:, 1] - at[:, 0]) & (over > 0))
        if not len(hit):
            continue
        a, b = snapped(kind, int(at[hit[0], 0]), int(at[hit[-1], 1]), text, points)
        hit = np.flatnonzero((at[:, 0] >= a) & (at[:, 1] <= b))
        if not len(hit) or y[hit].any():
            continue
        k = TYPES.index(kind)
        y[hit] = 2 + 2 * k
        y[hit[0]] = 1 + 2 * k
    return y


def _runs(y: np.ndarray) -> list[tuple[int, int]]:
    """(i, j) of each mention: a first label and the further ones after it."""
    starts = np.flatnonzero((y > 0) & ((y % 2 == 1) | (np.concatenate([[0], y[:-1]]) == 0)))
    ends = np.flatnonzero((y > 0) & np.concatenate([(y[1:] == 0) | (y[1:] % 2 == 1), [True]])) + 1
    return list(zip(starts.tolist(), ends.tolist()))


def train_field(texts: list[str], gold: list[list[tuple[int, int, str]]], names: dict[str, str], epochs: tuple[int, int] | None = None) -> Chain:
    """A field from texts with noisy gold spans (start, stop, type), see the module. `epochs` of the halves and of the whole."""
    epochs = epochs or (max(ROUNDS, min(MOST_ROUNDS, ROUNDS * TRAIN_NOTES // max(1, len(texts)))),) * 2
    lexicon = Lexicon(names)
    t = Tokens(texts, lexicon)
    x, sizes = features(t, lexicon), t.sizes
    ends = np.cumsum(sizes)
    cut = lambda v: [v[e - n : e] for e, n in zip(ends, sizes)]
    xs, places, signs = cut(x), cut(t.at), cut(t.signs)
    points = pointed_words(texts, gold)
    ys = [gold_labels(t, at, g, points) for t, at, g in zip(texts, places, gold)]
    better: dict[int, np.ndarray] = {}
    for k in (0, 1):
        mine, other = range(k, len(xs), 2), [i for i in range(1 - k, len(xs), 2) if len(xs[i])]
        if not len(mine) or not other:
            continue
        f = Chain(LABELS, BITS).train([xs[i] for i in mine], [ys[i] for i in mine], epochs[0])
        other.sort(key=lambda i: len(xs[i]))
        for lo in range(0, len(other), 40):
            part = other[lo : lo + 40]
            n = np.array([len(xs[i]) for i in part])
            e = f.scores(np.concatenate([xs[i] for i in part]))
            y, none, last = f.viterbi(e, n), f.marginals(e, n)[0][:, 0], np.cumsum(n)
            for i, a, b in zip(part, last - n, last):
                found = [(s[1], s[2], s[0]) for s in spans_of(y[a:b], places[i], signs[i], texts[i])]
                mine_ = gold_labels(texts[i], places[i], found, points)
                for p, q in _runs(ys[i]):  # gold that the field leaves open
                    if not mine_[p:q].any() and none[a + p : a + q].min() < 0.9:
                        mine_[p:q] = ys[i][p:q]
                better[i] = mine_
    ys = [better.get(i, y) for i, y in enumerate(ys)]
    return Chain(LABELS, BITS).train(xs, ys, epochs[1])


@functools.lru_cache(maxsize=2)
def _worker(model: bytes, names: tuple[tuple[str, str], ...]) -> tuple[Chain, Lexicon]:
    chain = Chain.load(model)
    return chain, Lexicon(dict(names), chain.w)


def mentions(texts: list[str], chain: Chain, lexicon: Lexicon, most_chars: int = 600_000) -> list[list[tuple[str, int, int]]]:
    """The mentions of each text, decoded in batches of texts of like length. `lexicon` has the chain's weights."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    lo = 0
    while lo < len(order):
        hi, chars = lo, 0
        while hi < len(order) and (hi == lo or chars + len(texts[order[hi]]) <= most_chars):
            chars += len(texts[order[hi]])
            hi += 1
        part = order[lo:hi]
        t = Tokens([texts[i] for i in part], lexicon)
        y = chain.viterbi(scores(t, lexicon, chain), t.sizes) if len(t.at) else np.zeros(0, np.int8)
        ends = np.cumsum(t.sizes)
        for i, a, b in zip(part, ends - t.sizes, ends):
            out[i] = spans_of(y[a:b], t.at[a:b], t.signs[a:b], texts[i])
        lo = hi
    return out


def training_sample(notes: DataFrame, gold: DataFrame, most: int = TRAIN_NOTES) -> DataFrame:
    """(text, spans) of at most `most` distinct notes with gold, those of the least key hash; spans: start, stop, type."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GOLD.items() for x in kv]), F.upper(F.trim("entity_type"))), F.lit("-"))
    g = gold.where("start IS NOT NULL AND stop > start AND document_id IS NOT NULL")
    g = g.groupBy(F.col("document_id").alias("_key")).agg(F.collect_set(F.struct("start", "stop", kind.alias("type"))).alias("spans"))
    g = g.orderBy(F.xxhash64("_key"), "_key").limit(most)
    n = notes.where("text IS NOT NULL").select(F.col("guid").alias("_key"), "text")
    return n.join(F.broadcast(g), "_key").groupBy("_key").agg(F.min("text").alias("text"), F.first("spans").alias("spans"))


def name_kinds(name_list: DataFrame) -> dict[str, str]:
    """Lower-cased single names with their kinds, from the fixed name list."""
    rows = name_list.where("name IS NOT NULL").groupBy(F.lower(F.trim("name")).alias("n")).agg(F.concat_ws("+", F.sort_array(F.collect_set("name_kind"))).alias("k")).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"a name list holds at most {MOST_NAMES} names")
    return {r["n"]: r["k"] for r in rows}


def trained_model(notes: DataFrame, gold: DataFrame, names: dict[str, str], most: int = TRAIN_NOTES) -> bytes:
    """The trained field as bytes (a few MB). Training runs in one task over the bounded sample."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key")
        spans = [[(s["start"], s["stop"], s["type"]) for s in r] for r in pdf["spans"]]
        return pd.DataFrame({"model": [train_field(pdf["text"].tolist(), spans, names).dump()]})

    rows = training_sample(notes, gold, most).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else Chain(LABELS, BITS).dump()


def find_personal(notes: DataFrame, model: bytes, names: dict[str, str], key: str = "guid", text: str = "text", placeholder: str | None = None) -> DataFrame:
    """Mentions of each note: `key`, entity_type, start, stop; or with `placeholder` (a format such as '[{}]') the
    `key`, n_mentions and redacted text of each distinct (key, text).

    Offsets are code points, half-open. Null and empty texts have no mentions; a null text is redacted to null. Rows
    with a null key are left out. Repeated rows give the same rows, which are returned once. Texts are decoded whole,
    whatever their length. Other columns are ignored. A field trained from no gold finds nothing.
    """
    spark = notes.sparkSession
    shared = spark.sparkContext.broadcast((model, tuple(sorted(names.items()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, lexicon = _worker(*shared.value)
        for p in batches:
            texts = p.column(1).to_pylist()
            found = mentions([t or "" for t in texts], chain, lexicon)
            if placeholder is None:
                at = np.repeat(np.arange(len(texts)), [len(m) for m in found])
                flat = [m for ms in found for m in ms]
                cols = [pa.array([m[i] for m in flat], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(at)), *cols], ["_key", "entity_type", "start", "stop"])
            else:
                done = [None if t is None else redacted(t, ms, placeholder) for t, ms in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([len(m) for m in found], pa.int32()), pa.array(done, pa.string())], ["_key", "n_mentions", "redacted"])

    kt = notes.schema[key].dataType.simpleString()
    schema = f"_key {kt}, entity_type string, start int, stop int" if placeholder is None else f"_key {kt}, n_mentions int, redacted string"
    d = notes.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return d.mapInArrow(run, schema).distinct().withColumnRenamed("_key", key)


def redacted(text: str, found: list[tuple[str, int, int]], placeholder: str = "[{}]") -> str:
    """The text with each mention replaced by its typed placeholder; the rest stays as it is."""
    parts, last = [], 0
    for kind, a, b in sorted(found, key=lambda m: m[1]):
        parts += [text[last:a], placeholder.format(kind)]
        last = b
    return "".join([*parts, text[last:]])
