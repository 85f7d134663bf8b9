"""Language identification with interpolated Kneser-Ney character models (operator 1).

Text is the sequence of its words: runs of letters and marks, lower-cased; a
word's end is a symbol too. Symbols have 12 bits (0 ends a word; code points
under 0x700 have codes of their own, the others share the rest by hash), so
that an n-gram of up to five symbols is one 64-bit word. For each language an
interpolated Kneser-Ney model of order ORDER is counted over whole texts: raw
counts at the top, continuation counts below, a discount n1 / (n1 + 2 n2) for
each order, a uniform floor.

The models are kept together as sorted hash arrays: the bijectively mixed
n-grams of all languages in order, an index by leading bits, and beside each
n-gram the log-probability under every language; contexts likewise with their
back-off weights. A text gets the language of least cross-entropy a symbol.
Its score is a calibrated probability (logistic regression of "was right" on
margin and length over calibration rows that no count has seen). It is
rejected when it has no letter, or when its cross-entropy lies so many standard
errors above its language's that a share of REJECTED of calibration rows would
lie there: the quantile among these rows, or if that is higher the point at
which an exponential tail through their upper TAIL has that share left. Fewer
than 1 / REJECTED calibration rows cannot tell such a share; then it must also
be CEILING times the largest cross-entropy of all these rows.

Fitting reads at most about `rows_per_language` rows and `bytes_per_language`
bytes of text a language (ROWS, BYTES; whole rows, a deterministic sample by
hash of the id) and takes at most `max_languages` languages, and fails if a
table has more. This bounds what the driver holds and broadcasts: a float for
each language and different n-gram of the sample. Everything that is predicted
is predicted from whole texts.

Defined results: a null text or one without letters (code points of the
categories L) is `und`, score 0, rejected; marks count only behind a letter; a
table without labelled text makes everything `und`; equal cross-entropies go
to the language first in alphabetical order; repeated rows get equal results;
columns named lang_pred, score, margin, entropy or rejected are replaced, all
others are passed through untouched; accepted() adds and replaces none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skald.llm.common import buffers, extended, mix, others, quoted, slices, tidy, unused

ORDER, BITS, ROWS, BYTES, LANGUAGES = 5, 12, 4000, 16 << 20, 256
REJECTED, TAIL, CEILING = 0.001, 0.05, 1.8
UNKNOWN = "und"
_OWN = 0x700
_TABLE = 0x20000


def _code(point: int) -> int:
    """The symbol of a code point, 0 if it is no letter or mark."""
    if unicodedata.category(chr(point))[0] not in "LM":
        return 0
    c = ord(chr(point).lower()[0])
    return c if c < _OWN else _OWN + (c * 40503 >> 4) % (4096 - _OWN)


_CODES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """The symbol of each code point under _TABLE, and which are marks."""
    if not _CODES:
        _CODES.append(np.array([_code(p) for p in range(_TABLE)], np.uint16))
        _CODES.append(np.array([unicodedata.category(chr(p))[0] == "M" for p in range(_TABLE)]))
    return _CODES


def symbols(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of some texts, one 0 after each word, and where each text's begin."""
    codes, marks = _tables()
    text = bytes(np.insert(raw, at[1:], 10)).decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, _TABLE - 1)
    code, mark = codes[low], marks[low]
    high = np.flatnonzero(points >= _TABLE)
    if high.size:
        kinds, which = np.unique(points[high], return_inverse=True)
        code[high] = np.array([_code(p) for p in kinds.tolist()], np.uint16)[which]
        mark[high] = np.array([unicodedata.category(chr(p))[0] == "M" for p in kinds.tolist()])[which]
    if mark.any():  # a word begins with a letter
        place = np.arange(len(points))
        letter = np.maximum.accumulate(np.where((code != 0) & ~mark, place, -1))
        gap = np.maximum.accumulate(np.where(code == 0, place, -1))
        code[mark & (letter <= gap)] = 0
    ends = _text_ends(raw, at, points)
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    where = np.append(0, np.cumsum(keep))
    return code[keep].astype(np.int64), where[np.append(0, ends)]


def _text_ends(raw: np.ndarray, at: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The point after each text's line feed."""
    lead = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    ends = lead[at[1:]] + np.arange(1, len(at))
    if len(ends) and ends[-1] != len(points):  # bytes that are no UTF-8: count again, text by text
        ends = np.cumsum([len(bytes(raw[a:b]).decode("utf-8", "replace")) + 1 for a, b in zip(at[:-1], at[1:])])
    return ends


def ngrams(code: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each symbol, it and the order - 1 before it in its word: the nearest in the low bits."""
    out, alive = code.copy(), np.ones(len(code), bool)
    for j in range(1, order):
        before = np.zeros_like(code)
        before[j:] = code[:-j]
        before[~alive] = 0
        alive &= before != 0
        out |= before << (BITS * j)
    return out


def _mask(n: int) -> int:
    return (1 << (BITS * n)) - 1


class _Language:
    """One language's model: for each order, its n-grams and contexts with probabilities and back-off weights."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.back: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        levels = {order: (grams, counts.astype(float))}
        for n in range(order - 1, 0, -1):
            short, many = np.unique(levels[n + 1][0] & _mask(n), return_counts=True)
            levels[n] = short, many.astype(float)
        for n in range(1, order + 1):
            key, count = levels[n]
            once, twice = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
            cut = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
            context, inverse, types = np.unique(key >> BITS, return_inverse=True, return_counts=True)
            total = np.bincount(inverse, count)
            self.back[n] = context, np.log(cut * types / total)
            lower = self.log_p(key & _mask(n - 1), n - 1) if n > 1 else np.full(len(key), -np.log(1 << BITS))
            self.grams[n] = key, np.log(np.maximum(count - cut, 0) / total[inverse] + np.exp(self.back[n][1][inverse] + lower))

    def log_p(self, key: np.ndarray, n: int) -> np.ndarray:
        """log P of each n-gram's symbol after its context."""
        if not n:
            return np.full(len(key), -np.log(1 << BITS))
        grams, p = self.grams[n]
        i = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
        hit = grams[i] == key
        out = np.where(hit, p[i], 0.0)
        rest = ~hit
        if rest.any():
            context, weight = self.back[n]
            c = key[rest] >> BITS
            j = np.minimum(np.searchsorted(context, c), len(context) - 1)
            out[rest] = np.where(context[j] == c, weight[j], 0.0) + self.log_p(key[rest] & _mask(n - 1), n - 1)
        return out


class _Sorted:
    """A sorted hash array with an index by leading bits and a row of floats for each key."""

    def __init__(self, key: np.ndarray, rows: np.ndarray):
        h = mix(key.astype(np.uint64))
        order = np.argsort(h)
        self.hash, self.rows = h[order], rows[order].astype(np.float32)
        bits = max(1, int(2 * len(h)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hash >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        h = mix(key.astype(np.uint64))
        lead = (h >> self.shift).astype(np.int64)
        i, end = self.first[lead], self.first[lead + 1]
        out = np.full(len(key), -1, np.int64)
        left = np.flatnonzero(i < end)
        i = i[left]
        while left.size:
            same = self.hash[i] == h[left]
            out[left[same]] = i[same]
            go = ~same & (i + 1 < end[left])
            left, i = left[go], i[go] + 1
        return out


class Model:
    """The languages' models together, and the calibration."""

    def __init__(self, languages: list[str], counted: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.languages, self.order = languages, order
        each = [_Language(*counted[x], order) for x in languages]
        self.grams, self.back = {}, {}
        for n in range(1, order + 1):
            key = np.unique(np.concatenate([x.grams[n][0] for x in each]))
            self.grams[n] = _Sorted(key, np.stack([x.log_p(key, n) for x in each], axis=1))
            context = np.unique(np.concatenate([x.back[n][0] for x in each]))
            rows = np.zeros((len(context), len(each)))
            for i, x in enumerate(each):
                rows[np.searchsorted(context, x.back[n][0]), i] = x.back[n][1]
            self.back[n] = _Sorted(context, rows)
        self.weights = np.array([0.0, 4.0, 0.5])
        self.mean = self.spread = np.zeros(len(languages))
        self.wide, self.limit = 1.0, np.inf
        self.ceiling = np.zeros(len(languages))

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """log P of each top-order n-gram under each language."""
        out = np.zeros((len(key), len(self.languages)), np.float32)
        left, rest = np.arange(len(key)), key
        for n in range(self.order, 0, -1):
            i = self.grams[n].find(rest)
            hit = i >= 0
            out[left[hit]] += self.grams[n].rows[i[hit]]
            left, rest = left[~hit], rest[~hit]
            if not left.size:
                return out
            j = self.back[n].find(rest >> BITS)
            known = j >= 0
            out[left[known]] += self.back[n].rows[j[known]]
            rest = rest & _mask(n - 1)
        out[left] -= np.float32(np.log(1 << BITS))
        return out

    def entropies(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a symbol of each text under each language (nats), and how many symbols it has."""
        raw, at = buffers(col)
        sums, many = np.zeros((len(at) - 1, len(self.languages))), np.zeros(len(at) - 1, np.int64)
        for lo, hi in slices(at, 1 << 20):
            code, begin = symbols(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            many[lo:hi] = np.diff(begin)
            if not len(code):
                continue
            p = self.log_p(ngrams(code, self.order))
            some = np.flatnonzero(np.diff(begin))
            sums[lo + some] = -np.add.reduceat(p, begin[:-1][some], axis=0, dtype=np.float64)
        return sums / np.maximum(many, 1)[:, None], many

    def judge(self, h: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: no letter), score, margin, and standard errors above the language's usual cross-entropy."""
        best = np.argmin(h, axis=1)
        ordered = np.sort(h, axis=1)
        margin = ordered[:, 1] - ordered[:, 0] if h.shape[1] > 1 else np.full(len(h), 10.0)
        z = np.stack([np.ones(len(h)), margin, np.log1p(many)], axis=1) @ self.weights
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        off = (ordered[:, 0] - self.mean[best]) / np.sqrt(self.spread[best] ** 2 + self.wide / np.maximum(many, 1))
        none = many == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, 0.0, margin), off

    def calibrate(self, h: np.ndarray, many: np.ndarray, truth: np.ndarray) -> None:
        """Fit score and rejection to rows of known language that the counts have not seen."""
        some = many > 0
        h, many, truth = h[some], many[some], truth[some]
        if not len(h):
            return
        own = h[np.arange(len(h)), truth]
        long = many >= np.median(many)
        mean = np.array([own[truth == i].mean() if (truth == i).any() else own.mean() for i in range(len(self.languages))])
        self.mean = mean
        square = np.where(long, (own - mean[truth]) ** 2, 0.0)
        pooled = square.sum() / long.sum()
        n = np.bincount(truth[long], minlength=len(self.languages))
        own_sum = np.bincount(truth, square, minlength=len(self.languages))
        self.spread = np.maximum(0.05, np.sqrt((own_sum + 30 * pooled) / (n + 30)))  # languages with few rows lean on all
        excess = (own - mean[truth]) ** 2 - self.spread[truth] ** 2
        self.wide = max(0.5, float(np.mean(np.maximum(excess, 0) * many)))
        best, _, _, off = self.judge(h, many)
        self.limit = upper_limit(off)
        if len(off) < 1 / REJECTED:  # too few rows to tell so small a share by
            self.ceiling = np.full(len(self.languages), CEILING * own.max())
        right = (best == truth).astype(float)
        ordered = np.sort(h, axis=1)
        margin = ordered[:, 1] - ordered[:, 0] if h.shape[1] > 1 else np.full(len(h), 10.0)
        x = np.stack([np.ones(len(h)), margin, np.log1p(many)], axis=1)
        prior = np.array([0.0, 4.0, 0.5])
        w = prior.copy()
        for _ in range(30):  # ridge towards the prior, so that rows without errors give finite weights
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3), x.T @ (right - p) - (w - prior))
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w


def upper_limit(off: np.ndarray, share: float = REJECTED, tail: float = TAIL) -> float:
    """What a share of such values exceeds: their quantile, or the exponential tail's through the upper ones if that is higher."""
    x = np.sort(off)
    i = int(np.ceil((len(x) + 1) * (1 - share))) - 1
    start = np.quantile(x, 1 - tail)
    above = x[x > start] - start
    mean = above.mean() * (1 + 2 / np.sqrt(len(above))) if len(above) else 1.0  # two standard errors of it up: few rows tell little of a tail
    fitted = start + mean * np.log(tail / share)
    return float(max(fitted, x[min(i, len(x) - 1)]))


def _sampled(labelled: DataFrame, id_col: str, lang_col: str, text_col: str, rows: int, size: int, most: int) -> DataFrame:
    """About rows rows and size bytes of each language, by hash of the id: all of a language that has fewer."""
    counts = labelled.groupBy(lang_col).agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("b")).limit(most + 1).collect()  # a row for each language
    if len(counts) > most:
        raise ValueError(f"more than {most} languages; raise max_languages if the driver can hold their models")
    if not counts:
        return labelled.limit(0)
    share = F.create_map(*[x for k, n, b in counts for x in (F.lit(k), F.lit(min(1.0, rows / n, size / max(1, b))))])
    return labelled.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) < F.element_at(share, F.col(lang_col)) * 1_000_000)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS, bytes_per_language: int = BYTES, max_languages: int = LANGUAGES, order: int = ORDER) -> Model | None:
    """A model of the labelled rows of docs, or None if there are none. A fifth of the sample calibrates."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    chosen = _sampled(labelled, "id", "lang", "text", rows_per_language, bytes_per_language, max_languages).withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)) == 0)
    schema = "lang string, gram long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            which = lang.indices.to_numpy(zero_copy_only=False)
            raw, at = buffers(batch.column(1))
            for lo, hi in slices(at):
                code, begin = symbols(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                g = ngrams(code, order)
                owner = np.repeat(which[lo:hi], np.diff(begin))
                for i in np.unique(owner):
                    key, n = np.unique(g[owner == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang.dictionary[int(i)].as_py()] * len(key), pa.string()), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    table = chosen.filter("not calibrates").select("lang", "text").mapInArrow(tidy(count), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if table.empty:
        return None
    counted = {}
    for name, part in table.sort_values(["lang", "gram"]).groupby("lang"):
        counted[name] = part["gram"].to_numpy(), part["n"].to_numpy()
    languages = sorted(counted)
    model = Model(languages, counted, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, many = shared.value.entropies(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(many)], names=["lang", "h", "many"])

    rows = chosen.filter(F.col("calibrates") & F.col("lang").isin(languages)).select("lang", "text").mapInArrow(tidy(weigh), "lang string, h array<double>, many long").toPandas()
    if len(rows):
        model.calibrate(np.stack(rows["h"].to_numpy()), rows["many"].to_numpy(), np.array([languages.index(x) for x in rows["lang"]]))
    return model


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, margin, entropy and rejected; map-only."""
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = others(docs.columns, *(f.name for f in new))
    where = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            if m is None:
                cols = [pa.array([UNKNOWN] * n, pa.string()), pa.array([0.0] * n), pa.array([0.0] * n), pa.array([0.0] * n), pa.array([True] * n)]
            else:
                h, many = m.entropies(batch.column(where))
                best, score, margin, off = m.judge(h, many)
                names = [*m.languages, UNKNOWN]
                least = np.where(many > 0, h.min(axis=1) if n else 0.0, 0.0)
                cols = [pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score), pa.array(margin), pa.array(least), pa.array((best < 0) | ((off > m.limit) & (least > m.ceiling[best])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[str(i) for i in range(batch.num_columns + len(cols))])

    return extended(docs.select(*[F.col(quoted(c)) for c in kept]), run, new)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from all learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Train on the rows of docs that are not held out, then predict all of them from their text alone."""
    model = train(docs.filter(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    return predict(docs, model, text_col=text_col)


def accepted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """docs, as they are, without the rows whose language is rejected."""
    model = train(docs.filter(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    names = unused(docs.columns, *(f"_c{i}" for i in range(len(docs.columns))))
    found = predict(docs.toDF(*names), model, text_col=names[docs.columns.index(text_col)])
    return found.filter("not rejected").select(*names).toDF(*docs.columns)
