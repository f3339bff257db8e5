"""Language identification by error-correcting output codes over character n-grams.

Every learned language has a codeword of bits, and every bit has a binary classifier: a logistic regression over
hashed n-grams of 1 to 4 bytes of the folded text, in which all ASCII symbols but letters are blanks and blanks
collapse. A text is the vector of the square roots of its n-grams' shares, whose length is one whatever the length
of the text. Up to seven languages get all 2^(n-1) - 1 ways to part them in two; beyond, 15 bits for each doubling
of their number, the best of some seeded random codes by least distance between codewords. Decoding is
loss-weighted: a bit counts for a language as much as its classifier was right on that language's rows kept
aside, and the language whose
codeword has the least weighted exponential loss is the prediction. `score` is its share among all languages,
from the losses; `ambiguous` says that the logarithm of the runner-up's loss is within `close` of the winner's.

Training sees a bounded sample: of the `max_languages` commonest values of `lang` (ties: the smaller), the
max_rows / n rows with the smallest hash of identifier and text each, by their commonest slots. Prediction reads
whole texts of all rows. The weights have 2^BITS slots for each bit of the code, whatever the corpus.

A null text, or one without a letter, gets `und` and the score 0, and isn't learned from; so does every text if
no row can be learned from. One language alone is always predicted. Rows whose `lang` is null are not learned
from. Very long texts are counted in slices. Repeated rows of the sample count once, and each gets its
prediction. An empty table gives an empty table. Extra columns are passed on, but for those with the names of the
results, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import vectext as V
from strandline.llm.storage import by_position

BITS, ORDERS, ROWS, SLICE = 15, (1, 2, 3, 4), 32, 1 << 18
MAX_ROWS, MAX_SLOTS, MAX_LANGUAGES = 8192, 4096, 1024
FACTOR = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


@dataclass
class Model:
    """`code` (languages x bits, of -1 and 1), `trust` (the same shape, rows add up to 1), and a classifier a bit."""

    languages: list[str]
    code: np.ndarray
    trust: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of folded bytes: each begins and ends with a blank, and no two blanks follow each other."""
    n = len(off) - 1
    low = V.fold_table()[data]
    low = np.where((low >= 0x61) & (low <= 0x7A) | (low >= 0x80), low, np.uint8(0x20))
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20)
    first = off[:-1][off[:-1] < off[1:]]
    keep[first] = True
    kept = np.concatenate(([0], np.cumsum(keep)))[off]
    at = kept + 2 * np.arange(n + 1)
    out = np.full(at[-1], 0x20, np.uint8)
    inner = np.ones(len(out), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[inner] = low[keep]
    return out, at


def counts(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x slots: how often the rows' n-grams fall into each slot."""
    n, slots = len(at) - 1, 1 << BITS
    out = np.zeros(n * slots, np.int64)
    for a in range(0, len(text), SLICE):
        b = min(a + SLICE, len(text))
        piece = text[a : b + max(ORDERS) - 1].astype(np.uint32)
        row = np.repeat(np.arange(n), np.diff(np.clip(at, a, b)))
        left = at[row + 1] - np.arange(a, b)
        gram, found = np.zeros(b - a, np.uint32), []
        for k in ORDERS:
            whole = piece[k - 1 : k - 1 + b - a]
            gram = gram[: len(whole)] << np.uint32(8) | whole
            h = gram * FACTOR[k - 1]
            h ^= h >> np.uint32(15)
            h *= FACTOR[0]
            h >>= np.uint32(32 - BITS)
            found.append((row[: len(whole)] * slots + h)[left[: len(whole)] >= k])
        out += np.bincount(np.concatenate(found), minlength=len(out))
    return out.reshape(n, slots)


def margins(found: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """rows x bits: the classifiers' outputs for the square roots of the rows' shares."""
    total = np.maximum(found.sum(1, keepdims=True), 1)
    return np.sqrt(found, dtype=np.float32) @ weights / np.sqrt(total) + bias


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        # Every way to part the languages in two; the first is always on the same side.
        return np.array([[1] + [1 - 2 * (c >> k & 1) for k in range(n - 1)] for c in range(1, 1 << (n - 1))], np.int8).T
    rng = np.random.default_rng(n)
    best, most = None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, 15 * int(np.ceil(np.log2(n)))))
        both = np.abs(code.astype(np.float32) @ code.T.astype(np.float32) - 2 * code.shape[1] * np.eye(n)).max(1)
        least = code.shape[1] - int(both.max())
        if least > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, least
    return best


def losses(margin: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """rows x languages: exponential loss of each codeword, weighted by what each bit is worth for it."""
    up, down = np.exp(-np.clip(margin, -30, 30)), np.exp(np.clip(margin, -30, 30))
    return up @ np.where(code > 0, trust, 0).T + down @ np.where(code < 0, trust, 0).T


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, epochs: int = 8, rate: float = 1.0, l2: float = 1e-6, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a logistic regression for every bit, by AdaGrad over seeded batches. `x` takes row
    numbers and returns their vectors; languages weigh alike, whatever their number of rows."""
    bits = code.shape[1]
    w, b = np.zeros((1 << BITS, bits), np.float32), np.zeros(bits, np.float32)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    weight = (len(y) / np.bincount(y, minlength=len(code)).clip(1) / len(code)).astype(np.float32)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            v, side = x(rows), code[y[rows]].astype(np.float32)
            used = np.flatnonzero(v.any(0))
            v = v[:, used]
            m = v @ w[used] + b
            g = -side / (1 + np.exp(np.clip(side * m, -30, 30))) * weight[y[rows], None]
            d = v.T @ g / len(rows) + l2 * w[used]
            gw[used] += d * d
            w[used] -= rate * d / np.sqrt(gw[used])
            d = g.mean(0)
            gb += d * d
            b -= 0.1 * rate * d / np.sqrt(gb)
    return w, b


def trusted(right: np.ndarray, y: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Share of a language's rows on which a bit was right, above chance; rows add up to 1."""
    out = np.array([(right[y == k] == code[k]).mean(0) if (y == k).any() else np.ones(code.shape[1]) for k in range(len(code))])
    out = np.maximum(out - 0.5, 1e-3)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def sample(df: DataFrame, text: str, lang: str, key: str, max_rows: int, max_languages: int) -> tuple[DataFrame, list[str]]:
    """h, lang and text of the rows to learn from, and the languages, in order."""
    t = F.col(f"`{text}`")
    rows = df.where(F.col(f"`{lang}`").isNotNull() & has_letter(t)).select(F.xxhash64(F.col(f"`{key}`").cast("string"), t).alias("h"), F.col(f"`{lang}`").cast("string").alias("lang"), t.alias("text"))
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("d")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not known:
        return rows.limit(0), []
    each = max(1, max_rows // len(known))
    # Hashes spread evenly: below this bound lie about twice the rows wanted, and only these are ranked. The
    # table has a row for each of `max_languages` languages at most.
    bounds = {r.lang: -(1 << 63) + min((1 << 64) - 1, (1 << 64) * (2 * each + 64) // max(r.d, 1)) for r in known}
    table = df.sparkSession.createDataFrame(sorted(bounds.items()), "lang string, bound long")
    near = rows.join(F.broadcast(table), "lang").where("h <= bound").select("h", "lang", "text").dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return near.withColumn("n", place).where(F.col("n") <= each).drop("n"), sorted(bounds)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_ROWS, max_slots: int = MAX_SLOTS, max_languages: int = MAX_LANGUAGES) -> Model:
    """`df`: rows to learn from. A row of the sample keeps its `max_slots` commonest slots."""
    rows, languages = sample(df, text, lang, key, max_rows, max_languages)
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, code.astype(float), np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))

    def grams(batches):
        for batch in batches:
            data, off = V.column_bytes(batch.column(2))
            slots, roots = [], []
            for a, b in zip(off, off[1:], strict=False):
                found = counts(*letters(data[a:b], np.array([0, b - a])))[0]
                k = np.sort(np.argsort(-found, kind="stable")[: min(max_slots, np.count_nonzero(found))])
                slots.append(k.astype(np.int32))
                roots.append(np.sqrt(found[k] / max(found.sum(), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32())), pa.array(roots, pa.list_(pa.float32()))], ["h", "lang", "slots", "roots"])

    def learn(batches):
        number = {la: k for k, la in enumerate(languages)}
        held = [(number[b.column(1)[r].as_py()], b.column(0)[r].as_py(), np.asarray(b.column(2)[r].values).astype(np.uint16), np.asarray(b.column(3)[r].values)) for b in batches for r in range(b.num_rows)]
        held.sort(key=lambda r: r[:2])
        y = np.array([r[0] for r in held])

        def dense(rows):
            out = np.zeros((len(rows), 1 << BITS), np.float32)
            for i, r in enumerate(rows):
                out[i, held[r][2]] = held[r][3]
            return out

        # Every fifth row of a language is kept aside, to see what each bit is worth for it.
        aside = (np.arange(len(y)) - np.searchsorted(y, y)) % 5 == 4
        own = np.flatnonzero(~aside)
        w, b = fit(lambda rows: dense(own[rows]), y[own], code)
        seen = np.flatnonzero(aside)
        right = np.concatenate([np.zeros((0, code.shape[1])), *(np.where(dense(seen[k : k + ROWS]) @ w + b >= 0, 1, -1) for k in range(0, len(seen), ROWS))])
        trust = trusted(right, y[seen], code)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (trust.astype(np.float64), w, b)], ["trust", "weights", "bias"])

    # One task: the fit sees `max_rows` rows at most, in a fixed order, as their slots.
    one = rows.repartition(16, "h").mapInArrow(grams, "h long, lang string, slots array<int>, roots array<float>").repartition(1).mapInArrow(learn, "trust binary, weights binary, bias binary").first()
    return Model(languages, code, np.frombuffer(one.trust).reshape(code.shape), np.frombuffer(one.weights, np.float32).reshape(1 << BITS, -1), np.frombuffer(one.bias, np.float32))


def predict(df: DataFrame, model: Model, text: str = "text", close: float = 0.05) -> DataFrame:
    """Every row with lang_pred, score and ambiguous."""
    results = ("lang_pred", "score", "ambiguous")
    df = df.drop(*results)
    inner, t = by_position(df), F.col(f"c{df.columns.index(text)}")
    kept = inner.schema.fields
    inner = inner.withColumn("t", F.when(has_letter(t), F.lower(t)))
    told = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def work(batches):
        m = told.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            n = batch.num_rows
            best, score, tied = np.full(n, len(m.languages)), np.zeros(n), np.zeros(n, bool)
            asked = np.flatnonzero(np.asarray(col.is_valid().to_numpy(zero_copy_only=False)))
            if len(m.languages) == 1:
                best[asked], score[asked] = 0, 1.0
            elif len(m.languages):
                data, off = V.column_bytes(col)
                for a in range(0, n, ROWS):
                    b = min(a + ROWS, n)
                    found = counts(*letters(data[off[a] : off[b]], off[a : b + 1] - off[a]))
                    best[a:b], score[a:b], tied[a:b] = decide(margins(found, m.weights, m.bias), m, close)
                lost = np.ones(n, bool)
                lost[asked] = False
                best[lost], score[lost], tied[lost] = len(m.languages), 0.0, False
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score), pa.array(tied)], schema.names)

    return inner.mapInArrow(work, schema).toDF(*df.columns, *results)


def decide(margin: np.ndarray, m: Model, close: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword (ties: the smaller), its share, and whether the next is about as near."""
    d = np.log(losses(margin.astype(np.float64), m.code, m.trust))
    best = d.argmin(1)
    rows = np.arange(len(d))
    least = d[rows, best]
    share = np.exp(-2 * (d - least[:, None]))
    score = 1 / share.sum(1)
    d[rows, best] = np.inf
    return best, score, d.min(1) - least < close


def held_out(key: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
