"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte 3- and 4-grams (lower case, white space
as one kind), hashed into a fixed number of rows.  Embeddings and softmax are trained
together by stochastic gradient descent; afterwards both collapse into one table of
scores per row, so prediction is a lookup and a sum over the whole text.  Scores are
calibrated by a temperature on held-out texts.  A softmax scores text of no known
language as freely as any, so texts are also measured by how familiar their subwords
are: the mean logarithm of the share that a row has in the languages learned.  Texts
below a low quantile of the held-out ones, by score or by familiarity, are rejected.
"""

from __future__ import annotations

import re
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from rolemill.llm.words import SPACES
from rolemill.plans.broadcast import broadcast_if_small
from rolemill.plans.session import materialize

ROWS = 1 << 16
DIM = 16
SAMPLE = 800  # most training texts of a language
MOST = 16_000  # most training texts of all languages together
EPOCHS = 6
RATE = 0.6
REJECTED = 0.0005  # share of held-out texts that the calibration lets go, half by score and half by familiarity
CHUNK = 1 << 20
UNKNOWN = "und"


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Rows of the 3- and 4-grams that start at every byte but the last ones."""
    x = data.astype(np.uint32)
    if len(x) < 3:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    three = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    four = three[:-1] * np.uint32(0x27D4EB2F) + x[3:] * np.uint32(0x165667B1)
    return [((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64) for h in (three, four)]


def _bytes(text: str) -> np.ndarray:
    """Lower-case bytes of a text between spaces."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    spaces = np.zeros(256, bool)
    spaces[list(SPACES)] = True
    return np.where(spaces[data], np.uint8(32), data)


def histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a text's subwords and their shares; adds up chunks, so any length fits."""
    data, total = _bytes(text), np.zeros(ROWS)
    for at in range(0, len(data), CHUNK):
        three, four = _grams(data[at:at + CHUNK + 3])
        total += np.bincount(three[:CHUNK], minlength=ROWS)
        total += np.bincount(four[:CHUNK], minlength=ROWS)
    found = np.flatnonzero(total)
    return found, total[found] / max(1.0, total.sum())


class Model:
    """Scores per subword row and, as last column, its familiarity; languages, temperature and the
    score and familiarity below which texts are rejected."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray):
        self.languages, self.table, self.bias = languages, table, bias
        self.temperature, self.least, self.familiar = 1.0, 0.0, -np.inf

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    def measure(self, text: str) -> tuple[np.ndarray, float]:
        """Logits and familiarity of a text."""
        data = _bytes(text)
        total, n = np.zeros(self.table.shape[1]), 0
        for at in range(0, len(data), CHUNK):
            for rows in _grams(data[at:at + CHUNK + 3]):
                counts = np.bincount(rows[:CHUNK], minlength=ROWS) if len(rows) > ROWS else None
                total += counts @ self.table if counts is not None else self.table[rows[:CHUNK]].sum(axis=0)
                n += min(len(rows), CHUNK)
        total /= max(1, n)
        return total[:-1] + self.bias, float(total[-1])


def _familiarity(examples: list[tuple[str, np.ndarray, np.ndarray]], languages: list[str]) -> np.ndarray:
    """Logarithm of each row's share in the languages, all languages alike; unseen rows have a small one."""
    total = np.zeros(ROWS)
    for name in languages:
        own = np.zeros(ROWS)
        for _, rows, shares in (e for e in examples if e[0] == name):
            own[rows] += shares
        total += own / max(1.0, own.sum())
    total += 1e-4 * len(languages) / ROWS
    return np.log(total / total.sum())


def low_quantile(values: np.ndarray, share: float) -> float:
    """The quantile of the values; where they are too few to reach it, their least or the normal tail, if that is lower."""
    found = float(np.quantile(values, share, method="inverted_cdf"))
    if len(values) * share < 1:
        found = min(found, float(np.mean(values) + NormalDist().inv_cdf(share) * np.std(values)))
    return found


def train_model(examples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """Fit on (language, rows, shares); every fifth example calibrates.  None without examples."""
    languages = sorted({e[0] for e in examples})
    if not languages:
        return None
    index = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    held, fit = (order[::5], np.delete(order, np.s_[::5])) if len(order) >= 10 else (order, order)
    table = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM))
    weights, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    steps = EPOCHS * len(fit)
    for step in range(steps):
        name, rows, shares = examples[fit[step % len(fit)]]
        if step % len(fit) == 0:
            rng.shuffle(fit)
        rate = RATE * (1 - step / steps)
        hidden = shares @ table[rows]
        z = hidden @ weights + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[index[name]] -= 1.0
        back = weights @ p
        weights -= rate * np.outer(hidden, p) * DIM
        bias -= 0.01 * rate * p
        table[rows] -= rate * np.outer(shares, back) * DIM
    scores = (table @ weights).astype(np.float32).astype(np.float64)
    model = Model(languages, np.column_stack((scores, _familiarity([examples[i] for i in fit], languages))), bias)
    measured = np.array([examples[i][2] @ model.table[examples[i][1]] for i in held])
    logits, familiar = measured[:, :-1] + bias, measured[:, -1]
    truth = np.array([index[examples[i][0]] for i in held])

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(truth)), truth], 1e-12)).sum()

    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = model.probabilities(logits)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    if len(right):
        model.least = float(np.quantile(right, REJECTED / 2, method="inverted_cdf"))  # of few scores the lowest
    if len(languages) > 1:  # every text scores 1/languages at least
        model.least = max(model.least, 1.05 / len(languages))
    # The least familiar language decides, so that a rare one stays.
    model.familiar = min(low_quantile(familiar[truth == i], REJECTED / 2) for i in np.unique(truth))
    return model


def fit(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample: int = SAMPLE, most: int = MOST) -> Model | None:
    """Train on a bounded sample: ``sample`` texts of every language, the first by hash, or all it has.

    Rows with equal id and text count once.  With more than ``most / sample`` languages
    each gives ``most / languages`` texts; more languages than ``most`` are an error.
    Tasks turn whole sampled texts, and a piece of each, into subword shares; at most
    ``2 * most`` of these reach the driver, where the descent runs, each with at most
    ``ROWS`` pairs of a two-byte row and a four-byte share.
    """
    usable = docs.where(F.coalesce(train, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    drawn = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"),
                          F.shiftrightunsigned(F.xxhash64(F.col(id), F.col(text)), 1).alias("key"))
    # One row per language each: about how many texts it has, then the last hash that is taken.
    texts = materialize(drawn.groupBy(F.col("lang").alias("_lang")).agg(F.approx_count_distinct("key").alias("_texts")),
                        "languages")
    languages = texts.count()
    if languages > most:
        raise ValueError(f"{languages} languages, but the sample has {most} texts")
    each = min(sample, most // max(1, languages))
    enough = F.lit(2.0 ** 63 * (2 * each + 20)) / F.col("_texts")  # a count that is off still leaves more than are taken
    first = (drawn.join(broadcast_if_small(texts), F.col("lang") == F.col("_lang")).where(F.col("key") <= enough)
             .select("_lang", "key").distinct()
             .withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("key"))).where(F.col("_n") <= each))
    last = broadcast_if_small(materialize(first.groupBy("_lang").agg(F.max("key").alias("_last")), "drawn"))
    chosen = (drawn.join(last, F.col("lang") == F.col("_lang")).where(F.col("key") <= F.col("_last"))
              .dropDuplicates(["lang", "key"]).select("lang", "text"))

    def features(batches):
        for batch in batches:
            out = []
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if has_letter(value):
                    at = len(value) // 3
                    piece = value[at:at + 160]
                    for part in (value, piece) if has_letter(piece) else (value,):
                        rows, shares = histogram(part)
                        out.append((name, rows.astype(np.uint16).tobytes(), shares.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary()),
                 pa.array([o[2] for o in out], pa.binary())], names=["lang", "rows", "shares"])

    got = chosen.mapInArrow(features, "lang string, rows binary, shares binary").toArrow()
    found = [e for batch in got.to_batches() for e in zip(*(batch.column(c).to_pylist() for c in ("lang", "rows", "shares")))]
    del got
    pa.default_memory_pool().release_unused()
    found.sort(key=lambda e: (e[0], len(e[1]), e[1], e[2]))  # whatever the order of tasks
    return train_model([(name, np.frombuffer(rows, np.uint16), np.frombuffer(shares, np.float32)) for name, rows, shares in found])


def has_letter(text: str) -> bool:
    """Whether some character is a letter by its category; numerals such as a half or a circled one are none."""
    return any(found[0].isalpha() for found in re.finditer(r"[^\W\d_]", text))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is
    every text if nothing could be learned.  A text with letters that looks like none of
    the languages keeps the nearest one and its score, and is rejected.  Ties go to the first language in order.  A
    column named like an added one is replaced.
    """
    added = ["lang_pred", "score", "rejected"]
    own = next(f.name for f in docs.schema if f.name == text)
    names = [f.name for f in docs.schema if f.name not in added]
    schema = StructType([docs.schema[n] for n in names] + [StructField("lang_pred", StringType()),
                                                           StructField("score", DoubleType()),
                                                           StructField("rejected", BooleanType())])

    def run(batches):
        for batch in batches:
            preds, scores, strange = [], [], []
            for value in batch.column(own):
                value = value.as_py()
                if model is None or not value or not has_letter(value):
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    strange.append(True)
                    continue
                logits, familiar = model.measure(value)
                p = model.probabilities(logits)
                best = int(p.argmax())
                preds.append(model.languages[best])
                scores.append(float(p[best]))
                strange.append(familiar < model.familiar)
            lost = [odd or s < model.least for odd, s in zip(strange, scores)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(lost, pa.bool_())], names=[*names, *added])

    return docs.mapInArrow(run, schema)
