"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased n-grams of 1 to 3 characters (code points) are hashed to ``DIMS`` columns, counted over
the whole text, damped and weighted by IDF, and scaled to length 1. Weights are trained with
follow-the-regularised-leader (per-coordinate steps, elastic-net penalty, so most stay exactly 0).
A temperature fitted on a calibration part of the sample scales the logits before the softmax.

Defined results: ``und`` with score 0 for null texts and texts without a letter; with no training
rows every text is ``und``. Ties go to the first language in code-point order. Rows that repeat
doc_id, lang and text train once; every row gets a prediction of its own. Columns of the input
besides those asked for are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.scratch import holdout_fold

DIMS = 8192
MAX_N = 3
#: The fit uses the rows of the lowest hashes of each language, this many at most, and so many of all languages.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 600, 8000
#: Classes of a model: the languages with most rows.
MAX_LANGUAGES = 400
EPOCHS, BATCH = 4, 16
ALPHA, BETA, L1, L2 = 0.4, 1.0, 0.05, 0.02
UNKNOWN = "und"
#: Share of held-out rows, predicted right, that the least score of a clear prediction may lose.
HELD_OUT_LOSS, EVEN = 0.005, 0.5

_LETTER = regex.compile(r"\p{L}")
#: Texts longer than this are counted in pieces that overlap by MAX_N - 1 characters.
PIECE_CHARS = 2_000_000
_SPREAD = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def gram_counts(text: str) -> np.ndarray:
    """Occurrences of each hashed character n-gram in the whole text."""
    low = text.lower()
    out = np.zeros(DIMS)
    for at in range(0, len(low), PIECE_CHARS):
        old = min(at, MAX_N - 1)
        char = np.frombuffer(low[at - old : at + PIECE_CHARS].encode("utf-32-le"), dtype="<u4")
        code = np.zeros(len(char), dtype=np.uint32)
        for n in range(1, min(MAX_N, len(char)) + 1):
            code = (code[: len(char) - n + 1] ^ char[n - 1 :]) * _SPREAD
            code ^= code >> np.uint32(15)
            # n-grams that end in the overlap were counted with the piece before
            fresh = code[max(0, old - n + 1) :] * np.uint32(2654435769) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            out += np.bincount((fresh >> np.uint32(19)).astype(np.int64), minlength=DIMS)
    return out


assert DIMS == 1 << 13  # as many hash bits as gram_counts keeps

Sparse = tuple[np.ndarray, np.ndarray]


def sparse_counts(text: str) -> Sparse:
    """Columns of a text's n-grams and how often each occurs."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    return at.astype("<u2"), counts[at].astype("<f4")


class Model:
    def __init__(self, langs: list[str]):
        self.langs = langs
        self.idf = np.ones(DIMS)
        self.weight = np.zeros((DIMS, len(langs)))
        self.bias = np.zeros(len(langs))
        self.temperature = 1.0

    def features(self, texts: list[str]) -> np.ndarray:
        x = np.log1p(np.stack([gram_counts(t) for t in texts])) * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for k in range(0, len(at), 64):
            some = at[k : k + 64]
            p = softmax(self.logits(self.features([texts[i] for i in some])) / self.temperature)
            for i, row in zip(some, p, strict=True):
                j = int(row.argmax())
                out[i] = (self.langs[j], float(row[j]))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader, proximal: weights follow from two sums a coordinate."""

    def __init__(self, columns: int, classes: int):
        self.z, self.n = np.zeros((columns, classes)), np.zeros((columns, classes))
        #: The last column is the bias, which no L1 penalty holds at 0.
        self.l1 = np.full((columns, 1), L1)
        self.l1[-1] = 0.0

    def weights(self) -> np.ndarray:
        open_ = np.abs(self.z) > self.l1
        return np.where(open_, -(self.z - np.sign(self.z) * self.l1) / ((BETA + np.sqrt(self.n)) / ALPHA + L2), 0.0)

    def step(self, x: np.ndarray, target: np.ndarray, heed: np.ndarray) -> None:
        """One mini-batch: rows of features and of class shares, and how much each row counts."""
        w = self.weights()
        g = x.T @ ((softmax(x @ w) - target) * heed[:, None]) / len(x)
        sigma = (np.sqrt(self.n + g * g) - np.sqrt(self.n)) / ALPHA
        self.z += g - sigma * w
        self.n += g * g


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss, with one more row, of every class alike, added to the rows.

    Without it, rows that are all predicted right would ask for a temperature of 0.
    """
    n, classes = logits.shape
    target = np.full((n, classes), 1 / (classes * (n + 1)))
    target[np.arange(n), y] += n / (n + 1)
    loss = lambda t: -(target * np.log(softmax(logits / t) + 1e-300)).sum()
    return float(min(np.geomspace(0.02, 5.0, 120), key=loss))


def fit(rows: list[Sparse], langs: list[str]) -> Model:
    """Train on shuffled mini-batches of counted texts; every fifth text only calibrates."""
    model = Model(sorted(set(langs)))
    if not rows:
        return model
    seen = np.zeros(DIMS)
    for at, _ in rows:
        seen[at] += 1
    model.idf = np.log((1 + len(rows)) / (1 + seen)) + 1

    def dense(part) -> np.ndarray:
        # the sample stays sparse: a batch at a time becomes dense
        out = np.zeros((len(part), DIMS + 1))
        out[:, -1] = 1.0
        for k, i in enumerate(part):
            at, count = rows[i]
            value = np.log1p(count.astype(float)) * model.idf[at]
            out[k, at] = value / max(float(np.sqrt((value * value).sum())), 1e-12)
        return out

    y = np.array([model.langs.index(v) for v in langs])
    calibrates = np.flatnonzero(np.arange(len(y)) % 5 == 4)
    train = np.flatnonzero(np.arange(len(y)) % 5 != 4)
    one = np.eye(len(model.langs))
    # languages count alike, so that a text of none of them is not given to the one with most rows
    share = np.bincount(y[train], minlength=len(model.langs))
    heed = len(train) / np.maximum(share, 1) / max(int((share > 0).sum()), 1)
    leader = Ftrl(DIMS + 1, len(model.langs))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            leader.step(dense(part), one[y[part]], heed[y[part]])
    w = leader.weights()
    model.weight, model.bias = w[:-1], w[-1]
    if len(calibrates):
        logits = np.concatenate([dense(part) @ w for part in np.array_split(calibrates, -(-len(calibrates) // 64))])
        model.temperature = calibrated(logits, y[calibrates])
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sparse_counts(t) for t in batch.column("text").to_pylist()]
        cells = [pa.array([at.tobytes() for at, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), *cells], ["lang", "h", "cols", "counts"])


def train(docs: DataFrame) -> Model:
    """Fit on texts with a known language outside the held-out fold, so many per language by hash of id and text.

    Languages are counted first; each then takes its lowest hashes, so a language with most of the
    rows is bounded like the others and no task gathers one. What the driver collects are n-gram
    counts, DIMS of them a row at most, and one row a class.
    """
    known = docs.filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & (holdout_fold(F.col("doc_id")) != 0))
    hashed = known.select("lang", F.xxhash64("doc_id", "text", F.lit("fit")).alias("h"), "text")
    sizes = [(r["lang"], r["count"]) for r in known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES).collect()]
    if not sizes:
        return fit([], [])
    most = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(sizes)))
    levels = []
    for lang, size in sizes:
        # hashes are uniform: the lowest ones lie under this level, with room to spare
        share = (most + 6 * most**0.5) / size
        levels.append((lang, 2**63 - 1 if share >= 1 else int(-(2**63) + share * (2**64 - 1))))
    level = F.broadcast(docs.sparkSession.createDataFrame(levels, "__lang string, __level long"))
    chosen = hashed.join(level, (F.col("lang") == F.col("__lang")) & (F.col("h") <= F.col("__level")))
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))
    found = chosen.select("lang", "h", "text").mapInArrow(_counted, "lang string, h long, cols binary, counts binary").collect()
    nth = {lang: 0 for lang, _ in sizes}
    rows, langs = [], []
    for r in sorted(found, key=lambda r: (r["h"], r["lang"])):
        nth[r["lang"]] += 1
        if nth[r["lang"]] <= most:
            rows.append((np.frombuffer(r["cols"], "<u2"), np.frombuffer(r["counts"], "<f4")))
            langs.append(r["lang"])
    return fit(rows, langs)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns plus the predicted language and its score, called ``names``, of every whole text.

    with_text: the text is one of ``keep`` and goes to the workers once.
    """
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if with_text else [F.col("text").alias("__text")]))
    at = keep.index("text") if with_text else len(keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(at).to_pylist())
            more = [pa.array([lang for lang, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *more], [*keep, *names])

    return source.mapInArrow(run, f"{kinds}, `{names[0]}` string, `{names[1]}` double")


def least_score(docs: DataFrame, model: Model) -> float:
    """The score under which a prediction is no better than for texts of no learned language.

    All but HELD_OUT_LOSS of the held-out rows that are predicted right score more; even odds suffice
    always, and are asked for where no row is held out.
    """
    held = docs.filter((holdout_fold(F.col("doc_id")) == 0) & F.col("lang").isNotNull()).select("lang", "text")
    right = F.when(F.col("lang") == F.col("__lang"), F.col("__score"))
    low = identify(held, model, keep=("lang",), names=("__lang", "__score")).agg(F.percentile_approx(right, HELD_OUT_LOSS, 10_000)).first()[0]
    return EVEN if low is None else min(EVEN, low)


def predict_all(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    found = identify(docs, train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (holdout_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
