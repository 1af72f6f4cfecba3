"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other.

Each view has a logistic classifier of its own. Both begin with the labelled rows; in each round both score all
documents (from features that are written once), either labels those without label that it is surest of, and these
join the training rows of the other. At the end each view is calibrated on labelled rows that were held back, and a logistic combination of both scores all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, discard, materialize, new_path, table, whole_row

#: Labelled rows that fitting may use, chosen by a seeded hash of the id.
LABELLED_ROWS = 6000
#: Rounds of pseudo-labels over all documents, and how many each view gives the other in a round.
ROUNDS, PER_ROUND = 3, 400
#: Log odds that a pseudo-label needs at least.
SURE = 2.0
TEXT_BITS, META_SIZE = 16, 2048
#: Share of good documents in the calibration rows that the threshold may reject.
LOST_GOOD = 0.002
#: Distinct words that a worker remembers, and their characters.
MEMO, MEMO_CHARS = 400_000, 1 << 25


class _Shapes(dict):
    """Signs by the class a shape has for them: letters a or A, digits 0; others stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = x = "0" if "0" <= c <= "9" else c if not c.isalpha() else "a" if c.islower() else "A"
        return x


_SHAPES, _AGAIN = _Shapes(), re.compile(r"(.)\1+")
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))


def words_slots(words: Iterable[str]) -> Iterator[tuple[int, int]]:
    """Slots of each word and of its shape (signs by class, runs shortened to one), for all words at once.

    The last 64 slots are kept for statistics of the whole text. No word has white space in it.
    """
    n, joined = (1 << TEXT_BITS) - 64, "\n".join(words)
    shapes = _AGAIN.sub(r"\1", joined.translate(_SHAPES)).encode()
    crc = zlib.crc32
    for a, b in zip(joined.lower().encode().split(b"\n"), shapes.split(b"\n"), strict=True):
        yield crc(a) % n, crc(b"\0" + b) % n


def repetition_slots(words: list[str]) -> list[int]:
    """Slots of whole-text statistics: share of distinct words (length by length), of words equal to the one before."""
    n = len(words)
    base = (1 << TEXT_BITS) - 64
    if not n:
        return [base]
    distinct = int(15.99 * len(set(words)) / n)
    again = int(15.99 * min(1.0, 4 * sum(map(eq, words, words[1:])) / n))
    return [base + 1 + distinct, base + 17 + again, base + 33 + min(15, int(np.log2(n)))]


def meta_slots(text: str, lang, source, n_chars) -> list[int]:
    """Slots of what is known about a page rather than said in it: source, language, sizes, lines, kinds of signs."""
    raw = text.encode()
    n = max(1, len(raw))
    lines = text.count("\n") + 1

    def share(signs: bytes) -> int:
        return int(np.ceil(24 * ((n - len(raw.translate(None, signs))) / n) ** 0.5))

    known = n_chars is not None and n_chars == n_chars
    facts = (
        ("source", source), ("lang", lang), ("chars", int(np.log2(max(0, n_chars) + 1)) if known else None), ("punct", share(_PUNCT)),
        ("upper", share(_UPPER)), ("digit", share(_DIGIT)), ("space", share(b" \t\n\r")), ("lines", int(np.log2(lines))), ("line", int(np.log2(n / lines + 1))),
        ("pipes", share(b"|")), ("shout", share(b"!")),
    )
    return [zlib.crc32(f"{k}={v}".encode()) % META_SIZE for k, v in facts]


class Packer:
    """Slots of words and of their shapes, two numbers of 16 bits a word; computed once, forgotten when too many are held."""

    def __init__(self):
        self.held: dict[str, int] = {}
        self.chars = 0

    def pack(self, texts: list[list[str]]) -> list[bytes]:
        new = list(set().union(*texts) - self.held.keys())
        self.chars += sum(map(len, new))
        if len(self.held) + len(new) > MEMO or self.chars > MEMO_CHARS:
            self.held.clear()
            new = list(set().union(*texts))
            self.chars = sum(map(len, new))
        if new:
            self.held.update(zip(new, (a | b << 16 for a, b in words_slots(new)), strict=True))
        return [np.fromiter(map(self.held.__getitem__, t), "<u4", len(t)).tobytes() for t in texts]


_packer: Packer | None = None


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, slots, stats, meta) of all documents with an id, written once: what rounds read in place of texts.

    slots: of each word and its shape, in the text's order; stats: of the whole text; meta: of the page.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        global _packer
        _packer = _packer or Packer()
        for b in batches:
            words = [t.split() for t in b["text"]]
            meta = [np.array(meta_slots(*row), "<i4").tobytes() for row in zip(b["text"], b["lang"], b["source"], b["n_chars"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": [len(w) for w in words], "slots": _packer.pack(words), "stats": [np.array(repetition_slots(w), "<i4").tobytes() for w in words], "meta": meta})

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    made = rows.mapInPandas(run, "doc_id long, n_words long, slots binary, stats binary, meta binary")
    path = new_path(docs.sparkSession, "cotrain-features")
    made.write.option("compression", "zstd").parquet(path)
    held = docs.sparkSession.read.schema(made.schema).parquet(path)
    held.written_to = path
    return held


def text_vector(n_words: int, slots: bytes, stats: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the text view: mean over words of word and shape slots, and the statistics."""
    at, count = np.unique(np.frombuffer(slots, "<u2"), return_counts=True)
    extra = np.frombuffer(stats, "<i4")
    return np.concatenate((at, extra)).astype(np.int32), np.concatenate((10.0 * count / max(1, n_words), np.ones(len(extra)))).astype(np.float32)


def row_sums(weights: np.ndarray, parts: list[bytes], kind: str) -> np.ndarray:
    """Sum of the weights of each row's slots."""
    size = np.array([len(p) for p in parts]) // np.dtype(kind).itemsize
    out, full = np.zeros(len(parts)), np.flatnonzero(size)
    if len(full):
        start = np.cumsum(size) - size
        out[full] = np.add.reduceat(weights[np.frombuffer(b"".join(parts), kind)], start[full])
    return out


class Memo:
    """Weights of words, each its slot's plus its shape's; computed once, forgotten when too many are held."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.held, self.chars = weights, {}, 0

    def sums(self, texts: list[list[str]]) -> list[float]:
        """Sum of the weights of each text's words."""
        new = list(set().union(*texts) - self.held.keys())
        self.chars += sum(map(len, new))
        if len(self.held) + len(new) > MEMO or self.chars > MEMO_CHARS:
            self.held.clear()
            new = list(set().union(*texts))
            self.chars = sum(map(len, new))
        if new:
            at = np.array(list(words_slots(new)))
            self.held.update(zip(new, (self.weights[at[:, 0]].astype(float) + self.weights[at[:, 1]]).tolist(), strict=True))
        return [sum(map(self.held.__getitem__, t)) for t in texts]


_memo: tuple | None = None


def memo_of(model, weights: np.ndarray) -> Memo:
    """The memo of a worker for the model at hand, kept from task to task."""
    global _memo
    if _memo is None or _memo[0] is not model:
        _memo = (model, Memo(weights))
    return _memo[1]


@dataclass
class Sparse:
    """Rows of a sparse matrix."""

    row: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        return cls(
            np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows]), np.concatenate([s for s, _ in rows] or [np.zeros(0, np.int64)]).astype(np.int64),
            np.concatenate([v for _, v in rows] or [np.zeros(0)]).astype(np.float64), len(rows),
        )

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.slot], minlength=self.n)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, size: int, steps: int = 60, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression by AdaGrad over all rows; ``weight`` 0 leaves a row out. The last slot is the bias."""
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    used = weight[x.row] > 0
    part = Sparse(x.row[used], x.slot[used], x.value[used], x.n)
    total = max(1.0, weight.sum())
    for _ in range(steps):
        error = (sigmoid(part.dot(w) + w[-1]) - y) * weight / total
        g = np.bincount(part.slot, part.value * error[part.row], minlength=size + 1)[: size + 1] + decay * w
        g[-1] = error.sum()
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def dense_logit(z: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression on few dense columns (with a bias) by Newton's method, lightly held back."""
    a = np.column_stack((z, np.ones(len(z))))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        h = a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
    return w


@dataclass
class Model:
    """Weights of both views, their calibration (slope and bias), the combination, and the threshold."""

    text: np.ndarray
    meta: np.ndarray
    platt_text: np.ndarray
    platt_meta: np.ndarray
    both: np.ndarray
    threshold: float


@dataclass
class Rows:
    """Features of rows in both views, by id."""

    ids: np.ndarray
    text: list[tuple[np.ndarray, np.ndarray]]
    meta: list[np.ndarray]

    def views(self) -> tuple[Sparse, Sparse]:
        return Sparse.of(self.text), Sparse.of([(m, np.ones(len(m))) for m in self.meta])

    def and_also(self, other: Rows) -> Rows:
        return Rows(np.concatenate((self.ids, other.ids)), self.text + other.text, self.meta + other.meta)


def features(packed: DataFrame, ids: DataFrame) -> Rows:
    """Features of the packed documents whose id is among ``ids`` (doc_id; few, by LABELLED_ROWS or PER_ROUND), a row an id."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, n, slots, stats, meta in zip(b["doc_id"], b["n_words"], b["slots"], b["stats"], b["meta"], strict=True):
                at, values = text_vector(n, slots, stats)
                rows.append((d, at.tobytes(), values.tobytes(), meta))
            yield pd.DataFrame(rows, columns=["doc_id", "slots", "values", "meta"])

    found = packed.join(F.broadcast(ids), "doc_id").mapInPandas(run, "doc_id long, slots binary, values binary, meta binary")
    # an id that is repeated is one row before it goes to the driver
    found = found.groupBy("doc_id").agg(F.min(F.struct("slots", "values", "meta")).alias("f")).select("doc_id", "f.*").toPandas()
    found = found.iloc[np.lexsort((found["doc_id"], [zlib.crc32(str(d).encode()) for d in found["doc_id"]]))]
    return Rows(
        found["doc_id"].to_numpy(np.int64), [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for s, v in zip(found["slots"], found["values"], strict=True)],
        [np.frombuffer(m, np.int32) for m in found["meta"]],
    )


def logits(texts: list[str], lang, source, n_chars, text: np.ndarray, meta: np.ndarray, memo: Memo) -> np.ndarray:
    """Log odds of each row in both views."""
    words = [t.split() for t in texts]
    z = np.zeros((len(texts), 2))
    for k, (t, w, total, a, b, n) in enumerate(zip(texts, words, memo.sums(words), lang, source, n_chars, strict=True)):
        z[k, 0] = 10.0 * total / max(1, len(w)) + text[repetition_slots(w)].sum() + text[-1]
        z[k, 1] = meta[meta_slots(t, a, b, n)].sum() + meta[-1]
    return z


def surest(packed: DataFrame, labelled: DataFrame, models: list[np.ndarray], good: float, given: list[set[int]]) -> list[dict[int, float]]:
    """For each view the ids of documents that the other is surest of, with the pseudo-label; PER_ROUND at most.

    All documents without label are scored by both models. given: ids that each view has been given before.
    """
    spark = packed.sparkSession
    shared = spark.sparkContext.broadcast(models)  # the slots of both views

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, meta = shared.value
        for b in batches:
            z0 = 10.0 * row_sums(text, b["slots"].tolist(), "<u2") / np.maximum(1, b["n_words"]) + row_sums(text, b["stats"].tolist(), "<i4") + text[-1]
            yield pd.DataFrame({"doc_id": b["doc_id"], "z0": z0, "z1": row_sums(meta, b["meta"].tolist(), "<i4") + meta[-1]})

    scored = packed.mapInPandas(run, "doc_id long, z0 double, z1 double")
    free = materialize(scored.groupBy("doc_id").agg(F.min("z0").alias("z0"), F.min("z1").alias("z1")).join(labelled.hint("merge"), "doc_id", "left_anti"), "cotrain-scores")
    n_good = round(PER_ROUND * good)
    out: list[dict[int, float]] = []
    for other in (0, 1):
        z, rest = F.col(f"z{1 - other}"), free
        if given[other]:  # ROUNDS * PER_ROUND at most
            rest = free.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(given[other])], "doc_id long")), "doc_id", "left_anti")
        found = {}
        for label, order, n in ((1.0, z.desc(), n_good), (0.0, z.asc(), PER_ROUND - n_good)):
            sure = rest.where(z > SURE if label else z < -SURE).orderBy(order, "doc_id").limit(n)
            found |= {r["doc_id"]: label for r in sure.collect()}
        out.append(found)
    discard(free)
    shared.destroy()
    return out


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS, seed: int = 11) -> Model | None:
    """Fit on at most ``labelled_rows`` labelled documents, and on pseudo-labels of all others.

    Rows with a null id or label teach nothing. Where an id has several labels, the least counts; where it has several
    documents, one of them does. None if the labels lack one of the two classes. An empty table has no labelled rows.
    """
    arrow_rows(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y"))
    known = materialize(known.groupBy("doc_id").agg(F.min("y").alias("y")), "cotrain-labels")
    chosen = materialize(known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(labelled_rows), "cotrain-chosen")
    truth = {r["doc_id"]: r["y"] for r in chosen.collect()}
    packed = pack(docs)
    own = features(packed, chosen.select("doc_id"))
    y = np.array([truth[int(d)] for d in own.ids], float)
    if len(np.unique(y)) < 2:
        discard(known, chosen, packed)
        return None
    held = np.arange(len(y)) % 3 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        taught = held = np.ones(len(y), bool)
    else:
        taught = ~held
    more = Rows(np.zeros(0, np.int64), [], [])
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels of each view
    models: list[np.ndarray] = []
    for turn in range(rounds + 1):
        rows = own.and_also(more)
        models = []
        for k, (x, size) in enumerate(zip(rows.views(), (1 << TEXT_BITS, META_SIZE), strict=True)):
            target = np.concatenate((y, [given[k].get(int(d), 0.0) for d in more.ids]))
            weight = np.concatenate((taught.astype(float), [0.5 * (int(d) in given[k]) for d in more.ids]))
            models.append(fit(x, target, weight, size))
        if turn == rounds:
            break
        new = surest(packed, known.select("doc_id"), models, float(y[taught].mean()), [set(g) for g in given])
        given = [g | n for g, n in zip(given, new, strict=True)]
        fresh = sorted(set().union(*new) - set(more.ids.tolist()))
        if not any(new):
            continue
        if fresh:
            more = more.and_also(features(packed, docs.sparkSession.createDataFrame([(i,) for i in fresh], "doc_id long")))
    z = [x.dot(m) + m[-1] for x, m in zip(own.views(), models, strict=True)]
    answer = y[held]
    platt = [dense_logit(s[held][:, None], answer) for s in z]
    calibrated = np.column_stack([s * p[0] + p[1] for s, p in zip(z, platt, strict=True)])
    both = dense_logit(calibrated[held], answer)
    score = sigmoid(calibrated[held] @ both[:-1] + both[-1])
    threshold = min(0.5, float(np.quantile(score[answer == 1], LOST_GOOD)))
    discard(known, chosen, packed)
    return Model(models[0].astype(np.float32), models[1].astype(np.float32), platt[0], platt[1], both, threshold)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with p_text, p_meta (calibrated views), score (both) and keep.

    Null or empty text, language, source and size are values like others; repeated rows have equal scores; a text of any
    length is scored whole, as one list of words. Without a model (no labels of both classes) all scores are 1 and
    everything stays. An empty table gives an empty result. Of docs' own columns, those named like a new one give way
    to it; all others pass through.
    """
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the slots of both views

    @F.pandas_udf("p_text double, p_meta double, score double, keep boolean")
    def quality(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        m = shared.value
        if m is None:
            one = np.ones(len(text))
            return pd.DataFrame({"p_text": one, "p_meta": one, "score": one, "keep": one > 0})
        z = logits(text.tolist(), lang, source, n_chars, m.text, m.meta, memo_of(m, m.text[:-1]))
        c = np.column_stack((z[:, 0] * m.platt_text[0] + m.platt_text[1], z[:, 1] * m.platt_meta[0] + m.platt_meta[1]))
        p = sigmoid(c @ m.both[:-1] + m.both[-1])
        return pd.DataFrame({"p_text": sigmoid(c[:, 0]), "p_meta": sigmoid(c[:, 1]), "score": p, "keep": p >= m.threshold})

    row = whole_row(docs.drop("p_text", "p_meta", "score", "keep"))
    found = docs.select(row, quality(F.coalesce("text", F.lit("")), "lang", "source", F.col("n_chars").cast("double")).alias("__new"))
    return found.select("__row.*", "__new.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "p_text", "p_meta", "score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with the columns they came with."""
    rows = docs.select(whole_row(docs), "text", "lang", "source", "n_chars")
    return score(rows, train(docs, labels)).where("keep").select("__row.*")
