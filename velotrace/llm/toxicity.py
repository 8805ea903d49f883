"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word chooses a hashed embedding row for all of it and one for each of several beginnings, so that inflected forms
share what they have in common. Its embedding is the sum of these rows; the first component is their evidence, the log
odds of the label among the training texts that have them, and is counted and not learned. Filters of several widths
slide over the words, each is max-pooled over the whole text, and a logistic layer weighs the pools. Thresholds are
calibrated per language, which is read off the text's function words.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .decontamination import normal_words

#: Labelled rows, and bytes of their texts, that training takes at most: those with the smallest hashes of their ids.
SAMPLE, SAMPLE_BYTES = 10_000, 48 << 20
BUCKET_BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 2, 64, 0.1
#: Training steps at least, whatever the sample; and words of a batch, unless one text has more.
LEAST_STEPS, BATCH_WORDS = 100, 200_000
#: Rows that fewer training texts have stay zero.
LEAST_DOCS = 3
#: Parts of the sample of which each is scored by a model that has not seen it, for the thresholds.
FOLDS = 4
#: Score at which the verdict turns; a language's calibrated threshold is mapped to it.
VERDICT = 0.3
PAD = max(WIDTHS) - 1
#: Words whose embeddings are held at a time.
BLOCK = 1 << 16
#: Parts of a word with a row each: all of it, and its first bytes if it is longer than these.
PARTS = (None, 4, 5, 6, 7, 8)
ROWS = len(PARTS) << BUCKET_BITS
_OFFSET = (np.arange(len(PARTS)) << BUCKET_BITS).astype(np.int32)
# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on with as be by at this are from or an".split(),
    "de": "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch".split(),
    "fr": "le les et des un du une est pour qui dans par plus pas au sur ne ce il avec".split(),
    "es": "el los del las por con para al lo como más pero sus este sí porque esta entre".split(),
}
LANGUAGES = ("other", *FUNCTION_WORDS)
#: Of the histograms for calibration: bins for each unit of the logit, and the farthest logit.
BINS, FARTHEST = 256, 50


def word_rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For all words of the texts, in order, the numbers (words, PARTS) of their parts' rows, unsigned 16 bits, 0 for a beginning that the word isn't longer than; and the number of words of each text."""
    words = [normal_words(t) for t in texts]
    data = np.frombuffer(b"".join(b" ".join(w) + b" " for w in words if w), np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = np.zeros((len(ends), len(PARTS)), np.uint16)
    sums = C.byte_sums(data) if len(ends) else np.zeros(1, np.uint64)
    for k, part in enumerate(PARTS):
        longer = np.flatnonzero(ends - starts > (part or 0))
        h = C.span_hashes(sums, starts[longer], ends[longer] if part is None else starts[longer] + part)
        out[longer, k] = 1 + h % np.uint64((1 << BUCKET_BITS) - 1)
    return out, np.fromiter(map(len, words), np.int64, len(words))


def _language_table() -> np.ndarray:
    table = np.zeros(1 << BUCKET_BITS, np.uint8)
    for k, lang in enumerate(LANGUAGES[1:], 1):
        table[word_rows([" ".join(FUNCTION_WORDS[lang])])[0][:, 0]] = k
    return table


def evidence(seen: np.ndarray, texts: np.ndarray, without: int | None = None) -> np.ndarray:
    """Of each row a share of its log odds: seen[label] texts of texts[label] have it; `without` a text of that label. Smoothed by one text, 0 for rows of fewer than LEAST_DOCS texts."""
    own = [np.maximum(seen[k] - (without == k), 0) for k in (0, 1)]
    toxic = texts[1] / texts.sum()
    odds = np.log((own[1] + toxic) / (own[0] + 1 - toxic)) - np.log(toxic / (1 - toxic))
    odds[own[0] + own[1] < LEAST_DOCS] = 0
    odds.reshape(len(PARTS), -1)[:, 0] = 0
    return (odds / len(PARTS)).astype(np.float32)


@dataclass
class Model:
    #: By row; the first component is the evidence.
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=lambda: [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS])
    bias: list[np.ndarray] = field(default_factory=lambda: [np.zeros(FILTERS, np.float32) for _ in WIDTHS])
    weight: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    shift: float = 0.0
    #: Threshold on the logit by language number.
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    language: np.ndarray = field(default_factory=_language_table)

    def embed(self, h: np.ndarray, known: np.ndarray | None = None, kind: np.ndarray | None = None) -> np.ndarray:
        """Embeddings of words, with the evidence known[kind] instead of the model's own if given."""
        x = self.embedding[h[:, 0]]
        for k in range(1, len(PARTS)):
            x += self.embedding[h[:, k] + _OFFSET[k]]
        if known is not None:
            x[:, 0] = known[kind[:, None], h + _OFFSET].sum(1)
        return x

    def pooled(self, h: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, kind: np.ndarray | None = None, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled, rectified filter outputs of each text (texts, widths x filters), and with `places` the word at which each window of a maximum starts.

        A window starts at each word; what reaches past its text is zero. `known`, `kind`: tables of evidence, and which
        one a text has. Words are embedded BLOCK at a time, however long a text is.
        """
        n, first = len(counts), np.concatenate(([0], np.cumsum(counts)))
        out, where = np.full((n, len(self.weight)), -np.inf, np.float32), np.zeros((n, len(self.weight)), np.int64)
        doc = np.repeat(np.arange(n), counts)
        # All filters' words side by side: one product for each word.
        taps = np.concatenate([f[j] for f in self.filters for j in range(len(f))], 1)
        for lo in range(0, len(h), BLOCK):
            hi = min(lo + BLOCK, len(h))
            end = min(hi + PAD, len(h))
            y = np.zeros((hi + PAD - lo, taps.shape[1]), np.float32)
            y[: end - lo] = self.embed(h[lo:end], known, None if known is None else kind[doc[lo:end]]) @ taps
            left = first[doc[lo:hi] + 1] - np.arange(lo, hi)  # words from here to the text's end
            z, at = np.empty((hi - lo, len(self.weight)), np.float32), 0
            for k, width in enumerate(WIDTHS):
                own = z[:, k * FILTERS : (k + 1) * FILTERS]
                own[:] = self.bias[k]
                for j in range(width):
                    more = y[j : hi - lo + j, at : at + FILTERS]
                    own += more * (left > j)[:, None] if j else more
                    at += FILTERS
            docs, start = np.unique(doc[lo:hi], return_index=True)
            if not places:
                out[docs] = np.maximum(out[docs], np.maximum.reduceat(z, start))
                continue
            for d, a, b in zip(docs.tolist(), start.tolist(), [*start[1:].tolist(), hi - lo]):
                top = z[a:b].argmax(0)
                best = z[a:b][top, np.arange(z.shape[1])]
                more = best > out[d]
                out[d, more], where[d, more] = best[more], lo + a + top[more]
        return np.maximum(out, 0, out=out), where

    def logits(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.pooled(h, counts)[0] @ self.weight + self.shift

    def languages(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        found = self.language[h[:, 0]]
        first = np.concatenate(([0], np.cumsum(counts)))
        tally = np.stack([np.zeros(len(counts)), *(np.diff(np.concatenate(([0], np.cumsum(found == k)))[first]) for k in range(1, len(LANGUAGES)))], 1)
        return np.where(tally.max(1) > 0, tally.argmax(1), 0)

    def score(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """0 to 1; VERDICT where the logit equals its language's threshold; 0 for texts without words."""
        x = self.logits(h, counts).astype(float) - self.threshold[self.languages(h, counts)] + np.log(VERDICT / (1 - VERDICT))
        return np.where(counts > 0, 1 / (1 + np.exp(-np.clip(x, -50, 50))), 0.0)

    def dumps(self) -> bytes:
        """Only rows of the embedding that aren't zero are written."""
        rows, out = np.flatnonzero(self.embedding.any(1)), io.BytesIO()
        np.savez(out, rows=rows, embedding=self.embedding[rows], weight=self.weight, shift=self.shift, threshold=self.threshold, **{f"filters{k}": f for k, f in enumerate(self.filters)}, **{f"bias{k}": b for k, b in enumerate(self.bias)})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Model:
        got, m = np.load(io.BytesIO(data)), cls()
        m.embedding[got["rows"]] = got["embedding"]
        m.weight, m.shift, m.threshold = got["weight"], float(got["shift"]), got["threshold"]
        m.filters, m.bias = ([got[f"{name}{k}"] for k in range(len(WIDTHS))] for name in ("filters", "bias"))
        return m


def gradients(m: Model, h: np.ndarray, counts: np.ndarray, y: np.ndarray, heavy: float, known: np.ndarray) -> dict:
    """Of the mean logistic loss, toxic texts `heavy` times: by filters, bias, weight and shift, and by the embedding of the words `words`. known: tables of evidence by label."""
    out, where = m.pooled(h, counts, known, y, places=True)
    p = 1 / (1 + np.exp(-np.clip(out @ m.weight + m.shift, -30, 30)))
    g = ((p - y) * np.where(y == 1, heavy, 1.0) / len(y)).astype(np.float32)
    by_pool = (g[:, None] * m.weight) * (out > 0)
    last = np.cumsum(counts)[:, None]
    found = {"filters": [], "bias": [], "weight": out.T @ g, "shift": float(g.sum())}
    words, by_word = [], []
    for k, width in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        own, place = by_pool[:, cols], where[:, cols]
        g_f = np.zeros_like(m.filters[k])
        for j in range(width):
            at, inside = np.minimum(place + j, len(h) - 1), place + j < last
            x = m.embed(h[at.ravel()], known, np.repeat(y, FILTERS)).reshape(*at.shape, DIM) * inside[:, :, None]
            g_f[j] = np.einsum("dfe,df->ef", x, own)
            some = inside & (own != 0)
            words.append(at[some])
            by_word.append((own[:, :, None] * m.filters[k][j].T[None])[some])
        found["filters"].append(g_f)
        found["bias"].append(own.sum(0))
    found |= {"words": np.concatenate(words), "embedding": np.concatenate(by_word)}
    found["embedding"][:, 0] = 0  # evidence isn't learned
    return found


def _batches(order: np.ndarray, size: np.ndarray):
    held, words = [], 0
    for d in order.tolist():
        if held and (len(held) == BATCH or words + size[d] > BATCH_WORDS):
            yield held
            held, words = [], 0
        held.append(d)
        words += size[d]
    if held:
        yield held


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Adagrad on the logistic loss, toxic texts weighted up to the square root of the classes' ratio.

    While it is trained, a text's evidence is counted without the text itself, so that what one text alone has is no
    evidence for it. Texts of one label only, or none, give a constant.
    """
    rng, m = np.random.default_rng(seed), Model()
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    if not n.all():
        m.shift = 3.0 if n[1] else -3.0
        return m
    seen = np.zeros((2, ROWS))
    for t, y in zip(texts, labels):
        seen[y][np.unique(t + _OFFSET)] += 1
    known = np.stack([evidence(seen, n, without=y) for y in (0, 1)])
    live = (seen.sum(0) >= LEAST_DOCS)[:, None]
    m.embedding = (rng.normal(0, 0.1, m.embedding.shape) * live).astype(np.float32)
    m.embedding[:, 0] = evidence(seen, n)
    m.embedding.reshape(len(PARTS), -1, DIM)[:, 0] = 0
    # The first filter of each width begins as the evidence of one word, the others at random.
    for k, f in enumerate(m.filters):
        f[:] = rng.normal(0, 0.3, f.shape)
        f[:, :, 0] = 0
        f[0, 0, 0] = 1
        m.weight[k * FILTERS : (k + 1) * FILTERS] = [1, *rng.normal(0, 0.1, FILTERS - 1)]
    m.shift = -3.0
    speed = {name: [np.full(a.shape, 1e-2, np.float32) for a in (getattr(m, name) if name in ("filters", "bias") else [getattr(m, name)])] for name in ("filters", "bias", "weight", "embedding")}
    speed_shift, heavy, size = 1e-2, float(np.sqrt(n[0] / n[1])), np.fromiter(map(len, texts), np.int64, len(texts))
    order, steps = np.arange(len(texts)), 0
    while epochs > 0 or steps < LEAST_STEPS:
        rng.shuffle(order)
        for some in _batches(order, size):
            h, counts = np.concatenate([texts[d] for d in some]), size[some]
            steps += 1
            if not len(h):
                continue
            g = gradients(m, h, counts, labels[some], heavy, known)
            g["weight"] += 1e-4 * m.weight
            for name in ("filters", "bias"):
                for a, v, d in zip(getattr(m, name), speed[name], g[name]):
                    v += d**2
                    a -= RATE * d / np.sqrt(v)
            speed["weight"][0] += g["weight"] ** 2
            m.weight -= RATE * g["weight"] / np.sqrt(speed["weight"][0])
            speed_shift += g["shift"] ** 2
            m.shift -= RATE * g["shift"] / float(np.sqrt(speed_shift))
            rows = h[g["words"]] + _OFFSET
            for k in range(len(PARTS)):
                touched, inverse = np.unique(rows[:, k], return_inverse=True)
                total = np.zeros((len(touched), DIM), np.float32)
                np.add.at(total, inverse, g["embedding"])
                total = (total + 1e-5 * m.embedding[touched]) * live[touched] * (touched != _OFFSET[k])[:, None]
                total[:, 0] = 0
                speed["embedding"][0][touched] += total**2
                m.embedding[touched] -= RATE * total / np.sqrt(speed["embedding"][0][touched])
        epochs -= 1
    return m


def _best_threshold(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Of all cuts between neighbouring logits x, with y toxic of n texts each, the one with the greatest F1; of equals the one in the widest gap; 0 if none reaches an F1 of a half."""
    order = np.argsort(-x, kind="stable")
    x, y, n = x[order], y[order], n[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.cumsum(n) + y.sum())
    gap = np.append(-np.diff(x), 1.0)
    f1[gap <= 0] = -1
    if f1.max() < 0.5:
        return 0.0
    top = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = top[gap[top].argmax()]
    return float(x[k] - gap[k] / 2)


def calibrate(m: Model, lang: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    """From histograms by language (y toxic of n texts at logit x): a threshold for each language with 10 toxic and 10 other texts or more; the others share one over all."""
    if not y.sum() or y.sum() == n.sum():
        return
    values, place = np.unique(x, return_inverse=True)
    m.threshold[:] = _best_threshold(values, np.bincount(place, y), np.bincount(place, n))
    for k in range(len(LANGUAGES)):
        own = lang == k
        if min(y[own].sum(), (n - y)[own].sum()) >= 10:
            values, place = np.unique(x[own], return_inverse=True)
            m.threshold[k] = _best_threshold(values, np.bincount(place, y[own]), np.bincount(place, n[own]))


def _bins(logits: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logits.astype(float), -FARTHEST, FARTHEST) * BINS).astype(np.int32)


def _read_sample(uri: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The sample's texts as word rows, in order of their places, equal texts once (with the largest label), and their labels."""
    fs, path = C.open_fs(uri)
    found: dict[bytes, tuple[int, int]] = {}
    for f in fs.get_file_info(pafs.FileSelector(path)):
        if f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as file:
                got = pq.read_table(file, columns=["place", "y", "h"])
            for place, y, h in zip(*(got[c].to_pylist() for c in ("place", "y", "h"))):
                before = found.get(h, (place, y))
                found[h] = (min(place, before[0]), max(y, before[1]))
    order = sorted(found.items(), key=lambda x: x[1])
    return [np.frombuffer(h, np.uint16).reshape(-1, len(PARTS)) for h, _ in order], np.array([y for _, (_, y) in order], np.int64)


def _fold(uri: str, fold: int) -> pa.RecordBatch:
    """Train without every FOLDS-th text from `fold` on, and count those by language, logit and label; or, beyond the last fold, train with all and write the model."""
    texts, labels = _read_sample(uri)
    names = ["lang", "bin", "y", "n"]
    if fold == FOLDS:
        C.put_bytes(f"{uri}/model.bin", train(texts, labels).dumps())
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64())], names)
    out = np.arange(len(texts)) % FOLDS == fold
    model = train([t for t, o in zip(texts, out) if not o], labels[~out])
    cells: dict[tuple[int, int], list[int]] = {}
    for some in _batches(np.flatnonzero(out), np.fromiter(map(len, texts), np.int64, len(texts))):
        h, counts = np.concatenate([texts[d] for d in some]), np.array([len(texts[d]) for d in some])
        for cell, y in zip(zip(model.languages(h, counts).tolist(), _bins(model.logits(h, counts)).tolist()), labels[some].tolist()):
            held = cells.setdefault(cell, [0, 0])
            held[0] += y
            held[1] += 1
    rows = [(*cell, *held) for cell, held in cells.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names)


def histograms(docs: DataFrame, known: DataFrame, used: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(lang, bin, y, n): toxic and all labelled rows by language and logit, without the ids in `used`. Documents are scored before the join, so that no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in C.slices(batches, limit=C.SLICE_BYTES // 2):
            h, counts = word_rows(C.column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([C.column(batch, "id"), pa.array(shared.value.languages(h, counts).astype(np.int32)), pa.array(_bins(shared.value.logits(h, counts)))], ["id", "lang", "bin"])

    source = docs.select(C.col(docs, id_col).alias("id"), C.col(docs, text_col).cast("string").alias("text")).where("id IS NOT NULL")
    scored = source.mapInArrow(C.released(run), T.StructType([source.schema["id"], T.StructField("lang", T.IntegerType()), T.StructField("bin", T.IntegerType())]))
    # An id of very many rows is counted before the join.
    scored = scored.join(F.broadcast(used), "id", "left_anti").groupBy("id", "lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    return scored.join(known, "id").groupBy("lang", "bin").agg(F.sum(F.col("y") * F.col("n")).alias("y"), F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled rows with a document and calibrate on all of them.

    The sample is taken in the order of hashes of ids: at most `sample` ids, of which a text that would bring the
    bytes over `sample_bytes` is passed over. Its word rows (2 bytes for each of PARTS) are written to the shared
    folder, where tasks train the model and one for each of FOLDS. Thresholds come from the folds' logits of the
    texts that they have not seen and from the model's logits of all labelled rows outside the sample; of both,
    histograms come to the driver. A null label or id is no label; an id labelled more than once counts by its
    largest label; of rows with one id the text with the smallest hash is trained on; equal texts count once; no
    labels, or one kind only, give a constant score.
    """
    C.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    known = labels.where(C.col(labels, label_col).isNotNull() & C.col(labels, id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    first = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(C.col(docs, id_col).alias("id"), C.col(docs, text_col).cast("string").alias("text")).withColumns({"t": F.xxhash64("text"), "size": F.coalesce(F.octet_length("text"), F.lit(0))})
    sized = texts.join(F.broadcast(first), "id").groupBy("id", "y").agg(F.min(F.struct("t", "size")).alias("m")).select("id", "y", "m.t", "m.size").orderBy(F.xxhash64("id"), "id").collect()
    chosen, total = [], 0
    for r in sized:
        if total + r.size <= sample_bytes:
            chosen.append((r.id, r.t, len(chosen), r.y))
            total += r.size

    def run(batches):
        for batch in C.slices(batches):
            h, counts = word_rows(C.column(batch, "text").to_pylist())
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([C.column(batch, "place"), C.column(batch, "y"), pa.array([h[b - n : b].tobytes() for b, n in zip(ends, counts)], pa.binary())], ["place", "y", "h"])

    kinds = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("t", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("y", T.IntegerType())])
    place = spark.createDataFrame(chosen, kinds)
    picked = texts.join(F.broadcast(place), ["id", "t"]).groupBy("place", "y").agg(F.min("text").alias("text"))
    uri = C.shared_dir(spark, "sample")
    picked.mapInArrow(C.released(run), "place int, y int, h binary").write.mode("overwrite").parquet(uri)

    def tasks(batches):
        for fold in (k for b in batches for k in b.column(0).to_pylist()):
            yield _fold(uri, fold)

    names = "lang int, bin int, y long, n long"
    parts = [spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(C.released(tasks), names).toArrow()]
    model = Model.loads(C.get_bytes(f"{uri}/model.bin"))
    if known.count() > len(chosen):
        parts.append(histograms(docs, known, place.select("id"), model, id_col, text_col).toArrow())
    found = pa.concat_tables([p.cast(parts[0].schema) for p in parts])
    calibrate(model, found["lang"].to_numpy(), found["bin"].to_numpy() / BINS, found["y"].to_numpy(), found["n"].to_numpy())
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text alone; a scan without shuffle.

    Null and empty texts, and texts without words, score 0; very long texts are read whole, a block of words at a
    time; repeated rows come out each, rows with one text with one score; a null id is kept; an empty table gives no
    rows; other columns are not looked at. The model has a fixed size and is broadcast.
    """
    C.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in C.slices(batches, limit=C.SLICE_BYTES // 2):
            yield pa.RecordBatch.from_arrays([C.column(batch, "id"), pa.array(shared.value.score(*word_rows(C.column(batch, "text").to_pylist())))], ["doc_id", "score"])

    source = docs.select(C.col(docs, id_col).alias("id"), C.col(docs, text_col).cast("string").alias("text"))
    return source.mapInArrow(C.released(run), T.StructType([T.StructField("doc_id", source.schema["id"].dataType), T.StructField("score", T.DoubleType())]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs, labels.where(~out))
    return toxicity(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= VERDICT).cast("int").alias("predicted"))
