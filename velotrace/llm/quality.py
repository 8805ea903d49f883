"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 0.3, 8
#: A document is kept if its posterior probability of quality reaches this.
KEEP = 0.5
# Characters that count as symbols, and frequent function words of the corpus's languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that it for was on with as be by at this are from or an he not but his had "
        "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
        "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec "
        "el los del las por con una su para al lo como más pero sus o este sí porque esta entre cuando"
    ).split()
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: More measures that rules look at.
MORE = ("n_lines", "n_closed_lines", "n_stop_words", "n_top_word", "n_upper", "n_letters", "n_plain_words", "n_bangs", "n_same_next")

#: Rule: (measure, of what, good from or up to, bad beyond). good < bad: low shares are good; good > bad: high ones.
#: Between the two, and where the divisor is zero, a rule abstains.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.03, 0.10),
    "duplicate_lines": ("n_dup_lines", "n_lines", 0.05, 0.30),
    "repeats": ("n_repeat_words", "n_words", 0.05, 0.20),
    "stop_words": ("n_stop_words", "n_words", 0.10, 0.03),
    "closed_lines": ("n_closed_lines", "n_lines", 0.60, 0.20),
    "upper_case": ("n_upper", "n_letters", 0.12, 0.40),
    "top_word": ("n_top_word", "n_words", 0.15, 0.30),
    "plain_words": ("n_plain_words", "n_words", 0.80, 0.60),
    "word_length": ("word_chars", "n_words", 12.0, 20.0),
    "exclamations": ("n_bangs", "n_words", 0.05, 0.25),
    "stutter": ("n_same_next", "n_words", 0.03, 0.15),
}


def measures(texts: list[str | None]) -> np.ndarray:
    """One row per text, columns BASE + MORE, over whole texts; null and empty texts have zeros."""
    raw = [t.encode() if t else b"" for t in texts]
    words = [t.split() for t in raw]
    n = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(texts), len(BASE) + len(MORE)), np.int64)
    out[:, 0] = n
    out[:, 4] = _repeat_words(words, n)
    for i, (text, own, data) in enumerate(zip(texts, words, raw)):
        if not own:
            continue
        b = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        out[i, 1] = b[_STARTS & ~C._SPACE].sum()
        out[i, 2] = b[[ord(c) for c in SYMBOLS]].sum()
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        counts = Counter(own)
        stripped = {w: w.strip(b".,;:!?()\"'").lower() for w in counts}
        out[i, 3] = len(lines) - len(set(lines))
        out[i, 5:] = (
            len(lines),
            sum(x.rstrip(" \t\r\x0b\x0c\"')»”")[-1:] in tuple(".!?…:") for x in lines),
            sum(c for w, c in counts.items() if stripped[w] in STOP_WORDS),
            max(counts.values()),
            b[_UPPER].sum(),
            b[_LETTER].sum(),
            sum(c for w, c in counts.items() if stripped[w].isalpha() or not stripped[w].isascii() and stripped[w].decode().isalpha()),
            b[33],
            sum(map(eq, own, own[1:])),
        )
    return out


def _repeat_words(words: list[list[bytes]], n: np.ndarray) -> np.ndarray:
    """Words in 8-word windows found twice or more in their text. Hashes of windows choose candidates, whole comparison decides."""
    out = np.zeros(len(words), np.int64)
    data = np.frombuffer(b"".join(w + b" " for own in words for w in own), np.uint8)
    ends = np.flatnonzero(data == 32)
    if len(ends) < WINDOW:
        return out
    starts = np.concatenate(([0], ends[:-1] + 1))
    grams = C.gram_hashes(C.word_hashes(data, starts, ends), WINDOW)
    doc = np.repeat(np.arange(len(words)), n)
    valid = np.flatnonzero(doc[: len(grams)] == doc[WINDOW - 1 :])
    key = C.mix64(grams[valid] + C.mix64(doc[valid].astype(np.uint64) + np.uint64(1)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = valid[count[inverse] > 1]
    first = np.concatenate(([0], np.cumsum(n)))
    for d, at in ((int(doc[x[0]]), x - first[doc[x[0]]]) for x in np.split(again, np.flatnonzero(np.diff(doc[again])) + 1) if len(x)):
        seen: dict[tuple, list[int]] = {}
        for i in at.tolist():
            seen.setdefault(tuple(words[d][i : i + WINDOW]), []).append(i)
        hit = np.zeros(int(n[d]) + 1, np.int64)
        for places in seen.values():
            if len(places) > 1:
                hit[places] += 1
                hit[np.array(places) + WINDOW] -= 1
        out[d] = (np.cumsum(hit)[:-1] > 0).sum()
    return out


def votes(m: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 abstains: a column for each of RULES."""
    name = {c: i for i, c in enumerate((*BASE, *MORE))}
    out = np.full((len(m), len(RULES)), 2, np.int8)
    for j, (what, of, good, bad) in enumerate(RULES.values()):
        with np.errstate(divide="ignore", invalid="ignore"):
            share = m[:, name[what]] / m[:, name[of]]
        low = good < bad
        out[share <= good if low else share >= good, j] = 1
        out[share > bad if low else share < bad, j] = 0
        out[m[:, name[of]] == 0, j] = 2
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(1)


def expectation_maximisation(patterns: np.ndarray, count: np.ndarray, rules: int = len(RULES), rounds: int = 100, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of quality of each vote pattern, the table P(vote | class) of shape (rules, 2, 3), and the prior of good.

    Two latent classes, rules independent given the class, abstentions informative; it starts from the share of good
    votes among those cast (a half if none), so that class 1 is the one that rules call good.
    """
    v = patterns[:, None] // 3 ** np.arange(rules) % 3
    cast = (v < 2).sum(1)
    post = np.where(cast, (v == 1).sum(1) / np.maximum(cast, 1), 0.5) * 0.9 + 0.05
    table, prior = np.zeros((rules, 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - post) * count, post * count])
        prior = (weight[1].sum() + smooth) / (count.sum() + 2 * smooth)
        for k in range(3):
            table[:, :, k] = ((v == k).T.astype(float) @ weight.T) + smooth
        table /= table.sum(2, keepdims=True)
        like = np.log([1 - prior, prior])[:, None] + np.log(table)[np.arange(rules)[:, None, None], np.arange(2)[None, :, None], v.T[:, None, :]].sum(0)
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -700, 700)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, table, float(prior)


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = KEEP) -> DataFrame:
    """The columns `keep` of docs (default all) as struct `row`, the measures BASE, base_failed, quality (posterior) and kept.

    One scan computes measures and votes; the counts of vote patterns (3 to the power of the number of rules at most,
    whatever the number of documents) go to the driver for EM, over all documents that pass the base rules. A
    document that fails them is not kept; of the others those whose posterior reaches the threshold are. Null and
    empty texts have no words and fail; very long texts are measured whole; documents with equal votes have equal
    posteriors, and one at the threshold is kept; repeated rows come out each; an empty table gives no rows; other
    columns, of any name and type, stay inside `row` as they are.
    """
    C.bound_batches(docs.sparkSession)
    names = docs.columns if keep is None else keep

    def run(batches):
        for batch in C.slices(batches):
            m = measures(C.column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([C.column(batch, "row"), *(pa.array(m[:, j]) for j in range(len(BASE))), pa.array(pattern(votes(m)))], ["row", *BASE, "votes"])

    source = docs.select(F.struct(*[C.col(docs, c) for c in names]).alias("row"), C.col(docs, text_col).cast("string").alias("text"))
    kinds = T.StructType([T.StructField("row", source.schema["row"].dataType), *(T.StructField(b, T.LongType()) for b in (*BASE, "votes"))])
    found = C.materialize(source.mapInArrow(C.released(run), kinds), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = found.where(~failed).groupBy("votes").count().collect()
    patterns, count = (np.array([r[k] for r in counted], np.int64) for k in (0, 1))
    post, _, _ = expectation_maximisation(patterns, count)
    spark = docs.sparkSession
    table = spark.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, post)], "votes long, quality double")
    found = found.withColumn("base_failed", failed).join(F.broadcast(table), "votes", "left")
    return found.select("row", *BASE, "base_failed", F.when(F.col("base_failed"), 0.0).otherwise(F.col("quality")).alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), *BASE, "base_failed", "kept", "quality")
