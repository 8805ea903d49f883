"""Benchmark decontamination: a generalised suffix automaton of normalised test items, streamed over by every document."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: A document is contaminated if its hit words are this share of its words, or more: one in 20.
COVERAGE = (1, 20)
#: Item words of one automaton; more items make more automata, which a task loads one after another.
SHARD_WORDS = 200_000
#: Everything but digits, letters and bytes from 0x80 on parts words; A-Z become a-z.
_NORMAL = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


class SuffixAutomaton:
    """Of several word sequences, each once; built by online extension from the root for each.

    States are numbers; next[v] maps a word's number to a state, link[v] is the suffix link, size[v] the length of
    the longest string of the state. After close(), window[v] is the state of the last `width` words of any match at
    v that long, and whole[v] lists (item, length) of shorter items that are suffixes of matches at v; items[v] has
    the numbers of the items in which a window state occurs.
    """

    def __init__(self, width: int = WINDOW):
        self.width = width
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.sequences: list[list[int]] = []

    def _state(self, size: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return new

    def add(self, words: list[bytes]) -> None:
        numbers = [self.words.setdefault(w, len(self.words) + 1) for w in words]
        self.sequences.append(numbers)
        last = 0
        for c in numbers:
            last = self._extend(last, c)

    def close(self) -> SuffixAutomaton:
        n, width = len(self.size), self.width
        self.window, self.whole, self.items = [-1] * n, [()] * n, {}
        own: dict[int, list[tuple[int, int]]] = {}
        by_size = sorted(range(1, n), key=self.size.__getitem__)
        for v in by_size:
            if self.size[v] >= width:
                self.window[v] = self.window[self.link[v]] if self.size[self.link[v]] >= width else v
        for item, numbers in enumerate(self.sequences):
            v = 0
            for c in numbers:
                v = self.next[v][c]
                if self.window[v] >= 0:
                    found = self.items.setdefault(self.window[v], [])
                    if not found or found[-1] != item:  # items come one after another
                        found.append(item)
            if 0 < len(numbers) < width:
                own.setdefault(v, []).append((item, len(numbers)))
        for v in by_size:
            self.whole[v] = (*own.get(v, ()), *self.whole[self.link[v]])
        return self

    def spans(self, numbers: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [from, to) of all windows that occur in a document, in order of their ends, and the items that they come from.

        numbers: the document's words as numbers, 0 if no item has the word. One step per word keeps the longest
        match that ends there.
        """
        follow, link, size, window, whole, width = self.next, self.link, self.size, self.window, self.whole, self.width
        out, states, items, v, length = [], set(), set(), 0, 0
        for i, c in enumerate(numbers):
            if not c:
                v = length = 0
                continue
            while v and c not in follow[v]:
                v = link[v]
                length = size[v]
            to = follow[v].get(c)
            if to is None:
                length = 0
                continue
            v, length = to, length + 1
            if length >= width and window[v] >= 0:
                out.append((i + 1 - width, i + 1))
                states.add(window[v])
            for item, n in whole[v]:
                if length >= n:
                    out.append((i + 1 - n, i + 1))
                    items.add(item)
        for s in states:
            items.update(self.items[s])
        return out, items


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def build_automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW, shard_words: int = SHARD_WORDS) -> str:
    """Write the items' automata to the shared folder, one file for each `shard_words` item words; returns the folder.

    Items are read in one pass by the driver, a partition at a time, and dealt into shards; what it holds is one
    shard. Tasks build the automata, one for each shard. Items with equal words share an entry. An item without words
    has no window; a null item_id has windows but no name.
    """
    uri = C.shared_dir(benchmark.sparkSession, "automata")
    shards, entries, total = 0, {}, 0

    def put():
        nonlocal shards, entries, total
        C.put_bytes(f"{uri}/{shards:06d}.items", pickle.dumps(entries))
        shards, entries, total = shards + 1, {}, 0

    def build(batches):
        for s in (s for b in batches for s in b.column(0).to_pylist()):
            own, automaton = pickle.loads(C.get_bytes(f"{uri}/{s:06d}.items")), SuffixAutomaton(width)
            for words in own:
                automaton.add(list(words))
            C.put_bytes(f"{uri}/{s:06d}.bin", pickle.dumps((automaton.close(), list(own.values()))))
            yield pa.RecordBatch.from_pydict({"id": pa.array([s], pa.int64())})

    for row in benchmark.select(C.col(benchmark, id_col).alias("id"), C.col(benchmark, text_col).cast("string").alias("text")).toLocalIterator():
        words = tuple(normal_words(row.text))
        if words:
            total += 0 if words in entries else len(words)
            entries.setdefault(words, []).append(row.id)
            if total >= shard_words:
                put()
    put()
    benchmark.sparkSession.range(0, shards, 1, shards).mapInArrow(C.released(build), "id long").write.format("noop").mode("overwrite").save()
    C.put_bytes(f"{uri}/shards", str(shards).encode())
    return uri


_loaded: dict[str, tuple[SuffixAutomaton, list]] = {}


def _load(uri: str) -> tuple[SuffixAutomaton, list]:
    """The last automaton stays in the worker."""
    if uri not in _loaded:
        _loaded.clear()
        _loaded[uri] = pickle.loads(C.get_bytes(uri))
    return _loaded[uri]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its spans of words, each with what stands between its words; what stands around them stays."""
    data = text.encode()
    inside = np.frombuffer(data.translate(_NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2].tolist(), edge[1::2].tolist()
    cuts = [0, *(at for a, b in spans for at in (starts[a], ends[b - 1])), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])).decode()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, width: int = WINDOW, coverage: tuple[int, int] = COVERAGE, shard_words: int = SHARD_WORDS, cut: bool = False
) -> DataFrame:
    """Per row of docs: the columns `keep` (default: the id) and __n_words, __n_hit, __spans (word spans [start, stop) to remove), __items, __contaminated and, with `cut`, __text (the text without its spans).

    A scan of the documents without shuffle: each task streams its texts through every automaton, one at a time.
    A word is hit if it lies in an occurrence of a window of an item; contaminated: at least one word is hit and at
    least coverage[0] / coverage[1] of the words are. Null and empty texts have no words and are clean; very long
    texts are read whole; items with equal windows are all named; repeated rows come out each; an empty benchmark
    leaves all clean; an empty docs gives no rows. Columns of any name and type can be kept but those named here.
    """
    C.bound_batches(docs.sparkSession)
    uri = build_automata(benchmark, "item_id" if "item_id" in benchmark.columns else benchmark.columns[0], "text", width, shard_words)
    keep = keep or [id_col]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    extra = {"__n_words": T.LongType(), "__n_hit": T.LongType(), "__spans": T.ArrayType(span), "__items": T.ArrayType(T.StringType())}
    extra |= {"__text": T.StringType()} if cut else {}
    if set(extra) & set(keep):
        raise ValueError(f"columns {sorted(set(extra) & set(keep))} cannot be kept beside results of these names")
    kinds = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *(T.StructField(c, t) for c, t in extra.items())])
    share, whole = coverage
    passed = [C.col(docs, c).alias(f"k{k}") for k, c in enumerate(keep)]

    def run(batches):
        shards = int(C.get_bytes(f"{uri}/shards"))
        for batch in C.slices(batches, "__text"):
            raw = C.column(batch, "__text").to_pylist()
            texts = [normal_words(t) for t in raw]
            spans: list[list] = [[] for _ in texts]
            names: list[set] = [set() for _ in texts]
            for s in range(shards):
                automaton, ids = _load(f"{uri}/{s:06d}.bin")
                number = automaton.words.get
                for d, words in enumerate(texts):
                    found, items = automaton.spans([number(w, 0) for w in words])
                    spans[d] += found
                    names[d].update(str(i) for item in items for i in ids[item] if i is not None)
            spans = [union(x) for x in spans]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(C.column(batch, f"k{k}") for k in range(len(keep))),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
                    pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], kind),
                    pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                    *([pa.array([without_spans(t, x) if x else t for t, x in zip(raw, spans)], pa.string())] if cut else []),
                ],
                [*keep, *extra],
            )

    found = docs.select(*passed, C.col(docs, text_col).cast("string").alias("__text")).mapInArrow(C.released(run), kinds)
    return found.withColumn("__contaminated", (F.col("__n_hit") > 0) & (whole * F.col("__n_hit") >= share * F.col("__n_words")))


def digest(names) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_contamination(docs, benchmark).select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        F.col("__contaminated").alias("contaminated"),
    )


OP5_SQL = r"""
WITH item AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS g
  FROM item, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS u(p) WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
gram AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM doc, (SELECT DISTINCT n FROM win) AS l, unnest(generate_series(1, len(w) - n + 1)) AS u(p) WHERE len(w) >= n),
hit AS (SELECT r, p, gram.n, item_id FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, p, n FROM hit), unnest(generate_series(p, p + n - 1)) AS u(q) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
