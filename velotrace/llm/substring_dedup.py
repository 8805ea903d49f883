"""Substring dedup by repeated-phrase automata.

1. Each partition's texts are written, words joined by one space, to a file of the shared folder. Of every 35-word
   window the 8-gram with the smallest hash (leftmost of equals) is its anchor: equal windows have equal anchors, and
   only about one word in 14 starts one. Anchor hashes that occur twice or more anywhere are routed back to the
   partitions that have them.
2. Runs of windows with such an anchor go, with their words, to the anchor's bucket; those of an anchor that is frequent
   go to the bucket of a longer span about it instead, so that a common beginning of many different passages is split
   by what follows and precedes it. There windows are compared word by word; stretches of windows confirmed to recur are the phrases, routed back to the partitions that they came from.
3. Each partition compiles its phrases into Aho-Corasick automata, in shards of bounded size, and streams all its
   documents through each shard. Every phrase consists of recurring windows, and every recurring window of the
   partition lies in a phrase, so the words of all occurrences are exactly the words to remove.

Hashes only choose what is compared. Every exchange is of a partition's distinct anchors or contexts, so a passage that
a third of all rows share costs one entry in each partition.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 35
ANCHOR = 8
#: Anchors, and bytes of contexts, that a task gathers before it sends them on.
ANCHORS_AT_ONCE, CONTEXT_BYTES = 2_000_000, 48 << 20
#: Occurrences from which on an anchor is frequent, and the parts into which its windows fall by its place in them.
FREQUENT, PARTS = 1000, 4
#: Nodes and distinct words of one automaton.
SHARD_NODES, SHARD_WORDS = 4_000_000, 260_000
#: Characters of a word's code, each one of 64.
LETTERS = 3
#: A word that no phrase of a shard has; one character, where other words have LETTERS.
_OTHER = "\0"


def normalised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words, each followed by one space, as bytes, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = C._SPACE[data]
    keep = ~space
    last = keep.copy()
    last[1:] = keep[:-1]
    last[0] = False
    closing = space & last
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    counts = np.add.reduceat(closing, np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64), dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    keep |= closing
    return np.where(space, np.uint8(32), data)[keep], counts


class Windows:
    """The windows of some documents: data (normalised bytes), starts and ends of words, first (first word of each document), and per window start its validity and anchor place."""

    def __init__(self, data: np.ndarray, counts: np.ndarray, window: int, anchor: int):
        self.data = data
        self.ends = np.flatnonzero(data == 32)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else self.ends
        self.words = C.word_hashes(data, self.starts, self.ends)
        self.grams = C.gram_hashes(self.words, min(anchor, window))
        n = len(self.starts) - window + 1
        if n <= 0:
            self.valid, self.place = np.zeros(0, bool), np.zeros(0, np.int64)
            return
        doc = np.repeat(np.arange(len(counts)), counts)
        self.valid = doc[:n] == doc[window - 1 :]
        self.place = _leftmost_min(self.grams, max(1, window - anchor + 1))[:n]


def context_runs(w: Windows, recurring: np.ndarray, frequent: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose anchor is among the sorted hashes `recurring`: key, first and last window of each.

    The key is the anchor's hash; or, if `frequent`, that of the words that all windows share which have the anchor
    in the same PARTS-th of them: with four parts 29 of 35 words. Equal windows have equal keys.
    """
    own = w.grams[w.place]
    at = np.minimum(np.searchsorted(recurring, own), len(recurring) - 1)
    found = np.flatnonzero(w.valid & (recurring[at] == own))
    step = -(-(window - anchor + 1) // PARTS)
    key, place = own[found], w.place[found]
    part = np.where(frequent[at[found]], (place - found) // step, 0)
    if frequent[at[found]].any():
        spans = C.gram_hashes(w.words, window - step + 1)
        key = np.where(frequent[at[found]], C.mix64(spans[np.minimum(place - part * step, len(spans) - 1)]), key)
    first = np.concatenate(([True], (np.diff(found) != 1) | (np.diff(place) != 0) | (np.diff(part) != 0))) if len(found) else np.zeros(0, bool)
    return key[first], found[first], found[np.concatenate((first[1:], [True]))] if len(found) else found


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of each `width` consecutive ones, by doubling."""
    best, place, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        m = len(best) - step
        later = best[step:] < best[:m]
        place = np.where(later, place[step:], place[:m])
        best = np.where(later, best[step:], best[:m])
        size += step
    return place


def _doc_file(uri: str, p: int) -> str:
    return f"{uri}/docs-{p:06d}.parquet"


def _read_docs(uri: str, p: int):
    """Slices (ids, normalised data, words of each document) of a partition's file."""
    fs, path = C.open_fs(_doc_file(uri, p))
    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):  # each is what the writer took up at once
            for part in file.read_row_group(g).combine_chunks().to_batches():
                text = C.column(part, "text").to_pylist()
                yield C.column(part, "id"), np.frombuffer(b"".join(text), np.uint8), C.column(part, "n").to_numpy()


def _by_bucket(h: np.ndarray, buckets: int):
    """(bucket, places) of hashes."""
    to = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), order[edge[b] : edge[b + 1]]


def _rows(rows: list[tuple[int, int, bytes]], a: str, b: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], [a, b, "blob"])


def _gather(batches, key: str):
    """All (key, blob) of a task."""
    return [(k, x) for batch in batches for k, x in zip(C.column(batch, key).to_pylist(), C.column(batch, "blob").to_pylist())]


def _store(uri: str, kind: str):
    """A task that writes what was routed to each of its partitions to one file."""

    def run(batches):
        by: dict[int, list[bytes]] = {}
        for p, blob in _gather(batches, "p"):
            by.setdefault(p, []).append(blob)
        for p, blobs in by.items():
            C.put_bytes(f"{uri}/{kind}-{p:06d}.bin", b"".join(struct.pack("<Q", len(x)) + x for x in blobs))
        yield pa.RecordBatch.from_pydict({"p": pa.array(list(by), pa.int64())})

    return run


def _stored(uri: str, kind: str, p: int) -> list[bytes]:
    fs, path = C.open_fs(f"{uri}/{kind}-{p:06d}.bin")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return []
    data, at, out = C.get_bytes(f"{uri}/{kind}-{p:06d}.bin"), 0, []
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _pack(hashes, counts, texts: list[bytes]) -> bytes:
    head = struct.pack("<Q", len(texts)) + np.array(hashes, "<u8").tobytes() + np.array(counts, "<u4").tobytes() + np.fromiter(map(len, texts), "<u4", len(texts)).tobytes()
    return zstandard.compress(head + b"".join(texts), 1)


def _unpack(blob: bytes):
    data = zstandard.decompress(blob)
    (n,) = struct.unpack_from("<Q", data)
    hashes, counts, lengths = np.frombuffer(data, "<u8", n, 8), np.frombuffer(data, "<u4", n, 8 + 8 * n), np.frombuffer(data, "<u4", n, 8 + 12 * n)
    ends = (np.cumsum(lengths, dtype=np.int64) + 8 + 16 * n).tolist()
    return hashes.tolist(), counts.tolist(), [data[a:b] for a, b in zip([8 + 16 * n, *ends[:-1]], ends)]


def confirm(contexts: dict[bytes, int], window: int) -> dict[bytes, list[bytes]]:
    """Of contexts (words joined by one space; occurrences) with one anchor, the stretches of windows that occur twice or more, by whole comparison of their words."""
    if len(contexts) == 1:
        return {c: [c] if n > 1 else [] for c, n in contexts.items()}
    offsets, count = {}, {}
    for context, n in contexts.items():
        at = offsets[context] = [0, *(m.end() for m in re.finditer(b" ", context)), len(context) + 1]
        for i in range(len(at) - window):
            key = context[at[i] : at[i + window] - 1]
            count[key] = count.get(key, 0) + n
    out = {}
    for context, at in offsets.items():
        found, start = [], None
        for i in range(len(at) - window + 1):
            twice = i < len(at) - window and count[context[at[i] : at[i + window] - 1]] > 1
            if twice and start is None:
                start = i
            elif not twice and start is not None:
                found.append(context[at[start] : at[i - 1 + window] - 1])
                start = None
        out[context] = found
    return out


def automata(phrases: list[bytes], nodes: int = SHARD_NODES, words: int = SHARD_WORDS):
    """(codes, automaton) shards over all phrases. A word is LETTERS characters from disjoint ranges, so that matches start at words only and no node has over 64 edges."""
    codes, size, automaton = {}, 0, ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for phrase in phrases:
        parts = phrase.split(b" ")
        for w in parts:
            if w not in codes:
                k = len(codes)
                codes[w] = chr(0x4E00 + k % 64) + chr(0x4E40 + k // 64 % 64) + chr(0x4E80 + k // 4096)
        automaton.add_word("".join(map(codes.__getitem__, parts)), len(parts))
        size += LETTERS * len(parts)
        if size >= nodes or len(codes) >= words:
            automaton.make_automaton()
            yield codes, automaton
            codes, size, automaton = {}, 0, ahocorasick.Automaton(ahocorasick.STORE_INTS)
    if size:
        automaton.make_automaton()
        yield codes, automaton


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """Remove every word in a window of `window` words that also starts anywhere else, the same document included.

    Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, with `with_text`,
    text (those words) and spans (word spans removed). Windows are judged on the input. Null and empty texts have no
    words; very long texts are read whole; repeated rows are documents of their own, so that their windows recur; of
    equal windows none is preferred, all go; an empty table gives no rows; a null id is kept; other columns are not
    looked at. `window` words at least make a window.
    """
    C.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    buckets, uri = C.parallelism(docs), C.shared_dir(spark, "phrases")
    anchor = min(anchor, window)

    def send_anchors(batches):
        p = TaskContext.get().partitionId()
        fs, path = C.open_fs(_doc_file(uri, p))
        held, size, writer, sink = [], 0, None, None

        def flush():
            h, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return _rows([(b, p, h[at].astype("<u8").tobytes() + np.minimum(count[at], 65535).astype("<u2").tobytes()) for b, at in _by_bucket(h, buckets)], "bucket", "p")

        tmp = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
        for batch in C.slices(batches):
            data, counts = normalised([t.encode() if t else b"" for t in C.column(batch, "text").to_pylist()])
            w = Windows(data, counts, window, anchor)
            ends = np.concatenate(([0], w.ends + 1))[np.concatenate(([0], np.cumsum(counts)))].tolist()
            whole = data.tobytes()
            out = pa.RecordBatch.from_arrays([C.column(batch, "id"), pa.array([whole[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()), pa.array(counts)], ["id", "text", "n"])
            if writer is None:
                sink = fs.open_output_stream(tmp)
                writer = pq.ParquetWriter(sink, out.schema, compression="zstd", use_dictionary=False)
            writer.write_batch(out)
            held.append(w.grams[np.unique(w.place[w.valid])])  # each place once, however many windows have it
            size += len(held[-1])
            if size >= ANCHORS_AT_ONCE:
                yield flush()
                size = 0
        if writer:
            writer.close()
            sink.close()
            fs.move(tmp, path)
        if held:
            yield flush()

    def find_recurring(batches):
        got = [(p, np.frombuffer(x, "<u8", len(x) // 10), np.frombuffer(x, "<u2", len(x) // 10, len(x) // 10 * 8)) for p, x in _gather(batches, "p")]
        if got:
            h, inverse = np.unique(np.concatenate([x[1] for x in got]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([x[2] for x in got]))[inverse]
            rows, lo = [], 0
            for p, mine, _ in got:
                own = times[lo : lo + len(mine)]
                lo += len(mine)
                if (own > 1).any():
                    rows.append((p, 0, mine[own > 1].tobytes() + (own[own > 1] >= FREQUENT).astype(np.uint8).tobytes()))
            yield _rows(rows, "p", "bucket")

    def send_contexts(batches):
        for p in (p for b in batches for p in b.column(0).to_pylist()):
            stored = _stored(uri, "anchors", p)
            recurring, once = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, "<u8", len(x) // 9) for x in stored)]), return_index=True)
            frequent = np.concatenate([np.zeros(0, bool), *(np.frombuffer(x, bool, len(x) // 9, len(x) // 9 * 8) for x in stored)])[once]
            held: dict[tuple[int, bytes], int] = {}
            size = 0

            def flush():
                keys = list(held)
                h = np.array([k[0] for k in keys], np.uint64)
                out = [(b, p, _pack(h[at], [held[keys[i]] for i in at], [keys[i][1] for i in at])) for b, at in _by_bucket(h, buckets)]
                held.clear()
                return _rows(out, "bucket", "p")

            for _, data, counts in _read_docs(uri, p) if len(recurring) else ():
                w = Windows(data, counts, window, anchor)
                if not len(w.place):
                    continue
                keys, lo, hi = context_runs(w, recurring, frequent, window, anchor)
                if not len(lo):
                    continue
                whole = data.tobytes()
                for h, a, b in zip(keys.tolist(), w.starts[lo].tolist(), w.ends[hi + window - 1].tolist()):
                    key = (h, whole[a:b])
                    if key in held:
                        held[key] += 1
                    else:
                        held[key] = 1
                        size += b - a
                if size >= CONTEXT_BYTES:
                    yield flush()
                    size = 0
            if held:
                yield flush()

    def confirm_phrases(batches):
        groups: dict[int, dict[bytes, int]] = {}
        places: dict[bytes, set[int]] = {}
        for p, blob in _gather(batches, "p"):
            for h, n, context in zip(*_unpack(blob)):
                group = groups.setdefault(h, {})
                group[context] = group.get(context, 0) + n
                places.setdefault(context, set()).add(p)
        out: dict[int, list[bytes]] = {}
        for group in groups.values():
            for context, phrases in confirm(group, window).items():
                for p in places[context] if phrases else ():
                    out.setdefault(p, []).extend(phrases)
        yield _rows([(p, 0, _pack([0] * len(x), [0] * len(x), x)) for p, x in out.items()], "p", "bucket")

    def locate(batches):
        for p in (p for b in batches for p in b.column(0).to_pylist()):
            phrases = sorted({x for blob in _stored(uri, "phrases", p) for x in _unpack(blob)[2]})
            total = sum(int(n.sum()) for _, _, n in _read_docs(uri, p))
            hit = np.zeros(total + 1, np.int32)
            stretch = re.compile(f"[^{_OTHER}]{{{LETTERS * window},}}")
            for codes, automaton in automata(phrases):
                base = 0
                for _, data, counts in _read_docs(uri, p):
                    whole, at = data.tobytes(), 0
                    words = whole.split()
                    for n in counts.tolist():
                        if n >= window:
                            text, others, seen = "".join(map(codes.get, words[at : at + n], repeat(_OTHER))), 0, 0
                            # A foreign word sends the automaton back to its root: only stretches between such words can match.
                            for m in stretch.finditer(text):
                                lo, hi = m.span()
                                others += text.count(_OTHER, seen, lo)
                                seen = lo
                                first = base + others + (lo - others) // LETTERS
                                for end, length in automaton.iter(text[lo:hi]):
                                    stop = first + end // LETTERS + 1
                                    hit[stop - length] += 1
                                    hit[stop] -= 1
                        base, at = base + n, at + n
                del codes, automaton  # before the next shard is compiled
            del phrases
            gone, base = np.cumsum(hit[:-1]) > 0, 0
            for ids, data, counts in _read_docs(uri, p):
                words, at, kept, removed, spans = data.tobytes().split(), 0, [], [], []
                for n in counts.tolist():
                    cut = gone[base : base + n]
                    removed.append(int(cut.sum()))
                    kept.append(b" ".join(w for w, c in zip(words[at : at + n], cut.tolist()) if not c) if removed[-1] else b" ".join(words[at : at + n]))
                    if with_text:
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], cut, [False])).astype(np.int8)))
                        spans.append([{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)])
                    base, at = base + n, at + n
                cols = [ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols += [pa.array([k.decode() for k in kept]), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
                    names += ["text", "spans"]
                yield pa.RecordBatch.from_arrays(cols, names)

    def route(rows: DataFrame, work, kind: str) -> None:
        """Rows to their buckets, work there, its results back to their partitions' files."""
        back = rows.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(C.released(work), "p long, bucket long, blob binary")
        back.repartitionById(buckets, F.pmod("p", F.lit(buckets)).cast("int")).mapInArrow(_store(uri, kind), "p long").write.format("noop").mode("overwrite").save()

    source = docs.select(C.col(docs, id_col).alias("id"), C.col(docs, text_col).cast("string").alias("text"))
    route(source.mapInArrow(C.released(send_anchors), "bucket long, p long, blob binary"), find_recurring, "anchors")
    fs, path = C.open_fs(uri)
    places = sorted(int(m[1]) for f in fs.get_file_info(pafs.FileSelector(path)) if (m := re.fullmatch(r"docs-(\d+)\.parquet", f.base_name)))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if with_text:
        schema = schema.add("text", T.StringType()).add("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))
    if not places:
        return spark.createDataFrame([], schema)
    parts = spark.range(0, max(places) + 1, 1, max(places) + 1).where(F.col("id").isin(places)) if len(places) <= max(places) else spark.range(0, len(places), 1, len(places))
    route(parts.mapInArrow(C.released(send_contexts), "bucket long, p long, blob binary"), confirm_phrases, "phrases")
    return parts.mapInArrow(C.released(locate), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, p, array_to_string(w[p : p + 34], ' ') AS g FROM doc, unnest(generate_series(1, len(w) - 34)) AS u(p) WHERE len(w) >= 35),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, q FROM (SELECT r, p FROM win JOIN twice USING (g)), unnest(generate_series(p, p + 34)) AS u(q)),
cut AS (SELECT r, count(*) AS n, list(q) AS qs FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(coalesce(qs, []), i)], ' '), '')) AS kept_sha256
FROM doc LEFT JOIN cut USING (r)
"""
