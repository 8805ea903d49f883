"""SimHash near-dedup: fingerprints of word shingles, exact tiled comparison, connected components."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SEED = 42
RADIUS = 3
#: Fingerprints of a tile at most; two tiles make one numpy comparison.
TILE = 2048
#: Comparisons that a task is given, about.
WORK = 1 << 29
#: Pairs in reach that are looked at in the first round; the fewer, the sooner links spare others.
PAIRS = 4096
#: Up to this radius a tile has one population count in each quarter; beyond it, tiles are filled up over several.
FINE = 4
#: Tiles are runs of equal population counts in the four 16-bit quarters; 17 values each bound their number.
_QUARTERS = tuple(range(0, 64, 16))
#: Mixtures for the further words of a wide fingerprint.
_MORE = (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of a text's shingles of lower-cased (A-Z) words, repeats included; fewer words: the whole sequence; none: none."""
    words = text.encode().translate(C.LOWER).split() if text else []
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[: len(words) - size + 1] - np.fromiter(map(len, words[: len(words) - size + 1]), np.int64, len(words) - size + 1) - 1).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bit set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    lanes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def wide_fingerprint(hashes: list[int] | np.ndarray) -> list[int]:
    """Four words of the distinct hashes and of three mixtures of them, so that bits differ as the sets do."""
    own = np.unique(np.array(hashes, np.uint64))
    return [fingerprint(own), *(fingerprint(C.mix64(own ^ np.uint64(k))) for k in _MORE)]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed 64-bit integer; a scan without shuffle."""

    def run(batches):
        for batch in C.slices(batches):
            fp = np.fromiter((fingerprint(shingle_hashes(t, shingle)) for t in C.column(batch, "text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    C.bound_batches(docs.sparkSession)
    kinds = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(C.col(docs, id_col).alias("doc_id"), C.col(docs, text_col).cast("string").alias("text")).mapInArrow(C.released(run), kinds)


#: A fingerprint with its node's number and, for verification, the place of its text (file, first byte, bytes) and further words.
_ITEM = np.dtype([("fp", "<u8"), ("key", "<i8"), ("p", "<i8"), ("at", "<i8"), ("n", "<i8"), ("m1", "<u8"), ("m2", "<u8"), ("m3", "<u8")])


class _Items:
    """Sorted items in flat files of the shared folder, and texts, both read by range."""

    def __init__(self, uri: str):
        self.uri = uri
        self.base = np.frombuffer(C.get_bytes(f"{uri}/base.bin"), "<i8")
        self.files: dict[int, C.Flat] = {}
        self.sets: dict[int, np.ndarray] = {}

    def read(self, lo: int, hi: int) -> np.ndarray:
        out, p = [], int(np.searchsorted(self.base, lo, "right")) - 1
        while lo < hi:
            if p not in self.files:
                self.files[p] = C.Flat(f"{self.uri}/{p:06d}.bin", _ITEM)
            end = min(hi, int(self.base[p + 1]))
            out.append(self.files[p].read(lo - int(self.base[p]), end - int(self.base[p])))
            lo, p = end, p + 1
        return np.concatenate(out)

    def shingles(self, item, texts: str, size: int) -> np.ndarray:
        """The distinct shingle hashes of an item's text; the last few thousand stay."""
        key = int(item["key"])
        if key not in self.sets:
            if len(self.sets) >= 4000:
                self.sets.clear()
            fs, path = C.open_fs(f"{texts}/text-{int(item['p']):06d}.bin")
            with fs.open_input_file(path) as f:
                raw = f.read_at(int(item["n"]), int(item["at"]))
            self.sets[key] = np.unique(np.array(shingle_hashes(zstandard.decompress(raw).decode(), size), np.uint64))
        return self.sets[key]


class Forest:
    """Union-find over the fingerprints that a task has linked; keeps one edge per union."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up.setdefault(x, x)
        while up != x:
            self.up[x] = up = self.up[up]
            x, up = up, self.up[up]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def link_pairs(forest: Forest, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, same=None) -> None:
    """Link keys a[x] and b[y]; with `same` a pair (x, y) counts only if that says so.

    Round by round pairs that are connected already fall out in numpy, and of the others one for each two roots is
    looked at; two in the next round, and so on, since pairs can turn out not to be the same.
    """
    each, most = 1, PAIRS
    while len(x):
        u, v = (np.flatnonzero(np.bincount(k)) for k in (x, y))
        number, n = np.unique([forest.root(k) for k in (*a[u].tolist(), *b[v].tolist())], return_inverse=True)[1], len(u) + len(v)
        root_a, root_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        root_a[u], root_b[v] = number[: len(u)], number[len(u) :]
        one, two = root_a[x], root_b[y]
        left = np.flatnonzero(one != two)
        x, y, pair = x[left], y[left], one[left] * n + two[left]
        if each == 1:
            first = np.full(n * n, -1, np.int32)
            first[pair[::-1]] = np.arange(len(pair), dtype=np.int32)[::-1]
            some = np.sort(first[first >= 0])[:most]
        else:
            order = np.argsort(pair, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], np.diff(pair[order]) != 0)))
            rank = np.arange(len(pair)) - np.repeat(start, np.diff(np.append(start, len(pair))))
            some = order[rank < each][:most]
        for p, q in zip(x[some].tolist(), y[some].tolist()):
            k, m = int(a[p]), int(b[q])
            if forest.root(k) != forest.root(m) and (same is None or same(p, q)):
                forest.link(k, m)
        left = np.ones(len(x), bool)
        left[some] = False
        x, y = x[left], y[left]
        each, most = (1, most) if same is None else (2 * each, 2 * most)


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles whose fingerprints differ in `radius` bits or fewer."""
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    step = max(1, (1 << 15) // max(1, len(b)))
    # Arrays small enough for the processor's cache, made once.
    bits, apart, near = (np.empty((step, len(b)), t) for t in (np.uint64, np.uint8, bool))
    for lo in range(0, len(a), step):
        n = min(step, len(a) - lo)
        np.bitwise_xor(a[lo : lo + n, None], b[None, :], out=bits[:n])
        np.bitwise_count(bits[:n], out=apart[:n])
        at = np.flatnonzero(np.less_equal(apart[:n], radius, out=near[:n]))
        if len(at):
            i, j = np.divmod(at, len(b))
            left.append(i + lo)
            right.append(j)
    return np.concatenate(left), np.concatenate(right)


def size_cell(n: int) -> int:
    """The least number of shingles that shares its first 12 binary digits with n."""
    k = max(0, n.bit_length() - 12)
    return n >> k << k


def _tiles(hist: list[tuple[int, int]], radius: int, sized: bool = False) -> dict[str, np.ndarray]:
    """Tiles over the sorted items: first place, items, and least and greatest population count of each quarter or, if `sized`, number of shingles."""
    cells = np.array(sorted(hist), np.int64).reshape(-1, 2)
    least = greatest = np.stack([cells[:, 0] // 17**k % 17 for k in (3, 2, 1, 0)], 1)
    if sized:
        least = cells[:, :1]
        greatest = np.array([n + (1 << max(0, n.bit_length() - 12)) - 1 for n in least[:, 0].tolist()], np.int64).reshape(-1, 1)
    first = np.concatenate(([0], np.cumsum(cells[:, 1])))
    group, held = np.zeros(len(cells), np.int64), 0
    for i in range(1, len(cells)):
        held += int(cells[i - 1, 1])
        fits = radius > FINE and held + int(cells[i, 1]) <= TILE
        group[i] = group[i - 1] + (not fits)
        held = held if fits else 0
    edge = np.flatnonzero(np.concatenate(([True], np.diff(group) > 0))) if len(cells) else np.zeros(0, np.int64)
    return {"at": first[:-1][edge], "n": np.add.reduceat(cells[:, 1], edge), "lo": np.minimum.reduceat(least, edge), "hi": np.maximum.reduceat(greatest, edge)}


def _near(t: dict[str, np.ndarray], i: int, radius: int, similarity: float | None = None) -> np.ndarray:
    """Tiles from i on whose population counts can be within the radius of tile i's, summed over the quarters; with `similarity`, those whose sets are small enough to be as similar as that to tile i's."""
    if similarity is not None:
        return np.arange(i, np.searchsorted(similarity * t["lo"][:, 0], t["hi"][i, 0], "right"))
    end = np.searchsorted(t["lo"][:, 0], t["hi"][i, 0] + radius, "right")
    apart = np.maximum(0, np.maximum(t["lo"][i:end] - t["hi"][i], t["lo"][i] - t["hi"][i:end])).sum(1)
    return i + np.flatnonzero(apart <= radius)


def near_links(items: DataFrame, radius: int = RADIUS, wide: int | None = None, texts: str | None = None, shingle: int = 3, similarity: float = 0.0) -> DataFrame:
    """(a, b) links between keys that connect all items (fp, key and, as far as needed, p, at, n, m1, m2, m3; keys distinct) whose fingerprints differ in `radius` bits or fewer.

    Items are sorted by the population counts of their fingerprints' four 16-bit quarters into tiles in flat files;
    two tiles are compared, by numpy exclusive-or and bit counts of all their pairs, unless those counts differ by
    more than the radius in sum (then no pair of them can be in reach). Nothing else is skipped, so no link is lost.
    With `wide`, pairs must also differ in that many bits or fewer over all four words.
    If items have a `size`, the size_cell of their numbers of distinct shingles, they are sorted by it instead, and two
    tiles are compared unless each set of the one is less than `similarity` times as large as each of the other: then
    no pair of them has that Jaccard similarity.
    With `texts`, a link counts only if the shingle sets of the two texts, read from there, have that Jaccard
    similarity or more. Of a task's links, those that its earlier links imply are left out, so that large groups
    give no quadratic output. Only the counts of at most 83,521 cells come to the driver. No items, no links.
    """
    spark = items.sparkSession
    n, uri = C.parallelism(items), C.shared_dir(items.sparkSession, "tiles")
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(0xFFFF)))
    sized = similarity if "size" in items.columns else None
    cell = F.col("size") if sized is not None else sum((quarter(k).cast("long") * 17 ** (3 - i) for i, k in enumerate(_QUARTERS)), F.lit(0).cast("long"))

    def store(batches):
        p, parts = TaskContext.get().partitionId(), [np.zeros((1 + len(_ITEM.names), 0), np.int64)]
        parts += [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
        cells, *rest = np.concatenate(parts, 1)
        out = np.zeros(len(cells), _ITEM)
        for name, values in zip(_ITEM.names, rest):
            out[name] = values.view(_ITEM[name])
        C.put_bytes(f"{uri}/{p:06d}.bin", out.tobytes())
        found, count = np.unique(cells, return_counts=True)
        yield pa.RecordBatch.from_pydict({"p": np.full(len(found), p, np.int64), "cell": found.astype(np.int64), "n": count.astype(np.int64)})

    zero = F.lit(0).cast("long")
    items = items.select(cell.alias("cell"), *[F.col(c) if c in items.columns else zero.alias(c) for c in _ITEM.names])
    hist = items.repartitionByRange(n, "cell", "fp", "key").sortWithinPartitions("cell", "fp", "key").mapInArrow(C.released(store), "p long, cell long, n long").collect()
    if not hist:
        return spark.createDataFrame([], "a long, b long")
    sizes = np.zeros(max(r.p for r in hist) + 1, np.int64)
    totals: dict[int, int] = {}
    for r in hist:
        sizes[r.p] += r.n
        totals[r.cell] = totals.get(r.cell, 0) + r.n
    C.put_bytes(f"{uri}/base.bin", np.concatenate(([0], np.cumsum(sizes))).astype("<i8").tobytes())
    C.put_bytes(f"{uri}/cells.bin", np.array(list(totals.items()), "<i8").tobytes())
    tiles = _tiles(list(totals.items()), radius, sized is not None)

    # Tasks: runs of (tile, rows from, rows to), each run about WORK comparisons or a tile's worth, whichever is more.
    units, unit, work = [], [], 0
    for i in range(len(tiles["n"])):
        near = _near(tiles, i, radius, sized)
        reach = int(tiles["n"][near].sum())
        for lo in range(0, int(tiles["n"][i]), TILE):
            hi = min(lo + TILE, int(tiles["n"][i]))
            unit.append((i, lo, hi))
            work += (hi - lo) * reach + 10_000 * len(near)
            if work >= WORK:
                units.append(unit)
                unit, work = [], 0
    units += [unit] if unit else []
    C.put_bytes(f"{uri}/units.bin", np.array([x for unit in units for x in unit], "<i8").tobytes())
    C.put_bytes(f"{uri}/ends.bin", np.cumsum([0, *map(len, units)]).astype("<i8").tobytes())

    def compare(batches):
        items = _Items(uri)

        def similar(one, two):
            s, t = items.shingles(one, texts, shingle), items.shingles(two, texts, shingle)
            both = len(np.intersect1d(s, t, assume_unique=True))
            return both >= similarity * (len(s) + len(t) - both)

        tiles = _tiles([tuple(x) for x in np.frombuffer(C.get_bytes(f"{uri}/cells.bin"), "<i8").reshape(-1, 2).tolist()], radius, sized is not None)
        at, count = tiles["at"].tolist(), tiles["n"].tolist()
        todo, ends = C.Flat(f"{uri}/units.bin", "<i8"), C.Flat(f"{uri}/ends.bin", "<i8")
        for u in (u for b in batches for u in b.column(0).to_pylist()):
            forest = Forest()
            first, last = ends.read(u, u + 2).tolist()
            for i, lo, hi in todo.read(3 * first, 3 * last).reshape(-1, 3).tolist():
                a = items.read(at[i] + lo, at[i] + hi)
                a_fp = np.ascontiguousarray(a["fp"])
                a_more = np.stack([a[m] for m in _ITEM.names[-3:]], 1)
                for j in _near(tiles, i, radius, sized).tolist():
                    for b_lo in range(lo if j == i else 0, count[j], TILE):
                        b = items.read(at[j] + b_lo, at[j] + min(b_lo + TILE, count[j]))
                        x, y = compare_tiles(a_fp, np.ascontiguousarray(b["fp"]), radius)
                        if wide is not None and len(x):
                            b_more = np.stack([b[m] for m in _ITEM.names[-3:]], 1)
                            apart = np.bitwise_count(a_fp[x] ^ b["fp"][y]).astype(np.int64) + np.bitwise_count(a_more[x] ^ b_more[y]).sum(1, dtype=np.int64)
                            x, y = x[apart <= wide], y[apart <= wide]
                        link_pairs(forest, a["key"], b["key"], x, y, (lambda p, q, b=b: similar(a[p], b[q])) if texts else None)
            pairs = np.array(forest.edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    return spark.range(0, len(units), 1, len(units)).mapInArrow(C.released(compare), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by alternating large and small stars.

    Each round is two aggregations and joins, written to the shared folder; nothing is gathered in one task.
    """
    edges = C.materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where("u != v").distinct()
        after = C.materialize(small, "links")
        if not after.exceptAll(edges).limit(1).count() and after.count() == edges.count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select(F.col("v"), F.col("v")).distinct())
        edges = after


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed) and component_id (smallest doc_id reachable over links of `radius` bits or fewer) of each row.

    Null and empty texts have fingerprint zero and are linked like any other; very long texts are read whole; repeated
    rows come out each; a tie for the smallest id is between rows of one id, which is the component's; a null doc_id
    keeps its row and counts in no minimum (a component of null ids only has a null id); an empty table gives no rows;
    other columns are not looked at.
    """
    fps = C.materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = C.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    root = components(near_links(distinct.select("fp", F.col("fp").alias("key")), radius))
    named = distinct.join(root, distinct.fp == root.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 24, wide: int = 72, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest id (nulls last, then smallest text hash) stays, as it is.

    Groups are connected by pairs of texts whose sets of `shingle`-word shingles have that Jaccard similarity or
    more; candidates are pairs whose fingerprints differ in `radius` bits or fewer in their first word and in `wide`
    or fewer of all 256, each verified on the whole texts. Texts are compared only with those whose numbers of
    distinct shingles allow that similarity, which loses no pair. At a similarity of 0.8 about 10 and 39 bits differ, of
    unrelated texts about 128. In simulations of 12,000 to 32,000 pairs at the least similarity of 0.8, no pair of 15
    to 100 shingles together but one was missed, and of pairs with 4 of 5 in common one in 5,000. Pairs below 0.8 stay.
    Texts with equal words (A-Z lower-cased) are copies whatever their length; null and empty texts are copies of each
    other; very long texts are compared whole. Of rows equal in id and text one stays. An empty table gives no rows;
    other columns are passed on.
    """
    C.bound_batches(docs.sparkSession)
    texts = C.shared_dir(docs.sparkSession, "texts")
    kinds = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in "t fp m1 m2 m3 size key p at n".split())])

    def run(batches):
        p, at = TaskContext.get().partitionId(), 0
        fs, folder = C.open_fs(texts)
        tmp, rows = f"{folder}/text-{p:06d}.{TaskContext.get().taskAttemptId()}.tmp", []
        pack = zstandard.ZstdCompressor(level=1)
        with fs.open_output_stream(tmp) as out:
            for batch in C.slices(batches):
                values = C.column(batch, "text").to_pylist()
                sets = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for t in values]
                fp = np.array([[*wide_fingerprint(s), size_cell(len(s))] for s in sets], np.uint64).view(np.int64)
                raw = [b" ".join(t.encode().translate(C.LOWER).split()) if t else b"" for t in values]
                key = np.fromiter((struct.unpack("<q", xxhash.xxh64_digest(r, 1))[0] for r in raw), np.int64, len(raw))
                data = [pack.compress(r) for r in raw]
                out.write(b"".join(data))
                size = np.fromiter(map(len, data), np.int64, len(data))
                ends = at + np.cumsum(size)
                rows.append(pa.RecordBatch.from_arrays([C.column(batch, "id"), C.column(batch, "t"), *(pa.array(fp[:, k]) for k in range(5)), pa.array(key), pa.array(np.full(len(fp), p, np.int64)), pa.array(ends - size), pa.array(size)], ["id", "t", "fp", "m1", "m2", "m3", "size", "key", "p", "at", "n"]))
                at = int(ends[-1])
        fs.move(tmp, f"{folder}/text-{p:06d}.bin")
        yield from rows

    t = F.xxhash64(C.col(docs, text_col).cast("string"))
    found = C.materialize(docs.select(C.col(docs, id_col).alias("id"), t.alias("t"), C.col(docs, text_col).cast("string").alias("text")).mapInArrow(C.released(run), kinds), "classes")
    last = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    classes = C.materialize(found.groupBy("key").agg(F.min(last).alias("first"), F.min(F.struct("p", "at", "n", "fp", "m1", "m2", "m3", "size")).alias("place")).select("key", "first", "place.*"), "classes")
    root = components(near_links(classes, radius, wide, texts, shingle, similarity))
    named = classes.join(root, classes.key == root.node, "left").select("first", F.coalesce("root", "key").alias("root"))
    stay = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("stay_id"), F.col("first.t").alias("stay_t"))
    times = found.groupBy("id", "t").agg(F.count(F.lit(1)).alias("times"))
    stay = C.materialize(stay.join(times, stay.stay_id.eqNullSafe(times.id) & (stay.stay_t == times.t)).select("stay_id", "stay_t", "times"), "stay")
    rows = docs.select(F.struct(*[C.col(docs, c) for c in docs.columns]).alias("row"), C.col(docs, id_col).alias("id"), t.alias("t"))

    def join(some):
        return rows.join(some, rows.id.eqNullSafe(some.stay_id) & (rows.t == some.stay_t), "left_semi")

    out = join(stay.where("times = 1")).select("row")
    again = stay.where("times > 1")
    if again.limit(1).count():
        out = out.union(join(again).groupBy("id", "t").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
