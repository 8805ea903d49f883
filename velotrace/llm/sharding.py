"""Sharding by histogram sort: probes are refined by exact byte counts until the splitters fit, then one exchange.

Rows are ordered by (hash of the text, id, a row hash). Splitter i is the place in that order whose bytes before it
come closest to i / shards of all bytes. It is looked for by counting, for all shards at once, the exact bytes below
candidate keys over all partitions and narrowing each splitter's interval. Equal texts stand together, and a splitter
that can stand between two groups within the tolerance does so; a group too large for that is split by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SHARDS = 40
#: How far a splitter may stand from its place, as a share of a shard's bytes.
TOLERANCE = 0.005
#: Candidate keys per unsettled splitter and round, and the rows of an interval that are fetched instead.
PROBES, FETCH = 64, 512
#: Bytes that a row weighs besides its text.
ROW_BYTES = 16
LEVELS = ("h", "id", "r")
_U = np.uint64
_TOP = 1 << 64


def _order(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit integers as unsigned ones in the same order."""
    return x.view(_U) ^ _U(1 << 63)


class Splitter:
    """A search for the key whose rows below it weigh closest to `goal`: an interval [lo, hi) of keys at the level after a prefix of settled keys, with the (bytes, rows) of all rows below its ends."""

    def __init__(self, goal: int, total: tuple[int, int]):
        self.goal, self.prefix = goal, ()
        self.lo, self.hi = 0, _TOP
        self.below, self.above = (0, 0), total

    @property
    def interval(self) -> tuple:
        return self.prefix, self.lo, self.hi

    def edges(self, n: int) -> list[int]:
        """The interval's ends and up to n keys evenly between them."""
        width = self.hi - self.lo
        return sorted({self.lo, self.hi, *(self.lo + max(1, width * k // (n + 1)) for k in range(1, n + 1) if width > 1)})

    def narrow(self, slots: list[tuple[int, int, int, int]]) -> None:
        """slots: in key order, (bytes, rows, least key, greatest key) of the interval's rows between each two edges. The one that holds the goal is left, between its own least and greatest key."""
        at = self.below
        for size, rows, least, greatest in slots:
            after = (at[0] + size, at[1] + rows)
            if after[0] > self.goal:
                self.lo, self.hi, self.below, self.above = least, greatest + 1, at, after
                return
            at = after

    def settle(self, slack: float) -> tuple[tuple[int, ...], tuple[int, int]] | None:
        """The splitter if an end of the interval is near enough, or nothing is left to part; a single key that weighs too much is gone into."""
        while True:
            near = self.goal - self.below[0] <= self.above[0] - self.goal
            key, at = (self.lo, self.below) if near else (self.hi, self.above)
            if abs(at[0] - self.goal) <= slack or self.hi - self.lo <= 1 and len(self.prefix) == len(LEVELS) - 1:
                return (*self.prefix, key), at
            if self.hi - self.lo > 1:
                return None
            self.prefix, self.lo, self.hi = (*self.prefix, self.lo), 0, _TOP

    def among(self, rows: list[tuple[int, int, int, int]], slack: float) -> tuple[tuple[int, ...], tuple[int, int]]:
        """The splitter among the interval's own rows (LEVELS, size) in order: the nearest place between two keys of the least depth that is near enough, else the nearest place at all."""
        best = None
        for depth in range(len(self.prefix) + 1, len(LEVELS) + 1):
            at, places = self.below, []
            for k, row in enumerate(rows):
                if not k or row[:depth] != rows[k - 1][:depth]:
                    places.append((abs(at[0] - self.goal), k, row[:depth], at))
                at = (at[0] + row[3], at[1] + 1)
            places.append((abs(at[0] - self.goal), len(rows), (*self.prefix, self.hi), at))
            best = min(places)
            if best[0] <= slack:
                break
        return best[2], best[3]


def _under(columns: list[np.ndarray], prefix: tuple[int, ...]) -> np.ndarray:
    mine = np.ones(len(columns[0]), bool)
    for column, value in zip(columns, prefix):
        mine &= column == _U(value)
    return mine


def _key_columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [_order(C.column(batch, c).to_numpy()) for c in LEVELS]


def _unsigned(x) -> int:
    return int(x) & (_TOP - 1)


def count_slots(keys: DataFrame, asked: dict[tuple, list[int]]) -> dict[tuple, list[tuple[int, int, int, int]]]:
    """For each interval (prefix, lo, hi) with its edges, its slots with rows: exact (bytes, rows, least key, greatest key), in key order. One pass over all keys."""
    by_prefix: dict[tuple[int, ...], np.ndarray] = {}
    for prefix, _, _ in asked:
        if prefix not in by_prefix:
            edges = {e for i, some in asked.items() if i[0] == prefix for e in some}
            by_prefix[prefix] = np.array(sorted(e for e in edges if e < _TOP), _U)

    def run(batches):
        total = {p: (np.zeros((2, len(x) + 1), np.int64), np.full(len(x) + 1, _TOP - 1, _U), np.zeros(len(x) + 1, _U)) for p, x in by_prefix.items()}
        for b in batches:
            size, columns = C.column(b, "size").to_numpy(), _key_columns(b)
            for p, x in by_prefix.items():
                mine = _under(columns, p)
                key = columns[len(p)][mine]
                at = np.searchsorted(x, key, "right")
                sums, least, greatest = total[p]
                sums[0] += np.bincount(at, size[mine], len(x) + 1).astype(np.int64)
                sums[1] += np.bincount(at, minlength=len(x) + 1)
                np.minimum.at(least, at, key)
                np.maximum.at(greatest, at, key)
        for n, (sums, least, greatest) in enumerate(total.values()):
            some = np.flatnonzero(sums[1])
            # Keys travel in signed order, so that the least and greatest are found by the engine.
            yield pa.RecordBatch.from_pydict({"p": np.full(len(some), n, np.int64), "slot": some.astype(np.int64), "bytes": sums[0, some], "rows": sums[1, some], "least": _order(least[some].view(np.int64)).view(np.int64), "greatest": _order(greatest[some].view(np.int64)).view(np.int64)})

    kinds = "p long, slot long, bytes long, rows long, least long, greatest long"
    counted = keys.mapInArrow(C.released(run), kinds).groupBy("p", "slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("greatest").alias("greatest")).collect()
    found = {(r.p, r.slot): (r.bytes, r.rows, _unsigned(r.least ^ -(1 << 63)), _unsigned(r.greatest ^ -(1 << 63))) for r in counted}
    out = {}
    for interval in asked:
        prefix, lo, hi = interval
        p, x = list(by_prefix).index(prefix), by_prefix[prefix]
        last = len(x) if hi >= _TOP else int(np.searchsorted(x, _U(hi)))
        out[interval] = [found[p, s] for s in range(int(np.searchsorted(x, _U(lo))) + 1, last + 1) if (p, s) in found]
    return out


def fetch_rows(keys: DataFrame, asked: list[tuple]) -> dict[tuple, list[tuple[int, int, int, int]]]:
    """The rows (LEVELS, size) of each interval (prefix, lo, hi), in order; the caller knows that they are few."""

    def run(batches):
        for b in batches:
            columns = _key_columns(b)
            for n, (prefix, lo, hi) in enumerate(asked):
                key = columns[len(prefix)]
                mine = np.flatnonzero(_under(columns, prefix) & (key >= _U(lo)) & (key <= _U(hi - 1)))
                if len(mine):
                    yield pa.RecordBatch.from_pydict({"n": np.full(len(mine), n, np.int64), **{c: columns[k][mine].view(np.int64) for k, c in enumerate(LEVELS)}, "size": C.column(b, "size").to_numpy()[mine]})

    got: dict[tuple, list] = {i: [] for i in asked}
    for r in keys.mapInArrow(C.released(run), f"n long, {', '.join(f'{c} long' for c in LEVELS)}, size long").collect():
        got[asked[r.n]].append((*(_unsigned(r[c]) for c in LEVELS), r.size))
    return {i: sorted(rows) for i, rows in got.items()}


def find_splitters(keys: DataFrame, total: tuple[int, int], goals: list[int], slack: float, probes: int = PROBES, fetch: int = FETCH) -> list[tuple[tuple[int, ...], tuple[int, int]]]:
    """For each goal (ascending bytes): a key (compared as far as it goes) and the exact (bytes, rows) below it.

    A splitter is settled if an end of its interval is within `slack` of the goal. If its interval has come down to
    one key that weighs too much, the search goes on inside that key at the next level, at the last of which the
    nearer end is taken. Intervals of `fetch` rows or fewer are fetched and settled by their rows.
    """
    found: list = [((0,), (0, 0)) if not total[1] else None for _ in goals]
    state = [Splitter(g, total) for g in goals]
    while True:
        for i, s in enumerate(state):
            found[i] = found[i] or s.settle(slack)
        todo = [s for s, f in zip(state, found) if f is None]
        if not todo:
            return found
        few = list(dict.fromkeys(s.interval for s in todo if s.above[1] - s.below[1] <= fetch))
        if few:
            rows = fetch_rows(keys, few)
            for i, s in enumerate(state):
                if found[i] is None and s.interval in rows:
                    found[i] = s.among(rows[s.interval], slack)
        many = {s.interval: s.edges(probes) for s in todo if s.above[1] - s.below[1] > fetch}
        if many:
            slots = count_slots(keys, many)
            for i, s in enumerate(state):
                if found[i] is None:
                    s.narrow(slots[s.interval])


def _pieces(h: np.ndarray, i: np.ndarray, r: np.ndarray, splitters: list[tuple[int, ...]]) -> np.ndarray:
    """For each row, how many splitters its key reaches. Splitters inside a group of equal texts are few and looked at one by one."""
    shallow = np.array(sorted(s[0] for s in splitters if len(s) == 1 and s[0] < _TOP), _U)
    deep = sorted(s for s in splitters if len(s) > 1)
    out = np.searchsorted(shallow, h, "right") + np.searchsorted(np.array([s[0] for s in deep], _U), h, "left")
    for s in deep:
        same = np.flatnonzero(h == _U(s[0]))
        if len(same) and s[1] < _TOP:
            reach = i[same] > _U(s[1]) if len(s) > 2 else i[same] >= _U(s[1])
            if len(s) > 2 and s[2] < _TOP:
                reach |= (i[same] == _U(s[1])) & (r[same] >= _U(s[2]))
            out[same] += reach
    return out


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, pieces: int | None = None) -> DataFrame:
    """Every row of docs in a struct `row`, with size, shard and slot; partitions hold shards' pieces in order.

    A row weighs its text's UTF-8 bytes plus 16 (null: 16). Each shard is also cut into `pieces` ranges, found in the
    same way, so that no task holds a shard and slots (gapless from 0 in each shard, in key order) come from prefix
    sums of exact counts. Whole rows are exchanged once. Very long texts are rows like others: shards differ by about
    the longest row where that is more than the tolerance. Ties: rows equal in all keys (repeated rows) keep an order
    of their own. Ids are whole numbers, null first, or of any other type, by a hash. Fewer rows than shards leave
    shards empty; an empty table gives no rows; other columns, of any name and type, stay inside `row`.
    """
    C.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    n_pieces = pieces or max(1, -(-C.parallelism(docs) // shards))
    text = C.col(docs, text_col).cast("string")
    whole_id = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    # Maps have no hash of their own.
    hashed = [C.col(docs, c).cast("string") if "map<" in docs.schema[c].dataType.simpleString() else C.col(docs, c) for c in docs.columns]
    source = docs.select(
        F.struct(*[C.col(docs, c) for c in docs.columns]).alias("row"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.xxhash64(text).alias("h"),
        F.coalesce(C.col(docs, id_col).cast("long") if whole_id else F.xxhash64(hashed[docs.columns.index(id_col)]), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(F.lit(7), text, *hashed).alias("r"),
    )
    keys = C.materialize(source.select("size", *LEVELS), "keys")
    total = keys.agg(F.sum("size"), F.count(F.lit(1))).first()
    whole = (int(total[0] or 0), int(total[1]))
    every = shards * n_pieces
    goals = [whole[0] * k // every for k in range(1, every)]
    found = find_splitters(keys, whole, goals, tolerance * whole[0] / shards)
    splitters = [f[0] for f in found]
    before = [0, *(f[1][1] for f in found)]
    base = [before[p] - before[p // n_pieces * n_pieces] for p in range(every)]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_pieces(*(_order(C.column(b, c).to_numpy()) for c in LEVELS), splitters).astype(np.int32))], [*b.schema.names, "piece"])

    def number(batches):
        at: dict[int, int] = {}
        for b in batches:
            piece = C.column(b, "piece").to_numpy()
            slot = np.zeros(len(piece), np.int64)
            for p in np.unique(piece).tolist():
                mine = piece == p
                start = at.get(p, base[p])
                slot[mine] = start + np.arange(mine.sum())
                at[p] = start + int(mine.sum())
            yield pa.RecordBatch.from_arrays([C.column(b, "row"), C.column(b, "size"), pa.array((piece // n_pieces).astype(np.int32)), pa.array(slot)], ["row", "size", "shard", "slot"])

    row, size, long, whole_number = source.schema["row"], T.StructField("size", T.LongType()), T.LongType(), T.IntegerType()
    placed = source.mapInArrow(C.released(run), T.StructType([row, size, *(T.StructField(c, long) for c in LEVELS), T.StructField("piece", whole_number)]))
    kinds = T.StructType([row, size, T.StructField("shard", whole_number), T.StructField("slot", long)])
    return placed.repartitionById(every, "piece").sortWithinPartitions("piece", *LEVELS).mapInArrow(C.released(number), kinds)


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
