"""The ten operators against brute force, on awkward rows, and as a pipeline."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from velotrace.llm import common as C
from velotrace.llm import decontamination, line_dedup, packing, quality, sharding, simhash, substring_dedup, token_files, tokens
from velotrace.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, h long, id long, piece int, key long"


def awkward(spark):
    """Nulls in any column, empty and blank texts, a long text, ties, repeated rows, columns with clashing names."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=80))
    lines = "\n".join(" ".join(rng.choices(words, k=9)) for _ in range(12))
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "one", f"a b c {passage} d e", f"{passage}\nx y", lines, f"extra line\n{lines}\nlast", "stop " * 300, " ".join(rng.choices(words, k=4000)), "É à ñ 日本 <|endoftext|>\x1c x", "Same Words here", "same words HERE"]
    texts += [lines.replace("w1 ", "w2 ", 1), " ".join(rng.choices(words, k=60))]
    rows = [(k, t, None if k % 3 else "en", "s", None, 5, "r", 1, 2, 3, 4) for k, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", 1, 5, "r", 1, 2, 3, 4), (5, texts[5], "en", "s", 1, 5, "r", 1, 2, 3, 4), (None, "no id at all", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


def test_substring_dedup(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    texts = [words_of(r.text) for r in rows]
    count = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    want = []
    for r, w in zip(rows, texts):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((r.doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    got = substring_dedup.remove_repeats(docs, with_text=True).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_frequent_anchors_are_split(spark, monkeypatch):
    """One 8-gram before many different continuations, of which some recur: keys differ by continuation, equal windows have equal keys."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    common = [f"zz{k}" for k in range(8)]
    bodies = [common + rng.choices(vocab, k=60) for _ in range(3000)]
    texts = [rng.choices(vocab, k=20) + b for b in bodies + bodies[:5]]
    data, counts = substring_dedup.normalised([" ".join(t).encode() for t in texts])
    w = substring_dedup.Windows(data, counts, 35, 8)
    # The common 8-gram is made the anchor of all windows that have it.
    hot = next(g for g, c in zip(*np.unique(w.grams, return_counts=True)) if c >= 3000)
    order = np.where(w.grams == hot, 0, w.grams | np.uint64(1))
    w.place = substring_dedup._leftmost_min(order, 28)[: len(w.valid)]
    recurring = np.array([hot])
    for frequent, most in ((False, None), (True, 60)):
        keys, lo, hi = substring_dedup.context_runs(w, recurring, np.array([frequent]), 35, 8)
        spread = np.unique(keys, return_counts=True)[1].max()
        assert spread <= most if most else spread == len(texts)
        seen = {}
        for key, a, b in zip(keys.tolist(), lo.tolist(), hi.tolist()):
            for i in range(a, b + 1):
                assert seen.setdefault(data.tobytes()[w.starts[i] : w.ends[i + 34]], key) == key
        assert sum(b - a + 1 for a, b in zip(lo, hi)) == (w.valid & (w.grams[w.place] == hot)).sum()


def test_substring_dedup_small_shards(spark, monkeypatch):
    phrases = [b"a b c d", b"b c d e", b"c d"]
    found = set()
    for codes, automaton in substring_dedup.automata(phrases, nodes=10):
        text = "".join(codes.get(w, substring_dedup._OTHER) for w in b"x a b c d e c d".split())
        found |= {(end, n) for end, n in automaton.iter(text)}
    assert {n for _, n in found} == {4, 2}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.execute(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert got[cols].astype(str).sort_values(cols).values.tolist() == want[cols].astype(str).sort_values(cols).values.tolist()


def brute_lines(rows):
    """Kept text of each distinct (id, text), from the definition."""

    def chunks(text):
        x = text.split("\n")
        h = [int(hashlib.md5(line.encode()).hexdigest()[:8], 16) for line in x]
        out, own = [], []
        for i, line in enumerate(x):
            own.append(line)
            if (h[i] + (31 * h[i - 1] if i else 0)) % 3 == 0 or i == len(x) - 1:
                out.append(own)
                own = []
        return out

    seen = {}
    for k, t in rows:
        for c, own in enumerate(chunks(t or "")):
            if len(own) > 1 and re.search(r"\S", "\n".join(own)):
                seen.setdefault("\n".join(own), set()).add((k is not None, k, t, c))
    first = {b: min(s, key=lambda x: x[:2]) for b, s in seen.items()}
    out = {}
    for k, t in rows:
        keep = [own for c, own in enumerate(chunks(t or "")) if "\n".join(own) not in first or first["\n".join(own)][1:] == (k, t, c)]
        out[k, t] = "\n".join(line for own in keep for line in own)
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    shared = [f"line {k} of it" for k in range(40)]
    rows = [(k, "\n".join([f"own {k}", *shared[rng.randrange(5) : rng.randrange(20, 40)], f"end {k}"])) for k in range(12)] + [(90, None), (91, ""), (92, "\n\n\n"), (93, "\n\n\n"), (None, "\n".join(shared))]
    rows.append(rows[3])
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, chunks int").repartition(3)
    found = line_dedup.dedup_lines(df)
    got = found.select("row.*", line_dedup.kept_text(F.col("row.text"), F.col("chunks"), F.col("cut")).alias("kept")).collect()
    assert len(got) == len(rows)
    want = brute_lines(rows)
    for r in got:
        assert (r.kept or "") == want[r.doc_id, r.text] and (r.kept is None) == (r.text is None)
    assert any(r.kept != r.text for r in got)
    long = "\n".join(f"line {k % 5000}" for k in range(100_000))
    both = spark.createDataFrame([(1, long), (2, "x\n" + long)], "doc_id long, text string")
    t = time.perf_counter()
    sizes = {r.id: (r.n, r.kept) for r in line_dedup.dedup_lines(both).select("row.doc_id", F.size("cut").alias("n"), F.length(line_dedup.kept_text(F.col("row.text"), F.col("chunks"), F.col("cut"))).alias("kept")).toDF("id", "n", "kept").collect()}
    assert sizes[2][0] > sizes[1][0] > 10_000 and sizes[1][1] < len(long) / 2 and time.perf_counter() - t < 60
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_encoder_equals_library():
    path = tokens.byte_bpe()
    t = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "hello <|endoftext|> x", "<|endoftext|><|endoftext|>a<|endoftext|>", "a <|endoftext|>", "<|endoftext", "<|ENDOFTEXT|>", "", " ", "a  b\n\n c", "It's we'll DON'T x's", "1234 12a b3 ²³ ½", " x  y", "\x1c\x1d z\x85", "日本語 ру́сский", "<|endoftext|> a", "tab\t\tend\r\n", "é ü ß ñ ¿qué?", "a" * 5000, "x" + " " * 50 + "y", "…—“q”"]
    rng = random.Random(2)
    texts += ["".join(rng.choices("ab é'st1 \n\t.,$ßÀ", k=rng.randrange(200))) for _ in range(300)]
    for dtype in ("<u2", "<u4"):
        assert [x.tolist() for x in tokens.Encoder(path, dtype).ids(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def expected_ids(texts, end):
    t = Tokenizer.from_file(tokens.byte_bpe())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_packing(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = packing.pack_documents(docs, tokens.byte_bpe(), capacity=64, with_ids=True, block=10, open_bins=3).collect()
    want = Counter()
    for r, ids in zip(rows, expected_ids([r.text for r in rows], 2)):
        rest = len(ids) % 64
        cuts = ([(0, rest)] if rest else []) + [(s, 64) for s in range(rest, len(ids), 64)]
        for n, (s, k) in enumerate(cuts):
            raw = np.array(ids[s : s + k], "<u4").tobytes()
            want[r.doc_id, n, s, k, zlib.crc32(raw), raw] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty(spark), tokens.byte_bpe()).count() == 0


def test_best_fit_is_tight():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 1024, 20_000)
    p, n = packing.BestFit(), 0
    for lo in range(0, len(items), packing.BLOCK):
        for k in sorted(items[lo : lo + packing.BLOCK], reverse=True):
            n += p.add(int(k), 0) is not None
    n += len(p.flush())
    assert n <= 1.03 * items.sum() / 1024
    p = packing.BestFit(10, 2)
    assert p.add(6, "a") is None and p.add(7, "b") is None
    assert p.add(8, "c") == [("b", 0)]  # the fullest closes
    assert p.add(4, "d") == [("a", 0), ("d", 6)]
    with pytest.raises(ValueError):
        p.add(11, "e")


def brute_fingerprint(text, size):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + size]).encode(), 42) for k in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [3, 14])
def test_simhash(spark, docs, radius):
    rows = docs.select("doc_id", "text").collect()
    fp = np.array([brute_fingerprint(r.text, 3) for r in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp) <= radius
    group = np.arange(len(rows))
    while True:
        new = np.array([group[near[k]].min() for k in range(len(rows))])
        if (new == group).all():
            break
        group = new
    first = {g: min((r.doc_id for r, k in zip(rows, group) if k == g and r.doc_id is not None), default=None) for g in set(group)}
    got = simhash.near_duplicates(docs, radius=radius).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter((r.doc_id, int(f), first[g]) for r, f, g in zip(rows, fp, group))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_near_links_lose_nothing(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    some = np.unique(np.concatenate([base, base[:150] ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64)), base[:80] ^ np.uint64(0b1011)]))
    df = spark.createDataFrame([(int(x),) for x in some.view(np.int64)], "fp long").selectExpr("fp", "fp AS key")
    links = {(r.node, r.root) for r in simhash.components(simhash.near_links(df, 3)).collect()}
    near = np.bitwise_count(some[:, None] ^ some) <= 3
    root = {a: b for a, b in links}
    for i, j in zip(*np.nonzero(near)):
        if i != j:
            assert root[int(some.view(np.int64)[i])] == root[int(some.view(np.int64)[j])]
    assert len(set(root.values())) == len({frozenset(x) for x in _closure(near)})


@pytest.mark.parametrize("verified", [False, True])
def test_near_links_of_one_large_cluster(verified):
    """4,000 near copies, all in reach of each other, take no step for each of 16 million pairs."""
    rng = np.random.default_rng(3)
    flips = [(1 << a) | (1 << b) | (1 << c) for a, b, c in (rng.choice(64, 3, replace=False).tolist() for _ in range(4200))]
    many = np.unique(np.uint64(0x0123456789ABCDEF) ^ np.array(flips, np.uint64))[:4000]
    forest, asked, t = simhash.Forest(), [], time.process_time()
    same = (lambda p, q: asked.append(1) or True) if verified else None
    for lo in range(0, len(many), simhash.TILE):
        for lo2 in range(lo, len(many), simhash.TILE):
            a, b = many[lo : lo + simhash.TILE], many[lo2 : lo2 + simhash.TILE]
            simhash.link_pairs(forest, a.view(np.int64), b.view(np.int64), *simhash.compare_tiles(a, b, 6), same)
    assert time.process_time() - t < 2 and len(many) > 3900
    assert len({forest.root(int(k)) for k in many.view(np.int64)}) == 1 and len(forest.edges) == len(many) - 1
    assert len(asked) == (len(many) - 1) * verified


def test_links_that_count_connect():
    """Pairs of which some do not count: the components are those of all that do, none is left out."""
    rng = np.random.default_rng(7)
    for trial in range(20):
        x, y = rng.integers(0, 60, 900), rng.integers(0, 50, 900)
        good = {(int(p), int(q)) for p, q in zip(x, y) if rng.random() < 0.03 * trial / 5}
        forest, plain = simhash.Forest(), simhash.Forest()
        a, b = np.arange(60), np.arange(50) + 1000
        simhash.link_pairs(forest, a, b, x, y, lambda p, q: (p, q) in good)
        for p, q in good:
            plain.link(p, q + 1000)
        keys = [*a.tolist(), *b.tolist()]
        assert len({(forest.root(k), plain.root(k)) for k in keys}) == len({forest.root(k) for k in keys}) == len({plain.root(k) for k in keys})


def test_recall_of_candidates():
    """Pairs of texts at a similarity of 0.8 or just above, from a few shingles to many: their wide fingerprints are in reach."""
    rng, missed, n = np.random.default_rng(11), 0, 0
    for union in (6, 10, 16, 25, 60, 200):
        both = -(-4 * union // 5)
        for _ in range(150):
            h = rng.integers(0, 1 << 64, union, dtype=np.uint64)
            own = int(rng.integers(0, union - both + 1))
            a, b = (np.array(simhash.wide_fingerprint(x), np.uint64) for x in (h[: both + own].tolist(), np.concatenate([h[:both], h[both + own :]]).tolist()))
            bits = np.bitwise_count(a ^ b)
            missed += bits[0] > 24 or bits.sum() > 72
            n += 1
    assert missed <= 1, f"{missed} of {n}"


def test_tiles_by_size(spark):
    """Sets of very unlike sizes are not compared; every pair of sizes that allows the similarity is."""
    rng = np.random.default_rng(9)
    sizes = np.exp(rng.uniform(0, np.log(50_000), 60_000)).astype(int)
    hist = Counter(simhash.size_cell(int(n)) for n in sizes)
    tiles = simhash._tiles(list(hist.items()), 24, True)
    assert tiles["n"].sum() == len(sizes)
    ends = [simhash._near(tiles, i, 24, 0.8)[-1] for i in range(len(tiles["n"]))]
    cells = np.array(sorted(hist))
    of = np.searchsorted(tiles["lo"][:, 0], cells, "right") - 1
    for n in sizes[:500].tolist():
        furthest = int(of[np.searchsorted(cells, simhash.size_cell(int(n / 0.8)), "right") - 1])
        assert furthest <= ends[int(of[np.searchsorted(cells, simhash.size_cell(n))])]
    compared = sum(int(tiles["n"][i]) * int(tiles["n"][simhash._near(tiles, i, 24, 0.8)].sum()) for i in range(len(tiles["n"])))
    assert compared < 0.15 * len(sizes) ** 2 / 2
    # The same links come out, whichever way items are sorted.
    h = rng.integers(0, 1 << 63, (300, 3)).repeat(2, 0)
    h[1::2] ^= 1 << rng.integers(0, 62, (300, 3))
    rows = [(int(x[0]), k, int(5 + k % 100 // 2 * 2)) for k, x in enumerate(h)]
    df = spark.createDataFrame(rows, "fp long, key long, size long")
    plain, sized = ({frozenset((r.a, r.b)) for r in simhash.near_links(d, 3, similarity=0.8).collect()} for d in (df.drop("size"), df))
    assert plain == sized and len(plain) == 300


def test_keep_one_equals_all_pairs(spark):
    """1,000 documents against the Jaccard similarity of all their pairs."""
    sf = SF.replace("0.001", "0.01")
    source = spark.read.parquet(f"{sf}/documents.parquet")
    rows = source.select("doc_id", "text").collect()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [words_of(lower(r.text))] for i in range(max(1, len(w) - 4))} for r in rows}
    where = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in sets.items():
        for o, both in Counter(o for x in s for o in where[x] if o > k).items():
            if both >= 0.8 * (len(s) + len(sets[o]) - both):
                a, b = sorted((root(k), root(o)))
                up[b] = a
    assert sorted(r.doc_id for r in simhash.keep_one(source).select("doc_id").collect()) == sorted({root(k) for k in sets})


def _closure(near):
    left, out = set(range(len(near))), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            i = todo.pop()
            own.add(i)
            new = set(np.flatnonzero(near[i])) & left
            left -= new
            todo += list(new)
        if len(own) > 1:
            out.append(own)
    return out


def test_keep_one(spark, docs):
    rng = random.Random(6)
    words = [f"v{k}" for k in range(500)]
    a = rng.choices(words, k=300)
    b = a[:150] + ["new"] + a[151:]
    far = a[:200] + rng.choices(words, k=100)
    rows = [(10, " ".join(a)), (4, " ".join(b)), (7, " ".join(far)), (9, " ".join(a).upper()), (1, None), (2, ""), (3, "short one"), (3, "short one"), (8, "Short  ONE")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, key string").repartition(3)
    got = sorted((r.doc_id, r.text or "") for r in simhash.keep_one(df).collect())
    assert [k for k, _ in got] == [1, 3, 4, 7]
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(empty(spark)).count() == 0


def test_decontamination(spark, docs, monkeypatch):
    rng = random.Random(9)
    words = [f"q{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([40, 13, 14, 5, 1, 0, 60])] + [(20, None), (21, "Q1, q2; Q3"), (22, "q1 q2 q3"), (None, "q7 q8 q9 q7")]
    texts = [" ".join(rng.choices(words, k=200)), items[0][1].upper() + " x " * 10, "foo " + items[1][1] + " bar", "q1-q2-q3", " ".join(items[6][1].split()[5:30]), None, "", "é", "y " * 59 + "q1 q2 q3", "y " * 57 + "q1 q2 q3"]
    texts += [" ".join(rng.choices(words[:4], k=50)) for _ in range(20)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    for shard in (200_000, 30):
        got = {r.doc_id: r for r in decontamination.find_contamination(df, bench, shard_words=shard, cut=True).collect()}
        for k, t in enumerate(texts):
            w, hit, names = norm(t), set(), set()
            for name, item in items:
                x = norm(item)
                n = min(13, len(x))
                for s in range(len(x) - n + 1 if x else 0):
                    for i in range(len(w) - n + 1):
                        if w[i : i + n] == x[s : s + n]:
                            hit.update(range(i, i + n))
                            names.add(str(name))
            r = got[k]
            assert (r["__n_words"], r["__n_hit"], r["__items"]) == (len(w), len(hit), sorted(names - {"None"}))
            assert r["__contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
            word = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
            places = [m.span() for m in word.finditer(t or "")]
            spans = [(places[s.start][0], places[s.stop - 1][1]) for s in r["__spans"]]
            assert r["__text"] == (t and "".join(t[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)])))
            assert all(j in hit for s in r["__spans"] for j in range(s.start, s.stop))
    with pytest.raises(ValueError):
        decontamination.find_contamination(df.withColumnRenamed("spans", "__spans"), bench, keep=["__spans"])
    shared = decontamination.SuffixAutomaton(3)
    for _ in range(20_000):
        shared.add([b"a", b"b", b"c"])
    t = time.perf_counter()
    assert [len(x) for x in shared.close().items.values()] == [20_000] and time.perf_counter() - t < 2
    assert decontamination.find_contamination(df, bench.limit(0)).where("__n_hit > 0").count() == 0
    assert decontamination.find_contamination(docs, bench, keep=docs.columns).count() == docs.count()
    assert decontamination.find_contamination(empty(spark), bench).count() == 0


def test_quality(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        t, w = r.text or "", words_of(r.text)
        lines = [x for x in t.split("\n") if words_of(x)]
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want[r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t) if w else 0, len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)] += 1
    got = quality.judge(docs).collect()
    assert Counter((r.row.doc_id, *(r[c] for c in quality.BASE), r.base_failed) for r in got) == want
    assert all(not (r.kept and r.base_failed) and 0 <= r.quality <= 1 for r in got)
    assert quality.judge(empty(spark)).count() == 0


def plain_measures(text):
    """The further measures of the rules, by their names, without shortcuts."""
    text = text or ""
    w = [x.encode() for x in words_of(text)]
    if not w:
        return dict.fromkeys(quality.MORE, 0)
    lines = [x for x in text.split("\n") if words_of(x)]
    bare = [x.strip(b".,;:!?()\"'").lower() for x in w]
    return {
        "n_lines": len(lines),
        "n_closed_lines": sum(bool(re.search("[.!?…:][ \t\r\x0b\x0c\"')»”]*$", x)) for x in lines),
        "n_stop_words": sum(x in quality.STOP_WORDS for x in bare),
        "n_top_word": max(w.count(x) for x in w),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_letters": sum("a" <= c <= "z" or "A" <= c <= "Z" for c in text),
        "n_plain_words": sum(x.decode().isalpha() for x in bare),
        "n_bangs": text.count("!"),
        "n_same_next": sum(a == b for a, b in zip(w, w[1:])),
    }


def test_quality_votes():
    """Measures and votes of all rules against their definitions, on awkward texts and on given ones."""
    import pyarrow.parquet as pq

    texts = [None, "", " \n ", "The end.", "A A A a!\n(The) é日本 b2 \"quoted.\"\nno end\n\n.", "STOP!!! " * 40, "x\x1cy z.\x0b"] + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:60]
    m = quality.measures(texts)
    names = (*quality.BASE, *quality.MORE)
    for row, t in zip(m, texts):
        own = dict(zip(names, row.tolist()))
        assert {k: own[k] for k in quality.MORE} == plain_measures(t), t
    for row, votes in zip(m, quality.votes(m)):
        own = dict(zip(names, row.tolist()))
        for (what, of, good, bad), vote in zip(quality.RULES.values(), votes.tolist()):
            share = own[what] / own[of] if own[of] else None
            low = good < bad
            want = 2 if share is None else 1 if (share <= good if low else share >= good) else 0 if (share > bad if low else share < bad) else 2
            assert vote == want


def test_quality_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.7
    v = np.stack([np.where(rng.random(len(y)) < 0.2, 2, np.where(rng.random(len(y)) < a, y, ~y)) for a in (0.9, 0.8, 0.7, 0.85)], 1)
    patterns, inverse, count = np.unique(quality.pattern(v), return_inverse=True, return_counts=True)
    post, table, prior = quality.expectation_maximisation(patterns, count, rules=4)
    assert abs(prior - 0.7) < 0.05 and ((post[inverse] > 0.5) == y).mean() > 0.9
    assert abs(table[0, 1, 1] / (table[0, 1, 1] + table[0, 1, 0]) - 0.9) < 0.04
    assert len(quality.expectation_maximisation(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


def test_quality_agrees_with_labels(spark):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op6_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").toPandas()
    assert (got.kept == (got.label == 1)).mean() > 0.95


def test_token_files(spark, docs):
    uri = C.shared_dir(spark, "test")
    manifest = token_files.write_tokens(docs, tokens.byte_bpe(), uri, partitions=4)
    got = token_files.read_tokens(spark, uri, len(manifest), token_files.id_type(tokens.byte_bpe()), docs.schema["doc_id"].dataType).collect()
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r, ids in zip(rows, expected_ids([r.text for r in rows], 0)))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    none = C.shared_dir(spark, "test")
    assert token_files.read_tokens(spark, none, len(token_files.write_tokens(empty(spark), tokens.byte_bpe(), none)), "<u2", docs.schema["doc_id"].dataType).count() == 0


def test_sharding(spark, docs):
    for df, shards in ((docs, 4), (spark.read.parquet(f"{SF}/documents.parquet"), 10), (spark.createDataFrame([(1, "same text")] * 200, "doc_id long, text string"), 7)):
        got = sharding.shard_by_bytes(df, shards, pieces=3).collect()
        assert Counter((r.row.doc_id, r.size) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 16) for r in df.collect())
        total, largest = sum(r.size for r in got), max(r.size for r in got)
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r)
        if df is not docs and df.count() != 200:
            assert all(abs(sum(r.size for r in own) - total / shards) <= 2 * largest + 0.02 * total / shards for own in by.values())
        assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
        assert set(by) <= set(range(shards))
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


@pytest.mark.parametrize("fetch", [0, 20, 10_000])
def test_splitters_are_nearest(spark, fetch):
    rng = np.random.default_rng(2)
    rows = [(int(h), int(i), 0, int(s)) for i, (h, s) in enumerate(zip(rng.integers(-(2**63), 2**63 - 1, 500), rng.integers(10, 90, 500)))]
    rows += [(77, k, int(k % 3), 40) for k in range(200)] + [(78, 5, k, 30) for k in range(150)] + [(2**63 - 1, 2**63 - 1, 2**63 - 1, 9)] * 3
    df = spark.createDataFrame(rows, "h long, id long, r long, size long").repartition(3).cache()
    total, rounds = sum(r[3] for r in rows), []
    real = sharding.count_slots
    goals = [total * k // 16 for k in range(1, 16)]
    ordered = sorted(rows)
    ends = np.cumsum([r[3] for r in ordered])
    # A place is between two rows of different keys.
    places = [0, *(int(e) for k, e in enumerate(ends) if k + 1 == len(ordered) or ordered[k][:3] != ordered[k + 1][:3])]
    sharding.count_slots = lambda *a: rounds.append(1) or real(*a)
    try:
        found = sharding.find_splitters(df, (total, len(rows)), goals, 0, fetch=fetch)
    finally:
        sharding.count_slots = real
    for goal, (key, (below, n)) in zip(goals, found):
        assert abs(below - goal) == min(abs(p - goal) for p in places) and below == (ends[n - 1] if n else 0)
        unsigned = lambda r: tuple(x + (1 << 63) for x in r[:3])
        assert sum(unsigned(r)[: len(key)] < key for r in rows) == n
    assert len(rounds) < 10


def test_odd_names_and_ids(spark):
    """Columns whose names or types need quoting, maps inside structs, string ids: all operators that keep columns or ids."""
    rows = [(f"k{k % 9}", " ".join(f"w{j * k % 13}" for j in range(40)), 1, {"m": k}, ({"n": k}, 2.0)) for k in range(30)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, `a b` int, `x:y` map<string,int>, `row` struct<`p q`:map<string,int>,z:double>").withColumn("d.o`t", F.lit(1)).repartition(3)
    whole = sorted(str(r) for r in df.collect())
    assert sorted(str(r.row) for r in quality.judge(df).collect()) == whole
    got = sharding.shard_by_bytes(df, 4).collect()
    assert sorted(str(r.row) for r in got) == whole
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(4))
    uri = C.shared_dir(spark, "test")
    manifest = token_files.write_tokens(df, tokens.byte_bpe(), uri, partitions=4)
    ids = [r.doc_id for r in token_files.read_tokens(spark, uri, len(manifest), "<u2", df.schema["doc_id"].dataType).orderBy("start").collect()]
    assert ids == [None, *sorted(r[0] for r in rows[:-1])]
    assert simhash.keep_one(df).columns == df.columns and 0 < simhash.near_duplicates(df).count() == len(rows)
    assert substring_dedup.remove_repeats(df).count() == len(rows) == packing.pack_documents(df, tokens.byte_bpe()).select("doc_id").count()
    bench = spark.createDataFrame([("i", "w1 w2 w3")], "item_id string, text string")
    assert sorted(str(tuple(r[c] for c in df.columns)) for r in decontamination.find_contamination(df, bench, keep=df.columns).collect()) == sorted(str(tuple(r)) for r in df.collect())
    assert line_dedup.dedup_lines(df).count() == len(rows)


def test_flat_files_are_read_by_ranges(spark, monkeypatch, tmp_path):
    np.arange(100, dtype="<u2").tofile(tmp_path / "a.bin")
    flat = C.Flat(f"file://{tmp_path}/a.bin", "<u2")
    want = flat.read(10, 20).tolist()
    assert flat.mapped is not None and want == list(range(10, 20))
    flat.mapped = None
    assert flat.read(10, 20).tolist() == want and len(flat.read(5, 5)) == 0


def test_shared_folder(spark):
    class Cluster:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: type("Conf", (), {"get": staticmethod(lambda k: None)})())

    class Session:
        sparkContext = Cluster
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError):
        C.shared_dir(Session, "x")


def test_scratch_goes(spark):
    from pyarrow import fs as pafs

    there = lambda uri: C.open_fs(uri)[0].get_file_info(C.open_fs(uri)[1]).type != pafs.FileType.NotFound
    out = C.shared_dir(spark, "out")
    with C.scratch():
        inner = C.shared_dir(spark, "inner")
        df = C.materialize(spark.range(5), "x", out)
        assert there(inner)
    assert not there(inner) and df.count() == 5
    C.remove(out)
    assert not there(out)


def test_tasks_follow_the_data(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert C.parallelism(docs) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(C, "TASK_BYTES", 1000)
    assert C.parallelism(docs) > 50


def test_pipeline(spark, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for start in (source.selectExpr("*", "1 AS `a b`", "map('k', doc_id) AS `x.y`"), source.limit(0), source.unionByName(spark.createDataFrame([(None, None, None, None, None), (3, "", None, None, 0)], source.schema)).unionByName(source.limit(5))):
        df, before = start, start.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = C.materialize(stage(spark, df, str(tmp_path)), name)
            assert df.columns == start.columns and df.count() <= before
            before = df.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
        assert pieces.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
    bad = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("-item_id - 1 AS doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert corpus_pipeline.decontaminate(spark, bad, str(tmp_path)).count() == 0
    some = bad.limit(1).crossJoin(source.where("n_chars > 9000").limit(1).selectExpr("text AS t")).selectExpr("doc_id", "concat(t, chr(10), text, chr(10), t) AS text", "lang", "source", "n_chars")
    [cut] = corpus_pipeline.decontaminate(spark, some, str(tmp_path)).collect()
    [whole] = some.collect()
    assert cut.n_chars == len(cut.text) < len(whole.text) and cut.text.startswith(whole.text[:9000])
    kept = corpus_pipeline.near_dedup(spark, source, str(tmp_path)).toPandas()
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [words_of(r.text.lower())] for i in range(max(1, len(w) - 4))} for r in source.collect()}
    for k in set(sets) - set(kept.doc_id):
        assert max(len(sets[k] & sets[o]) / len(sets[k] | sets[o]) for o in sets if o != k) >= 0.8
    ids = sorted(kept.doc_id)
    for a in ids:
        for b in ids:
            assert a >= b or len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
