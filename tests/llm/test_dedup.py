import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from .odd import TEXTS, documents

from gridweave.llm import bwt, common, embeddings, exact, simhash, substrings, windows


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# -- exact -------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [1000, 2])
def test_exact_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    monkeypatch.setattr(exact, "HOT_KEYS", hot)
    df = documents(spark).union(documents(spark).where("doc_id IN (5, 9)"))
    got = sorted(tuple(r) for r in exact.exact_groups(df, salts=3).collect())
    texts = [*enumerate(TEXTS), (5, TEXTS[5]), (9, TEXTS[9])]
    want = []
    for i, t in texts:
        same = [j for j, u in texts if low(u) == low(t)]
        want.append((i, max(same), len(same), i == max(same), hashlib.sha256(low(t).encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("hot", [1000, 3])
def test_exact_groups_of_null_ids(spark, monkeypatch, hot):
    """A null id wins only where there is no other, and a third of all rows may be one group."""
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    monkeypatch.setattr(exact, "HOT_KEYS", hot)
    rows = [(None, "a"), (None, "A"), (3, "a"), (None, "b"), (None, "B"), (None, None), (1, "")] + [(i, "Same") for i in range(10, 40)] + [(i, f"w{i}") for i in range(50, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("x"))
    want = []
    for i, t in rows:
        same = [j for j, u in rows if low(u) == low(t)]
        best = max((j for j in same if j is not None), default=None)
        want.append(str((i, best, len(same), i == best)))
    assert sorted(str(tuple(r)[:4]) for r in exact.exact_groups(df).collect()) == sorted(want)


def test_a_clash_of_digests_fails(spark, monkeypatch):
    """Were two contents to share both digests, the job would fail rather than drop one."""
    monkeypatch.setattr(exact, "HOT_KEYS", 2)
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.lit("same"))
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    for hot in (1000, 1):
        monkeypatch.setattr(exact, "HOT_KEYS", hot)
        df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
        with pytest.raises(Exception, match="two contents"):
            exact.exact_groups(df).collect()


def test_exact_keeps_columns_and_empty_table(spark):
    df = documents(spark)
    kept = exact.drop_exact_copies(df.union(df))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 8, 9, 10, 11, 12]
    assert exact.exact_groups(df.limit(0)).count() == 0


# -- simhash -------------------------------------------------------------------------


def slow_simhash(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_value(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 3)
    for t in TEXTS:
        t = t and t[:2000]
        assert simhash.simhash(t) == slow_simhash(t)


def components(n, linked):
    part = list(range(n))
    for _ in range(n):
        for a, b in linked:
            part[a] = part[b] = min(part[a], part[b])
    return part


@pytest.mark.parametrize("n,width", [(1, 10), (2, 10), (40, 3), (400, 50)])
def test_trie_links(n, width):
    rng = np.random.default_rng(n)
    f = rng.integers(0, 1 << 62, n, dtype=np.uint64)
    f[n // 2 :] = f[rng.integers(0, max(1, n // 2), n - n // 2)]
    for i in range(n // 2, n):
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            f[i] ^= np.uint64(1) << np.uint64(b)
    f = np.unique(f)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    want = components(len(f), np.argwhere(near).tolist())
    assert simhash.trie_links(f, np.array([0]), 0, 4, width).tolist() == want


def test_dense_buckets(monkeypatch):
    rng = np.random.default_rng(11)
    f = np.full(1500, rng.integers(0, 1 << 62), np.uint64)
    for i in range(1500):
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            f[i] ^= np.uint64(1) << np.uint64(b)
    f = np.unique(f)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    want = simhash.trie_links(f, np.array([0]), 0, 4).tolist()
    part = np.arange(len(f))
    while True:
        new = np.where(near, part[None], len(f)).min(1)
        if (new == part).all():
            break
        part = new
    assert want == part.tolist()
    monkeypatch.setattr(simhash, "DENSE", 50)
    monkeypatch.setattr(simhash, "DENSE_WIDTH", 300)
    assert simhash.trie_links(f, np.array([0]), 0, 4).tolist() == want


@pytest.mark.parametrize("split", [50_000, 2])
def test_near_links_across_buckets(spark, monkeypatch, split):
    """All pairs within four bits connect, whether or not buckets are dealt again."""
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", split)
    rng = random.Random(split)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for p in base:
        for k in (1, 3, 4, 5):
            q = p
            for b in rng.sample(range(64), k):
                q ^= 1 << b
            prints.add(q)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.near_links(spark.createDataFrame([(s, -s) for s in signed], "fp long, low long")).collect()
    assert all((e.a_low, e.b_low) == (-e.a, -e.b) for e in edges)
    at = {s: i for i, s in enumerate(signed)}
    got = components(len(prints), [(at[e.a], at[e.b]) for e in edges])
    want = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert got == components(len(prints), want)


@pytest.mark.parametrize("split", [50_000, 1])
def test_one_bit_of_each_block_but_one(spark, monkeypatch, split):
    """Prints that agree in a single block, bit 0 and the ends of the blocks among the flipped bits."""
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", split)
    rng = random.Random(12)
    ends = [*simhash.BLOCKS, 64]
    flips = [(0, 15, 30, 45), (0, 13, 26, 39), (12, 25, 38, 51)]
    for free in range(5):
        for _ in range(30):
            flips.append(tuple(rng.choice([ends[b], ends[b + 1] - 1, rng.randrange(ends[b], ends[b + 1])]) for b in range(5) if b != free))
    pairs = []
    for bits in flips:
        p = rng.getrandbits(64)
        pairs.append((p, p ^ sum(1 << (63 - b) for b in bits)))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p), 0) for pair in pairs for p in pair], "fp long, low long")
    got = {frozenset((e.a, e.b)) for e in simhash.near_links(df).collect()}
    assert got == {frozenset(map(signed, pair)) for pair in pairs}


def test_near_groups(spark):
    df = documents(spark)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(df.union(df)).collect()}
    prints = [slow_simhash(t) for t in TEXTS]
    linked = [(i, j) for i in range(len(TEXTS)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = components(len(TEXTS), linked)
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, want))}
    assert simhash.near_groups(df.union(df)).count() == 2 * len(TEXTS)
    assert simhash.near_groups(df.limit(0)).count() == 0
    assert simhash.drop_near_copies(df).columns == df.columns
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == sorted(set(want))


@pytest.mark.parametrize("hot", [1000, 3])
def test_null_and_repeated_ids_in_near_groups(spark, monkeypatch, hot):
    """Ids that are null come last; a repeated id names the groups of all its texts; hot prints join by broadcast."""
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    said = ["the cat sat on the mat", "green hills lie beyond the old river town"]
    rows = [(None, said[0])] * 3 + [(9, said[0]), (4, said[0]), (None, said[1]), (None, None), (4, "snow fell all night"), (7, "")] + [(i, "word") for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.near_groups(df).collect())
    prints = [slow_simhash(t) for _, t in rows]
    want = []
    for (i, _), p in zip(rows, prints):
        same = [j for (j, _), q in zip(rows, prints) if p == q and j is not None]
        want.append(str((i, f"{p:016x}", min(same, default=None))))
    assert all((p ^ q).bit_count() > 4 for p in prints for q in prints if p != q)
    assert got == sorted(want)


@pytest.mark.parametrize("hot", [1000, 4])
def test_connected_components(spark, monkeypatch, hot):
    """Stars, paths and random edges, with structs as vertices."""
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rng = random.Random(hot)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(299, i) for i in range(260, 299)]
    df = spark.createDataFrame([((-a, "v"), (-b, "v")) for a, b in edges], "a struct<x:long,y:string>, b struct<x:long,y:string>")
    got = {r.id.x: r.component.x for r in common.connected_components(df).collect()}
    part = components(300, [(299 - a, 299 - b) for a, b in edges])
    assert got == {-v: part[299 - v] - 299 for e in edges if e[0] != e[1] for v in e}
    assert common.connected_components(df.limit(0)).count() == 0


# -- repeated strings ------------------------------------------------------------------


def test_later_windows_against_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        length, letters = rng.choice([3, 5, 8]), rng.choice([b"ab", b"abc\0\xff"])
        parts = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 8))]
        doc, start = np.array([rng.randrange(4) for _ in parts]), np.array([rng.randrange(5) for _ in parts])
        got = {(i, o) for i, a, z in bwt.later_windows(parts, doc, start, length).tolist() for o in range(a, z)}
        seen = {}
        for i, p in enumerate(parts):
            for o in range(len(p) - length + 1):
                seen.setdefault(p[o : o + length], []).append((doc[i], start[i] + o, i, o))
        want = {(i, o) for v in seen.values() for d, s, i, o in v if (d, s) > min(x[:2] for x in v)}
        assert got == want


def test_lcp_values_come_from_the_transform():
    text = np.frombuffer(b"mississippi\0", np.uint8).astype(np.int16) + 1
    text[-1] = 0
    order = bwt.suffix_order(text, 20)
    raw = bytes(text.astype(np.uint8))
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))
    lcp = bwt.bounded_lcp(text, order, 3)
    assert lcp.tolist() == [0, 0, 1, 1, bwt.UNSET, 0, 0, 1, 0, 2, 1, bwt.UNSET]


def test_every_window_is_in_one_segment():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 99, 100, 101, 700, 3000)]
    sizes = np.array(list(map(len, texts)))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(texts) + bytes(32), np.uint8)
    of, begin, size, anchor = windows.segments(data, starts, sizes, 100)
    got = sorted((o, b + i) for o, b, s in zip(of, begin, size) for i in range(s - 99))
    assert got == [(o, starts[o] + i) for o in range(len(texts)) for i in range(max(0, sizes[o] - 99))]
    by_window = {}
    for o, b, s, a in zip(of, begin, size, anchor):
        for i in range(s - 99):
            by_window.setdefault(bytes(data[b + i : b + i + 100]), set()).add(a)
    assert all(len(v) == 1 for v in by_window.values())


def brute_removed(rows, length):
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            seen[k] = min(seen.get(k, (d, i)), (d, i))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] != (d, i):
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def repeating_documents(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abc é") for _ in range(400)) for _ in range(4)]
    texts = ["".join(b[rng.randrange(200) :][: rng.randrange(400)] for b in rng.sample(base, 3)) for _ in range(40)]
    texts[5:10] = [None, "", "a" * 1500, "a" * 1500, "xy" * 300]
    df = documents(spark, texts)
    df = df.union(df.where("doc_id = 3")).union(df.where("doc_id = 4").withColumn("text", df["lang"]))
    # rows without an id come last and don't precede each other
    none = df.where("doc_id IN (11, 12, 13)").union(df.where("doc_id = 11")).withColumn("doc_id", F.lit(None).cast("long"))
    return df.union(none)


@pytest.mark.parametrize(
    "contents,piece,rows,known",
    [(20_000, 1 << 23, 1 << 18, 1 << 17), (1, 1 << 23, 1 << 18, 1 << 17), (20_000, 500, 1 << 18, 3), (20_000, 1 << 23, 5, 1 << 17), (3, 800, 2, 20)],
)
def test_repeated_spans(spark, monkeypatch, contents, piece, rows, known):
    monkeypatch.setattr(substrings, "COMPARE_ROWS", rows)
    monkeypatch.setattr(substrings, "ANCHOR_CONTENTS", contents)
    monkeypatch.setattr(substrings, "PIECE", piece)
    monkeypatch.setattr(substrings, "KNOWN", known)
    df = repeating_documents(spark)
    want = brute_removed([(common.LAST_ID if r.doc_id is None else r.doc_id, r.text) for r in df.collect()], 100)
    got = substrings.repeated_spans(df).collect()
    assert sorted((common.LAST_ID if r.doc_id is None else r.doc_id, *tuple(r)[1:5]) for r in got) == want
    assert all(sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed for r in got)
    assert sum(r.doc_id is None for r in got) == 4
    assert substrings.repeated_spans(df.limit(0)).count() == 0


def test_claims_of_known_contents():
    """Only the earliest of equal contents asks, over all batches of a task, in any order of documents."""
    rng = random.Random(2)
    claims, rows = substrings.Claims(), []
    for _ in range(30):
        batch = [(rng.randrange(50), rng.randrange(5), rng.choice([b"a", b"b", b"c", bytes([rng.randrange(200)])])) for _ in range(20)]
        doc, start, text = zip(*batch)
        n = len(batch)
        out = claims.rows(np.full(n, 7, np.uint64), list(text), np.array(doc), np.zeros(n, np.int64), np.array(start), np.full(n, 100)).to_pydict()
        digest = {hashlib.blake2b(t, digest_size=12).digest(): t for t in text}
        for c, c2, i, at in zip(out["c"], out["c2"], out["id"], out["at"]):
            key = np.array([(c, c2)], np.dtype([("c", "<i8"), ("c2", "<i4")])).tobytes()
            rows.append((digest[key], i, at >> 9, at & 1))
    first = {}
    for t, i, s, _ in rows:
        first[t] = min(first.get(t, (i, s)), (i, s))
    assert all((i, s) > first[t] for t, i, s, later in rows if later)
    asked = [r for r in rows if not r[3]]
    assert set(first.items()) <= {(t, (i, s)) for t, i, s, _ in asked}
    assert len(asked) < len(rows) / 2


# -- embeddings ------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4000, 20])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "LEAF", 60)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 64))
    x[300:] = x[rng.integers(0, 60, 300)] + rng.normal(size=(300, 64)) * rng.choice([0.1, 0.3, 0.35], (300, 1))
    x[500:520] = x[400]
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    rows = [(i, v.tolist(), 1, None) for i, v in enumerate(x)]
    rows += [(1000, None, 0, 1), (1001, [], 0, 1), (1002, [0.0] * 64, 0, 1), (1003, [float("nan")] * 64, 0, 1), (1004, [None, 1.0], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n long")
    got = {r.vec_id: r for r in embeddings.vector_links(df).collect()}
    assert len(got) == len(rows)
    want = near.sum(1) - 1
    have = np.array([got[i].n_links for i in range(600)])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    part = components(600, np.argwhere(near).tolist())
    assert np.mean([got[i].component_id == part[i] for i in range(600)]) > 0.97
    for i in range(1000, 1005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.vector_links(df.limit(0)).count() == 0


def test_ids_that_are_null_or_repeated(spark):
    """Different vectors under one id keep links of their own; a null id names a group that has no other."""
    e = np.eye(64)
    rows = [(1, e[0]), (1, e[1]), (2, e[0]), (3, e[1]), (4, e[1]), (None, e[2]), (None, e[2] * 3), (None, e[0]), (5, e[3]), (5, e[3]), (6, None)]
    df = spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").withColumn("h", F.lit(1))
    got = sorted(str(tuple(r)) for r in embeddings.vector_links(df).collect())
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 2, 1, False), (5, 1, 5, True), (5, 1, 5, True), (6, 0, 6, True)]
    assert got == sorted(map(str, want))


def test_recall_in_a_deep_forest(spark, capsys, tmp_path):
    """50,000 vectors, 2,000 planted clusters of near copies at a cosine about the threshold, depth 7."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for c in range(2000):
        at = rng.choice(50_000, rng.integers(2, 8), replace=False)
        x[at] = x[at[0]] + rng.normal(size=(len(at), 64)) * rng.choice([0.01, 0.02, 0.025]) / 1.0
    big = rng.choice(50_000, 3000, replace=False)
    x[big] = x[big[0]] + rng.normal(size=(3000, 64)) * 0.02
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    depth = int(np.ceil(np.log2(len(x) / embeddings.LEAF)))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 2000):
        want[a : a + 2000] = (u[a : a + 2000] @ u.T >= 0.95).sum(1) - 1
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), tmp_path / "x.parquet", row_group_size=5000)
    rows = embeddings.vector_links(spark.read.parquet(str(tmp_path / "x.parquet"))).toPandas().set_index("vec_id").sort_index()
    have = rows.n_links.to_numpy()
    with capsys.disabled():
        print(f"\ndepth {depth}: {have.sum()} of {want.sum()} link ends found, recall {have.sum() / want.sum():.4f}")
    assert depth >= 7 and want.sum() > 1_000_000
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()


@pytest.mark.parametrize("names", [1024, 3])
def test_pairs_counted_in_their_first_leaf(monkeypatch, names):
    monkeypatch.setattr(embeddings, "NAMES", names)
    rng = np.random.default_rng(4)
    own = [sorted(set(rng.integers(0, 30, rng.integers(0, 6)).tolist())) for _ in range(50)]
    pairs = rng.random((50, 50)) < 0.5
    want = [[bool(pairs[i, j]) and not set(own[i]) & set(own[j]) for j in range(50)] for i in range(50)]
    embeddings._drop_shared(pairs, own)
    assert pairs.tolist() == want


def test_shared_runs_lose_no_shared_window():
    rng = random.Random(5)
    gram = bytes(rng.choice(b"abcd") for _ in range(windows.GRAM))
    segs = []
    for _ in range(60):
        left = bytes(rng.choice(b"xy") for _ in range(80)) if rng.random() < 0.5 or not segs else rng.choice(segs)[:80]
        right = bytes(rng.choice(b"xy") for _ in range(80)) if rng.random() < 0.5 or not segs else rng.choice(segs)[-80:]
        segs.append((left + gram + right)[rng.randrange(80) : 100 + rng.randrange(80)])
    segs = [s for s in segs if len(s) >= 100]
    data = np.frombuffer(gram + bytes(32), np.uint8)
    anchors = np.full(len(segs), windows.gram_hashes(data)[0])
    seen = {}
    for i, s in enumerate(segs):
        for o in range(len(s) - 99):
            seen.setdefault((s[o : o + 100], s.find(gram) - o), set()).add((i, o))
    shared = {x for v in seen.values() if len(v) > 1 for x in v}
    got = {(i, o) for i, a, z in windows.shared_runs(segs, anchors, 100).tolist() for o in range(a, z - 99)}
    assert shared <= got and len(got) < sum(len(s) - 99 for s in segs)


def test_an_anchor_compared_in_pieces(monkeypatch):
    """However rows are dealt into batches, the same rows are later and each other content is asked for once."""
    rng = random.Random(8)
    rows = sorted((rng.choice([1, 2, 2, 2, 2, 3]), rng.randrange(4), rng.randrange(6), rng.randrange(5) * 512 + 240 + rng.choice([0, 0, 1])) for _ in range(200))
    long, short = pa.int64(), pa.int32()
    def told(size, limit):
        monkeypatch.setattr(substrings, "COMPARE_ROWS", limit)
        names = ["h", "c", "c2", "id", "tag", "at"]
        cut = [rows[a : a + size] for a in range(0, len(rows), size)]
        columns = lambda x: [pa.array([f(r) for r in x], k) for f, k in ((lambda r: r[0], long), (lambda r: r[1] // 2, long), (lambda r: r[1] % 2, short), (lambda r: r[2], long), (lambda r: 0, long), (lambda r: r[3], long))]
        batches = [pa.RecordBatch.from_arrays(columns(x), names) for x in cut]
        out = pa.Table.from_batches(substrings._compare(False)(iter(batches))).to_pylist()
        marks = sorted((r["h"], r["id"], r["start"]) for r in out if r["kind"] == substrings.MARK)
        return marks, sorted((r["h"], r["id"], r["start"]) for r in out if r["kind"] != substrings.MARK)

    want = told(1000, 1000)
    assert want[0] and want[1]
    for size, limit in ((7, 1000), (7, 10), (3, 3), (50, 20), (200, 2)):
        assert told(size, limit) == want
