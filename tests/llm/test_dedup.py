"""Exact, SimHash and substring duplicates against plain Python over all pairs."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from compare import duck, mismatch
from pyspark.sql import functions as F

from tidepanel.llm import exact_dedup, queries, simhash_dedup, substring_dedup
from tidepanel.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert mismatch(queries.QUERIES[name](spark, SF), duck(SF), queries.SQL[name]) is None


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def low(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


@pytest.mark.parametrize("weak", [False, True])
def test_exact_classes(spark, docs, odd, weak):
    for df in (docs, odd):
        hashed = (lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 50), 4, "0"))) if weak else exact_dedup.content_hash
        got = exact_dedup.exact_classes(df, hashed=hashed).collect()
        groups = defaultdict(list)
        for i, t in texts_of(df):
            groups[t].append(i)
        want = []
        for t, ids in groups.items():
            known = [i for i in ids if i is not None]
            keep, done = max(known) if known else None, False
            for i in ids:
                want.append((i, keep, len(ids), i == keep and not done, hashlib.sha256(t.encode()).hexdigest()))
                done = done or i == keep
        key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_drop_copies(docs, odd, empty):
    for df in (docs, odd, empty):
        left = exact_dedup.drop_copies(df)
        assert left.columns == df.columns
        rows = left.collect()
        assert sorted((r["text"] or "") for r in rows) == sorted({t for _, t in texts_of(df)})
    assert [r["doc_id"] for r in exact_dedup.drop_copies(odd).filter("text = 'same text'").collect()] == [6]


def test_drop_copies_of_rows_with_maps(spark):
    rows = [(1, "a", {"k": 2}), (1, "a", {"k": 1}), (1, "a", None), (2, "a", {"k": 9}), (2, "a", {"k": 8}), (3, "b", {})]
    left = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id bigint, text string, m map<string,int>"))
    assert sorted((r["doc_id"], r["m"]) for r in left.collect()) == [(2, {"k": 8}), (3, {})]


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_classes(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return [(rows[i][0], f"{fps[i]:016x}", low(members[find(i)])) for i in range(len(rows))]


def test_near_classes(docs, odd):
    for df in (docs, odd):
        got = [tuple(r) for r in simhash_dedup.near_classes(df).collect()]
        assert sorted(got, key=str) == sorted(plain_classes(texts_of(df)), key=str)


def test_near_links_in_one_large_family(spark):
    """Thousands of fingerprints around one, so that anchors are dealt over several units."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base} | {rng.getrandbits(64) for _ in range(200)}
    while len(fps) < 4200:
        fps.add(base ^ sum(1 << b for b in rng.sample(range(10), rng.randint(1, 4))) ^ sum(1 << b for b in rng.sample(range(32, 44), rng.randint(0, 4))))
    fps = np.array(sorted(fps), np.uint64)
    links = simhash_dedup.near_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint"))
    rows = links.collect()
    got = {r["node"]: r["root"] for r in components(links).collect()}
    signed = fps.view(np.int64).tolist()
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3).tolist():
            root[find(i)] = find(j)
    mine, other = defaultdict(set), defaultdict(set)
    for i, s in enumerate(signed):
        mine[find(i)].add(s)
        other[got.get(s, s)].add(s)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, other.values()))
    assert len(rows) < 64 * len(fps)


def test_anchor_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 300).astype(np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 32, 300).astype(np.uint64))
    xi, xa, home = simhash_dedup.anchors(x)
    yi, ya, _ = simhash_dedup.anchors(y)
    assert sorted(xi[home].tolist()) == list(range(300))
    seen = set(zip(yi.tolist(), ya.tolist(), strict=True))
    assert all((i, a) in seen for i, a in zip(xi[home].tolist(), xa[home].tolist(), strict=True))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(220)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want, seen = {}, set()
    for n in sorted(near):
        if n in seen:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                want[x] = n
                todo += near[x]
    assert got == want


def test_keep_one(docs, odd, empty):
    for df in (docs, odd, empty):
        left = simhash_dedup.keep_one(df)
        assert left.columns == df.columns
        want = [(i, t) for (i, t), (_, _, c) in zip(texts_of(df), plain_classes(texts_of(df)), strict=True) if i == c]
        assert sorted(texts_of(left), key=str) == sorted(want, key=str)


def plain_repeats(rows, threshold=13):
    first = {}
    order = lambda i: float("inf") if i is None else i
    words = [(order(i), t.encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - threshold + 1):
            key = tuple(w[k : k + threshold])
            first[key] = min(first.get(key, i), i)
    out = []
    for (doc_id, _), (i, w) in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - threshold + 1):
            if first[tuple(w[k : k + threshold])] < i:
                gone.update(range(k, k + threshold))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [substring_dedup.BLOCK_ROWS, 50])
def test_remove_repeats(spark, docs, odd, empty, block, monkeypatch):
    """With blocks as they are and with such small ones that nearly all is compared after the shuffle."""
    monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", block)
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "the"]
    noisy = [(rng.randrange(30), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80)))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(60))
    noisy += [(100 + i, f"x{i} {passage} y{i} z {passage}") for i in range(40)] + [(200, "the " * 500), (201, "the " * 30)]
    for df in (docs, odd, spark.createDataFrame(noisy, "doc_id bigint, text string"), empty):
        got = substring_dedup.remove_repeats(df)
        rows = got.collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=str) == plain_repeats(texts_of(df))
        for r in rows:
            assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_lists_stay_within_a_text(spark, monkeypatch):
    """What is gathered for a row doesn't grow with the rows that share its id."""
    real = substring_dedup._windows

    def bounded(threshold, anchor):
        made = real(threshold, anchor)

        def checked(batches):
            def seen():
                for batch in batches:
                    assert all(len(s) <= 60 for s in batch.column(4))
                    yield batch

            yield from made(seen())

        return checked

    monkeypatch.setattr(substring_dedup, "_windows", bounded)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), (7, passage + " and more")] + [(i, f"{passage} {k} {i} " + " ".join(f"x{k % 150}-{j}" for j in range(20))) for i in (None, 5) for k in range(300)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    # Rows of id 5 lose the passage to id 1; rows without an id also lose the number after it and the last 20 words, which a row of id 5 has.
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in got) == sorted([(1, 0), (7, 20)] + [(5, 20)] * 300 + [(99, 41)] * 300)


def test_texts_of_one_id_with_like_hashes(spark):
    """Two texts without an id whose 64-bit hashes agree in their lower 31 bits stay apart."""
    import xxhash

    passage = " ".join(f"p{i}" for i in range(20))
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) & 0x7FFFFFFF
    long = {low(t): t for t in (" ".join(f"own{k}-{i}" for i in range(40)) + " " + passage for k in range(60_000))}
    short = next(t for t in (" ".join(f"other{k}-{i}" for i in range(16)) for k in range(2_000_000)) if low(t) in long)
    rows = [(1, passage), (None, long[low(short)]), (None, short), (3, "z " + short)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == plain_repeats(rows)
    assert sorted(r["n_removed"] for r in got) == [0, 0, 16, 20]
