"""Packing, token counts, decontamination, toxicity and chat formatting against the libraries and plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidepanel.llm import chat, decontaminate, packing, queries, token_counts, toxicity

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(st.one_of(st.sampled_from(list("ab 1.,'\n\t é日▁<>|")), st.characters(exclude_categories=("Cs",))), max_size=60)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def units():
    return packing.UnitEncoder(BPE)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_units_equal_the_library(text):
    store = packing.process_store("tests")
    if "l" not in store:
        store["l"], store["u"] = Tokenizer.from_file(BPE), packing.UnitEncoder(BPE)
    for t in (text, f"a {text} b", f"{text}<|endoftext|> {text}"):
        assert np.frombuffer(store["u"].encode(t), "<u4").tolist() == store["l"].encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 12))
def test_safe_splits(text, size):
    store = packing.process_store("tests")
    if "p" not in store:
        store["p"] = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    p = store["p"]
    whole = " ".join([text] * 3)
    assert sum(map(len, p.encode(token_counts.split_safely(whole, size)))) == len(p.encode(whole))


def test_pack(docs, odd, empty, library):
    for df in (docs, odd, empty):
        rows = packing.pack(df, BPE).collect()
        pieces = defaultdict(list)
        for r in rows:
            pieces[r["doc_id"], r["doc_tokens"]].append(r)
        for r in rows:
            assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        assert len({r["sequence_id"] for r in rows}) == len(rows)
        want = sorted(((d.doc_id, library.encode(d.text or "", add_special_tokens=False).ids + [1]) for d in df.collect()), key=str)
        got = []
        for (doc_id, n), parts in pieces.items():
            copies = sum(p["start"] == 0 for p in parts)
            parts.sort(key=lambda p: (p["sequence_id"]))
            assert sum(p["length"] for p in parts) == copies * n
            ids = []
            for p in parts:
                assert p["start"] == len(ids)
                ids += p["ids"]
                if len(ids) == n:
                    got.append((doc_id, ids))
                    ids = []
        assert sorted(got, key=str) == want


def test_buckets(spark, docs, tmp_path):
    packing.write_buckets(packing.pack(docs, BPE), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == packing.pack(docs, BPE, keep_ids=False).count()


def test_token_counts(docs, odd, empty):
    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, odd, empty):
        got = sorted((tuple(r) for r in token_counts.count_tokens(df, PIECES).collect()), key=str)
        want = []
        for r in df.collect():
            n = len(p.encode(r["text"] or ""))
            want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 4096))
        assert got == sorted(want, key=str)


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[:], i
        for j, b in enumerate(text, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b))
    return min(row)


def plain_leaks(docs, items):
    out = {}
    for d, t in docs:
        w = decontaminate.words_of(t or "")
        for i, s in items:
            x = decontaminate.words_of(s or "")
            if len(x) >= decontaminate.MIN_WORDS and len(set(x) & set(w)) > len(set(x)) // 4:
                e = plain_distance(x, w)
                if e <= decontaminate.allowed(len(x)):
                    out[d, i] = min(e, out.get((d, i), 99))
    return out


def test_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = [rng.choice("abcd") for _ in range(rng.randint(8, 70))]
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        index = decontaminate.Index([(0, item)], 0.8, 4)
        assert index.distance(0, index.symbols(text).tolist())[0] == plain_distance(item, text)


def test_bounds_lose_nothing():
    """The starts that the bounds leave out hold no match: with and without them the same items are found in the same texts."""
    rng, numbers = random.Random(6), np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(rng.choice((8, 9, 13, 20, 25, 26, 40, 75)))] for _ in range(60)]
    bounded = decontaminate.Index(list(enumerate(items)), 0.8, 24)
    unbounded = decontaminate.Index(list(enumerate(items)), 0.8, 24)
    unbounded.least = {size: {} for size in unbounded.sizes}
    assert any(4 in least for least in bounded.least.values())
    starts = [0, 0]
    for i, item in enumerate(items):
        place = decontaminate.PLACES[i % len(decontaminate.PLACES)]
        part = decontaminate.edited(numbers, bounded.symbols(item), decontaminate.allowed(len(item)), place, 62)
        x = np.array([int(numbers.integers(2, 62)) for _ in range(30)] + part + [int(numbers.integers(2, 62)) for _ in range(30)] + [decontaminate.PAD] * 200)
        found = []
        for k, index in enumerate((bounded, unbounded)):
            begins, segment = index.candidates(x)
            starts[k] += len(begins)
            close = set()
            for c in set(segment.tolist()):
                item_of = int(index.item_of[c])
                if index.distance(item_of, x.tolist())[0] <= decontaminate.allowed(len(items[item_of])):
                    close.add(item_of)
            found.append(close)
        assert found[0] == found[1]
    assert starts[0] < starts[1]


def test_blocks_of_the_benchmark(spark, docs, monkeypatch):
    """Several blocks find what one does, whatever the table of random bits."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, benchmark, recall=0.99).filter("distance = 0").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    parts = sorted(map(tuple, decontaminate.find_leaks(docs, benchmark, recall=0.99).filter("distance = 0").collect()))
    assert whole and parts == whole


def test_find_leaks(spark, docs, empty):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(docs, benchmark).collect()}
    want = plain_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert got == want and want
    assert decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    left = decontaminate.drop_leaks(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


@pytest.mark.parametrize("shortest, longest", [(14, 60), (90, 400)])
def test_recall_at_the_largest_distance(spark, shortest, longest):
    """Items with 20 % of their words changed, dropped or added, in the middle of other words."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    items = [(i, [rng.choice(words) for _ in range(rng.randint(shortest, longest))]) for i in range(120)]
    rows = []
    for i, x in items:
        y = list(x)
        for _ in range(decontaminate.allowed(len(x))):
            p = rng.randrange(len(y))
            kind = rng.randrange(3)
            if kind == 0:
                y[p] = rng.choice(words)
            elif kind == 1:
                y.insert(p, rng.choice(words))
            else:
                del y[p]
        filler = lambda: [rng.choice(words) for _ in range(rng.randint(0, 300))]
        rows.append((i, " ".join(filler() + y + filler())))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(300))) for i in range(100)] + [(None, None), (None, " ".join(items[0][1])), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in items] + [(500, None), (501, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    want = {(i, i) for i, _ in items} | {(None, 0)}
    assert got <= want and len(got) >= decontaminate.RECALL * len(want)


@pytest.mark.parametrize("n", [25, 60, 61, 200, 300, 700])
def test_recall_of_edits_in_one_place(spark, n):
    """Items whose head, middle or tail is replaced or dropped, as far as the distance allows."""
    rng = random.Random(n)
    words = [f"w{i}" for i in range(900)]
    k, rows, items = decontaminate.allowed(n), [], []
    for i in range(72):
        x = [rng.choice(words) for _ in range(n)]
        at = {0: 0, 1: (n - k) // 2, 2: n - k}[i % 3]
        # Replaced by words of other items, dropped, or replaced by words of no item.
        new = ([rng.choice(words) for _ in range(k)], [], [f"new{j}" for j in range(k)])[i // 3 % 3]
        items.append((i, " ".join(x)))
        rows.append((i, " ".join(["before"] * 40 + x[:at] + new + x[at + k :] + ["after"] * 40)))
    docs, benchmark = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got <= {(i, i) for i, _ in items} and len(got) >= decontaminate.RECALL * len(items)


@pytest.mark.parametrize("n", [20, 25, 30, 60, 120, 400])
def test_recall_of_each_kind_of_edit_alone(spark, n):
    """500 items of each kind: as many words replaced, added or dropped here and there as the distance allows."""
    rng = random.Random(n)
    words = [f"w{i}" for i in range(3000)]
    k, rows, items = decontaminate.allowed(n), [], []
    for i in range(1500):
        x = [rng.choice(words) for _ in range(n)]
        y = list(x)
        for _ in range(k):
            p = rng.randrange(len(y))
            y[p : p + (i % 3 != 1)] = [rng.choice(words)] * (i % 3 != 2)
        items.append((i, " ".join(x)))
        rows.append((i, " ".join([rng.choice(words) for _ in range(40)] + y + [rng.choice(words) for _ in range(40)])))
    docs, benchmark = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got <= {(i, i) for i, _ in items}
    found = [sum(i % 3 == kind for i, _ in got) / 500 for kind in range(3)]
    assert min(found) >= decontaminate.RECALL, found


def test_short_items_are_searched_exactly(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 40))] for _ in range(150)]
    items = [[rng.choice(words) for _ in range(n)] for n in range(2, 8) for _ in range(20)] + [["w3"], ["alone"]]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(docs, benchmark).collect()}
    distances = {(d, i): plain_distance(x, t) for d, t in enumerate(texts) for i, x in enumerate(items)}
    assert got == {key: e for key, e in distances.items() if e <= decontaminate.allowed(len(items[key[1]]))} and 1 in got.values()


def test_items_without_spaces(spark):
    item = "下列哪一种元素在常温常压下是液体，并且可以用来制作温度计，但对人体有很大的毒性"
    near = item.replace("液体", "气体")
    rows = [(1, "前面的话" + item + "后面的话"), (2, "前面的话" + near + "后面的话"), (3, "这里没有那个问题，只有别的句子，并且很长"), (4, "ที่นี่ " + item[:20])]
    docs, benchmark = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["distance"]) for r in decontaminate.find_leaks(docs, benchmark).collect()) == [(1, 0), (2, 1)]
    assert decontaminate.words_of("Ab 日本x é9") == ["ab", "日", "本", "x", "é9"]


def test_clean_rows_of_a_leaking_id_stay(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, f"é before {item} after"), (None, "a clean text without an id"), (None, None), (4, item), (4, "a clean text of the same id"), (5, None), (6, "clean")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")
    left = sorted(map(tuple, decontaminate.drop_leaks(docs, benchmark).collect()), key=str)
    assert left == sorted((r for r in rows if item not in (r[1] or "")), key=str)


def test_recall_that_is_out_of_reach():
    with pytest.raises(ValueError):
        decontaminate.repeats_for(0.95, 0.3, 60)


def auc(pairs):
    pairs = sorted(pairs)
    n1 = sum(y for _, y in pairs)
    return (sum(k for k, (_, y) in enumerate(pairs, 1) if y) - n1 * (n1 + 1) / 2) / (n1 * (len(pairs) - n1))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(held) > 0.97
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.97
    assert sum(s >= 0.5 and not y for s, y in held) <= 0.005 * len(held)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (None, 1), (8, None)], "doc_id bigint, toxic int")
    rows = toxicity.predictions(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.predictions(odd, none).collect()} == {0.5}
    assert toxicity.predictions(empty, labels).count() == 0
    assert toxicity.drop_toxic(empty, labels).columns == empty.columns


def test_model_is_sparse_and_does_not_depend_on_partitions(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(5), labels.repartition(3))
    assert sorted(a) == sorted(b) and len(a) < 20_000


def test_chat(spark):
    rows = [
        (1, 0, "system", "be <nice> [ok] <~ [~ <n"), (1, 1, "user", None), (1, 2, "user", "two\nlines"), (1, 3, "assistant", "<|end|>\n<|and|>"),
        (1, 4, "assistant", ""), (1, 4, "assistant", ""), (1, 5, None, "x"), (2, None, "assistant", "no turn"), (2, 7, "odd\nrole<", "é🙂"),
        (None, 1, "user", "no id"), (3, 1, "user", ""), (4, 0, "assistant", "y" * 200_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as turns", "2 as segments")
    chats = chat.format_chats(turns)
    got = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append(((n is not None, n or 0), r or "", t or ""))
    assert got.keys() == by.keys()
    for c, ts in by.items():
        ts.sort()
        joined = "".join(f"{r}\n{t}\n" for _, r, t in ts)
        loss = "".join(t for _, r, t in ts if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(ts) and g["turns_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert g["loss_chars"] == len(loss) and g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    text = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    assert text[1].count(chat.START) == 4 and text[1].count(chat.END) == 4  # adjacent turns of one role share a block
    assert all(re.fullmatch(r"(?:<\|(?:start|and|end)\|>|<~|<n|\[~|[^<\[])*", t) for t in text.values())
    assert chat.digests(chat.format_chats(turns.filter("false"))).count() == 0


def test_batches_end_by_bytes_and_callers_keep_their_limit(spark):
    from tidepanel.llm.common import BATCH_BYTES, bound_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        bound_batches(spark)
        assert int(spark.conf.get(name).rstrip("bB")) == BATCH_BYTES
        spark.conf.set(name, "1000")
        bound_batches(spark)
        assert int(spark.conf.get(name).rstrip("bB")) == 1000
        # Texts longer than the limit stay whole, each in a batch of its own.
        docs = spark.createDataFrame([(i, "word " * (100 + 400 * i)) for i in range(4)], "doc_id bigint, text string")
        counted = {r["doc_id"]: r["n_bytes"] for r in token_counts.count_tokens(docs, PIECES).collect()}
        assert counted == {i: 5 * (100 + 400 * i) for i in range(4)}
    finally:
        spark.conf.set(name, before)
