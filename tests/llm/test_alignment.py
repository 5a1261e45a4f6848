"""Token alignment against the libraries and plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidepanel.llm import alignment, packing, queries

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(st.one_of(st.sampled_from(list("ab 1.,'\n\t é日▁<>|0x")), st.characters(exclude_categories=("Cs",))), max_size=60)


class Plain:
    """Both libraries on whole texts; byte values of tokens by the vocabularies' own definitions."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [k for k in range(256) if k not in printable]
        byte_of = {chr(k): k for k in printable} | {chr(256 + i): k for i, k in enumerate(rest)}
        self.a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text):
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if not text or b"".join(self.a_bytes[i] for i in a) != whole or b"".join(map(self.b_bytes, b)) != whole:
            return [], []
        return a, b

    def aligned(self, text):
        """(ids of A, ids of B, links as pairs of ids, groups as text)."""
        a, b = self.ids(text or "")
        a_ends, b_ends = np.cumsum([len(self.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(self.b_bytes(i)) for i in b]).tolist()
        links, groups, i, j = [], [], 0, 0
        group = ([], [])
        a_end = b_end = None
        # Step through the bytes' end points, always past the nearer end.
        while i < len(a):
            links.append((a[i], b[j]))
            if not group[0] or a_end != i:
                group[0].append(a[i])
            if not group[1] or b_end != j:
                group[1].append(b[j])
            a_end, b_end = i, j
            if a_ends[i] == b_ends[j]:
                groups.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
                group, a_end, b_end = ([], []), None, None
                i, j = i + 1, j + 1
            elif a_ends[i] < b_ends[j]:
                i += 1
            else:
                j += 1
        return a, b, links, groups

    def rows(self, documents):
        done = [(d, *self.aligned(t)) for d, t in documents]
        times = Counter(p for row in done for p in row[3])
        best = Counter()
        for (_, b), n in times.items():
            best[b] = max(best[b], n)
        return [
            (
                d, len(a), len(b), len(groups), len(links), sum(times[p] == best[p[1]] for p in links), sum(times[p] for p in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
            )
            for d, a, b, links, groups in done
        ]


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_merge_path(step):
    rng = random.Random(step)
    for _ in range(500):
        n = rng.randint(1, 40)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in range(2))
        i, j, closes = alignment.overlaps(np.array(a), np.array(b), step)
        starts = [0, *a], [0, *b]
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(starts[0][x], starts[1][y]) < min(a[x], b[y])]
        assert list(zip(i.tolist(), j.tolist())) == want
        assert [a[x] == b[y] for x, y in want] == closes.tolist()
        # Each diagonal splits the merged order after as many elements as its number says.
        from_a, from_b = alignment.diagonals(np.array(a), np.array(b), step)
        merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
        for x, y in zip(from_a.tolist(), from_b.tolist()):
            assert sorted([(v, 0) for v in a[:x]] + [(v, 1) for v in b[:y]]) == merged[: x + y]


def test_no_ends():
    assert [len(x) for x in alignment.overlaps(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0, 0]


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_units_equal_the_libraries(text):
    store = packing.process_store("alignment_tests")
    if "p" not in store:
        store["p"], store["e"] = Plain(), alignment.PairEncoder(BPE, PIECES)
    for t in (text, f"a {text} b", f"{text}<|endoftext|> </s> <s>{text}"):
        got = store["e"].encode(t) or (b"", b"")
        assert tuple(np.frombuffer(x, "<u4").tolist() for x in got) == store["p"].ids(t)


@given(st.lists(st.integers(0, 2**24 - 1), min_size=1, max_size=300), st.integers(3, 4))
def test_numbers_survive_packing(values, width):
    x = np.array(values, np.uint32)
    assert alignment.unpacked_numbers(alignment.packed_numbers(x, width), width).tolist() == values


def test_whole_tables(spark, docs, odd, empty, plain):
    special = spark.createDataFrame(
        [(40, "<s> </s> <unk> <0x41> <|endoftext|>"), (41, "has ▁ the mark"), (42, "  two  spaces "), (43, "\x00 nul"), (44, "　wide space ​")],
        "doc_id bigint, text string",
    )
    for df in (odd, empty, special, docs.limit(60)):
        got = alignment.align_documents(df, BPE, PIECES)[0].collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain.rows([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]), key=str)


def test_blocks_and_chunks_share_counts(spark, docs, plain, monkeypatch):
    # Many blocks of a few texts each, many chunks in a block.
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found, pairs = alignment.align_documents(docs.repartition(5), BPE, PIECES)
        got, pairs = found.collect(), pairs.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    documents = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, got)) == sorted(plain.rows(documents))
    times = Counter(p for _, t in documents for p in plain.aligned(t)[2])
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs} == dict(times)


def test_query(spark, docs, plain):
    got = queries.op12_token_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain.rows([(r["doc_id"], r["text"]) for r in docs.collect()]))
