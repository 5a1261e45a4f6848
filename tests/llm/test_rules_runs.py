"""Line rules and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import line_rules, queries, runs
from tidepanel.llm.substring_dedup import WordHash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    times = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, docs, odd, empty):
    extra = spark.createDataFrame(
        [(20, "a b c a b c"), (21, "x x x x"), (22, "a b c d a b c d a"), (23, "one two"), (24, "é ü 🙂 # | <p>\r\nsame\nsame\n same\n\n\n")],
        "doc_id bigint, text string",
    )
    for df in (docs, odd, empty, extra):
        got = line_rules.clean_lines(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        want = []
        for r in df.collect():
            base = plain_base(r["text"])
            want.append((r["doc_id"], *base, base[0] < 50 or 100 * base[4] > 50 * base[0]))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_chance_meetings_change_nothing(spark, monkeypatch):
    # All windows meet under one hash: only their words tell them apart.
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(0).cast("bigint") * F.length(F.concat_ws("", *c)))
    df = spark.createDataFrame([(1, "a b c d e f a b c x y z"), (2, "p q r s t u v")], "doc_id int, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in line_rules.clean_lines(df).collect()} == {1: 6, 2: 0}


@pytest.mark.parametrize(
    "line, fails",
    [
        ("An ordinary sentence of a few words.", False), ("It ends here!  \r", False), ("“Quoted speech.”", False), ("No mark at the end", True),
        ("Home | News | Sport | Weather.", True), ("Sign up!", True), ("Back to top.", True), ("We went home.", False), ("Contact us.", True),
        ("All rights reserved.", True), ("Licensed under the Apache License, Version 2.0.", True), ("STOP! IT! NOW! GO! ON! AND! ON! AND! ON!", True),
        ("He paid 5 % of it & left a # behind, as all of them did on that day.", False), ("a### b$$$ c*** d.", True),
        ("long " * 50 + "prose that names a privacy policy.", False),
    ],
)
def test_lines(spark, line, fails):
    n = len(WORD.findall(line))
    assert spark.range(1).select(line_rules.line_fails(F.lit(line), F.lit(n)).alias("f")).first()["f"] is fails


def test_lines_go_and_documents_that_lose_too_much(spark):
    good = [" ".join(f"w{(7 * i + k) ** 3 % 997}" for k in range(7)) + "." for i in range(8)]
    menu = ["Home | News | Sport | Weather | Video", "Read more", "All rights reserved."]
    texts = ["\n".join([menu[0], *good, "", *menu[1:]]), "\n".join(good[:5] + [f"item{i} | its{i} | price{i}" for i in range(30)])]
    rows = line_rules.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r["kept"], r["base_failed"], r["n_failed_lines"]) for r in rows] == [(True, False, 3), (False, False, 30)]
    assert rows[0]["cleaned_text"] == "\n".join([*good, ""])
    again = line_rules.clean_lines(spark.createDataFrame([(1, good[0] + "\n" + good[0] + "\nHome")], "doc_id int, text string")).first()
    assert again["cleaned_text"] == good[0] + "\n" + good[0]


def plain_runs(words, min_length=24, min_exponent=3):
    """All runs by comparing each word with the one a period on, for every period."""
    n, found = len(words), []
    codes = np.unique(words, return_inverse=True)[1] if n else None
    for q in range(1, n // min_exponent + 1):
        if (codes[q:] == codes[:-q]).sum() < max(min_length, min_exponent * q) - q:
            continue
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_exponent * q) and not any(words[i : i + length - d] == words[i + d : i + length] for d in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_answer(doc_id, text):
    words = WORD.findall(text or "")
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(listed), sha(kept))


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_small_alphabets(seed):
    rng, total = random.Random(seed), 0
    for _ in range(800):
        words, k = [], rng.randint(1, 4)
        while len(words) < rng.randint(0, 70):
            block = [rng.randint(1, k) for _ in range(rng.randint(1, 8))]
            words += block * rng.choice((1, 1, 2, 3, 5, 9))
        limits = rng.choice(((24, 3), (6, 3), (4, 2), (9, 2), (5, 3), (7, 4)))
        want = plain_runs(words, *limits)
        assert runs.runs_of_words([str(x).encode() for x in words], WordHash(), *limits) == want
        if words:
            assert runs.runs_in(words, 5, *limits) == want
        total += len(want)
    assert total > 500


def test_suffix_order_and_extensions():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))]
        order, parted = runs.leaf_tour([*s, 0], 4)
        assert order.tolist() == sorted(range(len(s) + 1), key=lambda i: [*s, 0][i:])
        ext = runs.Extensions(s, 4)
        for _ in range(10):
            i, j = rng.sample(range(len(s) + 1), 2)
            k = 0
            while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            assert ext(*(np.array([x]) for x in (i, j))).tolist() == [k]


def test_collapse(spark, docs, odd, empty):
    made = spark.createDataFrame(
        [(30, "start " + "a b c " * 9 + "end"), (31, "x " * 23), (32, "x " * 24), (33, "x " * 30 + "y " * 40), (34, "a b a b c " * 12 + "a b z"), (None, "q " * 50)],
        "doc_id bigint, text string",
    )
    for df in (docs, odd, empty, made):
        got = runs.collapse_runs(df).drop("runs", "collapsed_text").collect()
        assert sorted(map(tuple, got), key=str) == sorted((plain_answer(r["doc_id"], r["text"]) for r in df.collect()), key=str)
    row = runs.collapse_runs(made.where("doc_id = 30")).first()
    assert row["collapsed_text"] == "start a b c end" and [tuple(r) for r in row["runs"]] == [(1, 27, 3)]


def test_periodic_runs_query(spark, docs):
    want = []
    for r in docs.collect():
        words, h = WORD.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        text = r["text"]
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w if i < a else words[a + (i - a) % p] for i, w in enumerate(words))
        want.append(plain_answer(r["doc_id"], text))
    got = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r["n_runs"] > 0 for r in got) > 10
