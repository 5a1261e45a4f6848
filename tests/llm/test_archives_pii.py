"""Archives: round trip and salvage. Pseudonyms: a plain Python Feistel network, formats and links."""

import datetime as dt
import hashlib
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from tidepanel.llm import pii, queries, warc
from tidepanel.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_round_trip_of_odd_pages(spark):
    rows = [
        (1, "http://a/1", "<p>same</p>"), (2, "http://a/2\r\nX: y", "<p>same</p>"), (3, None, None), (4, "u", ""), (None, "u", "<p>same</p>"),
        (None, "u", "only without id"), (None, "v", "only without id"), (5, "u", "WARC/1.1\r\n\r\n\x1f"), (6, "u", "é" * 100_000), (6, "u", "é" * 100_000),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as payload", "2 as sha1")
    got = sorted((tuple(r) for r in warc.archived(pages).collect()), key=str)
    known = {}
    for i, _, h in rows:
        if i is not None:
            known[h or ""] = max(i, known.get(h or "", i))
    want = []
    for i, _, h in rows:
        p, keep = (h or "").encode(), known.get(h or "")
        other = keep is not None and i != keep
        want.append((i, len(p), warc.digest(p), "revisit" if other else "response", keep if other else None))
    assert got == sorted(want, key=str)
    assert warc.archived(pages.filter("false")).count() == 0
    small = warc.read_archives(warc.write_archives(pages, scratch_path(spark, "w"), min_payload=1, max_bytes=300), keep_payload=True).collect()
    assert all(r["record_type"] == "response" for r in small if r["payload_bytes"] == 0) and len({r["file"] for r in small}) > 3
    assert {(r["page_id"], bytes(r["payload"])) for r in small if r["record_type"] == "response" and r["page_id"] is not None} == {
        (2, b"<p>same</p>"), (3, b""), (4, b""), (5, b"WARC/1.1\r\n\r\n\x1f"), (6, ("é" * 100_000).encode())}


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    rng = random.Random(4)
    wrap = warc.member if packed else lambda x: x
    parts = [wrap(warc.record(i, "http://a", rng.randbytes(rng.randint(0, 4000)), None)) for i in range(40)]
    offsets = [sum(map(len, parts[:i])) for i in range(41)]
    data = bytearray(b"".join(parts))
    assert [f["page_id"] for k, _, _, f in warc.salvage(bytes(data)) if k == "record"] == list(range(40))
    hurt = {3, 4, 17, 30}
    for i in hurt:
        at = offsets[i] + len(parts[i]) // 2
        data[at] ^= 0xFF
    cut = bytes(data[: offsets[39] + len(parts[39]) // 2])  # the last record is cut short
    spoiled = cut[: offsets[20]] + b"junk \x1f\x8b\x08 WARC/1.1 junk" + cut[offsets[20] :]
    found = list(warc.salvage(spoiled))
    assert [f["page_id"] for k, _, _, f in found if k == "record"] == [i for i in range(39) if i not in hurt]
    assert [a for _, a, _, _ in found][1:] == [b for _, _, b, _ in found][:-1] and found[0][1] == 0 and found[-1][2] == len(spoiled)
    gaps = [(a, b) for k, a, b, _ in found if k == "gap"]
    assert (offsets[3], offsets[5]) in gaps and len(gaps) == 5


def foreign(kind, block, *headers):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:0>", *headers, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers(spark, tmp_path):
    body = b"<p>hello</p>"
    plain, chunked = b"HTTP/1.1 200 OK\r\n\r\n" + body, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=1\r\n<p>he\r\n7\r\nllo</p>\r\n0\r\n\r\n"
    sha256 = hashlib.sha256(body).hexdigest().encode()
    records = [
        foreign(b"warcinfo", b"software: other\r\n"), foreign(b"request", b"GET / HTTP/1.1\r\n\r\n", b"WARC-Target-URI: http://a"),
        foreign(b"response", plain, b"WARC-Target-URI: http://a"), foreign(b"response", chunked, b"WARC-Payload-Digest: sha1:" + warc.digest(body).encode()),
        foreign(b"response", plain, b"WARC-Payload-Digest: sha256:" + sha256), foreign(b"response", plain, b"WARC-Payload-Digest: blake9:abc"),
        foreign(b"metadata", b"a: b"), foreign(b"resource", b"\x89PNG", b"WARC-Target-URI: http://b"), foreign(b"response", b"no http at all"),
        foreign(b"revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", b"WARC-Payload-Digest: sha1:ABC"),
    ]
    kinds = ["warcinfo", "request", "response", "response", "response", "response", "metadata", "resource", "response", "revisit"]
    for data in (b"".join(records), b"".join(map(warc.member, records)), warc.member(b"".join(records)), warc.member(b"".join(records[:4])) + b"".join(records[4:])):
        found = list(warc.salvage(data))
        assert [f["record_type"] for k, _, _, f in found if k == "record"] == kinds and all(k == "record" for k, *_ in found)
        replies = [f for _, _, _, f in found if f["record_type"] == "response"]
        assert [(f["payload"], f["payload_digest"]) for f in replies[:4]] == [(body, warc.digest(body))] * 4 and replies[4]["payload"] == b"no http at all"
        assert found[-1][3]["payload_digest"] == "ABC" and found[0][3]["payload_bytes"] is None
    # A digest that is stated and known has to be right.
    for wrong in (b"WARC-Payload-Digest: sha256:" + sha256[::-1], b"WARC-Block-Digest: md5:" + b"0" * 32):
        assert [k for k, *_ in warc.salvage(foreign(b"response", plain, wrong))] == ["gap"]
    # A record that is lost inside a whole member is a gap of the member's range; the others come back.
    spoiled = warc.member(records[2] + records[3].replace(b"hello", b"HELLO").replace(b"he\r\n", b"HE\r\n") + records[4])
    assert [(k, a, b) for k, a, b, _ in warc.salvage(spoiled)] == [("record", 0, len(spoiled))] * 2 + [("gap", 0, len(spoiled))]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(map(warc.member, records)))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "file string"), keep_payload=False).collect()
    assert [r["record_type"] for r in rows] == kinds and [r["url"] for r in rows][1:3] == ["http://a"] * 2


def test_an_archive_is_read_through_a_window(tmp_path, monkeypatch):
    """A file of many members and one that inflates without end: what is held stays near the longest record."""
    import pyarrow.fs as fs

    rng = random.Random(8)
    parts = [warc.member(warc.record(i, "u", rng.randbytes(300_000), None)) for i in range(120)]
    parts.insert(60, warc.member(foreign(b"response", b"HTTP/1.1 200 OK\r\n\r\n" + b"0" * (64 << 20))))
    path = tmp_path / "long.warc.gz"
    path.write_bytes(b"".join(parts) + b"\r\n trailing junk")
    monkeypatch.setattr(warc, "MAX_RECORD_BYTES", 8 << 20)
    place, name = fs.FileSystem.from_uri(f"file://{path}")
    reads = []
    with place.open_input_file(name) as opened:
        real = opened.read

        class Counted:
            size, seek = staticmethod(opened.size), staticmethod(opened.seek)

            @staticmethod
            def read(n):
                reads.append(n)
                return real(n)

        found = [(k, w["page_id"] if k == "record" else w) for k, _, _, w in warc.salvage(Counted())]
    assert [p for k, p in found if k == "record"] == list(range(120))
    assert [p for k, p in found if k == "gap"] == ["too long", "no record header"] and max(reads) <= 9 << 20


def test_lost_records_are_told(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id bigint, url string, html string")
    real = warc.write_archives

    def damaged(*args, **options):
        files = real(*args, **options)
        path = files.filter("records > 0").first()["file"].removeprefix("file:")
        data = bytearray(open(path, "rb").read())
        data[len(data) // 2] ^= 0xFF
        open(path, "wb").write(data)
        return files

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(ValueError, match="came back"):
        warc.archived(pages)


def test_names_of_file_systems():
    assert warc.arrow_uri("s3a://bucket/a.warc.gz") == "s3://bucket/a.warc.gz" and warc.arrow_uri("/a/b") == "/a/b" and warc.arrow_uri("hdfs://h/a") == "hdfs://h/a"


def keyed(key, *parts):
    return int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def plain_feistel(l, r, a, b, key, kind):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            l = (l + keyed(key, kind, i, a, r) % a) % a
        else:
            r = (r + keyed(key, kind, i, b, l) % b) % b
    return l, r


def plain_digits(d, key, kind):
    n, h = len(d), len(d) // 2
    l, r = plain_feistel(int(d[:h]), int(d[h:]), 10**h, 10 ** (n - h), key, kind)
    return f"{l:0{h}d}{r:0{n - h}d}"


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10


def refill(shape, digits):
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


def plain_new(m, key):
    if "@" in m:
        local, _, domain = m.partition("@")
        return "u" + hashlib.sha256(f"{key}|email|{local.lower()}|{m.lower()}".encode()).hexdigest()[:16] + "@" + domain
    if re.match(r"(?i)token|secret|password|api", m):
        v = re.search(r"[A-Za-z0-9_-]+$", m)[0]
        return m[: -len(v)] + hashlib.sha512(f"{key}|secret|{v}".encode()).hexdigest()[: len(v)].ljust(len(v), "0")
    if m.startswith("+"):
        head, rest = m[: m.index("(")], m[m.index("(") :]
        return head + refill(rest, plain_digits(re.sub(r"\D", "", rest), key, "phone"))
    for shape, fmt in ((r"\d{4}-\d\d-\d\d", "%Y-%m-%d"), (r"\d\d\.\d\d\.\d{4}", "%d.%m.%Y"), (r"\d\d/\d\d/\d{4}", "%d/%m/%Y")):
        if re.fullmatch(shape, m):
            try:
                n = (dt.datetime.strptime(m, fmt).date() - dt.date(1700, 1, 1)).days
            except ValueError:
                return m
            if not 0 <= n < 146_097:
                return m
            l, r = plain_feistel(n // 773, n % 773, 189, 773, key, "date")
            return (dt.date(1700, 1, 1) + dt.timedelta(l * 773 + r)).strftime(fmt)
    if "." in m:
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return m
        l, r = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return f"{l >> 8}.{l & 255}.{r >> 8}.{r & 255}"
    d = re.sub(r"\D", "", m)
    if luhn(d):
        return m
    body = plain_digits(d[:-1], key, "card")
    return refill(m, body + str((10 - luhn(body + "0")) % 10))


ANY = regex.compile("|".join(pii.PATTERNS.values()))


def test_pseudonyms_of_the_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    changed = 0
    for r in queries.op7_pii(spark, SF).collect():
        n = [0]

        def new(m, n=n):
            out = plain_new(m[0], queries.KEY)
            n[0] += out != m[0]
            return out

        assert r["text"] == ANY.sub(new, docs[r.doc_id]) and r["n_replaced"] == n[0]
        changed += n[0]
    assert changed > 0


def test_formats_and_links(spark):
    texts = [
        "mail a.b@mail.example.com, call +1 (017) 555-7713 or +49 (200) 5551234.", "card 4111 1111 1111 1111 and 4111-1111-1111-1111 and 4111111111111111",
        "not a card: 4111111111111112; ip 10.0.0.255 but not 300.1.1.1 or 1.2.3.4.5", "born 1984-02-29, 29.02.1984, 31/12/1999; not 1985-02-29 or 2300-01-01",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', None, "", "no data here: version 2.0, page 12", "x" * 50_000 + " 4111111111111111", "4111111111111111",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("r", F.lit(1)).withColumn("n", F.lit(2))
    out = pii.pseudonymised(df, "k")
    assert out.columns == df.columns
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    for old, new in zip(texts, got, strict=True):
        assert new == ANY.sub(lambda m: plain_new(m[0], "k"), old or "")
    cards = re.findall(r"\d(?:[ -]?\d){15}", got[1])
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and luhn(re.sub(r"\D", "", cards[0])) == 0 and cards[0] != "4111 1111 1111 1111"
    assert got[9] in got[8] and re.sub(r"\D", "", cards[0]) == got[9]
    assert got[2] .startswith("not a card: 4111111111111112") and "300.1.1.1 or 1.2.3.4.5" in got[2] and "10.0.0.255" not in got[2]
    assert "1985-02-29 or 2300-01-01" in got[3] and got[7] == texts[7]
    assert pii.pseudonymised(df.filter("false"), "k").count() == 0


def test_planted_numbers(spark):
    """Cards beside other numbers and telephone numbers in their usual forms; what is expected does not come from the patterns."""
    card, other = "4111111111111111", "5500000000000004"
    new = {c: plain_digits(c[:-1], "k", "card") for c in (card, other)}
    new = {c: n + str((10 - luhn(n + "0")) % 10) for c, n in new.items()}
    cases = []
    for before, after in [
        ("card ", " 123"), ("", " 12/27"), ("pay 5 ", ""), ("42 ", ""), ("12 34 56 ", " 7"), ("no ", " 12a"), ("on 2024-13-45 ", " 300.1.1.1"), ("", " 1 2 3 4 5 6 7 8 9"),
    ]:
        for c in (card, other):
            for form in (c, " ".join(re.findall("....", c)), "-".join(re.findall("....", c))):
                cases.append((before + form + after, before + refill(form, new[c]) + after))
    cases.append((f"{card} {other}", f"{new[card]} {new[other]}"))
    cases.append((f"{card} 10.0.0.255 x", None))
    number = plain_digits("2025550143", "k", "phone")
    for form in ("+1 202 555 0143", "+1-202-555-0143", "+12025550143", "001 202 555 0143", "+1 (202) 555-0143", "+49 20 2555 0143", "+44.20.2555.0143"):
        head = re.sub(r"\D", "", form)[:-10]
        cases.append((f"call {form}, now", f"call {refill(form, head + number)}, now"))
    for form in ("(202) 555-0143", "(202)555-0143", "202-555-0143", "202.555.0143", "202 555 0143"):
        cases.append((f"call {form}.", f"call {refill(form, number)}."))
    for same in ("a +5 and 12-34-56", "no 4111111111111112 2", "1 2 3", "99" + card, "12 345 6789"):
        cases.append((same, same))
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "doc_id bigint, text string")
    got = [r["text"] for r in pii.pseudonymised(rows, "k").orderBy("doc_id").collect()]
    for (old, want), out in zip(cases, got, strict=True):
        assert out == want if want is not None else card not in out and "10.0.0.255" not in out, (old, out)


def test_permutations(spark):
    n = 10_000
    moved = spark.range(n).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("p"))
    assert moved.distinct().count() == n
    days = spark.range(146_097).select(F.date_format(F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    new = days.select(pii.new_date(F.col("d"), "k").alias("p"))
    assert new.distinct().count() == 146_097
