"""The corpus operators against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import components, host_rules, jaccard, katz, line_dedup, packing, quality, suffix_dedup, url_rules, warc, winnow

#: Columns that operators use inside clash with these.
EXTRA = "uid long, node long, n long, s string, k1 long, spans string, _n long, w string"
DOCS = f"doc_id long, text string, source string, {EXTRA}"


def frame(spark, rows, parts=3):
    """Documents (id, text, source) with clashing columns, over a few partitions."""
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4, "y", 5, "z") for r in rows], DOCS).repartition(parts, "doc_id", "text")


def texts(seed=0, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)] + ["É", "naïve", "日本"]
    passage = " ".join(rng.choice(words) for _ in range(120))
    rows = []
    for i in range(n):
        body = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 8)))
        if i % 5 == 0:
            body = body[: len(body) // 2] + passage + body[len(body) // 2 :]
        if i % 7 == 0 and rows:
            body = rng.choice(rows)[1]
            if body and rng.random() < 0.6:
                cut = body.split(" ")
                cut[rng.randrange(len(cut))] = "Edited"
                body = " ".join(cut)
        rows.append((i, body, f"h{i % 3}"))
    rows += [(900, None, None), (901, "", "h0"), (902, " \t\n ", "h1"), (903, "one two", "h1"), (904, "ONE two", None), (None, "no id at all here now", "h2"), (905, "ab" * 3000, "h0")]
    return [*rows, rows[3], rows[3]]


ROWS = texts()
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def key(row):
    return tuple((x is None, x) if not isinstance(x, float) else x for x in row)


def same(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None, None)]])
@pytest.mark.parametrize("length", [2, 60])
def test_suffix_dedup(spark, rows, length):
    found = suffix_dedup.digest(suffix_dedup.repeated_spans(frame(spark, rows), length=length)).collect()
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    want = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    same(found, want)


def jaccard_brute(rows, k, num, den):
    sets = []
    for _, text, _ in rows:
        w = words_of(text)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    ids = {g: min((x for x in v if x is not None), default=None) for g, v in least.items()}
    return [(r[0], len(sets[i]), ids[root(i)]) for i, r in enumerate(rows)]


def test_jaccard(spark):
    same(jaccard.near_duplicates(frame(spark, ROWS), k=2).collect(), jaccard_brute(ROWS, 2, 80, 100))
    assert jaccard.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("k", [3, 5])
def test_jaccard_windows(spark, monkeypatch, k):
    """Families of near copies of many lengths about the threshold, at the query's k too; hot windows come under several keys."""
    monkeypatch.setattr(jaccard, "HOT_ROWS", 3)
    rng = random.Random(k)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for f in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([5, 8, 30, 60, 100, 101, 126, 160]))]
        for _ in range(rng.choice([2, 6, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w[: len(w) - rng.randint(0, len(w) // 9)]), "s"))
    want = jaccard_brute(rows, k, 80, 100)
    assert 20 < len({r[2] for r in want}) < len(rows) - 20
    same(jaccard.near_duplicates(frame(spark, rows), k=k).collect(), want)


@pytest.mark.parametrize("limit", [0, 8])
def test_jaccard_chains_and_tiles(spark, monkeypatch, limit):
    """Many copies, each linked to some only, in tiles of a few rows."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 8)
    monkeypatch.setattr(jaccard, "PIECE_PAIRS", 16)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 3)
    monkeypatch.setattr(jaccard, "HUB_ROWS", 4)
    monkeypatch.setattr(jaccard, "PAIRS_PER_ROW", limit)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w), "s"))
    same(jaccard.near_duplicates(frame(spark, rows), k=1).collect(), jaccard_brute(rows, 1, 80, 100))


def test_signature_bound():
    rng = np.random.default_rng(1)
    for size in (3, 50, 700, 2000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 2**63, size // 2 + 1).astype(np.uint64)]))
        x, y = jaccard.signature(a), jaccard.signature(b)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("task_edges", [20, 1 << 20])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 1), (3, 3)]
    label = list(range(80))
    for _ in range(80):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    same(found, [(x, label[x]) for x in want])
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_central_partners():
    a, b = np.array([1, 1, 1, 2, 5]), np.array([2, 3, 4, 3, 6])
    x, y = components.central_partners(a, b)
    assert {*x.tolist(), *y.tolist()} == {1, 2, 3, 4, 5, 6} and len(x) <= 6


def test_edit_distance():
    rng = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(90))] for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain(a, b)


def test_line_dedup(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    base = [" ".join(name(997 * i + j * j) for j in range(1, 11)) + " 17" for i in range(12)]
    long = " ".join(f"tok{name(i)}" for i in range(200))
    rows = [(i, "\n".join(base[i : i + 3] + ["short line"]), "s") for i in range(10)]
    rows += [(20, long, "s"), (21, long.replace("tokhh ", "other "), "s"), (22, None, "s"), (23, "", "s"), (24, "\n\n", "s"), (None, base[0], "s"), rows[0]]
    rows += [(30, base[5].upper().replace(" ", "  ") + "!!", "s")]
    out = line_dedup.dedup_lines(frame(spark, rows), carry=["source"])
    got = out.collect()
    assert len(got) == len(rows) and {r.carry.source for r in got} == {"s"}
    kept = Counter()
    for r in got:
        assert r.n_lines == (next(x[1] for x in rows if x[0] == r.doc_id) or "").count("\n") + 1
        for line in r.text.split("\n"):
            w = re.findall("[a-z0-9]+", line.lower())
            if len(w) >= 5:
                kept[" ".join(w)] += 1
    assert all(n == 1 for n in kept.values())
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r.text)
    assert by_id[0][0].split("\n")[:3] == base[:3] or by_id[0][1].split("\n")[:3] == base[:3]
    assert by_id[9] == ["\n".join([base[11], "short line"])] and by_id[None] == [""] and by_id[30] == [""] and by_id[24] == ["\n\n"]
    sim = [line_dedup._Lines(block_of(x)).simhash(np.array([0]))[0] for x in (long, long.replace("tokhh ", "other "))]
    linked = int(np.bitwise_count(sim[0] ^ sim[1])) <= line_dedup.MOST_BITS
    assert by_id[20] == [long] and (by_id[21] == [""]) == linked
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def block_of(text):
    import pyarrow as pa

    from spanforge.llm import _blocks

    data = np.frombuffer(text.encode() + b" ", np.uint8)
    return _blocks.Block(0, pa.array([1]), np.array([False]), np.array([len(data) - 1]), data)


def test_masks_are_pigeonholes():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in line_dedup.MASKS)


def test_katz(spark):
    rows = [(i, t, s) for i, t, s in ROWS]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    from spanforge.llm.queries import remainder

    got = katz.score_texts(frame(spark, rows), held_out=remainder(10) == 0).collect()
    docs = [(i, [*words_of(t), None]) for i, t, _ in rows]
    uni, pair, n_texts, k = Counter(), Counter(), 0, 5
    for i, w in docs:
        if not held(i):
            n_texts += 1
            uni.update(w)
            pair.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    d1 = katz.discounts([sum(c == r for c in uni.values()) for r in range(1, k + 2)], k)
    d2 = katz.discounts([sum(c == r for c in pair.values()) for r in range(1, k + 2)], k, 2)
    kept = sum((d1[c] if c <= k else 1) * c for c in uni.values())
    total = n if n - kept > 1e-9 * n else n + 1
    p1 = {w: (d1[c] if c <= k else 1) * c / total for w, c in uni.items()}
    unseen = 1 - sum(p1.values())
    uni["<s>"] = n_texts
    seen = defaultdict(dict)
    for (h, w), c in pair.items():
        if c >= 2:
            seen[h][w] = (d2[c] if c <= k else 1) * c
    back, events = {}, {}
    for h, ws in seen.items():
        mass = sum(ws.values())
        events[h] = uni[h] if uni[h] - mass > 1e-9 * uni[h] else uni[h] + 1
        back[h] = (events[h] - mass) / events[h] / (1 - sum(p1[w] for w in ws))
        everything = sum(x / events[h] for x in ws.values()) + back[h] * (unseen + sum(p for w, p in p1.items() if w not in ws))
        assert math.isclose(everything, 1, abs_tol=1e-9)
    want = Counter()
    for i, w in docs:
        score = sum(math.log10(seen[h][x] / events[h] if x in seen.get(h, {}) else back.get(h, 1) * p1.get(x, unseen)) for h, x in zip(["<s>", *w], w, strict=False))
        plain = sum(math.log10((uni.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[(i, held(i), len(w), sum(x in p1 for x in w), n, v, round(plain, 6), round(score, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.distinct_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert katz.score_texts(frame(spark, [])).collect() == []
    alone = katz.score_texts(frame(spark, [(1, "a b", "s")]), held_out=remainder(1) == 0).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and alone.score <= 0


PAGES = "page_id long, url string, html string, digest string, row long"


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "é" * 200, "tiny"
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\nX: y", small), (4, "u", small), (5, "u", None), (6, "u", ""), (2, "again", big), (7, "u", "x" * 300_000), (None, "n", big), (8, "q", "a\r\n\r\nb" * 40)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES).repartition(3)
    folder = str(tmp_path / "w")
    lists = warc.write_archives(df, folder, archive_bytes=2000)
    got = warc.read_archives(lists, folder).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[2] or "").encode()), hashlib.sha256((r[2] or "").encode()).hexdigest()) for r in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    revisits = Counter((r.page_id, r.refers_to) for r in got if r.record_type == "revisit")
    assert revisits == {(2, 1): 2}
    assert all(bytes(r.payload) == (next(x[2] for x in rows if x[0] == r.page_id and len((x[2] or "").encode()) == r.payload_bytes) or "").encode() for r in got if r.record_type == "response")
    assert warc.read_archives(warc.archive_list(spark, folder), folder).count() == len(rows)
    empty = warc.round_trip(spark.createDataFrame([], PAGES))
    assert empty.collect() == []


def test_warc_damage():
    good = warc.record(1, "u", b"payload" * 50, hashlib.sha256(b"payload" * 50).hexdigest(), None, False)
    assert [r["page_id"] for r in warc.read_stream(io.BytesIO(good * 3))] == [1, 1, 1]
    raw = zlib.decompress(good, 31)
    for bad in (good[:-9], zlib_gzip(raw.replace(b"payloadpay", b"paxloadpay", 1)), zlib_gzip(raw[:-4]), zlib_gzip(raw + b"x"), zlib_gzip(b"HTTP" + raw)):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.read_stream(io.BytesIO(bad)))


def test_warc_of_other_writers(spark, tmp_path):
    """Versions 1.0 and 1.1, other types and digests, folded headers, records without digests, an HTTP head without end."""
    import base64

    def foreign(version, kind, block, *more, content="application/http; msgtype=response"):
        head = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
        return zlib_gzip("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nContent-Type:text/html\r\nX-Odd\r\n\r\n"
    body = b"<p>caf\xc3\xa9\r\n\r\n</p>" * 9000
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    url = "WARC-Target-URI: <http://a/>"
    members = [
        foreign("WARC/1.0", "warcinfo", b"software: x\r\n", content="application/warc-fields"), foreign("WARC/1.0", "request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", url),
        foreign("WARC/1.1", "response", http + body, "WARC-Target-URI:\r\n http://a/", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: SHA-256:{hashlib.sha256(http + body).hexdigest()}"),
        foreign("WARC/1.0", "response", http + body, url, f"WARC-Payload-Digest: md5:{hashlib.md5(body).hexdigest().upper()}"), foreign("WARC/1.0", "response", b"no head at all", url),
        foreign("WARC/1.0", "revisit", http, url, f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Refers-To: <urn:uuid:1>"), foreign("WARC/1.1", "resource", body, url, content="text/html"),
    ]
    got = list(warc.read_stream(io.BytesIO(b"".join(members))))
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "response", "revisit", "resource"]
    assert got[2]["payload"] == got[3]["payload"] == got[6]["payload"] == body and got[2]["url"] == got[3]["url"] == "http://a/" and got[0]["url"] is None
    assert got[2]["payload_digest"] == hashlib.sha256(body).hexdigest() and got[2]["payload_bytes"] == len(body) and got[4]["payload_bytes"] == 0
    assert got[5]["payload_digest"] == hashlib.sha1(body).hexdigest() and got[5]["payload"] is None and {r["page_id"] for r in got} == {None}
    light = list(warc.read_stream(io.BytesIO(b"".join(members)), keep=False))
    assert [{**r, "payload": None} for r in got] == light
    for bad in (foreign("WARC/1.1", "response", http + body, f"WARC-Payload-Digest: sha1:{sha1[::-1]}"), foreign("WARC/0.9", "response", http), zlib_gzip(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n\r\n\r\n")):
        with pytest.raises(warc.WarcError):
            list(warc.read_stream(io.BytesIO(bad)))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members))
    rows = warc.read_archives(warc.archive_list(spark, str(tmp_path)), str(tmp_path)).collect()
    assert len(rows) == 7 and {r.record_type for r in rows} == {r["record_type"] for r in got}


def zlib_gzip(data):
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


@pytest.mark.parametrize("special", [True, False])
def test_packing(spark, special):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rows = [*ROWS, (950, "word and <|endoftext|> " * 900, "s"), (951, "a" * 3000, "s"), (952, " " * 1_000_000, "s"), (953, "b" * 1_000_000, "s"), (954, "x" + "\n" * 20_000 + " <|endoftext|>y", "s")]
    pieces = packing.pack_documents(frame(spark, rows), **({} if special else {"special": False})).collect()
    reference = Tokenizer.from_file(path("byte_bpe_50k.json"))
    if not special:
        reference.encode_special_tokens = True
    want = Counter((r[0], tuple([*reference.encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in rows)
    docs, sequences = defaultdict(dict), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0
        docs[p.doc_id].setdefault((p.start, p.doc_tokens), []).append(tuple(ids.tolist()))
        sequences[p.sequence_id].append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # nothing to pad
    assert sum(p.length for p in pieces) == sum(len(t) * n for (_, t), n in want.items())
    single = {i for (i, _), n in want.items() if n == 1 and sum(j == i for j, _ in want) == 1}
    for i, ids in ((i, t) for (i, t), n in want.items() if i in single):
        assert tuple(x for _, piece in sorted(docs[i].items()) for x in piece[0]) == ids
    assert packing.pack_documents(frame(spark, [])).collect() == []


def test_packing_ids_are_those_of_the_tokenizers_file():
    """Every code point in several surroundings, and random strings of odd pieces."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encode, plain = packing.encoder("byte_bpe_50k", True), Tokenizer.from_file(path("byte_bpe_50k.json"))
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for i in range(0, len(points), 64):
        text = "".join(f"a{c}a 1{c}1 {c} !{c}! " for c in points[i : i + 64])
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids
    rng = random.Random(1)
    odd = ["'s", "'LL", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2028", "<|endoftext|>", "<|endoftext", "é", "e\u0301", "日本", "😀", "١٢", "½", "word", "Word", "_", "$$", "\x00", "\ufffd"]
    for _ in range(4000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 101, 500)
    bins = packing.first_fit_decreasing(sizes, 100)
    free: list[int] = []
    want = np.zeros(500, int)
    for i in np.argsort(-sizes, kind="stable"):
        b = next((j for j, f in enumerate(free) if f >= sizes[i]), None)
        if b is None:
            free.append(100)
            b = len(free) - 1
        free[b] -= sizes[i]
        want[i] = b
    assert (bins == want).all()


def test_quality(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        n = rng.randint(30, 120)
        text = " ".join(f"w{rng.randrange(500)}" + ("" if good else "$$$") for _ in range(n)) + "."
        docs.append((i, text, "s"))
        labels.append((i, int(good), 0))
    docs += [(None, None, "s"), (1000, "", "s"), docs[0]]
    labels += [(None, 1, 0), (5000, 1, 0), (3, None, 0)]
    from spanforge.llm.queries import remainder

    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.rank(frame(spark, docs), lab, remainder(5) == 0).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels if q is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.score for r in quality.rank(frame(spark, docs[:5]), lab.limit(0), remainder(5) == 0).collect()} == {0.5}
    assert quality.rank(frame(spark, []), lab, remainder(5) == 0).collect() == []


def plain_features(text):
    """The numbers of quality.features, one text at a time in plain Python."""
    if not text:
        return [0.0] * quality.FEATURES
    data = text.encode()
    inside = lambda c: set(range(ord(c[0]), ord(c[2]) + 1)) if len(c) == 3 and c[1] == "-" else {ord(x) for x in c}
    out = [sum(b in inside(c) for b in data) / len(data) for c in quality.CLASSES] + [sum(b >= 0xC0 for b in data) / len(data)]
    w, lines = words_of(text), data.split(b"\n")
    many, top = max(1, len(w)), max(Counter(w).values(), default=0)
    out += [math.log1p(len(w)), len(data) / many, len(set(w)) / many, top / many, sum(a == b for a, b in zip(w, w[1:], strict=False)) / many]
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    return out + [math.log1p(len(lines)), len(set(lines)) / len(lines), ends / len(lines), len(w) / len(lines), math.log1p(top)]


def test_quality_brute_force(spark):
    """Scores of all rows, very long and tied ones too, from plain features and a fit by plain gradient steps."""
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" + ("$" if i % 3 == 0 and rng.random() < 0.4 else "") for _ in range(rng.randint(20, 90))) + "." * (i % 2), "s") for i in range(160)]
    docs += [(500, "long text " * 300_000, "s"), (501, None, "s"), (502, "", "s"), (503, docs[5][1], "s"), (504, docs[5][1], "s"), (None, docs[6][1], "s"), docs[7]]
    labels = [(i, int(i % 3 != 0), 0) for i in range(160)]
    from spanforge.llm.queries import remainder

    got = quality.rank(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), remainder(5) == 0).collect()
    texts = {t: quality.features([(t or "").encode()])[0] for _, t, _ in docs}
    for t, x in texts.items():
        assert np.allclose(x, plain_features(t), rtol=1e-5, atol=1e-6)
    hashed = {r.i: r.h for r in spark.range(160).select(F.col("id").alias("i"), F.xxhash64("id").alias("h")).collect()}
    sample = sorted((hashed[i], i, t) for i, t, _ in docs if i is not None and i < 160 and zlib.crc32(str(i).encode()) % 5)
    x, y = np.array([texts[t] for _, _, t in sample]), np.array([int(i % 3 != 0) for _, i, _ in sample])
    model = quality.fit(x, y, 0.3)
    # the weights are the minimum of the pairwise loss: its gradient, of the start's size at weights of 0, is next to nothing there
    z, draw = model.indicators(x), np.random.default_rng(quality.SEED)
    d = z[draw.choice(np.flatnonzero(y == 1), quality.PAIRS)] - z[draw.choice(np.flatnonzero(y == 0), quality.PAIRS)]
    assert np.abs(d.T @ (1 / (1 + np.exp(d @ model.weights))) - 10 * model.weights).max() < 0.01 * np.abs(d.T @ np.full(len(d), 0.5)).max()
    strength = [sum(w for w, e, v in zip(model.weights.reshape(quality.FEATURES, -1).ravel(), model.edges.ravel(), np.repeat(texts[t], model.edges.shape[1]), strict=True) if v >= e) for _, t, _ in docs]
    want = Counter((i, round(1 / (1 + math.exp(-model.slope * (s - model.threshold) - math.log(0.3 / 0.7))), 9)) for (i, _, _), s in zip(docs, strength, strict=True))
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)


def test_url_rules(spark):
    urls = ["http://Example.com/en/7x?q", "https://a.example.com/en/8", "com://com/en/", "http://notexample.com/en/71", "http://x.net/de/8", "http://a.example.net/de/81#f", "ftp://o.org/es", "http://o.org/es/", None, "", "no scheme", "http://x.com/EN/7", "http://example.com:80/en/7", "://com/en/?/x"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])]
    rules = [*url_rules.QUERY_RULES, url_rules.Rule("odd", "block", r".*/q[0-9]+$", ()), url_rules.Rule("seo", "block", r".*casino.*", ("casino",), 1)]
    got = url_rules.judge_urls(spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string"), rules).collect()

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group() if u else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = None
        for r in rules:
            if re.match(r.pattern, host + path, re.DOTALL) and (best is None or r.rank > best.rank):
                best = r
        return host, path, best.name if best else None, best.verdict if best else "allow"

    same(got, [(i, *plain(u)) for i, u in rows])
    assert plain("http://example.com/en/7x")[2] == "example.com/en/7" and plain("http://x.example.com/en/8")[2] == "com/en/"


def test_host_rules(spark):
    fine = lambda i: " ".join(f"fine{(i * 7 + j) % 1000}" for j in range(80))
    rows = [*ROWS, *((2000 + i, "too short", "bad") for i in range(60)), (3000, fine(0), "bad"), (3001, "same word here " * 40 + "\nx\nx\n# $\n", "ok")]
    rows += [(4000 + i, fine(i), f"good{i % 9}") for i in range(300)] + [(5000, fine(1) + " $" * 9, "good1"), (5001, fine(2) + " $" * 8, "good1"), (5002, "\n".join([fine(3), "a b", "a b", "a b", "a b"]), "good2")]
    rows += [(5003, " ".join(f"{i:012d}" for i in range(60)), "good3"), (5004, " ".join(chr(97 + i % 26) + str(i % 9) for i in range(300)), "good3")]
    got = host_rules.judge(frame(spark, rows)).collect()
    want, fails = [], defaultdict(lambda: defaultdict(list))
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j + o for j in range(len(w) - 2) if grams[(w[j], w[j + 1], w[j + 2])] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars, symbols, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
        rules = {"short": n < 50, "repeats": 100 * len(hit) > 50 * n, "symbols": symbols > 0.1 * n, "lines": dup > 0.5 * len(lines), "letters": chars < 3 * n or chars > 10 * n}
        rules["any"] = any(rules.values())
        for r, x in rules.items():
            fails[r][s].append(x)
        want.append((i, n, chars, symbols, dup, len(hit), rules["short"] or rules["repeats"], rules["any"], s))
    bad = set()
    for hosts in fails.values():
        total = sum(map(len, hosts.values()))
        mean = sum(map(sum, hosts.values())) / total
        spread = sum(sum(x) ** 2 / len(x) for x in hosts.values()) / total - mean**2 - mean * (1 - mean) * len(hosts) / total
        strength = 1e6 if spread <= 0 else min(1e6, max(10, mean * (1 - mean) / spread - 1))
        most = max(0.5, min(0.75, mean + 3 * math.sqrt(mean * (1 - mean) / (strength + 1))))
        bad |= {h for h, x in hosts.items() if (sum(x) + mean * strength) / (len(x) + strength) > most}
    assert bad == {"bad"}
    same(got, [(*x[:7], not x[7] and x[8] not in bad) for x in want])
    assert {r.doc_id: r.kept for r in got if r.doc_id and r.doc_id >= 3000 and not 4000 <= r.doc_id < 5000} == {3000: False, 3001: False, 5000: False, 5001: True, 5002: False, 5003: False, 5004: False}
    assert host_rules.judge(frame(spark, [])).collect() == []


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_winnowing(spark, monkeypatch, broadcast_rows):
    from spanforge.llm import _native

    monkeypatch.setattr(_native, "BROADCAST_ROWS", broadcast_rows)
    items = [(1, " ".join((ROWS[5][1] or "").split()[:30])), (2, "two"), (12, "one TWO"), (3, None), (4, "  !! "), (None, "no id at all"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (6, "É日本 x")]
    rows = [*ROWS, (700, "x Alpha beta, gamma delta epsilon zeta eta theta iota kappa! and beta gamma delta epsilon zeta eta theta iota kappa LAMBDA", "s"), (701, "x É日本-X", "s")]
    got = winnow.contamination(frame(spark, rows), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n int")).collect()
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    wins = []
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        wins += [(i, tuple(w[j : j + n])) for j in range(len(w) - n + 1) if n]
    want = []
    for i, t, _ in rows:
        w, hit, found = split(t), set(), set()
        for item, x in wins:
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit.update(range(j, j + len(x)))
                    found.add(str(item) if item is not None else None)
        ids = sorted(found - {None})
        want.append((i, len(w), len(hit), len(ids), tuple(ids), bool(hit)))
    same([(r[0], r[1], r[2], r[3], tuple(r[4]), r[5]) for r in got], want)
    assert winnow.contamination(frame(spark, []), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_queries_are_whole(spark):
    from spanforge.llm import queries

    names = list(queries.queries())
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline(spark):
    import corpus_pipeline

    rows = [(*r[:2], "en", r[2], len(r[1] or "")) for r in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "doc_id", "text")
    from spanforge.llm import _scratch

    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = _scratch.stored(stage(spark, _scratch.stored(docs, "in"), ""), name)
        assert docs.columns == corpus_pipeline.COLUMNS
    texts_left = [r.text for r in docs.collect()]
    assert 0 < len(texts_left) <= len(rows) and len(set(texts_left)) == len(texts_left)


@pytest.mark.parametrize("tile", [3, 2048])
def test_line_dedup_brute_force(spark, monkeypatch, tile):
    """All pairs of distinct lines, linked by the two conditions; the first occurrence of a group stays."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile)
    monkeypatch.setattr(jaccard, "HUB_ROWS", 2)
    monkeypatch.setattr(jaccard, "PAIRS_PER_ROW", tile % 7)
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    seeds = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 70))] for _ in range(25)]

    def line():
        w = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w) if rng.random() < 0.8 else " ".join(w).upper() + " !"

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 5))), "s") for i in range(120)] + [(None, line(), "s")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    norm = lambda x: tuple(re.findall("[a-z0-9]+", x.lower()))
    first = {}
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for j, x in enumerate(text.split("\n")):
            first.setdefault(norm(x), ((i is None, i), j))
    distinct = list(first)
    sims = [int(line_dedup._Lines(block_of(" ".join(x))).simhash(np.array([0]))[0]) for x in distinct]
    group = list(range(len(distinct)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    fuzzy = 0
    for a in range(len(distinct)):
        for b in range(a):
            if (sims[a] ^ sims[b]).bit_count() <= 3:
                most = max(len(distinct[a]), len(distinct[b]))
                if 100 * (most - line_dedup.edit_distance(list(distinct[a]), list(distinct[b]))) >= 80 * most:
                    fuzzy += 1
                    x, y = root(a), root(b)
                    group[max(x, y)] = min(x, y)
    assert fuzzy > 20
    keep = {}
    for k, x in enumerate(distinct):
        keep[root(k)] = min(keep.get(root(k), first[x]), first[x])
    kept = {keep[root(k)]: k for k in range(len(distinct))}
    for i, text, _ in rows:
        want = []
        for j, x in enumerate(text.split("\n")):
            if ((i is None, i), j) in kept:
                want.append(x)
        assert got[i] == "\n".join(want)
