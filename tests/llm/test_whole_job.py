"""The registered queries do the whole job: nothing that their criterion asks for is left out."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from spanforge.llm import _blocks, jaccard, katz, line_dedup, quality, queries, url_rules


@pytest.fixture
def folder(spark, tmp_path):
    """Writes rows (id, text, source) as the documents of a new folder."""

    def write(rows):
        spark.createDataFrame([(*r[:2], "en", r[2], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def edited(rng, words, vocabulary, n):
    w = list(words)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[at] = rng.choice(vocabulary)
        elif kind == 1:
            w.insert(at, rng.choice(vocabulary))
        elif len(w) > 4:
            del w[at]
    return w


@pytest.mark.parametrize("size", [30, 400])
def test_line_dedup_links_all_similar_lines(spark, folder, monkeypatch, size):
    """Groups by edit similarity alone, over all pairs of distinct lines; few words make repeated word pairs."""
    monkeypatch.setattr(jaccard, "PAIRS_PER_ROW", 2)
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 2)
    rng = random.Random(size)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(8)) for _ in range(size)]
    seeds = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 5, 6, 7, 8, 9, 10, 10, 12, 15, 20, 24, 30, 40, 60, 100)]
    lines = [edited(rng, s, vocabulary, rng.randint(0, max(1, len(s) // 5))) for s in seeds for _ in range(8)]
    lines = [x for x in lines if len(x) >= 5]
    docs = spark.read.parquet(f"{folder([(i, ' '.join(x), 's') for i, x in enumerate(lines)])}/documents.parquet")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_words=1, most_bits=None, most_keys=None).collect()}
    group = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            most = max(len(lines[a]), len(lines[b]))
            if 100 * (most - line_dedup.edit_distance(lines[a], lines[b])) >= 80 * most and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert len(set(group)) < len(lines) - 40
    assert [i for i in got if got[i]] and {i for i in got if got[i]} == set(group)


def test_line_dedup_recall(spark, folder):
    """Share of the linked pairs of lines that the query finds, by length and similarity, against edit similarity alone."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    word = lambda: vocabulary[min(int(rng.paretovariate(0.6)) - 1, 3999)] if rng.random() < 0.5 else rng.choice(vocabulary)
    rows, classes = [], {}
    for n in (5, 8, 11, 15, 20, 30, 50, 100, 200):
        for similarity in (0.8, 0.9):
            while sum(c == (n, similarity) for c in classes.values()) < 60:
                a = [word() for _ in range(n)]
                b = edited(rng, a, vocabulary, int((1 - similarity) * n + 1e-9))
                most = max(len(a), len(b))
                if a != b and 100 * (most - line_dedup.edit_distance(a, b)) >= 80 * most:
                    classes[len(rows)] = (n, similarity)
                    rows += [(len(rows), " ".join(a), "s"), (len(rows) + 1, " ".join(b), "s")]
                elif int((1 - similarity) * n + 1e-9) == 0:
                    break
    got = {r.doc_id: r.text for r in queries.op6_line_dedup(spark, folder(rows)).collect()}
    found, total = Counter(), Counter()
    for i, c in classes.items():
        total[c] += 1
        found[c] += got[i + 1] == ""
    recall = {c: found[c] / total[c] for c in total}
    assert len(recall) >= 14 and min(recall.values()) >= 0.9 and all(r == 1 for (n, _), r in recall.items() if n <= 11), recall
    assert sum(found.values()) >= 0.98 * sum(total.values())


def test_line_dedup_of_long_lines_is_whole(spark, folder, tmp_path):
    """Lines of similarity 0.8 whose grams of the lowest hashes are spoiled, as any twelve can be: every pair is found, and no scratch table but texts and answers stays."""
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n)]
    rows = []
    for i in range(120):
        a = words(60)
        data = np.frombuffer(" ".join([*a, ""]).encode(), np.uint8)
        grams = line_dedup._Lines(_blocks.Block(0, pa.array([1]), np.array([False]), np.array([len(data) - 1]), data)).grams(3, np.arange(58))
        b, spoiled = list(a), set()
        for at in np.argsort(grams):  # its lowest grams go first, with twelve words
            if len(spoiled) < 12 and not spoiled & set(range(at, at + 3)):
                spoiled.add(int(at) + 1)
                b[at + 1] = "x" + a[at + 1]
        rows += [(2 * i, " ".join(a), "s"), (2 * i + 1, " ".join(b), "s")]
    base = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in base.iterdir()}
    got = {r.doc_id: r.text for r in queries.op6_line_dedup(spark, folder(rows)).collect()}
    assert all(got[2 * i] and not got[2 * i + 1] for i in range(120))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path)).collect()) == list(range(0, 240, 2))
    assert {p.name.split("-")[1] for p in base.iterdir() if p.name not in before} <= {"blocks", "gone"}


def test_similar_lines_share_a_first_gram():
    """The bound behind the keys, whatever the common order, for lines of all lengths about the change of kinds."""
    rng = random.Random(8)
    for _ in range(6000):
        a = [rng.randrange(12) for _ in range(rng.choice([4, 5, 8, 9, 10, 11, 12, 13, 20, 40]))]
        b = edited(rng, a, range(12), rng.randint(1, max(1, len(a) // 5)))
        most = max(len(a), len(b))
        if a == b or 100 * (most - line_dedup.edit_distance(a, b)) < 80 * most:
            continue
        seed, found = rng.random(), []
        for x in (a, b):
            n, keys = np.array([len(x)]), set()
            for q, keyed in line_dedup._kinds(n, 80, 100):
                grams = {tuple(x[i : i + q]) for i in range(len(x) - q + 1)}
                if keyed[0]:
                    keys |= set(sorted(grams, key=lambda g: hash((g, seed)))[: int(line_dedup._prefix(n, 80, 100, q)[0])])
            found.append(keys)
        assert found[0] & found[1]


def test_line_dedup_short_lines(spark, folder):
    """Exact copies go however short, and in scripts without spaces; lines without a word stay."""
    rows = [(1, "Les.\n\nthe thin line\n長い行がここに繰り返されている", "s"), (2, "les\n--\nThe thin  line!\n長い行がここに繰り返されている\nthe thick line", "s"), (3, "LES\n--\n\nnew", "s")]
    got = {r.doc_id: (r.text, r.n_removed) for r in queries.op6_line_dedup(spark, folder(rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("--\nthe thick line", 3), 3: ("--\n\nnew", 1)}


def test_packing_by_the_tokenizers_file(spark, folder):
    """The ids of the reference tokenizer as its file sets it up, special token included."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "plain é日本", "<|endoftext|", " <|endoftext|>\n\n y", "", None]
    got = queries.op4_packing(spark, folder([(i, t, "s") for i, t in enumerate(texts)])).where("start = 0 and length = doc_tokens").collect()
    reference = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = [[*reference.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert 50256 in want[0]
    ids = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in got}
    assert len(ids) > 3
    assert any(50256 in want[i] for i in ids)
    assert all(x == (len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes())) for i, x in ids.items())


def test_katz_keeps_pairs_seen_once(spark, folder):
    """Scores with every pair of training in the table, the once seen ones by their discount."""
    rng, k = random.Random(6), 5
    docs = [[f"w{min(int(rng.paretovariate(0.7)), 90)}" for _ in range(rng.randint(1, 20))] for _ in range(150)]
    got = {r.doc_id: r.score for r in queries.op9_katz(spark, folder([(i, " ".join(w), "s") for i, w in enumerate(docs)])).collect()}
    uni, pair, n_texts = Counter(), Counter(), 0
    for i, w in enumerate(docs):
        if zlib.crc32(str(i).encode()) % 10:
            n_texts += 1
            uni.update([*w, None])
            pair.update(zip(["<s>", *w], [*w, None], strict=True))
    d1, d2 = (katz.discounts([sum(c == r for c in x.values()) for r in range(1, k + 2)], k) for x in (uni, pair))
    assert d2[1] < 1
    n = sum(uni.values())
    kept = sum((d1[c] if c <= k else 1) * c for c in uni.values())
    total = n if n - kept > 1e-9 * n else n + 1
    p1 = {w: (d1[c] if c <= k else 1) * c / total for w, c in uni.items()}
    unseen = 1 - sum(p1.values())
    uni["<s>"] = n_texts
    seen = defaultdict(dict)
    for (h, w), c in pair.items():
        seen[h][w] = (d2[c] if c <= k else 1) * c
    events, back = {}, {}
    for h, ws in seen.items():
        mass = sum(ws.values())
        events[h] = uni[h] if uni[h] - mass > 1e-9 * uni[h] else uni[h] + 1
        back[h] = (events[h] - mass) / events[h] / (1 - sum(p1[w] for w in ws))
    for i, w in enumerate(docs):
        score = sum(math.log10(seen[h][x] / events[h] if x in seen.get(h, {}) else back.get(h, 1) * p1.get(x, unseen)) for h, x in zip(["<s>", *w], [*w, None], strict=True))
        assert math.isclose(got[i], score, abs_tol=1e-6)


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/; the longest wins."""
    assert [(r.name, r.verdict) for r in url_rules.QUERY_RULES] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    urls = {"http://a.net/de/1": ("net/de/", "allow"), "http://www.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://example.com/en/8": ("com/en/", "block"), "http://x.org/es/": ("org/es/", "block"), "http://x.org/" + "p/" * 500_000: (None, "allow"), "http://x.org/es/" + "q" * 1_000_000: ("org/es/", "block")}
    rows = list(enumerate(urls))
    spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op7_url_rules(spark, str(tmp_path)).collect()}
    assert got == {i: urls[u] for i, u in rows}


def thue_morse(k):
    x = "a"
    for _ in range(k):
        x += x.translate({97: 98, 98: 97})
    return x


def test_hashes_tell_thue_morse_words_apart(spark, folder):
    """Polynomials modulo 2^64 give a Thue-Morse word and its complement one hash, whatever the base."""
    from spanforge.llm import suffix_dedup
    from spanforge.llm._text import Words, span_hash

    pairs = [(x := thue_morse(k), x.translate({97: 98, 98: 97})) for k in (5, 6, 8, 10, 12)]
    for a, b in pairs:
        text = np.frombuffer(f"{a} {b} ".encode(), np.uint8)
        assert len(set(Words(text, np.array([len(text) - 1])).hashes.tolist())) == 2
        assert len(set(span_hash(text, np.array([0, len(a) + 1]), np.array([len(a), len(text) - 1])).tolist())) == 2
    rows = [(i, " ".join(f"{w}{j}" for j in range(6)), "s") for i, w in enumerate(x for p in pairs for x in p)]
    assert {r.doc_id: r.component_id for r in queries.op3_ngram_jaccard(spark, folder(rows)).collect()} == {i: i for i in range(len(rows))}
    rows = [(1, pairs[3][0], "s"), (2, pairs[3][1], "s")]
    data = [r[1].encode() for r in rows]
    count = Counter(x[p : p + 400] for x in data for p in range(len(x) - 399))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.digest(suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    for i, x in enumerate(data):
        gone = bytearray(len(x))
        for p in range(len(x) - 399):
            if count[x[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        assert got[i + 1] == sum(gone)


def test_quality_learns_from_all_rows():
    """Of 30,000 rows each has its say: the weights are the minimum of the loss of all pairs, edges and threshold those of all rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30_000, quality.FEATURES)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=len(x)) > 0.4).astype(int)
    model = quality.fit(x, y, 0.3)
    assert np.array_equal(model.edges, np.sort(np.concatenate([np.sort(x, axis=0)[np.floor((len(x) - 1) * np.arange(1, 10) / 10 + 0.5).astype(int)].T, np.sort(x[y == 0], axis=0)[np.floor(((y == 0).sum() - 1) * np.array([0.02, 0.98]) + 0.5).astype(int)].T], axis=1), axis=1))
    z = model.indicators(x)
    s = z @ model.weights
    assert np.isclose(model.threshold, np.sort(s)[(y == 0).sum()], rtol=1e-6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pull = np.zeros(len(x))
    for i in range(0, len(good), 500):
        p = 1 / (1 + np.exp(s[good[i : i + 500], None] - s[bad]))
        pull[good[i : i + 500]] += p.sum(axis=1)
        pull[bad] -= p.sum(axis=0)
    scale = quality.PAIRS / len(good) / len(bad)
    start = np.where(y == 1, len(bad), -len(good)) * 0.5
    assert np.abs(scale * (z.T @ pull) - 10 * model.weights).max() < 0.002 * np.abs(scale * (z.T @ start)).max()


def test_line_keys_grow_with_edits():
    """A line is sent under two keys an edit and one more, and no limit to keys can be set."""
    n = np.array([5, 9, 10, 12, 100, 1000])
    keys = sum(np.where(keyed, line_dedup._prefix(n, 80, 100, q), 0) for q, keyed in line_dedup._kinds(n, 80, 100))
    assert keys.tolist() == [3, 4, 5, 5, 41, 401]
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(None, most_bits=None, most_keys=12)


def test_edit_distance_with_a_limit():
    rng = random.Random(3)
    rule = line_dedup.edit_rule(80, 100, None)
    for _ in range(3000):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(2))
        d = line_dedup.edit_distance(a, b)
        assert all((line_dedup.edit_distance(a, b, most) <= most) == (d <= most) for most in (0, 1, 3, 6))
        longer = max(len(a), len(b))
        assert rule.linked(np.array(a, np.uint64), np.array(b, np.uint64)) == (100 * (longer - d) >= 80 * longer)


def test_salted_line_keys_come_back():
    """Keys of a frequent word pair are dealt out by salt and are one pair again afterwards."""
    shift = np.uint64(64 - line_dedup.KEY_BITS)
    key = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift << shift
    salt = np.arange(199, dtype=np.uint64) % np.uint64(7)
    got, found = line_dedup._plain(line_dedup._turned(key, salt) | salt)
    assert (got == key).all() and (found == (salt > 0)).all()


def test_second_pass_of_line_keys_drops_lines_of_one_component():
    """Rows of one component don't meet again under a shared pair; rows whose pair stands too far apart can't link."""
    rule = line_dedup.edit_rule(80, 100, None)
    group, n, bits = np.zeros(3, np.int64), np.array([10, 10, 10]), np.zeros(3, np.uint64)
    partnered = lambda place, comp: jaccard._partnered(group, n, bits, rule, np.array(place), np.array(comp)).tolist()
    assert partnered([4, 4, 4], [1, 1, 1]) == [False] * 3
    assert partnered([4, 5, 4], [1, 1, 2]) == [True] * 3
    assert partnered([4, 8, 4], [1, 1, 2]) == [True, False, True]
    assert partnered([4, jaccard.NO_PLACE, 4], [1, 1, 2]) == [True] * 3


@pytest.mark.parametrize("most", [1, 4])
def test_lines_that_the_first_keys_miss_are_found(spark, folder, monkeypatch, most):
    """Pairs whose rarest word pairs are spoiled link by the other keys, whatever the number of first keys."""
    monkeypatch.setattr(line_dedup, "FIRST_KEYS", most)
    rng = random.Random(31)
    common = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(40)]
    rows = []
    for i in range(60):
        a = [rng.choice(common) for _ in range(40)]
        b = list(a)
        for at in range(2, 40, 5):  # the rarest pairs of either line are those of its own words
            a[at], b[at] = f"left{i}x{at}", f"right{i}x{at}"
        rows += [(2 * i, " ".join(a), "s"), (2 * i + 1, " ".join(b), "s")]
    got = {r.doc_id: r.text for r in queries.op6_line_dedup(spark, folder(rows)).collect()}
    assert all(got[2 * i] and not got[2 * i + 1] for i in range(60))
