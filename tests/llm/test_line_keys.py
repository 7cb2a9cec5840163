"""Keys of line dedup: what unrelated long lines cost, and that lines at the border of the two kinds of keys meet."""

import numpy as np
import pytest

from spanforge.llm import line_dedup


def _removed(spark, lines: list[str]) -> list[int]:
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    out = line_dedup.dedup_lines(docs, min_words=1, most_bits=None)
    return [r["doc_id"] for r in out.where("n_removed > 0").orderBy("doc_id").collect()]


def test_unrelated_long_lines_are_no_candidates(spark, monkeypatch):
    # each line has one pair in common with the next, at the same place, and nothing else
    rng = np.random.default_rng(5)
    lines = [[f"w{x}" for x in rng.integers(0, 10**9, 100)] for _ in range(60)]
    for a, b in zip(lines[::2], lines[1::2], strict=True):
        a[50:52] = b[50:52]
    rows, banded = [], line_dedup.banded

    def counting(groups, rule):
        out = banded(groups, rule)
        rows.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "banded", counting)
    assert _removed(spark, [" ".join(x) for x in lines]) == []
    assert rows == [0, 0]


@pytest.mark.parametrize("n", [39, 40, 41, 45, 50, 51, 60])
def test_all_similar_lines_are_found_at_the_border_of_kinds(spark, n):
    # twins that differ in as many words as may be: replaced evenly, or left out
    rng = np.random.default_rng(n)
    lines, most = [], n // 5
    for k in range(12):
        line = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        spoilt = np.linspace(k % 3, n - 1 - k % 2, most).round().astype(int)
        twin = list(line)
        for i in spoilt:
            twin[i] += "x"
        lines += [line, twin if k % 2 else [w for i, w in enumerate(line) if i not in set(spoilt.tolist())]]
    assert _removed(spark, [" ".join(x) for x in lines]) == list(range(1, 24, 2))


def test_common_words_bound_the_distance_as_the_plain_surplus():
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = rng.integers(1, 2**63, rng.integers(1, 40)).astype(np.uint64)
        lines = [words[rng.integers(0, len(words), rng.integers(0, 30))] for _ in range(rng.integers(2, 40))]
        u = rng.integers(0, len(lines), 100)
        v = (u + rng.integers(1, len(lines), 100)) % len(lines)
        for a, b, common in zip(u, v, line_dedup._common(lines, u, v), strict=True):
            if len(lines[a]) + len(lines[b]):
                assert max(len(lines[a]), len(lines[b])) - common == line_dedup._surplus(lines[a], lines[b])
