"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import periodic as pe


def plain_runs(s, min_words, times):
    """Runs by trying every period."""
    n, out = len(s), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_words, times * q) and not any(all(s[x] == s[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 9), st.integers(0, 60))
def test_runs_equal_their_definition(symbols, period, start):
    symbols = list(symbols)
    for i in range(start + period, len(symbols)):
        symbols[i] = symbols[i - period]
    for min_words, times in ((1, 2), (8, 3), (24, 3)):
        assert pe.periodic_runs(np.array(symbols, dtype=np.int64), min_words, times) == plain_runs(symbols, min_words, times)


def test_long_sequences():
    assert pe.periodic_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert pe.periodic_runs(np.tile(np.arange(700), 60)) == [(0, 42_000, 700)]
    apart = np.concatenate([np.r_[np.arange(30), 1000 + i] for i in range(3000)])  # one passage, never a run
    assert pe.periodic_runs(apart) == []
    with pytest.raises(ValueError, match="two periods"):
        pe.periodic_runs(np.zeros(50, np.int64), 24, 1)


DOCS = [
    (1, " ".join(["a b c"] * 9) + " d", "x"),
    (2, None, "x"),
    (3, "", "x"),
    (None, "w " * 30, "x"),
    (4, "a\tb\v\na b " + "q r\n" * 12 + "tail", "x"),
    (4, "a\tb\v\na b " + "q r\n" * 12 + "tail", "x"),
    (5, " ".join(f"w{i}" for i in range(3000)), "x"),
    (6, " ".join(["p"] * 40 + ["u v"] * 20 + [f"w{i}" for i in range(50)] * 4), "x"),
]


def test_documents(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string, runs string")
    got = {(r.doc_id, r.n_words): r for r in pe.collapsed_runs(df).collect()}
    assert pe.collapsed_runs(df).count() == len(DOCS)
    for id_, text, _ in DOCS:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        row, runs = got[id_, len(words)], plain_runs(words, 24, 3)
        assert [tuple(r) for r in row.runs] == runs
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert pe.collapsed_runs(df.limit(0)).count() == 0


def test_texts_share_no_runs():
    """Texts handled together never continue each other."""
    _, runs = pe.runs_of_texts([b"a b " * 8, b"a b " * 8, b"a b " * 12, b"", b"a b " * 12])
    assert runs == [[], [], [(0, 24, 2)], [], [(0, 24, 2)]]


def test_query_equals_definition(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice((0, 3, 40, 120)))), "extra") for i in range(150)]
    rows += [(200, None, "extra"), (None, "a " * 40, "extra"), (7, rows[7][1], "extra")]
    spark.createDataFrame(rows, "doc_id bigint, text string, period string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in pe.op13_periodic(spark, str(tmp_path)).na.fill(-1).collect())
    want = []
    for id_, text, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        n, h = len(w), zlib.crc32(str(id_).encode()) if id_ is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w, 24, 3)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        top = (*best, 1000 * best[1] // best[2]) if best else (-1,) * 4
        want.append((-1 if id_ is None else id_, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
