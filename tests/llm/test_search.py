"""Ranked search against SQL and against sums over every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folium.llm import lexical_search as ls
from folium.llm.queries import QUERIES, SQL

from ..conftest import DATA, same


def test_query_matches_sql(spark, duck):
    same(QUERIES["op12_lexical_search"](spark, DATA), duck, SQL["op12_lexical_search"])


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k):
    counts = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n, total = sum(c > 0 for _, _, c in counts), sum(c for _, _, c in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c, size in counts:
            m = 75 + (25 * size * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    """Skewed terms, ties, repeated rows, nulls; one shard of many documents and many shards with a first part; a full index."""
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.5)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(2500)]
    docs += [(3, "tie A-b"), (2, "TIE a_b"), (1, "tie\x00a b"), (None, "tie a b"), (9, None), (8, ""), (7, "é É ß ö"), (3, "tie A-b")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(25)]
    items += [(90, "tie a tie"), (91, "É"), (92, None), (93, "..."), (94, "nobody"), (90, "tie a tie"), (90, "b"), (None, "w1 w1 w2")]
    frame = spark.createDataFrame([(d, t, 0, 0, "x") for d, t in docs], "doc_id long, text string, item_id int, score int, term string").repartition(5)
    asked = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items, 20)
    assert rows(ls.rank_documents(frame, asked)) == want
    assert rows(ls.search(ls.build(frame), asked, 20, seed=2)) == want
    monkeypatch.setattr(ls, "VOCABULARY", 3)
    monkeypatch.setattr(ls, "BLOCK_TERMS", 100)
    assert rows(ls.rank_documents(frame, asked, 3)) == brute(docs, items, 3)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 9), st.integers(1, 12), st.integers(0, 60), st.integers(0, 10**6))
def test_hybrid_equals_sums(size, n_lists, k, least, seed):
    rng = np.random.default_rng(seed)
    lists = []
    for _ in range(n_lists):
        docs = np.flatnonzero(rng.random(size) < rng.random())
        if len(docs):
            lists.append((docs, rng.integers(1, 30, len(docs))))
    ranks = rng.permutation(size)
    was, ls.RANGE = ls.RANGE, 64
    try:
        docs, sums = ls.best(lists, size, ranks, k, max(least, 1))
    finally:
        ls.RANGE = was
    total = np.zeros(size, np.int64)
    for d, s in lists:
        total[d] += s
    want = [d for d in np.lexsort((ranks, -total)) if total[d] >= max(least, 1)][:k]
    assert docs.tolist() == [int(d) for d in want] and sums.tolist() == total[want].tolist()


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "word1 mail"), (2, None)], "item_id long, text string")
    assert {r["item_id"] for r in ls.rank_documents(awkward, items).collect()} == {1}
    assert ls.rank_documents(nothing, items).count() == 0
    assert ls.rank_documents(awkward, items.filter("false")).count() == 0
