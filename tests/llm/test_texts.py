"""Decontamination, n-gram join, repeated bytes and language model against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from folium.llm import gru_lm, ngram_join, phrase_index, suffix_dedup
from folium.llm.queries import QUERIES, SQL

from ..conftest import DATA, same

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def split(text):
    return (text or "").encode().translate(LOW).split()


def links(sets):
    """Smallest id reachable, by comparing all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingles(text):
    w = split(text)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def test_join_matches_all_pairs(spark):
    rnd = random.Random(2)
    texts = {}
    for family in range(12):
        base = [f"f{family}x{rnd.randrange(40)}" for _ in range(rnd.choice([3, 5, 9, 30, 80, 200]))]
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(9)}"
            texts[len(texts)] = " ".join(w)
    sets = {i: shingles(t) for i, t in texts.items()}
    want = links(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}


def test_texts_that_share_common_passages_are_not_compared(spark, monkeypatch):
    """Texts that have lines of a small store in common do not meet, near copies of them do; links equal all pairs."""
    rnd = random.Random(4)
    store = [" ".join(f"s{i}x{k}" for k in range(12)) for i in range(6)]
    own = lambda i, n: [f"d{i}y{k}" for k in range(n)]
    texts = {i: " ".join([*own(i, 30), *rnd.sample(store, 2), *own(-i - 1, 30)]) for i in range(120)}
    texts |= {200 + i: texts[i].replace(f"d{i}y5", "other") for i in range(5)}
    texts |= {300 + i: " ".join(rnd.sample(store, 4)) for i in range(40)}
    met = []
    plain = ngram_join.streamed
    monkeypatch.setattr(ngram_join, "streamed", lambda df, *rest: (met.append({r["doc_id"] for r in df.select("doc_id").collect()}), plain(df, *rest))[1])
    sets = {i: shingles(t) for i, t in texts.items()}
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == links(sets)
    assert {i for i in met[0] if i < 300} == {*range(5), *range(200, 205)}


def test_leaves_of_a_large_family_find_the_same_links():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = []
    for _ in range(90):
        s = base.copy()
        at = rnd.integers(0, 300, rnd.integers(0, 30))
        s[at] = rnd.integers(0, 1 << 62, len(at)).astype(np.uint64)
        sets.append(np.unique(s))
    limit = ngram_join.Threshold(85)
    want = {(i, j) for i, j in combinations(range(90), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}

    def classes(pairs):
        label = list(range(90))
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    whole = ngram_join.links_within(list(range(90)), sets, limit)
    assert set(map(lambda p: tuple(sorted(p)), whole)) <= want and classes(whole) == classes(want)
    half = np.arange(90) % 2
    parts = [p for s in (0, 1) for p in ngram_join.links_within([i for i in range(90) if i % 2 == s], [sets[i] for i in range(90) if i % 2 == s], limit)]
    assert classes(parts + ngram_join.links_within(list(range(90)), sets, limit, half)) == classes(want)


def test_join_on_awkward_rows(awkward, nothing):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(awkward).collect()), key=str)
    by = {g[0]: g for g in got if g[0] is not None}
    assert len(got) == 13
    assert by[0][2] == by[1][2] == by[2][2] == 0
    assert by[3][1:] == (0, 3) and by[4][1:] == (0, 4) and by[5][1:] == (0, 5)
    assert by[6][1] == 1 and by[9][2] == 6
    assert all(g[2] is None for g in got if g[0] is None)
    assert ngram_join.jaccard_join(nothing).count() == 0


def test_decontamination_sql(spark, duck):
    same(QUERIES["op3_decontaminate"](spark, DATA), duck, SQL["op3_decontaminate"])


def test_decontamination_on_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "Word5 word6, WORD7 word8 word9 word10 word11 word12 word13 word14 word15"), (2, "one TWO"), (3, None), (4, " .,"), (None, "word30 word31"), (5, "absent thing")], "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in phrase_index.contamination(awkward, items).collect()]
    assert len(got) == 13
    assert (0, 120, 13, [1]) in got and (6, 2, 2, [2]) in got and (9, 2, 2, [2]) in got and (3, 0, 0, []) in got
    assert phrase_index.contamination(nothing, items).count() == 0
    assert phrase_index.contamination(awkward, items.filter("false")).filter("n_hit > 0").count() == 0


def test_decontamination_with_repeated_items(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    items = [(1, passage), (1, passage), (2, "short one"), (None, "no id here"), (None, "no id here")]
    docs = [(0, f"before {passage}"), (1, f"{passage} " + "after " * 30), (2, f"a short one and no id here {passage[:-4]}"), (3, "no id"), (4, None)]
    want = []
    for i, t in docs:
        w, marked, named = split(t), set(), set()
        for item, x in items:
            x = split(x)
            for k in range(max(len(x) - 9, 1)):
                part = x[k : k + 10]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        marked.update(range(at, at + len(part)))
                        named |= {item} - {None}
        want.append((i, len(w), len(marked), sorted(named)))
    found = phrase_index.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()) == want


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c y d"), (3, "d c b a"), (4, "a b c"), (5, "d")], "doc_id long, text string")
    wanted = phrase_index.windows(spark.createDataFrame([(7, "a b c d")], "item_id long, text string"), 10)
    got = {(r["doc_id"], r["kind"]) for r in phrase_index.search(phrase_index.build(docs), wanted, slack=3).collect()}
    assert got == {(1, "phrase"), (2, "proximity"), (3, "proximity")}


def brute_removal(docs, size):
    seen = defaultdict(list)
    for r, (_, t) in enumerate(docs):
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            seen[b[p : p + size]].append((r, p))
    cover = [bytearray(len((t or "").encode())) for _, t in docs]
    for places in seen.values():
        if len(places) > 1:
            for r, p in places:
                cover[r][p : p + size] = b"\1" * size
    out = []
    for (i, t), c in zip(docs, cover, strict=True):
        b = (t or "").encode()
        spans = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
        out.append((i, len(b), sum(c), spans, hashlib.sha256(bytes(x for x, y in zip(b, c, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def test_removal_matches_brute_force(spark):
    rnd = random.Random(4)
    base = "".join(rnd.choice("ab cé") for _ in range(1500))
    docs = []
    for i in range(30):
        a = rnd.randrange(1000)
        t = base[a : a + rnd.randrange(700)]
        if i % 3 == 0:
            t = "".join(rnd.choice("abé") for _ in range(50)) + t + "x" * rnd.randrange(600)
        if i % 7 == 0:
            t = "ab" * rnd.randrange(400) + t
        docs.append((i, t))
    docs += [(30, None), (31, ""), (32, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (None, "zz")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(frame).collect()), key=str)
    assert got == brute_removal(docs, 400)
    assert suffix_dedup.remove_repeats(frame.filter("false")).count() == 0


def test_strings_around_one_hash_are_bounded(spark, monkeypatch):
    rnd = random.Random(6)
    letters = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage, bound = letters(450), 20_000
    docs = [(i, letters(300) + passage[: rnd.choice([350, 390, 450])] + letters(300)) for i in range(60)]
    docs += [(60, docs[0][1]), (61, "ab" * 12_000), (62, "xy" + "ab" * 300), (63, letters(900)), (None, docs[1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    sort = suffix_dedup._sorted_strings

    def watched(length):
        inner = sort(length)

        def run(batches):
            kept = list(batches)
            size = Counter()
            for b in kept:
                for r in b.to_pylist():
                    size[r["hash"]] += len(r["bytes"])
            assert max(size.values(), default=0) <= bound
            yield from inner(iter(kept))

        return run

    monkeypatch.setattr(suffix_dedup, "_sorted_strings", watched)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", bound)
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(frame).collect()), key=str) == brute_removal(docs, 400)


@pytest.mark.parametrize("copied", [1 << 16, 2])
def test_suffix_order_is_lexicographic(monkeypatch, copied):
    monkeypatch.setattr(suffix_dedup, "COPIED", copied)
    rnd = random.Random(9)
    for _ in range(30):
        strings = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randrange(1, 60))) for _ in range(4)]
        text = np.frombuffer(b"".join(strings), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        ends = np.repeat(first[1:], np.diff(first))
        wanted = np.array([rnd.random() < 0.7 for _ in text])
        raw = text.tobytes()
        order = suffix_dedup.suffix_order(text, ends, wanted, 100)
        suffixes = [raw[i : ends[i]] for i in order]
        assert sorted(order) == list(np.flatnonzero(wanted)) and suffixes == sorted(suffixes)


def test_removal_with_clashing_columns_and_periodic_texts(spark, awkward):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()] + [(20, "ab" * 3000), (21, "abc" * 1000 + "x"), (22, "y" * 5000)]
    frame = awkward.unionByName(spark.createDataFrame(docs[-3:], "doc_id long, text string"), allowMissingColumns=True)
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(frame).collect()), key=str) == brute_removal(docs, 400)


def test_scores_base_exactly(spark):
    docs = [(i, "the cat sat on the mat " * (i % 5) + f"word{i % 11}") for i in range(60)] + [(60, None), (61, ""), (None, "The CAT"), (5, "the end"), (5, "the end")]
    got = [tuple(r) for r in gru_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()
    for i, t in docs:
        if not held(i):
            count.update([*split(t), "end"])
    total = sum(count.values())
    want = []
    for i, t in docs:
        w = [*split(t), "end"]
        want.append((i, held(i), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + len(count) + 1)) for x in w), 6)))
    assert sorted(((*g[:5], round(g[5], 6)) for g in got), key=str) == sorted(want, key=str)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    m = gru_lm.Model(rng.normal(0, 0.3, gru_lm.Model.size()))
    given, goal = (rng.integers(0, gru_lm.LISTED + gru_lm.TAILS, (3, 5)) for _ in range(2))
    mask = np.ones((3, 5), bool)
    mask[1, 3:] = False

    def loss(flat):
        p, h, total = gru_lm.Model(flat), np.zeros((3, gru_lm.STATE)), 0.0
        x = p.E[given] @ p.Wx + p.b
        for t in range(5):
            h = np.where(mask[:, t, None], p.step(x[:, t], h)[0], h)
            total -= (p.log_probs(h, goal[:, t]) * mask[:, t]).sum()
        return total / mask.sum()

    g, _ = gru_lm.gradient(m, given, goal, mask, np.zeros((3, gru_lm.STATE)))
    for i in rng.choice(np.flatnonzero(g), 25):
        up, down = m.flat.copy(), m.flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(g[i], abs=1e-6)


def test_model_is_a_distribution():
    m = gru_lm.Model.start(np.arange(1, gru_lm.LISTED + 1.0), np.ones(gru_lm.TAILS))
    h = np.zeros((gru_lm.LISTED + gru_lm.TAILS, gru_lm.STATE), np.float32)
    assert np.exp(m.log_probs(h, np.arange(len(h)))).sum() == pytest.approx(1, abs=1e-4)


def test_held_out_texts_teach_nothing(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    docs = [(i, "the cat sat on the mat " * (i % 5) + f"word{i % 11}") for i in range(60) if i not in held] + [(held[0], "the unseen cat sings")]
    score = lambda rows: {r["doc_id"]: r["score"] for r in gru_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    a, b = score(docs + [(held[1], "mat")]), score(docs + [(held[1], " ".join(f"sings{i}s" for i in range(500)))])
    a.pop(held[1]), b.pop(held[1])
    assert a == pytest.approx(b, rel=1e-6)


def test_scores_carry_the_state_through_all_windows():
    rng = np.random.default_rng(8)
    m = gru_lm.Model(rng.normal(0, 0.3, gru_lm.Model.size()).astype(np.float32))
    sizes = np.array([0, 1, 150, 63, 64, 65], np.int64)
    codes = rng.integers(1, gru_lm.LISTED + gru_lm.TAILS, sizes.sum())
    first = np.concatenate([[0], np.cumsum(sizes)])
    want = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        h, before, total = np.zeros(gru_lm.STATE), 0, 0.0
        for goal in [*codes[a:z], 0]:
            x = m.E[before] @ m.Wx + m.b
            n = gru_lm.STATE
            u = h @ m.U
            zed, r = 1 / (1 + np.exp(-(x[:n] + u[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + u[n : 2 * n])))
            c = np.tanh(x[2 * n :] + r * u[2 * n :])
            h = zed * h + (1 - zed) * c
            logits = h @ m.Wc + m.bc
            kind = goal // gru_lm.PER if goal < gru_lm.LISTED else goal - gru_lm.LISTED + gru_lm.CLASSES
            total += logits[kind] - math.log(np.exp(logits).sum())
            if goal < gru_lm.LISTED:
                inner = h @ m.Ww[kind] + m.bw[kind]
                total += inner[goal % gru_lm.PER] - math.log(np.exp(inner).sum())
            before = goal
        want.append(total)
    assert gru_lm._model_scores(m, codes, sizes, first, rows=4, window=16) == pytest.approx(want, rel=1e-3)


def test_scores_on_awkward_rows(spark, awkward, nothing):
    got = gru_lm.score_documents(awkward).collect()
    assert len(got) == 13 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert max(r["n_tokens"] for r in got) == 30001
    assert gru_lm.score_documents(nothing).count() == 0


def test_rounds_train_on_each_run_once(monkeypatch):
    rng = np.random.default_rng(3)
    sizes, held = np.array([0, 5, 63, 64, 65, 700, 31, 1000], "<i4"), np.array([0, 0, 0, 0, 0, 0, 1, 1], np.uint8)
    tokens = rng.integers(1, gru_lm.LISTED, sizes.sum())
    seen = Counter()

    def gradient(m, given, target, mask, h):
        seen.update(target[mask].tolist())
        return np.zeros_like(m.flat), h

    monkeypatch.setattr(gru_lm, "gradient", gradient)
    m = gru_lm.Model(np.zeros(gru_lm.Model.size(), np.float32))
    n = sum(gru_lm._train_shard(m, np.ones_like(m.flat), tokens, sizes, held, turn) for turn in range(gru_lm.ROUNDS))
    assert n == (sizes[held == 0] + 1).sum()
    assert seen == Counter([*tokens[: sizes[held == 0].sum()].tolist(), *[0] * (held == 0).sum()])
