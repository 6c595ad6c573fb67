"""Fingerprints against sets of paragraphs and edits in plain loops."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from folium.llm import fingerprints as fp
from folium.llm.queries import QUERIES

from ..conftest import DATA


def pieces(text):
    return {m[0] for m in re.finditer(fp.PARAGRAPH.replace("$", r"\Z"), text or "")}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(docs):
    order = sorted(((d, t or "") for d, t in docs), key=lambda x: -x[0])
    out = {}
    for k, (d, t) in enumerate(order):
        follows = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + follows[:half]
        out[d] = (len(t), hashlib.sha256(edit.encode()).hexdigest(), likeness(pieces(t), pieces(edit)), likeness(pieces(t), pieces(follows)))
    return out


def got(df):
    return {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in df.collect()}


def same_values(found, want):
    assert found.keys() == want.keys()
    for d, row in want.items():
        assert found[d][:2] == row[:2] and found[d][2:] == pytest.approx(row[2:], abs=1e-12), d


@pytest.mark.parametrize("rows", [10**6, 7])
def test_query_equals_brute_force(spark, monkeypatch, rows):
    """All given documents in one run of ids, and in many whose ends meet."""
    monkeypatch.setattr(fp, "ROWS", rows)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op11_fingerprints"](spark, DATA)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "bigint", "string", "string", "string", "double", "double"]
    same_values(got(found), brute(docs))


def test_odd_documents(spark, monkeypatch):
    """Nulls, empty texts, astral characters, gaps between ids, a text of one long line, one of very many lines, equal texts, clashing columns."""
    monkeypatch.setattr(fp, "ROWS", 3)
    rng = random.Random(3)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) + "."
    base = "\n".join(line() for _ in range(40))
    texts = [None, "", "\n\n\n", "👩‍👩 a😀b" * 9, base, base, base.replace("w1", "v1"), " ".join(line() for _ in range(300)), "\n".join(line() for _ in range(6000)), "x", "same\n" * 500, "same"]
    docs = [(k**3 - 100, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(d, t, 1, "z", 0) for d, t in docs], "doc_id long, text string, n_chars int, group string, next int").repartition(3)
    rows = fp.fingerprint_versions(frame)
    same_values(got(rows), brute(docs))
    told = {r["doc_id"]: r for r in rows.collect()}
    ids = [d for d, _ in docs]
    assert told[ids[4]]["fingerprint"] == told[ids[5]]["fingerprint"] != told[ids[6]]["fingerprint"]
    assert len({len(r["fingerprint"].split(",")) for r in told.values()}) == 1
    edits = spark.createDataFrame([(i, brute_edit) for i, brute_edit in edited_texts(docs)], "doc_id long, text string")
    own = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint_versions(edits).collect()}
    assert own == {d: r["edited_fingerprint"] for d, r in told.items()}


def edited_texts(docs):
    order = sorted(((d, t or "") for d, t in docs), key=lambda x: -x[0])
    return [(d, t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]) for k, (d, t) in enumerate(order)]


def test_digests_are_recovered_and_small_blocks_are_tried_again(spark, monkeypatch):
    """Blocks far too small at first: later sizes recover every digest."""
    monkeypatch.setattr(fp, "LOAD", 8.0)
    monkeypatch.setattr(fp, "LEAST", 1)
    rng = random.Random(8)
    words = [f"line {k}" for k in range(400)]
    rows = [(k, "\n".join(rng.sample(words, rng.randint(0, 90))), "\n".join(rng.sample(words, rng.randint(0, 90)))) for k in range(60)]
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    digest = {r["w"]: r["d"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", fp._checked(F.xxhash64("w")).alias("d")).collect()}
    for r in fp.compare(frame, "id", ["a", "b"]).collect():
        a, b = ({digest[w] for w in rows[r["id"]][i].split("\n") if w} for i in (1, 2))
        assert sorted(r["only_first_b"]) == sorted(a - b) and sorted(r["only_b"]) == sorted(b - a) and r["near_b"] == pytest.approx(likeness(a, b))


def test_strings_alone(spark):
    lines = [f"line {k}" for k in range(60)]
    rows = [(0, lines, lines), (1, lines, lines[:-2] + ["new"]), (2, [], []), (3, [], ["one"]), (4, lines[:30], lines[30:])]
    frame = spark.createDataFrame([(k, "\n".join(a), "\n".join(b)) for k, a, b in rows], "id long, a string, b string")
    made = fp.compare(frame, "id", ["a", "b"]).select("id", "near_b", fp.compare_fingerprints(F.col("fingerprint_a"), F.col("fingerprint_b")).alias("c"))
    read = {r["id"]: (r["near_b"], r["c"]) for r in made.collect()}
    assert all(read[k][1]["likeness"] == read[k][0] for k in (0, 1, 2, 3)) and read[4] == (0.0, None)
    assert len(read[1][1]["only_left"]) == 2 and len(read[1][1]["only_right"]) == 1


def test_awkward_rows(spark, awkward, nothing):
    rows = fp.fingerprint_versions(awkward).collect()
    assert len(rows) == 13 and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert fp.fingerprint_versions(nothing).count() == 0
    one = fp.fingerprint_versions(awkward.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_no_python_in_the_plan(spark, monkeypatch):
    monkeypatch.setattr(fp, "TASK_DIGESTS", 500)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lists = docs.select("doc_id", *(fp.paragraphs(F.col("text")).alias(f"_p_{v}") for v in "ab"))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (fp.with_next(docs), fp._attempt(lists, "doc_id", ["a", "b"], 0, False), QUERIES["op11_fingerprints"](spark, DATA))]
    assert not any(word in p for p in plans for word in ("Python", "Arrow"))
    # from the first sum of cells to the last turn nothing is shuffled
    assert plans[0].count("Exchange hashpartitioning") == plans[1].count("Exchange hashpartitioning") == 1
