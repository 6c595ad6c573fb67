"""Licence notices that have lost the word that tells of licences."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.llm import licences


def test_notices_without_a_telling_word_are_found(spark):
    notice = "is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    plain = [f"The {w} of the house stood open all day, and nobody came by." for w in "door gate window roof wall stair".split()]
    docs = spark.createDataFrame(list(enumerate([*plain, f"Some words.\n{notice}", None])), "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licences.scan(docs).collect()}
    assert got == {i: "MIT" if i == 6 else "" for i in range(8)}


def test_words_are_found_again_in_named_texts_only(spark, monkeypatch):
    """The second look, which confirms, cuts only texts into paragraphs in which something is named."""
    seen = []
    cut = licences.paragraphs
    monkeypatch.setattr(licences, "paragraphs", lambda docs: seen.append(docs.count()) or cut(docs))
    docs = spark.createDataFrame([(i, f"The house number {i} stood open all day.") for i in range(40)] + [(40, "Some words.\nReleased under the MIT License.")], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licences.scan(docs).collect()}
    assert seen == [41, 1] and got == {i: "MIT" if i == 40 else "" for i in range(41)}


def test_wrapped_lines_join_as_without_the_look_ahead(spark):
    plain = licences._WRAP.removeprefix(r"(?=[ \t]*\n)")
    ends = ["", ".", ":", " ", ". ", "\t \t", "!\t", " \n", "\n\n"]
    texts = [f"{'w' * n} {'v' * m}{e}\n{s}{t}" for n in (3, 36, 39, 60) for m in (0, 1, 2) for e in ends for s in ("", " ", "\t ") for t in ("", "x", "\nx")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", licences._WRAP, " ").alias("a"), F.regexp_replace("t", plain, " ").alias("b"), "t").collect()
    assert plain != licences._WRAP and all(r["a"] == r["b"] for r in rows) and any(r["a"] != r["t"] for r in rows)
