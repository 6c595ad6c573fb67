"""Alignment of two tokenizers' tokens against whole texts, all pairs of tokens and plain counts."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folium.llm import token_alignment as ta
from folium.llm.queries import QUERIES

from ..conftest import DATA


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer
    import sentencepiece

    a = Tokenizer.from_file(f"{ta.FILES}/{ta.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{ta.FILES}/{ta.PIECE_BPE}")


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts, tokenizers):
    """Rows of the contract: whole texts, every pair of tokens compared."""
    a, b = tokenizers
    # the characters of a byte-level vocabulary, from its decoder
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    rows, corpus = [], Counter()
    for doc, text in texts:
        want = f" {text}".encode() if text else b""
        ia = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        pa = [bytes(code[c] for c in a.id_to_token(i)) for i in ia]
        pb = []
        for i in ib:
            p = b.id_to_piece(i)
            pb.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(pa) != want or b"".join(pb) != want:
            ia, ib, pa, pb = [], [], [], []
        sa, sb = spans(pa), spans(pb)
        linked = [(ia[i], ib[j]) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if x < v and u < y]
        cuts = sorted({y for _, y in sa} & {y for _, y in sb})
        groups, at = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, (x, y) in zip(ia, sa) if at <= x and y <= c) + "|" + ",".join(str(i) for i, (x, y) in zip(ib, sb) if at <= x and y <= c))
            at = c
        corpus.update(linked)
        rows.append((doc, len(ia), len(ib), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, y), n in corpus.items():
        most[y] = max(most[y], n)
    return sorted(((d, na, nb, g, len(l), sum(corpus[p] == most[p[1]] for p in l), sum(corpus[p] for p in l), s) for d, na, nb, g, l, s in rows), key=repr), corpus, most


ODD = [
    "", None, " ", "  ", "a", "foo  \n\n bar\n", "foo \n  bar", "it's we'll <|endoftext|> <s> </s> <0x41> <unk>", "tab\tand nbsp 　wide line", "x▁y", "日本語のテキスト 中文 text", "éä ﬁ ½ Ⅻ", "👩‍👩‍👧 👍🏽", "\x00nul \x1fsep\x1c x", "a" * 3000, "1234567890 " * 50,
    "   lead", "trail   ", "\n \n \n", "don 't 's  's", "﻿bom ​zero",
]


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=repr)


def test_odd_texts_equal_brute_force(spark, tokenizers):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(5, ODD[5]), (None, "it's")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n_a int, shard string").repartition(3)
    want, corpus, most = brute(texts, tokenizers)
    found, pairs = ta.align(docs)
    assert got(found) == want
    assert {(r["id_a"], r["id_b"]): (r["count"], r["best"]) for r in pairs.collect()} == {p: (n, n == most[p[1]]) for p, n in corpus.items()}
    whole = {r["doc_id"]: r["groups"] for r in ta.token_groups(docs).filter("doc_id is not null").collect()}
    for row in want:
        if row[0] is not None:
            text = ";".join(f"{','.join(map(str, g['a']))}|{','.join(map(str, g['b']))}" for g in whole[row[0]])
            assert (hashlib.sha256(text.encode()).hexdigest() if text else "") == row[-1]


def test_given_documents_equal_brute_force(spark, tokenizers):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter(F.length("text") < 1500)
    want, _, _ = brute([tuple(r) for r in docs.collect()], tokenizers)
    assert got(ta.align_documents(docs)) == want


def test_chunks_are_the_whole_text(tokenizers):
    from pathlib import Path

    t = ta.Tokenizers(Path(f"{ta.FILES}/{ta.BYTE_BPE}").read_bytes(), Path(f"{ta.FILES}/{ta.PIECE_BPE}").read_bytes())
    assert t.chunked
    for text in ODD:
        if text:
            assert "".join(f" {c}" for c in t.cut(text)) == f" {text}"


def test_query_and_awkward_rows(spark, awkward, nothing):
    assert QUERIES["op13_token_alignment"](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert ta.align_documents(awkward).count() == 13
    assert ta.align_documents(nothing).count() == 0
