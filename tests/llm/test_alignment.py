"""op11 against brute force on whole tokenizations."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tarazu.llm import alignment, queries
from tarazu.llm.packing import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = {chr(c): b for b, c in byte_letters().items()}
    with open(A, encoding="utf-8") as f:
        names = {i: w for w, i in json.load(f)["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    of_a = lambda i: bytes(letters[c] for c in names[i])
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: a.encode(" " + t, add_special_tokens=False).ids, b.encode, of_a, of_b


def brute(texts, vocabularies):
    encode_a, encode_b, of_a, of_b = vocabularies
    docs = []
    for t in texts:
        ia, ib = (encode_a(t), encode_b(t)) if t else ([], [])
        if t and not b"".join(map(of_a, ia)) == b"".join(map(of_b, ib)) == (" " + t).encode():
            ia, ib = [], []
        ea, eb = np.cumsum([0, *(len(of_a(i)) for i in ia)]).tolist(), np.cumsum([0, *(len(of_b(i)) for i in ib)]).tolist()
        links = Counter((x, y) for k, x in enumerate(ia) for m, y in enumerate(ib) if ea[k] < eb[m + 1] and eb[m] < ea[k + 1]) if len(ia) < 3000 else None
        groups, i, j = [], 0, 0
        for cut in sorted(set(ea[1:]) & set(eb[1:])):
            x, y = ea.index(cut), eb.index(cut)
            groups.append(",".join(map(str, ia[i:x])) + "|" + ",".join(map(str, ib[j:y])))
            i, j = x, y
        docs.append((len(ia), len(ib), groups, links))
    counts, documents = Counter(), Counter()
    for *_, links in docs:
        counts.update(links)
        documents.update(links.keys())
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for na, nb, groups, links in docs:
        best = sum(n for (x, y), n in links.items() if counts[x, y] == top[y])
        out.append((na, nb, len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if na else ""))
    return out, counts, documents, top


def rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


EDGES = [None, "", " ", "  two  spaces\t and\n\nlines ", "one", "▁ lost", "the <|endoftext|> <s> </s> <unk> [INST] plain", "x\x00y \x1c z", "日本語 é ünïcödé İ 𝔘𝔫𝔦 👩‍👩‍👧 á ́b", "don't it's 'tis a'll 12345 67,89", " nbsp wide 　x", "same text", "same text", "same text", "w " * 400, "ends with space ", " starts", "<0x41> <0x0A>", "﻿bom �"]


def test_alignment_edges(spark, vocabularies):
    df = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(EDGES)], "doc_id long, text string, of string, rows string")
    want, counts, documents, top = brute(EDGES, vocabularies)
    found, pairs = alignment.align(df.repartition(3), A, B)
    assert rows(found) == want
    got = {(r.a, r.b): (r.docs, r.links, r.best) for r in pairs.collect()}
    assert got == {p: (documents[p], n, n == top[p[1]]) for p, n in counts.items()}


def test_alignment_table(spark, sf, vocabularies):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    short = [d.text if d.text is None or len(d.text) < 4000 else None for d in docs]
    want = brute(short, vocabularies)[0]
    got = rows(alignment.align(spark.createDataFrame([(d.doc_id, t) for d, t in zip(docs, short)], "doc_id long, text string"), A, B)[0])
    assert got == want
    whole = queries.op11_pair_bitmaps(spark, sf)
    assert whole.count() == len(docs) and whole.where((F.col("n_best") > F.col("n_links")) | (F.col("n_links") < F.greatest("n_a", "n_b"))).count() == 0


def test_alignment_blocks(spark, vocabularies, monkeypatch):
    """Many small blocks, and bitmaps of both kinds, give what one block gives."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["tion", "the", "anea", "Überer", "x1", "été,"], int(rng.integers(0, 60)))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts, vocabularies)[0]
    assert rows(alignment.align(df.coalesce(1), A, B)[0]) == want
    keys, docs = rng.integers(0, 20, 3000), rng.integers(0, 500, 3000)
    once = sorted(set(zip(keys.tolist(), docs.tolist())))
    times = rng.integers(1, 40, len(once))
    k, d = (np.array(x) for x in zip(*once))
    held = alignment.planes(k, d, times, 500)
    assert held["dense"].any() and not held["dense"].all()
    pair, n, links = alignment.popcounts(held, 500)
    assert [(p, int((k == p).sum()), int(times[k == p].sum())) for p in range(20)] == list(zip(pair.tolist(), n.tolist(), links.tolist()))


def test_cut_texts_have_the_tokens_of_whole_ones(vocabularies):
    encode_a, encode_b, of_a, of_b = vocabularies
    aligner, rng = alignment.Aligner(A, B), np.random.default_rng(5)
    alphabet = list("ab'sAé1 9\t\n.,-<>|日 ́") + [" ", " ", "  ", "'ll", "　"]
    for _ in range(1500):
        t = "".join(rng.choice(alphabet, int(rng.integers(1, 40))))
        chunks = aligner.chunks([t])[0]
        groups = b";".join(c[3] for c in chunks).decode().split(";")
        assert [int(i) for g in groups for i in g.split("|")[0].split(",")] == encode_a(t), repr(t)
        assert [int(i) for g in groups for i in g.split("|")[1].split(",")] == encode_b(t), repr(t)


def test_alignment_empty(spark):
    found, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert found.count() == 0 and pairs.count() == 0
