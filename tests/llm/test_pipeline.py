"""The pipeline's stages one after the other against brute force, each judged on its own input."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarazu.llm import queries, simhash
from tests.llm.test_llm_operators import WORD, edge_docs, jaccard, least_reachable, shingles_of, slow_lines, slow_targets


OWN = {"score": 0.123, "held_out": "own", "lang_pred": "own", "n_lines": 9, "n_dropped": 8, "size": 1, "copies": 9, "k": 7, "n": 6, "of": "own", "gone": False, "found": "own", "__k": 5, "__n": 4, "__may": True, "own_0_doc_id": 3}


def row(r):
    return (str(r.doc_id), r.text, r.lang, r.source)


@pytest.mark.parametrize("edges", [False, True])
def test_stages(spark, sf, edges, tmp_path):
    from tokenizers import Tokenizer

    docs = edge_docs(spark).withColumns({c: F.lit(v) for c, v in OWN.items()}) if edges else spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    made = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, made[-1], sf).write.parquet(str(tmp_path / str(k)))
        made.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == len(corpus_pipeline.STAGES) - 1 or made[-1].columns == columns
        assert not edges or k == len(corpus_pipeline.STAGES) - 1 or {tuple(r) for r in made[-1].select(*OWN).collect()} == {tuple(OWN.values())}
    before, lang, lines, single, mixed, packed = (m.collect() for m in made)

    gone = collections.Counter(map(row, before)) - collections.Counter(map(row, lang))
    lettered = lambda t: any(c.isalpha() for c in t or "")
    assert not collections.Counter(map(row, lang)) - collections.Counter(map(row, before))
    assert all(lettered(r.text) for r in lang) and (edges or all(not lettered(t) or len(t) < 40 for _, t, *_ in gone))

    assert collections.Counter((str(r.doc_id), r.text) for r in lines) == collections.Counter(slow_lines(lang)[0])
    assert all(r.n_chars == len(r.text) for r in lines)

    sets = [shingles_of(r.text) for r in lines]
    links = np.array([[jaccard(a, b) >= 0.8 for b in sets] for a in sets])
    groups = collections.defaultdict(list)
    for k, g in enumerate(least_reachable(list(range(len(lines))), links)):
        groups[g].append(lines[k])
    key = lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest())
    assert collections.Counter(map(row, single)) == collections.Counter(row(min(g, key=key)) for g in groups.values())

    sizes, copies = collections.Counter(), collections.Counter(map(row, mixed))
    for r in single:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    took, biggest = collections.Counter(), collections.Counter()
    for r in single:
        n = len(WORD.findall(r.text or ""))
        assert 0 <= copies[row(r)] <= 2
        took[r.source] += copies[row(r)] * n
        biggest[r.source] = max(biggest[r.source], n)
    assert set(copies) <= set(map(row, single))
    assert all(abs(took[s] - t) <= biggest[s] / 2 + 1 for s, t in slow_targets(sizes).items())

    tk, want = Tokenizer.from_file(queries.tokenizer_path()), collections.Counter()
    for r in mixed:
        ids = [*tk.encode(r.text or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            want[(r.doc_id, at, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in packed) == want


def test_near_copies_are_told_apart_by_row(spark, sf):
    """Null and repeated ids beside a near copy: only the copies go."""
    t, u, v, w, x, y, z = (" ".join(f"{a}{k}" for k in range(40)) for a in "tuvwxyz")
    rows = [(1, t), (None, t.upper()), (None, u), (None, u), (5, v), (5, w), (2, w.upper()), (6, x), (6, y), (6, y), (None, z), (None, z.upper())]
    d = spark.createDataFrame([(i, text, "en", "a") for i, text in rows], "doc_id long, text string, lang string, source string")
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, d, sf).collect())
    last = min((z, z.upper()), key=lambda s: hashlib.md5(s.encode()).hexdigest())
    assert got == collections.Counter([(1, t), (None, u), (5, v), (2, w.upper()), (6, x), (6, y), (None, last)])


def test_groups_at_the_threshold_and_reruns(spark):
    """Texts with two or three changed words in 200, most pairs right around 0.8: of the rows that exact links remove at least 0.97 go, none wrongly, and neither ids' order nor tasks change the result."""
    rng, rows = np.random.default_rng(11), []
    for _ in range(24):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for _ in range(20):
            words = list(base)
            for k in rng.choice(200, int(rng.integers(2, 4)), replace=False):
                words[k] = f"n{rng.integers(10**9)}"
            rows.append(" ".join(words))
    sets = [shingles_of(t) for t in rows]
    links = np.array([[abs(a - b) < 20 and jaccard(sets[a], sets[b]) >= 0.8 for b in range(len(sets))] for a in range(len(sets))])
    whole = least_reachable(list(range(len(rows))), links)
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    one, two = ({r.doc_id: r.component_id for r in simhash.similar_groups(x).collect()} for x in (d.repartition(7), d.orderBy(F.desc("doc_id")).coalesce(2)))
    assert one == two and all(whole[c] == whole[i] for i, c in one.items())
    assert len(rows) - len(set(one.values())) >= 0.97 * (len(rows) - len(set(whole)))


def test_no_found_pair_is_left_out(spark):
    """Groups are exactly those of the links among all pairs that share a shard and lie within the radius, whatever pairs below the similarity lie closer."""
    rng, rows = np.random.default_rng(5), []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(40):
            words = list(base)
            for k in rng.choice(120, int(rng.integers(1, 4)), replace=False):
                words[k] = f"n{rng.integers(10**9)}"
            rows.append(" ".join(words))
    sets = [simhash.shingle_set(t.encode()) for t in rows]
    codes = [simhash.wide_fingerprint(s) for s in sets]
    bits, tables, radius = simhash.shard_plan(len(rows), 0.8, 32, 0.97)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(codes, pa.binary())], ["uid", "code"])
    keys = next(iter(simhash.shards_map(bits, tables)([batch]))).column("key").to_numpy().reshape(len(rows), tables)
    near = lambda a, b: (keys[a] == keys[b]).any() and (int.from_bytes(codes[a]) ^ int.from_bytes(codes[b])).bit_count() <= radius
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    similar = lambda a, b: (n := both(a, b)) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)
    pairs = {(a, b): similar(a, b) for a in range(len(rows)) for b in range(a) if near(a, b)}
    links = np.zeros((len(rows), len(rows)), bool)
    for (a, b), linked in pairs.items():
        links[a, b] = links[b, a] = linked
    assert sum(pairs.values()) > 500 < len(pairs) - sum(pairs.values())
    odd = [int.from_bytes(simhash.parity_sketch(s)) for s in sets]
    assert all((odd[a] ^ odd[b]).bit_count() <= len(np.setxor1d(sets[a], sets[b])) for a, b in pairs)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), block=24).collect()}
    assert got == dict(enumerate(least_reachable(list(range(len(rows))), links)))


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns and corpus_pipeline.ORACLE_SQL is None
