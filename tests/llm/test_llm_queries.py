"""Registered queries against their SQL, and the pipeline against its stages by brute force."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from compare import connection, rows

from slicelake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    own = queries.QUERIES[name](spark, SF).toPandas()
    sql = connection(SF).execute(queries.ORACLES[name]).df()
    assert sorted(own.columns) == sorted(sql.columns)
    assert rows(own) == rows(sql)


def test_pipeline(spark):
    import public_tokenizers as P
    import tiktoken
    from test_llm_operators import plain_components, plain_shingles

    from slicelake.llm import bpe, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.written(stage(spark, kept, SF), "test")
        seen.append(kept.toPandas().sort_values("doc_id").reset_index(drop=True))
    first, near, cut, mixed, tokens = seen
    assert list(first.columns) == list(near.columns) == list(cut.columns) == list(mixed.columns) == docs.columns
    scores = queries.QUERIES["op5_quality_classifier"](spark, SF).toPandas()
    assert first["doc_id"].tolist() == sorted(scores.loc[scores["predicted"] == 1, "doc_id"])
    fps = [int.from_bytes(simhash.fingerprint(t.encode(), 5, 3), "big") for t in first["text"]]
    sets = [plain_shingles(t, 5) for t in first["text"]]
    near_ = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= corpus_pipeline.MAX_BITS and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    ids = first["doc_id"].tolist()
    assert near["doc_id"].tolist() == [ids[i] for i, c in enumerate(plain_components(len(fps), lambda i, j: (max(i, j), min(i, j)) in near_)) if i == c]
    windows: dict[bytes, int] = {}
    for i, t, own in zip(near["doc_id"], near["text"], cut["text"], strict=True):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if windows.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = True
        at, out = 0, ""
        for ch in t:
            n = len(ch.encode())
            out += "" if gone[at : at + n].all() else ch
            at += n
        assert own == out
    assert (cut["n_chars"] == cut["text"].map(len)).all()
    words = {d: len(t.split()) for d, t in zip(cut["doc_id"], cut["text"], strict=True)}
    assert sum(words[d] for d in mixed["doc_id"]) <= 0.9 * sum(words.values())
    assert mixed["doc_id"].value_counts().max() <= 2 and set(mixed["doc_id"]) <= set(cut["doc_id"])
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((int(d), hashlib.sha256(",".join(map(str, plain.encode_ordinary(t))).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in zip(mixed["doc_id"], mixed["text"], strict=True))
    assert sorted(zip(tokens["doc_id"].tolist(), tokens["ids_sha256"], tokens["decoded_sha256"], strict=True)) == want


def test_near_dedup_finds_pairs_of_similarity_four_fifths(spark):
    """Against the Jaccard similarity of all pairs, without any index: edited texts, around 0.8 on both sides."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.005, 0.08)))):
            other[at] = f"v{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    like = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert sum(0.8 <= x < 0.9 for x in like.values()) >= 10 and sum(0.6 < x < 0.8 for x in like.values()) >= 40
    found = [i + 1 not in kept for i, x in like.items() if x >= 0.8]
    assert len(found) > 40 and sum(found) >= 0.99 * len(found)
    assert all(i in kept for i in like) and all(i + 1 in kept for i, x in like.items() if x < 0.8)


def test_stages_on_rows_without_ids_repeated_rows_and_nothing(spark, hard, empty):
    from collections import Counter

    of = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    every = of(hard)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, hard, SF)
        assert stage(spark, empty, SF).count() == 0
        if name == "byte-level BPE encoding and decoding":
            assert Counter((r.doc_id, r.decoded_sha256) for r in got.collect()) == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in hard.collect())
            continue
        rows = of(got)
        assert got.columns == corpus_pipeline.COLUMNS
        if name == "quality classifier":  # equal rows alike
            assert all(n == every[x] for x, n in rows.items()) and rows
        elif name == "SimHash near-dedup":
            assert set(rows.values()) == {1} and {x for x in every if x[0] is None} <= set(rows)
            texts = [t for _, t in rows if t and len(t) > 100]
            assert (0, next(t for i, t in every if i == 0)) in rows and not any(i in (30, 31) for i, _ in rows) and len(texts) > 20
            assert sum(i == 1 for i, _ in rows) == 2  # two texts of one id
        elif name == "suffix-array dedup":
            assert Counter(i for i, _ in rows.elements()) == Counter(r.doc_id for r in hard.collect())
            assert {x for x in rows if x[0] is None} == {(None, t or "") for i, t in every if i is None}
        else:
            assert set(rows) <= set(every) and all(n <= 2 * every[x] for x, n in rows.items())
