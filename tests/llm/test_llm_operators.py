"""Operators against brute force on a small table of odd texts."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from slicelake.llm import bpe, quality, sampling, simhash, suffixes, token_files
from slicelake.llm.language import RUN, Model, fit, languages, letters
from slicelake.llm.mixing import domain_of_source, mix, mixed_documents, target_weights
from slicelake.llm.quality import isotonic, quality_scores
from slicelake.llm.search import top_k
from slicelake.llm.spans import sentence_spans


def table(df):
    return df.toPandas().sort_values("doc_id").reset_index(drop=True)


def plain_fingerprint(text: str, n: int = 4) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(n: int, linked) -> list[int]:
    """The least place that each of n places reaches over links (i, j)."""
    label, near = list(range(n)), [[j for j in range(n) if i == j or linked(i, j)] for i in range(n)]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(n)]
        if new == label:
            return label
        label = new


def plain_shingles(text: str, n: int) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("block", [1024, 2])
def test_simhash(docs, texts, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    got = table(simhash.simhash_groups(docs))
    fps = [plain_fingerprint(t or "") for _, t in texts]
    assert got["fingerprint"].tolist() == [f"{f:016x}" for f in fps]
    assert got["component_id"].tolist() == plain_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)


def test_links_in_lists_longer_than_a_block(spark, monkeypatch):
    """Several far groups share four bytes, so that most of a list is not near its hub; and bits drift along a chain."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(4)
    fps = []
    for centre in rng.integers(0, 1 << 32, 6):
        x = int(centre)
        for _ in range(25):
            x ^= 1 << int(rng.integers(32))
            fps.append(0xABCD_0123 << 32 | x)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(i, f) for i, f in zip(signed, signed, strict=True)], "id long, f0 long")
    got = simhash.connected_components(simhash.links(simhash.byte_postings(rows, ["f0"], 4), ["f0"], 4, 4))
    label = {r.node: r.component for r in got.collect()}
    want = plain_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    groups = {}
    for f, w in zip(signed, want, strict=True):
        groups.setdefault(w, []).append(f)
    assert label == {f: min(g) for g in groups.values() if len(g) > 1 for f in g}


def test_simhash_of_repeated_rows_null_ids_and_nothing(spark, docs, empty):
    twice = docs.union(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    for wide in ({}, {"shingle": 5, "words": 3, "max_bits": 37, "match": 4, "least": "0.8"}):
        got = simhash.simhash_groups(twice, **wide)
        assert got.count() == docs.count() + 4
        assert got.where("doc_id is null").first().component_id == 0
        assert simhash.simhash_groups(empty, **wide).count() == 0
    with pytest.raises(ValueError, match="positional"):
        simhash.simhash_groups(docs, max_bits=8)


@pytest.mark.parametrize("block", [1024, 2])
def test_wide_fingerprints_join_exactly_what_is_similar(spark, docs, texts, block, monkeypatch):
    """Components by the Jaccard similarity of all pairs; with cells of two texts, all ways that large groups take."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash.jaccard, "CELL_TEXTS", block)
    rng, words = random.Random(9), [f"w{i}" for i in range(120)]
    more = [(1000, "sed ut perspiciatis unde omnis " * 50_000)]
    for i in range(40):  # a large group about one text, whose members are often less similar to one another
        own = list(words)
        for at in rng.sample(range(120), rng.randint(0, 4)):
            own[at] = f"v{i}.{at}"
        more.append((2000 + i, " ".join(own)))
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = table(simhash.simhash_groups(docs, shingle=5, words=3, match=4, max_bits=48, least="0.8"))
    sets = [plain_shingles(t, 5) for _, t in [*texts, *more]]
    place = {int(d): i for i, d in enumerate(got["doc_id"])}
    own = [place[int(c)] for c in got["component_id"]]
    want = plain_components(len(sets), lambda i, j: not sets[i] and not sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    assert own == want and 30 < len(set(want)) < len(sets)


def test_similar():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.choice(60, rng.integers(0, 60), replace=False)).astype("u8") for _ in range(30)]
    plain = np.array([[len(set(a) & set(b)) for b in map(np.ndarray.tolist, sets)] for a in map(np.ndarray.tolist, sets)])
    assert (simhash.jaccard.common(sets) == plain).all() and (simhash.jaccard.common(sets[:2]) == plain[:2, :2]).all()


def plain_removed(texts, n=50):
    seen, out = {}, []
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, "i1")
        for p in range(len(b) - n + 1):
            if seen.setdefault(b[p : p + n], i) < i:
                gone[p : p + n] = 1
        d = np.diff(np.r_[0, gone[:-1], 0])
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((d == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("step", "parts", "hot"), [(1 << 17, 1 << 23, 4096), (120, 4000, 4096), (120, 4000, 2), (1 << 17, 2000, 4)])
def test_suffixes(docs, texts, step, parts, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "STEP", step)
    monkeypatch.setattr(suffixes, "CHUNK", parts)
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = table(suffixes.digest(docs))
    assert [tuple(r) for r in got.itertuples(index=False)] == plain_removed(texts)


def test_suffixes_edges(docs, empty):
    assert suffixes.digest(empty).count() == 0
    same = docs.where("doc_id = 0")
    twice = table(suffixes.digest(same.union(same)))
    assert twice["n_removed"].tolist() == [0, 0]
    nameless = suffixes.digest(same.unionByName(same.withColumn("doc_id", F.lit(None).cast("long"))))
    assert sorted(r.n_removed for r in nameless.collect()) == [0, 0]


def test_kept_text_has_whole_characters(spark):
    shared = "é" * 40
    df = spark.createDataFrame([(1, "x" + shared), (2, "yy" + shared + "z")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffixes.kept_text(df).collect()} == {1: "x" + shared, 2: "yyz"}


def test_bpe(docs, texts, empty):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = table(bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks))
    for (_, t), ids, decoded in zip(texts, got["ids"], got["decoded"], strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(t or "")
        assert decoded.decode() == (t or "")
    assert bpe.encode(empty, ranks, P.PATTERN).count() == 0
    few = table(bpe.digest(docs.where("doc_id in (1, 38)"), ranks, P.PATTERN))
    assert few["ids_sha256"].iloc[0] == hashlib.sha256(",".join(map(str, plain.encode_ordinary(texts[1][1]))).encode()).hexdigest()
    assert few["n_tokens"].iloc[1] == 0


@pytest.mark.parametrize("text", ["a  b\n c", " lead", "x\t\ty", "it's, don't!s", "ab,cd 's", "é.è;", "1,000.5%", "a b  c", "\x1c\x1d x", "end \n", "A_b-c d's've", "ǆ,ß!"])
def test_words_are_cut_where_no_match_goes_on(text):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = bpe.WORD.findall(text)
    assert "".join(words) == text
    assert [i for w in words for i in plain.encode_ordinary(w)] == plain.encode_ordinary(text)


def plain_signature(text: str) -> list:
    """The samples term by term: the formulas of consistent weighted sampling over the counted pairs of words."""
    words = [xxhash.xxh64_intdigest(w) for w in text.split()]
    mix = lambda x: int(sampling._mix(np.array([x & (1 << 64) - 1], "u8"))[0])
    terms = [mix(a * 0x9E3779B97F4A7C15 + b) for a, b in zip(words, words[1:], strict=False)] if len(words) > 1 else words
    gamma, _, uniform, salts = sampling._quantiles()
    out = []
    for salt in salts.tolist():
        best = None
        for term in sorted(set(terms)):
            h = mix(term ^ salt)
            r, c, b = (np.float32(q[h >> shift & 65535]) for q, shift in ((gamma, 0), (gamma, 16), (uniform, 32)))
            t = np.floor(np.log(terms.count(term)).astype("f4") / r + b)
            a = np.log(c.astype("f8")) - r * (t - b + 1)
            if best is None or a < best[0] - 1e-5:
                best = a, term, int(t)
        out.append(best and best[1:])
    return out


def test_samples_are_those_of_the_formulas(texts):
    raw = [t or "" for _, t in texts if len(t or "") < 400]
    plain = [plain_signature(t) for t in raw]
    own = [sampling.signature(t) for t in raw]
    for i in range(len(raw)):
        for j in range(i):
            want = np.mean([x == y for x, y in zip(plain[i], plain[j], strict=True)])
            assert abs(sampling.likeness(own[i], own[j]) - want) <= 1 / 64


def test_sampling(docs, texts, empty):
    got = table(sampling.edited_fingerprints(docs))
    raw = [t or "" for _, t in texts]
    for i, (t, after) in enumerate(zip(raw, raw[1:] + raw[:1], strict=True)):
        q = len(t) // 4
        edit = t[: len(t) - q] + after[:q]
        row = got.iloc[i]
        assert (row.n_chars, row.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        own, other = sampling.signature(t), sampling.signature(edit)
        assert (row.fingerprint, row.edited_fingerprint) == (own.tobytes().hex(), other.tobytes().hex())
        assert row.near_edited == sampling.likeness(own, other)
        assert row.near_next == sampling.likeness(own, sampling.signature(after))
    assert got.loc[0, "fingerprint"] == got.loc[30, "fingerprint"]
    assert sampling.edited_fingerprints(empty).count() == 0
    one = sampling.edited_fingerprints(docs.where("doc_id = 7")).first()
    assert one.near_next == 1


@pytest.mark.parametrize("block", [8192, 5])
def test_terms_shared_by_texts_and_edits_are_drawn_once(texts, block, monkeypatch):
    """Drawing is the work: what a text, its edit and their neighbours share isn't drawn for each, and the samples are those of each text alone."""
    raw = [t or "" for _, t in texts if len(t or "") < 2000]
    pairs = [(i, t, after) for i, (t, after) in enumerate(zip(raw, raw[1:] + raw[:1], strict=True))]
    edits = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for _, t, after in pairs]
    want = [(sampling.signature(t).tobytes(), sampling.signature(edit).tobytes()) for (_, t, _), edit in zip(pairs, edits, strict=True)]
    drawn, draws = [], sampling.draws
    monkeypatch.setattr(sampling, "draws", lambda terms: drawn.append(len(terms)) or draws(terms))
    monkeypatch.setattr(sampling, "BLOCK", block)
    got = sampling._rows(pairs)
    assert [row[3:5] for row, _ in got] == want

    def counted(text: str) -> Counter:
        words = text.split()
        return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter(words)

    assert sum(drawn) < 0.7 * sum(len(counted(t)) for t in [*raw, *edits])


def test_samples_collide_as_generalised_jaccard():
    """Over a vocabulary of far more terms than any table of draws would have rows."""
    rng = np.random.default_rng(1)
    off = []
    for k in range(60):
        words = [f"w{k}-{x}" for x in rng.zipf(1.2, 3000)]
        other = words[:2000] + [f"v{k}-{x}" for x in rng.zipf(1.2, 1000)]
        bags = [{}, {}]
        for bag, ws in zip(bags, (words, other), strict=True):
            for p in zip(ws, ws[1:], strict=False):
                bag[p] = bag.get(p, 0) + 1
        keys = bags[0].keys() | bags[1].keys()
        true = sum(min(bags[0].get(k, 0), bags[1].get(k, 0)) for k in keys) / sum(max(bags[0].get(k, 0), bags[1].get(k, 0)) for k in keys)
        off.append(sampling.likeness(*(sampling.signature(" ".join(w)) for w in (words, other))) - true)
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.09


def test_token_files(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), "rb") as f:
        model = f.read()
    plain = Tokenizer.from_buffer(model)
    texts = [*texts, (100, "hello <|endoftext|> world"), (101, "x<|startoftext|>y<|endoftext|><|endoftext|>"), (102, "a<|ENDOFTEXT|>b <|end"), (103, "lorem ipsum " * 60_000)]
    docs = docs.unionByName(spark.createDataFrame(texts[-4:], "doc_id long, text string"), allowMissingColumns=True)
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(docs, model, path, files=5)
    got = table(token_files.token_digest(spark, path))
    start = 0
    for (i, t), row in zip(texts, got.itertuples(), strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in token_files.read_token_files(spark, path).where("doc_id = 5").collect()] == [5]
    assert token_files.op10_rows(empty, model).count() == 0
    again = docs.where("doc_id in (1, 5)").unionByName(docs.where("doc_id in (5, 38)")).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    rows = sorted(token_files.op10_rows(again, model).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 5, 5, 38] and rows[2].ids_crc32 == rows[3].ids_crc32 and rows[4].n_tokens == 1
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]


@pytest.mark.parametrize("memory", [450_000, 40])
def test_words_are_cut_once_and_recurring_pieces_kept(texts, memory, monkeypatch):
    """Cutting, looking up and learning are the work: a batch does it for its distinct words, and a full memory keeps what recurs."""
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        coder = token_files._Coder(f.read())
    rng = random.Random(7)
    marks = ["a", "Bé", "don't", " ", "\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u3000", "12:30", "<|endoftext|>", "<|END", "-", "İ", "e\u0301", "東京", "🙂", "\x00"]
    raw = [t or "" for _, t in texts] + ["".join(rng.choice(marks) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    looked, learned, numbers, learn = [], [], coder._numbers, coder.learn
    monkeypatch.setattr(coder, "_numbers", lambda flat: looked.append(len(flat)) or numbers(flat))
    monkeypatch.setattr(coder, "learn", lambda pieces: learned.extend(pieces) or learn(pieces))
    monkeypatch.setattr(token_files, "MEMORY", memory)
    for _ in range(3):
        ids, size = coder.encode(pa.array(["not read", *raw]).slice(1))
        for t, own in zip(raw, np.split(ids, np.cumsum(size)[:-1]), strict=True):
            assert own.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert max(looked) < sum(len(t.split()) for t in raw) / 2
    assert memory == 40 or len(learned) == len(set(learned))
    # frequent words in every batch, others in one
    learned.clear()
    coder.number, coder.ids, coder.size, coder.uses = {}, [np.empty(0, "i4")], [np.empty(0, "i8")], np.empty(0, "i4")
    coder._join()
    for i in range(9):
        coder.encode(pa.array([f"the river ran {' '.join(rng.choice('bcdfgh') + 'x' * i + rng.choice('klmnop') for _ in range(20))}"]))
    assert Counter(learned)["river"] == 1


def test_token_files_are_ordered_by_number(spark, docs, tmp_path):
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        model = f.read()
    path = f"{tmp_path}/ids"
    token_files.write_token_files(docs.where("doc_id < 9"), model, f"file://{path}", files=3)
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    for n, number in zip(names, ("99998", "99999", "100000"), strict=False):
        os.rename(f"{path}/{n}", f"{path}/part-{number}{n[10:]}")
        if os.path.exists(f"{path}/.{n}.crc"):
            os.rename(f"{path}/.{n}.crc", f"{path}/.part-{number}{n[10:]}.crc")
    got = table(token_files.token_digest(spark, f"file://{path}"))
    assert len(names) > 1 and got["start"].tolist() == [0, *np.cumsum(got["n_tokens"])[:-1]]


def test_language_of_held_out_rows(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.95
    odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "123 !", "en"), (10**6 + 2, "", "fr")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in languages(docs.select("doc_id", "text", "lang").union(odd)).where("doc_id >= 1000000").collect()} == {"und"}
    assert languages(empty).count() == 0
    assert {r.lang_pred for r in languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_languages(rows: list[tuple], n_words: int, n_grams: int) -> list[tuple[str, float]]:
    """Predictions for the texts of (learned, lang, text) by plain counters."""
    words: dict[str, Counter] = {}
    find = lambda t: re.findall(r"[a-zà-ÿœ]+", (t or "").lower())  # noqa: E731  letters of these texts
    for learned, lang, text in rows:
        if learned:
            words.setdefault(lang, Counter()).update(find(text))
    grams = [{x: Counter() for x in words} for _ in range(5)]
    for x, c in words.items():
        for w, n in c.items():
            for size in range(1, 5):
                for i in range(len(w) + 3 - size):
                    grams[size][x][f" {w} "[i : i + size]] += n
    langs = sorted(words)

    def scores(counts: dict[str, Counter], most: int) -> dict[str, list[float]]:
        held = {k for c in counts.values() for k, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:most]}
        return {k: [math.log((counts[x][k] + 0.5) / (counts[x].total() + 0.5 * (len(held) + 1))) for x in langs] for k in held}

    known, parts = scores(words, n_words), [None, *(scores(grams[size], n_grams) for size in range(1, 5))]
    out = []
    for _, _, text in rows:
        total = [0.0] * len(langs)
        for w in find(text):
            i, padded, add = 0, f" {w} ", []
            if w in known:
                add, i = [known[w]], len(padded)
            while i < len(padded):
                size = next((k for k in range(4, 0, -1) if i + k <= len(padded) and padded[i : i + k] in parts[k]), 0)
                if size:
                    add.append(parts[size][padded[i : i + size]])
                i += size or 1
            for x in add:
                total = [a + b for a, b in zip(total, x, strict=True)]
        likely = [math.exp(x - max(total)) for x in total]
        out.append((langs[likely.index(1.0)], 1 / sum(likely)) if find(text) else ("und", 0.0))
    return out


@pytest.mark.parametrize(("words", "grams"), [(20_000, 5_000), (60, 40)])
def test_language_against_plain_counters(spark, words, grams):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "regexp_replace(substr(text, 1, 300), '[^ A-Za-z]', ' ') AS text", "lang").where("doc_id < 120")
    got = table(languages(docs, words=words, grams=grams))
    rows = docs.orderBy("doc_id").collect()
    want = plain_languages([(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and r.text is not None, r.lang, r.text) for r in rows], words, grams)
    assert got["lang_pred"].tolist() == [x for x, _ in want]
    assert np.allclose(got["score"], [y for _, y in want], atol=1e-9)


@pytest.mark.parametrize("text", ["½", "²", "①", "Ⅷ", "123", "_", "٣", " . "])
def test_numbers_are_no_letters(text):
    words = lambda t: [w for run in RUN.findall(t) for w in letters(run)]
    assert words(text) == [] and words(f"a{text}é") == ["a", "é"]
    model = Model(["x", "y"], {"a": [-1.0, -2.0], "é": [-3.0, -1.0]}, [{}] * 5)
    assert model.predict(text) == ("und", 0.0)
    assert model.predict(f"a{text}é") == model.predict("a é")


def test_every_language_is_learned(spark):
    common = [(i, ("the house and the river" if i % 2 else "la maison et la rivière") + f" n{i}", "en" if i % 2 else "fr") for i in range(900)]
    rare = [(1000 + i, "dom oraz rzeka oraz dom", "pl") for i in range(8)]
    got = languages(spark.createDataFrame(common + rare, "doc_id long, text string, lang string"), fit_docs=20).where("doc_id >= 1000").collect()
    assert {r.held_out for r in got} == {True, False} and {r.lang_pred for r in got} == {"pl"}


def test_a_model_of_three_hundred_languages_grows_with_what_occurs(spark):
    own = lambda i: [f"{chr(0x4E00 + i)}{chr(0x4E00 + i)}{x}" for x in "abcde"]  # noqa: E731  words of one language alone
    rows = [(i * 3 + k, " ".join([*own(i), "shared"]), f"l{i:03}") for i in range(300) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs.select("lang", "text"))
    assert len(model.langs) == 300 and len(model.words.row) == 1501 and len(model.words.at) == 300 * 6
    assert len(model.grams[2].at) < 300 * 40  # 300 * 300 * 13 entries if each key had all languages
    assert (model.words.get("shared") > model.words.none).all() and (model.words.get(own(7)[0]) > model.words.none).nonzero()[0].tolist() == [7]
    seen = {l for i, _, l in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    got = languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in got if r.lang in seen) and len(seen) > 250


def test_quality_against_dense_equations(spark):
    """Features, ridge and calibration once more, in one matrix and with isotonic levels by their min-max formula."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = table(quality_scores(docs, labels))
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.orderBy("doc_id").collect()
    x = np.array([quality.statistics(r.text or "") for r in rows])
    fit = [i for i, r in enumerate(rows) if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5]
    y = np.array([known[rows[i].doc_id] for i in fit], "f8")
    mean, scale = x[fit].mean(axis=0), np.maximum(x[fit].std(axis=0), 1e-6)
    rng = np.random.Generator(np.random.PCG64(quality.SEED))
    w, b = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.c_[np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - mean) / scale, -6, 6) @ w + b), np.ones(len(x))]
    raw = z @ np.linalg.solve(z[fit].T @ z[fit] + quality.PENALTY * len(fit) * np.eye(z.shape[1]), z[fit].T @ y)
    bins = np.minimum((np.clip((raw[fit] + 1) / 3, 0, 1) * quality.BINS).astype(int), quality.BINS - 1)
    used = np.unique(bins)
    weight, level = np.array([(bins == k).sum() for k in used], "f8"), np.array([y[bins == k].mean() for k in used])
    mean_of = lambda i, j: (weight[i : j + 1] * level[i : j + 1]).sum() / weight[i : j + 1].sum()
    levels = [max(min(mean_of(i, j) for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))]
    want = np.interp(raw, (used + 0.5) / quality.BINS * 3 - 1, levels)
    assert np.mean(np.abs(got["score"] - want) < 1e-6) > 0.99  # a raw score at the edge of a bin may fall on either side
    assert (got["held_out"] == [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def test_operators_on_rows_without_ids_repeated_rows_and_a_long_text(spark, hard):
    """Every row gives a row, equal rows equal ones, rows of one id each by its own text."""
    import tiktoken
    from tokenizers import Tokenizer

    n, raw = hard.count(), hard.select("doc_id", "text").collect()
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        model = f.read()
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 36)], "doc_id long, quality int")
    vectors = hard.select("doc_id", "text").where("doc_id is not null or text is not null")
    assert vectors.count() == n - 1
    by_text = lambda rows, f: Counter((r.doc_id, f(r.text or "")) for r in rows)

    prints = Counter((r.doc_id, int(r.fingerprint, 16)) for r in simhash.simhash_groups(hard).collect())
    assert prints == by_text(raw, plain_fingerprint)
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert Counter((r.doc_id, r.ids_sha256) for r in bpe.digest(hard, ranks, P.PATTERN).collect()) == by_text(raw, lambda t: digest(plain.encode_ordinary(t)))
    assert Counter((r.doc_id, r.fingerprint) for r in sampling.edited_fingerprints(hard).collect()) == by_text(raw, lambda t: sampling.signature(t).tobytes().hex())
    tokenizer = Tokenizer.from_buffer(model)
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in token_files.op10_rows(hard, model).collect()) == by_text(raw, crc)
    scores = quality_scores(hard, labels).collect()
    assert len(scores) == n and len({r.score for r in scores if r.doc_id == 1}) <= 2 and all(0 <= r.score <= 1 for r in scores)
    assert not any(r.held_out for r in scores if r.doc_id is None)
    found = languages(hard).collect()
    assert len(found) == n and {r.lang_pred for r in found} <= {"en", "fr", "und"} and sum(r.lang_pred == "und" for r in found) >= 4
    chosen = mix(hard, domain_of_source(), target_weights(), share=2.0, epochs=2)
    tokens = lambda t: len(re.findall(r"[^ \t-\r]+", t))
    assert chosen.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] == 2 * sum(tokens(r.text or "") for r in raw)
    assert mixed_documents(hard, chosen).count() == 2 * n
    spans = sentence_spans(hard).collect()
    assert len(spans) == n and sum(r.n_removed for r in spans if r.doc_id is None) == 0
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.digest(hard).collect()}
    by_id = sorted({(r.doc_id, r.text or "") for r in raw if r.doc_id is not None})
    assert {k: v for k, v in removed.items() if k[0] is not None and k[0] != 500} == {(i, b): g for i, b, g, _, _ in plain_removed([x for x in by_id if x[0] != 500])}
    assert {k: v for k, v in removed.items() if k[0] is None} == {(None, 0): 0, (None, next(len(r.text.encode()) for r in raw if r.doc_id is None and r.text)): 0}


def test_quality_of_held_out_rows(spark, docs, empty):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_scores(own, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got.loc[got["quality"] == 1, "score"].to_numpy(), got.loc[got["quality"] == 0, "score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() >= 0.95
    assert (got["predicted"] == got["quality"]).mean() >= 0.9
    odd = quality_scores(docs, labels).toPandas()
    assert odd["score"].between(0, 1).all() and len(odd) == docs.count()
    assert quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    assert isotonic(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]
    assert isotonic(np.array([3.0, 1.0]), np.array([1.0, 3.0])).tolist() == [1.5, 1.5]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.3, (300, 40)).astype("f4")
    x[7] = x[9]
    rows = [(i, [float(v) for v in r], i) for i, r in enumerate(x)]
    rows += [(300, None, 0), (350, [float("nan")] * 40, 0), (400, [None] * 40, 0), (450, [float("inf")] + [0.0] * 39, 0), (None, [0.0] * 40, 0), (500, [0.1, 0.2], 0), (550, [], 0)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).toPandas()
    q = np.zeros((304, 40))
    ids = np.array([*range(300), 500, 550])
    q = np.zeros((302, 40))
    q[:300] = np.floor(256 * x.astype("f8"))
    q[300, :2] = np.floor(256 * np.array([0.1, 0.2], "f4").astype("f8"))
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = q @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want += [(ids[i], n + 1, ids[j], s[j]) for n, j in enumerate(order)]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].astype(int).to_numpy())) == sorted(tuple(map(int, w)) for w in want)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_ties_repeated_ids_and_vast_numbers(spark):
    rows = [(0, [1.0, 2.0])] + [(i, [1.0, 1.0]) for i in (9, 8, 7, 6, 5, 4, 3)] + [(8, [1.0, 1.0])]
    rows += [(50, [1e18, -1e300]), (51, [1e18, 0.0]), (52, [-1e18, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(df).collect()}
    assert [got[0, k] for k in range(1, 6)] == [(51, 256**2 * 10**18 // 1 if 256**2 * 10**18 < 2**63 else 2**63 - 1), (3, 3 * 65536), (4, 3 * 65536), (5, 3 * 65536), (6, 3 * 65536)]
    assert got[50, 1] == (51, 2**63 - 1) and (50, 5) in got
    few = top_k(spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 256 * 128)]


def test_spans(spark, empty):
    a = "The first of them is here today. A second one follows it closely. And then a third comes along."
    b = "This one sentence goes on and on over so many words that it stands for a passage all by itself, as it has more than five and twenty of them in all."
    rows = [(1, f"{a} Tail one."), (2, f"Head. {a}"), (3, a), (4, "Short. Short. Short. Short. Short."), (5, None), (6, ""), (1, f"{a} Tail one."), (None, a), (3, a + " More."), (7, b), (8, f"Ahead of it. {b}"), (9, b), (10, "A text of one sentence, of forty letters or more"), (11, "A text of one sentence, of forty letters or more"), (12, "Short one"), (13, "Short one")]
    got = sentence_spans(spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))).collect()
    kept = {(r.doc_id, t): r.kept for r, t in ((r, r.kept) for r in got)}
    assert sorted(k for i, k in kept if i == 1) == [f"{a} Tail one."] and sum(r.doc_id == 1 for r in got) == 2
    assert {i: sorted(k for j, k in kept if j == i) for i in (2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None)} == {
        2: ["Head."], 4: ["Short. Short. Short. Short. Short."], 5: [""], 6: [""], 7: [b], 8: ["Ahead of it."], 9: [""], 10: ["A text of one sentence, of forty letters or more"], 11: [""], 12: ["Short one"], 13: ["Short one"], None: [a]}
    assert sorted(k for i, k in kept if i == 3) == ["", " More."]
    assert sentence_spans(empty).count() == 0


def test_spans_of_a_text_of_one_line_a_hundred_thousand_times(spark):
    line, other = "The very same line stands here once more, and again.\n", "This line stands here but once, somewhere among the others.\n"
    text = line * 50_000 + other + line * 50_000
    got = sentence_spans(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).orderBy("doc_id").collect()
    # the span that starts at the second line repeats the one at the first, and so on; those across the other line come but once
    assert [(r.n_sentences, r.n_removed, r.kept) for r in got] == [(100_001, 99_999, line + other), (100_001, 100_001, "")]


def test_mixing_keeps_budgets_and_fills_siblings_first(spark, empty):
    rows = [(i, "w " * 10, "en" if i % 2 else "fr", f"src{i % 3}") for i in range(300)] + [(1000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("copies", F.lit(9))
    weights = {"domain": F.lit(1.0), "lang": F.when(F.col("lang") == "en", 9.0).otherwise(1.0), "source": F.lit(1.0)}
    got = mix(docs, F.lit("d"), weights, share=0.5, epochs=1).toPandas()
    took = got.assign(t=got["n_tokens"] * got["copies"]).groupby("lang")["t"].sum()
    # English can't take nine tenths of 1500 in one epoch of 1500; French takes what it may
    assert took["en"] == 1350 and took["fr"] == 150
    full = mix(docs, F.lit("d"), weights, share=0.9, epochs=1).toPandas()
    assert full.loc[full["lang"] == "en", "n_tokens"].sum() == 1500
    assert full["n_tokens"].sum() == 2700
    twice = mixed_documents(docs, mix(docs, domain_of_source(), target_weights(), share=1.5, epochs=2))
    assert twice.columns == docs.columns and 445 <= twice.count() <= 450
    assert mix(empty, domain_of_source(), target_weights()).count() == 0
