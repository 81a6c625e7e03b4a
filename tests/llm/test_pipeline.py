"""The pipeline's stages on columns of clashing names, on odd rows and against brute force; WARC files and the laid-out mix."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import forest, mixing, simhash, tokens, warc
from lattica.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns or return.
TAKEN = "score lang_pred n_entities _pass _row _text _di _shard row i h head doc component text_hash fp sequence_id offset open ids _d _h k found new n own".split()


def prose(seed, n):
    r = random.Random(seed)
    words = "the quick river stone holds under winter light and many small birds return to their trees before the evening comes".split()
    return " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i % 40, 40 + i), "en", "abc"[i % 3], 0) for i in range(60)]
    rows += [(100, None, "en", "a", None), (101, "", None, None, 0), (102, "12 34 56", "en", "a", 8), (103, "mail jane.roe@example.org now and then", "en", "b", 3), (None, prose(77, 90), "en", None, 1)]
    rows += [rows[3], rows[3], (7, prose(500, 80), "en", "c", 2)]  # repeated rows, and another text under one doc_id
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string").alias(n) for n in TAKEN])


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", ["language", "near_copies", "surrogates", "mixing"])
def test_stage_keeps_columns_whatever_their_names(spark, clashing, name):
    out = stage(name)(spark, clashing, "").cache()
    assert out.columns == clashing.columns and out.count() > 0
    assert out.where(" or ".join(f"not (`{n}` <=> cast(coalesce(doc_id, -1) as string))" for n in TAKEN)).isEmpty()


@pytest.mark.parametrize("name", ["language", "near_copies", "surrogates", "mixing", "packing"])
def test_stage_takes_an_empty_table(spark, docs, name):
    assert stage(name)(spark, docs.limit(0), "").isEmpty()


def test_language_drops_texts_without_letters_only(spark, docs):
    kept = sorted((r.doc_id or -1, r.text) for r in stage("language")(spark, docs, "").collect())
    assert kept == sorted((r.doc_id or -1, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))


def test_near_copies_keep_one_row_a_group(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = group[a], group[b]
                group = [y if c == x else c for c in group]
    heads = {g: min(((rows[k][0] is None, rows[k][0] or 0) for k in range(len(rows)) if group[k] == g)) for g in set(group)}
    kept = stage("near_copies")(spark, docs, "").collect()
    assert sorted(heads.values()) == sorted((r.doc_id is None, r.doc_id or 0) for r in kept)
    texts = {r.text for r in kept}
    assert prose(500, 80) in texts and len([r for r in kept if r.doc_id == 7]) == 2  # unrelated texts of one doc_id both stay


def test_mixing_takes_the_targets(spark, docs):
    out = stage("mixing")(spark, docs, "").collect()
    words = {}
    for r in out:
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    plan = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert {k: round(v) for k, v in plan.items() if round(v)} == words


def test_run_covers_every_token(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = corpus_pipeline.materialize(f(spark, before, str(tmp_path)), name)
    encoder = tokens.Encoder(vocabulary("word_bpe_49k.json"))
    assert sum(r.length for r in out) == sum(len(encoder.tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())


def test_shards_come_from_the_tree(docs):
    mixed = mixing.mix(docs, block=16, levels=3, seed=5).cache()
    pieces = mixing.shuffled(mixed).collect()
    assert sum(p.n for p in pieces) == sum(x.n for r in mixed.collect() for x in r.pieces)
    slots = {}
    for p in pieces:
        slots.setdefault(p.shard, set()).add((p.source, p["turn"]))
    assert len(slots) == 8 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    one = {p.shard for p in mixing.shuffled(mixing.mix(docs, block=16, levels=0, seed=5)).collect()}
    assert one == {0}
    again = mixing.shuffled(mixing.mix(docs, block=16, levels=3, seed=5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, pieces))


def test_derive_files(spark, tmp_path):
    records = [warc.response_record(f"http://a.example/{k}", f"<html><head><title>T{k}</title></head><body><p>text {k}</p></body></html>".encode(), "2024-05-06T07:08:09Z") for k in range(3)]
    request = warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:0>")], b"GET / HTTP/1.1\r\n\r\n")
    data = request + b"".join(warc.record(*r) for r in records)
    (tmp_path / "plain.warc").write_bytes(data)
    (tmp_path / "zipped.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (request, *[warc.record(*r) for r in records])))
    out = warc.derive_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(out) == 12 and {r.refers_to for r in out} == {dict(h)["WARC-Record-ID"] for h, _ in records}
    for r in out:
        k = next(i for i, (h, _) in enumerate(records) if dict(h)["WARC-Record-ID"] == r.refers_to)
        assert r.source_digest == dict(records[k][0])["WARC-Payload-Digest"] and r.block_digest == warc.digest(r.content.encode())
        if r.record_type == "conversion":
            assert r.content == f"T{k}\ntext {k}"


def test_forest_finds_planted_families(spark):
    """Recall of links among families of jittered copies in 20,000 vectors, one of them a tenth of all."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(3))
    n, dims = 20_000, 32
    x = rng.standard_normal((n, dims)).astype(np.float32)
    family = np.full(n, -1)
    at = 0
    for f, size in enumerate([2_000, 300, *[3] * 200]):
        base = rng.standard_normal(dims)
        x[at : at + size] = base / np.linalg.norm(base) + rng.standard_normal((size, dims)) * 0.02
        family[at : at + size] = f
        at += size
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(unit[k : k + 2000] @ unit.T >= 0.95).sum(1) - 1 for k in range(0, n, 2000)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = {r.vec_id: r for r in forest.near_vectors(df).collect()}
    got = np.array([out[i].n_links for i in range(n)])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
    heads = {f: int(np.flatnonzero(family == f)[0]) for f in set(family.tolist()) - {-1}}
    right = [out[i].component_id == heads[f] for i, f in enumerate(family.tolist()) if f >= 0 and want[i]]
    assert np.mean(right) >= 0.9
