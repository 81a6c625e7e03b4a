"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import components, dac, forest, language, licenses, mixing, packing, pii, quality, simhash, tokens, warc
from lattica.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, h long, key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


TEXTS = [
    None, "", "   \n\t", "one", "One two THREE", prose(1, 50), prose(1, 50), prose(1, 49) + " changed", prose(2, 300), prose(3, 6000), "é Ünïcode 漢字 text text text text",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0. CC BY-NC 4.0", "x\nx\nx\n y\ny", " ".join(["same words again and again here now then"] * 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], 0, "clash", 1, "k") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def least_reachable(ids, linked):
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(250)]
    found = {x.node: x.component for x in components.connected_components(spark.createDataFrame([*links, (None, 1), (5, 5)], "a long, b long")).collect()}
    want = least_reachable(range(300), links)
    assert all(found.get(i, i) == want[i] for i in range(300))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


# SimHash


def test_byte_sets_hit_any_four():
    from itertools import combinations

    for size, n in ((3, 20), (4, 70)):
        sets = simhash.byte_sets(size)
        assert len(sets) == n
        assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, nothing):
    found = simhash.simhash_groups(docs).collect()
    assert len(found) == docs.count()
    prints = [(i, slow_fingerprint(t)) for i, t in texts_of(docs)]
    assert sorted(((r.doc_id, r.fp % 2**64) for r in found), key=repr) == sorted(prints, key=repr)
    ids = {i: f for i, f in prints if i is not None}
    want = least_reachable(ids, [(a, b) for a in ids for b in ids if (ids[a] ^ ids[b]).bit_count() <= 4])
    assert all(r.component_id == want[r.doc_id] for r in found if r.doc_id is not None)
    assert simhash.simhash_groups(nothing).isEmpty()
    kept = simhash.keep_first(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))


def test_near_links_in_a_dense_family(spark):
    r = random.Random(7)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(12), r.randrange(5))) for _ in range(300)} | {r.getrandbits(64) for _ in range(200)}
    fps |= {x ^ 0b1000100010001 for x in list(fps)[:50]}
    want = least_reachable(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    signed = lambda x: x - 2**64 if x >> 63 else x
    found = {x.fp: x.component for x in simhash.near_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    groups = lambda label: sorted(sorted(v) for v in _grouped(label).values())
    assert groups({signed(k): signed(v) for k, v in want.items()}) == groups(found)


def _grouped(label):
    out = collections.defaultdict(list)
    for k, v in label.items():
        out[v].append(k)
    return out


# Tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    odd = ["a  b", " a", "a ", "\n\na", "a \n b", "it's, they'll!", "...!?", "x\t y", "a b  c", "ΣΊΣΥΦΟΣ Σ", "İstanbul", "é é", "a\x1cb \x1c c", "1,234.56", "word!! \"quoted\" (x)", "<|endoftext|> end", "日本語 text", "don't 'tis", *[t or "" for t in TEXTS]]
    e = tokens.Encoder(vocabulary(name))
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(odd)]
        assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def test_token_file_random_access():
    r = random.Random(5)
    ids = np.array([r.choice([3, 255, 256, 65535, 65536, 2**32 - 1, r.randrange(50_000)]) for _ in range(3000)], np.uint32)
    file = dac.TokenFile(dac.pack([7, None, 9], np.array([0, 1000, 1000, 3000]), ids))
    assert file.tokens().tolist() == ids.tolist() and file.doc_ids() == [7, None, 9]
    assert all(file.token(i) == ids[i] for i in range(0, 3000, 7)) and file.document(1) == []
    assert dac.TokenFile(dac.pack([], np.array([0]), np.zeros(0, np.uint32))).tokens().tolist() == []


def test_token_round_trip(docs, nothing):
    path = vocabulary("byte_bpe_50k.json")
    found = sorted((r for r in dac.round_trip(docs, path).collect()), key=lambda r: r.start)
    tk = tokens.Encoder(path).tokenizer
    want = [(i, tk.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in sorted(texts_of(docs), key=lambda x: (x[0] is not None, x[0] or 0))]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in found] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want]
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum([len(x) for _, x in want])[:-1]]).tolist()
    assert dac.round_trip(nothing, path).isEmpty()


@pytest.mark.parametrize("parts", [1, 40])
def test_packing(docs, nothing, parts):
    path = vocabulary("word_bpe_49k.json")
    found = packing.pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(parts), path, with_ids=True).collect()
    tk = tokens.Encoder(path).tokenizer
    want = {i: tk.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts_of(docs) if i is not None}
    by_doc, by_sequence = _rows(found, "doc_id"), _rows(found, "sequence_id")
    for i, ids in want.items():
        joined = [x for p in sorted(by_doc[i], key=lambda p: p.start) for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert joined == ids and all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(p.ids) for p in by_doc[i])
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == np.concatenate([[0], np.cumsum([p.length for p in ps])[:-1]]).tolist() and sum(p.length for p in ps) <= 4096
    assert packing.pack_documents(nothing, path).isEmpty()


def _rows(found, key):
    out = collections.defaultdict(list)
    for r in found:
        out[r[key]].append(r)
    return out


def test_packer_is_bounded():
    p = packing.Packer(100, 3, 10, 0)
    r = random.Random(2)
    for k in range(500):
        p.add(k, 0, r.randrange(1, 250))
        assert len(p.open) <= 3
    assert all(sum(b - a for _, a, b in x) <= 100 for _, x in p.finish())


# Mixing


def test_mixing(docs, nothing):
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in texts_of(docs))
    assert sorted(r["size"] for r in found) == sizes
    by = _rows(found, "source")
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * sum(sizes)) < 1e-6
    for rows in by.values():
        assert abs(sum(p.n for r in rows for p in r.pieces) - rows[0].target) <= 0.5
        for r in rows:
            assert sum(p.n for p in r.pieces) <= 2 * r["size"]
            for number in {p["pass"] for p in r.pieces}:
                spans = sorted((p.start, p.n) for p in r.pieces if p["pass"] == number)
                assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    assert mixing.mix(nothing).isEmpty() and mixing.mixed_documents(nothing).isEmpty()


def test_mixed_documents_keep_words(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = sum(p.n for r in mixing.mix(docs).collect() for p in r.pieces)
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect()) == taken


def test_mix_is_laid_out_by_shard_and_turn(spark):
    rows = [(i, f"d{i} " + prose(i, 20 + i % 700), ["a", "b", "c"][i % 3], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").coalesce(1)
    mixed = mixing.mix(docs, levels=3).collect()
    pieces = [(p["shard"], r.source, p["pass"], r.doc_id, p["turn"]) for r in mixed for p in r.pieces]
    laid = mixing.shuffled(mixing.mix(docs, levels=3)).select("shard", "turn", F.spark_partition_id().alias("part")).collect()
    assert sorted((r.shard, r.turn) for r in laid) == sorted((s, t) for s, *_, t in pieces)
    assert all((a.shard, a.turn) <= (b.shard, b.turn) for a, b in zip(laid, laid[1:]) if a.part == b.part)
    place = collections.defaultdict(list)
    for s, _, p, d, t in pieces:
        place[d, p].append((t, s))
    at = collections.defaultdict(list)
    for (d, _), found in place.items():
        at[d].append((min(found)[1], min(found)[0]))
    out = mixing.mixed_documents(docs, levels=3).select("doc_id", F.spark_partition_id().alias("part")).collect()
    assert collections.Counter(r.doc_id for r in out) == {d: len(x) for d, x in at.items()}
    single = [(r.part, at[r.doc_id][0]) for r in out if len(at[r.doc_id]) == 1]
    assert len(single) > 50 and all(a[1] <= b[1] for a, b in zip(single, single[1:]) if a[0] == b[0])


def test_hypergeometric_is_exact(spark):
    from math import comb

    u = (F.col("id") + 0.5) / 50_000
    found = spark.range(50_000).select(mixing.hypergeometric(F.lit(12), F.lit(40), F.lit(15), u).alias("k")).groupBy("k").count().collect()
    assert all(abs(r["count"] / 50_000 - comb(12, r.k) * comb(28, 15 - r.k) / comb(40, 15)) < 1e-4 for r in found)


def test_split_quotas_are_exact(spark):
    quotas = spark.createDataFrame([(0, "a", 1000), (1, "b", 0), (2, "c", 37), (3, None, 5)], "k long, source string, n long")
    found = mixing.split_quotas(quotas, 3, 1).collect()
    assert {k: sum(r.n for r in x) for k, x in _rows(found, "source").items()} == {"a": 1000, "b": 0, "c": 37, None: 5}
    shards = [sum(r.n for r in x) for x in _rows(found, "shard").values()]
    assert max(shards) - min(shards) <= 3 and all(r.n >= 0 for r in found)


# Licences


def test_licenses(docs, nothing):
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect() if r.doc_id is not None}
    r = found[11]
    assert (r.n_base, r.base_labels, r.first_word, r.last_word) == (3, "apache-2,cc-by-nc,mit", 1, 13)
    for i, t in texts_of(docs):
        if i is not None:
            assert found[i].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)))
    assert licenses.scan_licenses(nothing).isEmpty() and licenses.scan_licenses(docs).count() == docs.count()


def test_license_text_with_changes(spark):
    text = "x y z Permission is hereby granted, free of charge, to any person obtaining a fine copy of this software and associated documentation files (the Software), to deal in the Software without any restriction"
    other = "permission is a word and software is another, granted that files are free"
    rows = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (rows[0].labels, rows[0].base_labels) == ("mit", "") and 0.8 <= rows[0].score <= 1
    assert (rows[1].labels, rows[1].score) == ("", 0.0)


# Quality


def slow_features(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (99, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.apply_quality_rules(docs, labels).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == sorted((i or -1, *slow_features(t)) for i, t in texts_of(docs))
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed) for r in found)
    assert quality.apply_quality_rules(nothing, labels).isEmpty()
    assert quality.apply_quality_rules(docs, labels.limit(0)).count() == docs.count()


def test_quality_cutoffs_reject_junk_and_keep_good(spark):
    rows, labels = [], []
    for i in range(30_000):
        bad = i % 6 == 0
        words = [WORDS[(i * 7 + k * k + k * (i % 11)) % 20] + ("###" if bad else "") + str((i + k * 31) % 97) for k in range(25)]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad)))
    out = quality.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"), limit=0.03)
    by = {(r.bad, r.kept): r["count"] for r in out.where("not base_failed").groupBy((F.col("doc_id") % 6 == 0).alias("bad"), "kept").count().collect()}
    assert by.get((True, True), 0) == 0 and by.get((False, False), 0) == 0


def test_quality_certifies_strata_of_some_hundred_good_labels(spark):
    rows, labels = [], []
    for i in range(6_000):
        bad = i % 5 == 0
        words = [WORDS[(i * 7 + k * k + k * (i % 11)) % 20] + ("###" if bad else "") + str((i + k * 31) % 97) for k in range(25)]
        rows.append((i, " ".join(words), ["en", "de", "fr", None][i // 5 % 4]))
        labels.append((i, int(not bad)))
    out = quality.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    by = {(r.bad, r.kept): r["count"] for r in out.where("not base_failed").groupBy((F.col("doc_id") % 5 == 0).alias("bad"), "kept").count().collect()}
    assert by.get((True, True), 0) == 0 and by.get((False, False), 0) == 0 and by[True, False] > 1000


def test_binomial_tail(spark):
    from math import comb

    for n, k, p in ((50, 1, 0.05), (400, 3, 0.02), (5000, 0, 0.001)):
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert abs(got - sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))) < 1e-9


# Language


def test_language(spark, docs, nothing):
    en, de = "the and of that with this from there which would people".split(), "der die und nicht mit einer auch werden zwischen über".split()
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(en if i % 2 else de) for _ in range(30)), "en" if i % 2 else "de") for i in range(200)]
    found = language.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(x.lang_pred == ("en" if x.doc_id % 2 else "de") and 0 <= x.score <= 1 for x in found)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in found)
    odd = {x.doc_id: x.lang_pred for x in language.predict_languages(docs).collect()}
    assert odd[0] == odd[1] == odd[2] == "und" and odd[3] == "en"
    assert language.predict_languages(nothing).isEmpty()


# Vectors


def brute_links(x, ids, least):
    n = np.linalg.norm(x, axis=1)
    linked = (x @ x.T) / np.outer(n, n) >= least
    np.fill_diagonal(linked, False)
    comp = least_reachable(ids, [(ids[i], ids[j]) for i, j in np.argwhere(linked)])
    return {ids[i]: (int(linked[i].sum()), comp[ids[i]]) for i in range(len(ids))}


@pytest.mark.parametrize("block", [16, 1024])
def test_vector_forest(spark, block):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16))
    x = np.vstack([x, x[:80] + 0.02 * rng.standard_normal((80, 16)), np.repeat(x[:1], 60, 0), x[1] + 0.05 * rng.standard_normal((90, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, x[0, :8].tolist()), (9006, [None] * 16)]
    found = forest.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), block=block, leaf=32)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    want = brute_links(x.astype(float), list(range(len(x))), 0.95)
    assert all(got[i] == (0, i) for i, _ in odd)
    assert sum(got[i][0] for i in want) >= 0.98 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
    assert forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()


def test_vector_forest_dense_group(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    x = np.vstack([rng.standard_normal((8000, 64)), centre + 0.176 * rng.standard_normal((4000, 64))]).astype(np.float32)
    found = forest.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert want.sum() > 4000 * 3000 and sum(n for n, _ in got.values()) >= 0.999 * want.sum()
    assert all(got[i][0] <= want[i] for i in got)
    assert {got[i][1] for i in range(8000, 12000)} == {8000} and all(got[i] == (0, i) for i in range(8000) if want[i] == 0)


# WARC


def test_warc_derivatives(spark):
    page = "<html><head><title>T &amp; t</title><script>var a='<p>no</p>'</script></head><body><p>Hello <b>wor</b>ld<p title='a>b'>Two<!-- no --></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/", page), (2, None, None), (1, "http://a.example/", page)], "page_id long, url string, html string")
    rows = warc.derive_pages(pages).collect()
    assert len(rows) == 6
    meta, text = (next(r for r in rows if r.page_id == 1 and r.record_type == k) for k in ("metadata", "conversion"))
    assert text.content == "T & t\nT & t\nHello world\nTwo" or text.content == "T & t\nHello world\nTwo"
    headers, block = warc.response_record("http://a.example/", page.encode(), "2025-01-01T00:00:00Z")
    assert meta.refers_to == text.refers_to == dict(headers)["WARC-Record-ID"]
    assert warc.digest(page.encode()) in meta.content and text.record_id in meta.content
    data = warc.record(headers, block)
    back = list(warc.read_records(data + data))
    odd = warc.record(*warc.response_record("http://a/\r\nWARC-Type: x", b"", "2025-01-01T00:00:00Z"))
    assert dict(next(warc.read_records(odd))[0])["WARC-Type"] == "response"
    assert len(back) == 2 and back[0][1] == block and dict(back[0][0])["WARC-Target-URI"] == "http://a.example/"
    assert warc.derive(*back[0], "2025-01-01T00:00:00Z")[1][2].decode() == text.content
    with pytest.raises(ValueError):
        list(warc.read_records(data[:-10]))


def test_warc_text_of_unclosed_elements():
    assert warc.plain_text("<html><head><title>T</title><body><p>all the text</p></body></html>") == "T\nall the text"
    assert warc.plain_text("<head><title>T</title><style>p{}</style><p>all the text") == "T\nall the text"
    for name in ("iframe", "object", "canvas", "svg", "template", "noscript"):
        assert warc.plain_text(f"<p>a</p><{name} x=1><p>all the text</p>") == "a\nall the text"
        assert warc.plain_text(f"<p>a</p><{name} x=1>no</{name.upper()} ><p>b</p>") == "a\nb"
    for name in ("script", "style"):
        assert warc.plain_text(f"<p>a</p><{name}>no<p>no</p>") == "a"


# Personal data


def test_surrogates(spark, docs, nothing):
    texts = ["Mr. John Smith wrote to jane.roe@corp.example and Smith's phone is +1 (407) 555-7710.", "Mrs. Mary Smith, card 4111 1111 1111 1111, ip 10.1.2.3, jane.roe@corp.example", "token = \"0123456789abcdef0123456789abcdef01234567\"", "Nothing to see in 2024.", None, ""]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kind int")
    out = {r.doc_id: r for r in pii.replace_entities(df, b"key").collect()}
    assert [out[i].text for i in (3, 4, 5)] == texts[3:] and [out[i].n_entities for i in (3, 4, 5)] == [0, 0, 0]
    joined = " ".join(out[i].text for i in (0, 1, 2))
    for secret in ("John", "Smith", "jane", "4111", "10.1.2.3", "0123456789abcdef", "555-7710", "Mary"):
        assert secret not in joined
    email = re.search(r"[\w.]+@[\w.]+", out[0].text)[0]
    assert email in out[1].text
    surname = re.search(r"Mr\. (\w+) (\w+)", out[0].text)
    assert surname[1] in pii.FIRST_NAMES["latin", "m"] and f"{surname[2]}'s" in out[0].text and surname[2] in out[1].text
    card = re.search(r"(?:\d{4} ){3}\d{4}", out[1].text)[0]
    assert pii.luhn(card.replace(" ", "")) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[0].text) and re.search(r"\b10\.\d+\.\d+\.\d+", out[1].text)
    assert pii.replace_entities(nothing, b"key").isEmpty() and pii.replace_entities(docs, b"key").count() == docs.count()


def test_surrogates_stay_distinct(spark):
    values = [f"10.0.{i // 250}.{i % 250}" for i in range(500)]
    df = spark.createDataFrame([(i, f"from {v} on") for i, v in enumerate(values)], "doc_id long, text string")
    table = pii.surrogate_table(pii.entity_table(df), b"k").collect()
    assert len({r.surrogate for r in table}) == 500 and not {r.surrogate for r in table} & set(values)
    values = [f"192.168.{i // 250}.{i % 250}" for i in range(2000)]  # a small space: some have to be drawn again
    df = spark.createDataFrame([(i, f"from {v} on") for i, v in enumerate(values)], "doc_id long, text string")
    table = pii.surrogate_table(pii.entity_table(df), b"k").collect()
    assert len({r.surrogate for r in table}) == 2000 and not {r.surrogate for r in table} & set(values)
    known, surrogates = {(r.kind, r.canonical): r.surrogate for r in table}, pii.Surrogates(b"k")
    assert any(r.draw > 0 for r in table)
    want = {r.doc_id: pii.replaced(r.text, pii.find_entities(r.text), surrogates, known) for r in df.collect()}
    assert {r.doc_id: r.text for r in pii.replace_entities(df, b"k").collect()} == want
