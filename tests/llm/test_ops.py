"""The ten operators against brute force, on small tables with nulls, ties, copies, long texts and clashing columns."""

import base64
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from loomlog.llm import bpe, embedding_dedup, license_scan, line_dedup, packing, quality, simhash, spotsigs, suffix_dedup, url_filter
from loomlog.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a string, b string, component_id long, fp string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x", None, 7, "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [words(rng, rng.randint(1, 120)) for _ in range(30)]
    near = [base[0] + "!", base[1].upper(), base[2].replace(" ", "  "), base[3] + " " + base[4]]
    passage = words(rng, 60)
    shared = [words(rng, 20) + "\n" + passage + "\n" + words(rng, 20) for _ in range(6)]
    return [*base, *near, *shared, base[0], base[0], "", None, "   ", "é" * 400, "日本語 text ★ 123", words(rng, 9000), "x" * 300, "Id 17 of 20\nid 18 of 20", "Id 99 of 3", "Id 5 of 6"]


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(500, 700)] + [(9, 9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(101, 161)} == {100} and 100 not in got and {got[i] for i in range(500, 700)} == {1} and 9 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not (m >> i) & 1 and not (m >> j) & 1 for m in masks)


def simhash_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum((x >> b) & 1 for x in h) > len(h))


def smallest(n, linked):
    low = list(range(n))
    for _ in range(n):
        new = [min([low[i], *(low[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == low:
            break
        low = new
    return low


def test_simhash(spark, texts):
    got = {r.doc_id: r for r in simhash.components(docs(spark, texts)).collect()}
    fp = [simhash_of(t, 3) for t in texts]
    low = smallest(len(fp), lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= 2)
    assert [(got[i].fingerprint, got[i].component_id) for i in range(len(fp))] == [(f"{x:016x}", c) for x, c in zip(fp, low, strict=True)]
    kept = simhash.dedup(docs(spark, texts), 3)
    assert kept.columns == docs(spark, texts).columns and {r.doc_id for r in kept.collect()} == set(low)
    assert simhash.components(docs(spark, [])).count() == 0


def test_simhash_links_random_fingerprints_exactly(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps)[:20]:
        y = x
        for _ in range(3):
            y ^= 1 << rng.randrange(64)
            fps.add(y)
            y ^= 1 << rng.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in links)
    order = {x: i for i, x in enumerate(signed)}
    pairs = {(order[r.a], order[r.b]) for r in links}
    want = smallest(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    assert smallest(len(fps), lambda i, j: (i, j) in pairs or (j, i) in pairs) == want


def test_line_dedup(spark, texts, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 2000)
    boiler = "Read on at page {} of the site today"
    lines = [*texts, *[f"own {i} words\n" + boiler.format(i) + "\n\nend\r\x00" + str(i) for i in range(5)]]
    got = {r.doc_id: r for r in line_dedup.cleaned(docs(spark, lines)).collect()}
    assert all(got[i].kept == "" for i, t in enumerate(lines) if not t)
    first = len(texts)
    assert boiler.format(0) in got[first].kept and all(boiler.format(i) not in got[first + i].kept for i in range(1, 5))
    assert got[first + 1].n_lines == 3 and got[first + 1].n_dropped == 3 and got[first + 1].kept == ""
    assert got[len(texts) - 4].kept == "x" * 300
    out = line_dedup.dedup(docs(spark, lines))
    assert out.schema.simpleString() == docs(spark, lines).schema.simpleString()
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def test_line_templates_generalise():
    lines = [x.split() for x in ["user alice logged in from home now", "user bob logged in from home now", "user carol went away for a walk"]]
    assert line_dedup.templates(lines, 0.8) == [0, 0, 1]


def embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 64))
    rows = [x for x in base] + [base[0] + 0.03 * rng.normal(size=64) for _ in range(60)] + [base[1]] * 4 + [2 * base[1], base[2] + 0.2 * rng.normal(size=64)]
    bad = [None, [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] * 64, []]
    data = [[float(np.float32(v)) for v in x] for x in rows]
    return data, spark.createDataFrame([(i, x, 3, "k") for i, x in enumerate([*data, *bad])], "vec_id long, embedding array<float>, label int, key string")


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 16])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    data, df = embeddings(spark)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.array(data, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    low = smallest(len(x), lambda i, j: near[i, j])
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == low
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(len(x), len(x) + 6)) and len(got) == len(x) + 6
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 64))
    b = 0.97 * a + 0.2 * rng.normal(size=a.shape)
    a, b = (v / np.linalg.norm(v, axis=1)[:, None] for v in (a, b))
    code, stored = embedding_dedup.codes(a)
    signs = (np.unpackbits(code, axis=1) * 2.0 - 1) / 8
    estimate = ((b @ embedding_dedup.rotation(64, 0).T) * signs).sum(axis=1) / stored
    truth = (a * b).sum(axis=1)
    assert abs((estimate - truth).mean()) < 0.01
    error = embedding_dedup.EPSILON * np.sqrt(1 - stored**2) / stored / math.sqrt(63)
    assert (np.abs(estimate - truth) <= error).all()


def spots(text):
    stop = {w for ws in spotsigs.ANCHORS.values() for w in ws}
    ws = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [w for w in ws if w not in stop]
    out, seen = set(), 0
    for w in ws:
        if w in stop and seen + 1 < len(content):
            out.add((w, content[seen], content[seen + 1]))
        seen += w not in stop
    return out or ({tuple(ws)} if ws else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_spot_signatures(spark, texts, monkeypatch):
    monkeypatch.setattr(spotsigs, "WINDOW_DOCS", 5)
    got = {r.doc_id: r for r in spotsigs.compare(docs(spark, texts, [i * i for i in range(len(texts))])).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for at, i in enumerate(order):
        mine, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(mine) // 2
        edited, row = mine[: len(mine) - half] + after[:half], got[i * i]
        assert row.n_chars == len(mine) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(jaccard(spots(mine), spots(edited))) and row.near_next == pytest.approx(jaccard(spots(mine), spots(after)))
    assert got[0].fingerprint == got[40 * 40].fingerprint
    assert spotsigs.compare(docs(spark, [])).count() == 0 and spotsigs.compare(docs(spark, ["one"])).count() == 1


def test_similar_spot_sets(spark, texts):
    rng = random.Random(8)
    long = words(rng, 300)
    more = [*texts, long, long + " and a tail of new words here", words(rng, 300)]
    got = {(r.a, r.b) for r in spotsigs.similar(docs(spark, more), 0.8).collect()}
    sets = {}
    for i, x in enumerate(more):
        s = frozenset(spots(x or ""))
        if s:
            sets.setdefault(s, i)
    want = {(min(i, j), max(i, j)) for a, i in sets.items() for b, j in sets.items() if i < j and jaccard(a, b) >= 0.8}
    assert got == want and want


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))
    texts = [*texts, "<|endoftext|>", "a <|endoftext|>b"]
    rows = packing.pack(docs(spark, texts), sequence=128).toPandas().sort_values(["doc_id", "start"])
    for i, part in rows.groupby("doc_id"):
        ids, at = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 1], 0
        for r in part.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert rows.doc_id.nunique() == len(texts)
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert (rows.groupby("sequence_id").length.sum() < 128).sum() <= 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(1)
    sizes = [rng.randint(1, 99) for _ in range(200)]
    room, want = [], {}
    for i in sorted(range(200), key=lambda i: -sizes[i]):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= sizes[i]
        want[i] = b
    assert packing.first_fit_decreasing(np.array(sizes), 100).tolist() == [want[i] for i in range(200)]


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/x?y#z", "https://example.com/en", "http://a.example.com/en/1", "http://x.net/es/", "http://net/fr/a", "http://net", "http://com/", "http://notexample.com/en/", "no scheme", None, "", "a://b://c.com/x", "http://example.com?u=/en/", "http://..com//en/"]
    pages = spark.createDataFrame([(i, u, "<p>", "k") for i, u in enumerate(urls)], "page_id long, url string, html string, keys string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).orderBy("page_id").collect()]
    for u, (host, path, rule, verdict) in zip(urls, got, strict=True):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h = (m[1] if m else "").lower()
        p = m[2] if m else ""
        fits = [(hh + pp, a) for a, hh, pp in url_filter.RULES if (h == hh or h.endswith("." + hh)) and p.startswith(pp)]
        want = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (host, path, rule, verdict) == (h, p, *want), u
    assert url_filter.judge(pages.limit(0)).count() == 0 and url_filter.judge(pages, []).where("verdict = 'block'").count() == 0


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(0)
    universe = rng.integers(0, 2**63, size=(20_000, 2)).astype(np.uint64)
    listed, others = universe[:300], universe[300:]
    first = url_filter.Bloom(listed, 0.2, 1)
    cascade = url_filter.Cascade(listed, others[first.has(others)], first)
    assert len(cascade.levels) > 2 and cascade.member(listed).all() and not cascade.member(others).any()


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(9)
    good = [words(rng, 60) + "." for _ in range(300)]
    junk = [" | ".join(words(rng, 40).split()) if i % 2 else "BUY NOW!! " * 20 for i in range(150)]
    d = docs(spark, [*good, *junk, "", None])
    labels = spark.createDataFrame([*((i, 1, 0) for i in range(300)), *((i, 0, 0) for i in range(300, 450)), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels, 400)
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    out = [i for i in range(450) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(out)) for i in range(450)) and len(got) == 452
    assert sum(got[i].predicted == (i < 300) for i in out) / len(out) > 0.95
    assert 0 <= got[450].score <= 1 and got[450].score == got[451].score
    assert quality.fit(d, labels.where("quality = 1")) is None and quality.score(d, None).where("score = 0.5").count() == 452
    assert quality.keep_good(d, model).columns == d.columns and quality.score(d.limit(0), model).count() == 0


def license_texts():
    rng, mit = random.Random(5), next(b for a, b in license_scan.LICENSES if a == "MIT" and len(b) > 100)
    wrapped = "\n".join("// " + mit[i : i + 60] for i in range(0, len(mit), 60) if mit[i - 1 : i + 1].strip() or True)
    by_word, line = [], "#"
    for w in mit.replace("sublicense", "sublicence").split():
        if len(line) > 60:
            by_word.append(line)
            line = "#"
        line += " " + w
    by_word = "\n".join([*by_word, line])
    bsd = license_scan._bsd(3, True).replace("1. ", "\n\n  1) ").replace("2. ", "\n  2) ").replace("CONTRIBUTORS \"AS IS\"", "CONTRIBUTORS ``AS IS\'\'")
    return [
        ("Copyright (c) 2020 Me\n" + mit.upper(), "MIT", "MIT", 1),
        ("prose\nReleased under the MIT Licence!\nmore", None, "MIT", 1),
        ("released under the mit license for no one", None, "MIT", 1),
        ("unreleased under the mit license, or released under the mit licenses", None, "", 0),
        (None, None, "", 0),
        ("", None, "", 0),
        ("Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", None, "CC-BY-NC-4.0", 2),
        (f"# Copyright 2019 A B\n#\n{by_word}\nimport os\n" + words(rng, 3000) + " licensed under the\nMIT\n\nLicense.", None, "MIT", 2),
        ("The package\n\n" + bsd + "\nend", None, "BSD-3-Clause", 1),
        (bsd, "BSD-3-Clause", "BSD-3-Clause", 1),
        (wrapped[:200], None, "", 0),
        (mit[:-20], None, "", 0),
        (mit + " " + license_scan._bsd(2, False), None, "BSD-2-Clause,MIT", 2),
    ]


def test_licenses(spark, duck):
    cases = license_texts()
    d = docs(spark, [x[0] for x in cases])
    got = [(r.whole_license, r.licenses, r.n_license_spans) for r in license_scan.scan(d).orderBy("doc_id").collect()]
    assert got == [x[1:] for x in cases]
    assert license_scan.scan(docs(spark, [])).count() == 0 and license_scan.scan(d, [], []).where("licenses <> ''").count() == 0
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE documents AS SELECT unnest(range(?)) AS doc_id, unnest(?) AS text", [len(cases), [x[0] for x in cases]])
    sql = con.execute(license_scan.oracle() + " ORDER BY doc_id").fetchall()
    assert [(r[2], r[3], r[4]) for r in sql] == got and [r[1] for r in sql] == [r.digest for r in license_scan.scan(d).orderBy("doc_id").collect()]


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the system has no licence texts")
def test_digests_are_those_of_the_published_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    bodies = [(n, open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read()) for f, n in names.items()]
    d = docs(spark, [b for _, b in bodies] + ["a readme\n" + bodies[2][1].replace("\n", "\r\n* ") + "\nmore"])
    got = [(r.whole_license, r.licenses) for r in license_scan.scan(d).orderBy("doc_id").collect()]
    assert [x[0] for x in got[:-1]] == [n for n, _ in bodies] and got[-1][0] is None
    assert all(n in x[1].split(",") for (n, _), x in zip(bodies, got, strict=False)) and "GPL-3.0" in got[-1][1].split(",")


def test_bpe_is_tiktoken(spark, texts):
    import tiktoken

    path = bpe.public_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=ranks, special_tokens={})
    more = [*texts, "🎉🎉 a\u0301 \x00 ", "aaaaaaaaaa" * 500, "<|endoftext|>"]
    got = {r.doc_id: r for r in bpe.round_trip(docs(spark, more)).collect()}
    for i, x in enumerate(more):
        ids = enc.encode_ordinary(x or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs(spark, more))).collect()
    assert all(bytes(r.bytes) == (more[r.doc_id] or "").encode() for r in back)
    assert bpe.round_trip(docs(spark, [])).count() == 0


@pytest.mark.parametrize("sizes", [(3 << 19, 16 << 20, 1 << 19, 1000), (900, 4000, 700, 1000), (900, 4000, 700, 1)])
def test_suffix_dedup(spark, texts, monkeypatch, sizes):
    for name, v in zip(("CHUNK", "BUCKET", "ARRAY", "HOT"), sizes, strict=True):
        monkeypatch.setattr(suffix_dedup, name, v)
    ids = [3 * i + 5 for i in range(len(texts))]
    ids[-1] = ids[-2]  # two rows of one doc_id
    got = suffix_dedup.removed(docs(spark, texts, ids)).collect()
    held = {}
    for i, x in zip(ids, texts, strict=True):
        b = (x or "").encode()
        for p in range(len(b) - 49):
            held[b[p : p + 50]] = min(held.get(b[p : p + 50], i), i)
    want = []
    for i, x in zip(ids, texts, strict=True):
        b = (x or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if held[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert sorted(tuple(r) for r in got) == sorted(want)
    out = suffix_dedup.dedup(docs(spark, texts, ids))
    assert out.schema.simpleString() == docs(spark, texts).schema.simpleString() and out.count() == len(texts)
    assert suffix_dedup.removed(docs(spark, [])).count() == 0


def test_interval_expansion_gives_common_prefixes():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(1, 4, 400), np.tile([1, 2, 3, 3], 30), [0]]).astype(np.uint8)
    order = suffix_dedup.suffix_order(text, 20)
    turned = [bytes(np.roll(text, -i)[:20]) for i in order]
    assert turned == sorted(turned)
    assert suffix_dedup.divided(text, order, 20).tolist() == [True, *[a != b for a, b in zip(turned, turned[1:], strict=False)]]


def test_pipeline_stages_keep_columns_and_end_packed(spark):
    import corpus_pipeline
    from loomlog.llm.common import cut, table

    d = table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in d.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = cut(stage(spark, d, SF), name)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id: r.text for r in d.collect()}
        assert now.keys() <= before.keys() and all(len(now[k].encode()) <= len((before[k] or "").encode()) for k in now)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, d, SF).toPandas()
    assert set(packed.doc_id) == set(before) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_null_ids_and_columns_have_defined_results(spark, texts):
    some = [*texts[:6], texts[0], None]
    ids = [4, None, 7, None, 2**60, 9, None, None]
    d = docs(spark, some, ids)
    order = sorted(map(repr, ids))
    for make in (simhash.components, line_dedup.cleaned, spotsigs.compare, license_scan.scan, bpe.round_trip, suffix_dedup.removed, lambda x: quality.score(x, None)):
        assert sorted(repr(r.doc_id) for r in make(d).collect()) == order
    assert {r.doc_id for r in packing.pack(d).collect()} == set(ids)
    for make in (simhash.dedup, line_dedup.dedup, suffix_dedup.dedup):
        assert make(d).columns == d.columns
    assert [r.component_id for r in simhash.components(d).where("doc_id = 4").collect()] == [None]
    v = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (6, None)], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_duplicates(v).collect()) == [(0, 1, 0, True), (5, 1, 0, False), (6, 0, 6, True)]
    pages = spark.createDataFrame([(None, None)], "page_id long, url string")
    assert url_filter.judge(pages).first().verdict == "allow"


def test_line_dedup_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 1500)
    monkeypatch.setattr(line_dedup, "BUCKET", 4000)
    rng = random.Random(6)
    pool = [words(rng, rng.randint(1, 14)) for _ in range(25)] + ["user {} came from {} to the big house today", "page {} of {}"]
    names = ["anna", "bo", "17", "x9", "carl"]
    texts = ["\n".join(p.replace("{}", rng.choice(names)) for p in rng.choices(pool, k=rng.randint(0, 9))) + rng.choice(["", "\n", "\n\n "]) for _ in range(60)]
    fields = lambda line: ["<*>" if re.search(r"\d", w) else w for w in line.split()]
    owners, leaves = {}, {}
    for i, text in enumerate(texts):
        for line in text.split("\n"):
            w = fields(line)
            if w:
                owners.setdefault(" ".join(w), set()).add(i)
                leaves.setdefault((len(w), *w[:3]), set()).add(" ".join(w))
    keeper = {}
    for lines in leaves.values():
        known = []
        for line in sorted(lines):
            w = line.split(" ")
            same = [sum(a == b for a, b in zip(k, w, strict=True)) for k, _ in known]
            if same and max(same) >= 0.8 * len(w):
                best = known[same.index(max(same))]
                best[0][:] = [a if a == b else "<*>" for a, b in zip(best[0], w, strict=True)]
                best[1].append(line)
            else:
                known.append((w, [line]))
        for _, members in known:
            ids = set().union(*(owners[m] for m in members))
            if len(ids) >= 3:
                keeper |= dict.fromkeys(members, min(ids))
    got = {r.doc_id: r for r in line_dedup.cleaned(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        lines = text.split("\n")
        kept = [x for x in lines if keeper.get(" ".join(fields(x)), i) == i]
        assert got[i].kept == "\n".join(kept) and got[i].n_dropped == len(lines) - len(kept) and got[i].n_lines == sum(bool(x.split()) for x in lines)
    assert sum(r.n_dropped for r in got.values()) > 20


def test_near_duplicate_stage_links_every_pair_of_the_threshold(spark, texts):
    import corpus_pipeline

    rng = random.Random(12)
    more = [*texts]
    for n in (40, 90, 200):
        chain = words(rng, n).split()
        more.append(" ".join(chain))
        for _ in range(12):  # each differs in one word from one of the last two, so ends of the chain differ in many
            chain = (more[-rng.randint(1, 2)] if n == 200 else more[-1]).split()
            chain[rng.randrange(len(chain))] = words(rng, 1) + "q"
            more.append(" ".join(chain))
    passage = words(rng, 40)
    more += [words(rng, 12) + " " + passage for _ in range(30)]
    ids = list(range(len(more)))
    rng.shuffle(ids)
    w = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")) for x in more]
    sets = {i: {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set() for i, x in zip(ids, w, strict=True)}
    near = {(i, j) for i in ids for j in ids if jaccard(sets[i], sets[j]) >= 0.8}
    low = smallest(len(ids), lambda i, j: (i, j) in near)
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs(spark, more, ids), SF).collect()}
    assert got == set(low) and len(got) < len({frozenset(s) for s in sets.values()}) - 5


def test_packing_gives_added_tokens_their_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))
    some = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>\n", "<|endoftext|", "<|ENDOFTEXT|>", "no such"]
    got = {r.doc_id: r for r in packing.pack(docs(spark, some)).collect()}
    for i, x in enumerate(some):
        ids = [*tok.encode(x, add_special_tokens=False).ids, 1]
        assert got[i].doc_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("n", [10, 16, 50])
def test_chunks_of_few_bytes_have_no_runs(n):
    from loomlog.llm.suffix_dedup import Runs, _zip, covered

    for size in [*range(2 * n + 1), 101]:
        for lens in ([size], [size // 2, size - size // 2], [0, size]):
            body = bytes(97 + i % 3 for i in range(size))
            runs = Runs(np.arange(len(lens)).tobytes(), np.array(lens, dtype=np.int64).tobytes(), _zip(body), n)
            want = sum(max(0, k - n + 1) for k in lens)
            assert int(runs.count.sum()) == want
            runs.shared(3, [])
            if not runs.entries:
                assert not covered(runs, []).any()


def test_one_short_text_per_partition(spark):
    for texts in (["a b c"], ["abc", "", "x" * 9, None, "y" * 49, "z" * 50]):
        d = docs(spark, texts).repartition(len(texts) + 2, "doc_id")
        got = {r.doc_id: r for r in suffix_dedup.removed(d).collect()}
        assert len(got) == len(texts) and all(r.n_removed == 0 and r.n_bytes == len(texts[i] or "") for i, r in got.items())


def test_other_columns_are_handed_on_as_they_are(spark):
    import datetime
    import decimal

    when = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    line = "the same long line of words that is in every one of the documents here, again and again"
    rows = [(i if i else None, f"{line}\nown {i}", when, 7, decimal.Decimal("1.20"), {"k": i}, [i, None], None, "d", "g", None) for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ts timestamp, `_` int, dec decimal(10,2), m map<string,int>, arr array<int>, `a.b` string, `we``ird` string, meta string, c0 int")
    want = {r.doc_id: tuple(r)[2:] for r in d.collect()}
    for make in (line_dedup.dedup, suffix_dedup.dedup, lambda x: simhash.dedup(x, 3), lambda x: quality.keep_good(x, None)):
        out = make(d)
        assert out.columns == d.columns and [f.dataType for f in out.schema.fields] == [f.dataType for f in d.schema.fields]
        got = {r.doc_id: tuple(r)[2:] for r in out.collect()}
        assert got and all(v == want[k] for k, v in got.items())
    for make in (line_dedup.dedup, suffix_dedup.dedup):
        assert make(d.limit(0)).count() == 0 and {r.doc_id for r in make(d).collect()} == set(want)
        assert make(d.select("text", "doc_id")).columns == ["text", "doc_id"]


def test_long_words_merge_in_tiktokens_order():
    import tiktoken

    path = bpe.public_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=ranks, special_tokens={})
    ours, rng = bpe.ByteBPE(ranks, bpe.public_pattern()), random.Random(4)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (1023, 1024, 1025, 5000, 1_000_000)] + ["a" * 9001, "ab" * 4000, "\u65e5\u672c\u8a9e" * 2000]
    assert [x.tolist() for x in ours.encode_batch(texts)] == [enc.encode_ordinary(x) for x in texts]
    assert ours.decode(ours.encode_batch(texts)[4]) == texts[4].encode()


def test_embedding_tables_miss_hardly_any_pair_and_move_ids_and_codes_only():
    bits, tables, most = embedding_dedup.plan(50_000, 0.95)
    rng = np.random.default_rng(7)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b  # all pairs at the threshold
    x, y = embedding_dedup.wide_codes(a), embedding_dedup.wide_codes(b)
    at = embedding_dedup.places(bits, tables)
    met = (embedding_dedup.table_keys(x, at) == embedding_dedup.table_keys(y, at)).any(axis=1)
    near = np.bitwise_count(x ^ y).sum(axis=1) <= most
    assert (met & near).mean() > 0.995
    shown = [embedding_dedup.plan(n, 0.95)[1] * (20 + embedding_dedup.WIDE // 8) for n in (10**4, 10**6, 10**8)]
    assert shown[0] < 1000 and shown[2] < 10_000  # bytes that a vector costs in the tables' shuffle


def test_repeated_vector_ids_stay_apart(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.01]), (3, [1.0, 0.01, 0.0]), (3, [0.0, 0.0, 1.0]), (0, [0.0, 1.0, 0.02])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(d).collect())
    assert got == [(0, 2, 0, True), (1, 1, 1, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True), (3, 1, 1, False)]


@pytest.mark.parametrize("records", ["1", "2", "3", "10000"])
def test_buckets_stream_whatever_the_batches(spark, records):
    from loomlog.llm import shingles

    rng = random.Random(3)
    rows = sorted({(rng.randint(0, 9) ** 2, rng.randint(0, 12)) for _ in range(60)} | {(1000, k) for k in range(30)} | {(5, 5)})
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        got = shingles.met(spark.createDataFrame([(k, x, x + 100) for k, x in rows], "key long, node long, n int")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    by = {}
    for k, x in rows:
        by.setdefault(k, set()).add(x)
    assert sorted((r.key, r.node, r.n) for r in got) == sorted((k, x, x + 100) for k, xs in by.items() if len(xs) > 1 for x in xs)
    assert all(len({(r.leader, r.leader_n) for r in got if r.key == k}) == 1 for k, xs in by.items() if len(xs) > 1)
    assert all(r.leader in by[r.key] and r.leader_n == r.leader + 100 for r in got)


def test_histograms_lose_no_pair():
    from loomlog.llm import shingles

    rng, passed = np.random.default_rng(5), 0
    for n in (1, 4, 5, 9, 40, 300, 5000):
        for _ in range(20):
            a = np.unique(rng.integers(-(2**63), 2**63, n))
            m = int(n * rng.uniform(0.6, 1))
            b = np.unique(np.concatenate([a[:m], rng.integers(-(2**63), 2**63, max(0, n - m))]))
            fits = shingles.may_be_alike(shingles.histogram(a), shingles.histogram(b), len(a), len(b))
            assert fits or not shingles.alike(a.tobytes(), b.tobytes())
            passed += fits and not shingles.alike(a.tobytes(), b.tobytes())
    assert passed < 70
    same = np.arange(3000, dtype=np.int64)  # all in one bucket: the counts are full and tell nothing
    assert shingles.may_be_alike(shingles.histogram(same), shingles.histogram(same + 1), 3000, 3000)


@pytest.mark.parametrize("block", [3, 1000])
def test_blocks_of_a_bucket_meet_pair_by_pair(spark, block):
    import pandas as pd

    from loomlog.llm.common import in_blocks

    rng = random.Random(9)
    rows = [(k, i, rng.randint(0, 50)) for i, k in enumerate([1] * 40 + [2] * 7 + [3] + [4] * 2)]

    def near(pdf, left, right):
        x, y = pdf.v.to_numpy(), pdf.id.to_numpy()
        found = [(y[i], y[j]) for i in range(left.start, left.stop) for j in range(right.start, right.stop) if (i < j if left == right else True) and abs(x[i] - x[j]) <= 2]
        return pd.DataFrame(found, columns=["a", "b"]) if found else None

    got = in_blocks(spark.createDataFrame(rows, "key long, id long, v long"), ["key"], "id", near, "a long, b long", block).collect()
    want = {(i, j) for k, i, v in rows for m, j, w in rows if k == m and i < j and abs(v - w) <= 2}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} == want
    assert in_blocks(spark.createDataFrame([], "key long, id long, v long"), ["key"], "id", near, "a long, b long", block).count() == 0


def test_crossing_pairs_are_those_that_histograms_allow():
    import pandas as pd

    from loomlog.llm import shingles

    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(-(2**63), 2**63, 130))
    sets = [np.unique(np.concatenate([base[: int(len(base) * f)], rng.integers(-(2**63), 2**63, 5)])) for f in (1, 0.97, 0.93, 0.9, 0.5, 0.45)] + [np.unique(rng.integers(-(2**63), 2**63, m)) for m in (120, 130, 3, 4)]
    pdf = pd.DataFrame({"key": 1, "node": range(len(sets)), "component": [0, 0, 1, 2, 3, 4, 5, 6, 7, 8], "n": [len(x) for x in sets], "hist": [shingles.histogram(x) for x in sets]})
    for left, right in ((slice(0, 10), slice(0, 10)), (slice(0, 4), slice(4, 10)), (slice(0, 1), slice(1, 10))):
        got = {(r.b, r.a) for r in shingles.crossing(pdf, left, right).itertuples()}
        want = {(i, j) for i in range(left.start, left.stop) for j in range(right.start, right.stop) if i < j and pdf.component[i] != pdf.component[j] and 5 * min(pdf.n[i], pdf.n[j]) >= 4 * max(pdf.n[i], pdf.n[j]) and shingles.may_be_alike(pdf["hist"][i], pdf["hist"][j], pdf.n[i], pdf.n[j])}
        assert got == want and (left.stop < 10 or want)


def slow_tokens(text):
    """Tokens of a text, one at a time: letters, digits, other characters; each word is followed by its shape."""
    raw, out, before = text.encode(), [], None
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x00-\x20A-Za-z0-9\x80-\xff]", raw):
        w = m[0]
        if w[:1].isdigit():
            out.append("digits")
            continue
        out.append(w)
        if re.match(rb"[A-Za-z\x80-\xff]", w):
            upper = [65 <= c <= 90 for c in w[:2]]
            out.append(("shape", 4 if w == before else 3 if upper[:2] == [True, True] else 1 if upper[0] else 0))
            before = w
    return out


def test_pooling_is_mean_and_spread_of_token_vectors(monkeypatch):
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32))
    texts = ["The cat, THE cat; the Cat the the 12 34!", "", "  \n", "é è é è über Ünter", "a" * 50 + " b1c2", "x y z " * 400, "...", "No no No no"]
    slots = {}
    for text in texts:
        found, bounds = quality.tokens([text])
        want = slow_tokens(text)
        assert len(found) == len(want) == bounds[-1]
        for slot, token in zip(found.tolist(), want, strict=True):  # one slot for each token, the fixed ones for shapes and digits
            assert slots.setdefault(token, slot) == slot
            if isinstance(token, tuple):
                assert slot == token[1]
            elif token == "digits":
                assert slot == quality.SHAPES - 1
    assert len(set(slots.values())) > len(slots) - 3
    for part in (1 << 18, 64):
        monkeypatch.setattr(quality, "PART", part)
        got = model.pool(texts)
        for row, text in zip(got, texts, strict=True):
            v = np.array([model.vectors[slots[t]] for t in slow_tokens(text)], dtype=np.float64).reshape(-1, quality.DIM)
            mean = v.mean(axis=0) if len(v) else np.zeros(quality.DIM)
            spread = np.sqrt(np.maximum((v * v).mean(axis=0) - mean * mean, 0)) if len(v) else np.zeros(quality.DIM)
            if part > len(text):
                assert np.allclose(row, [*mean, *spread], atol=1e-3)  # squares are of single precision


def test_scores_are_the_network_by_hand():
    rng = np.random.default_rng(6)
    model = quality.Model(rng.normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32))
    d = 2 * quality.DIM
    model.mean, model.scale, model.temperature = rng.normal(size=d), rng.uniform(0.5, 2, d), 1.7
    model.layers = [rng.normal(size=(d, 5)), rng.normal(size=5), rng.normal(size=(5, 1)), rng.normal(size=1)]
    texts = ["some words here", "", "OTHER words, 17"]
    x = model.pool(texts)
    for row, got in zip(x, model.score(texts), strict=True):
        z = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale, strict=True)]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, model.layers[0][:, j], strict=True)) + model.layers[1][j]) for j in range(5)]
        logit = sum(h * w for h, w in zip(hidden, model.layers[2][:, 0], strict=True)) + model.layers[3][0]
        assert got == pytest.approx(1 / (1 + math.exp(-logit / 1.7)))


def lines_kept(texts):
    """Line dedup by brute force: id -> text."""
    fields = lambda line: ["<*>" if re.search(r"\d", w) else w for w in line.split()]
    owners, leaves, keeper = {}, {}, {}
    for i, text in texts.items():
        for line in text.split("\n"):
            w = fields(line)
            if w:
                owners.setdefault(" ".join(w), set()).add(i)
                leaves.setdefault((len(w), *w[:3]), set()).add(" ".join(w))
    for lines in leaves.values():
        known = []
        for line in sorted(lines):
            w = line.split(" ")
            same = [sum(a == b for a, b in zip(k, w, strict=True)) for k, _ in known]
            if same and max(same) >= 0.8 * len(w):
                best = known[same.index(max(same))]
                best[0][:] = [a if a == b else "<*>" for a, b in zip(best[0], w, strict=True)]
                best[1].append(line)
            else:
                known.append((w, [line]))
        for _, members in known:
            ids = set().union(*(owners[m] for m in members))
            if len(ids) >= 3:
                keeper |= dict.fromkeys(members, min(ids))
    return {i: "\n".join(x for x in text.split("\n") if keeper.get(" ".join(fields(x)), i) == i) for i, text in texts.items()}


def group_firsts(texts):
    """Ids that are the smallest of their group of 5-word shingle sets of likeness 0.8 and more."""
    ids = sorted(texts)
    w = {i: texts[i].lower().split() for i in ids}
    sets = {i: {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set() for i, x in w.items()}
    low = smallest(len(ids), lambda a, b: jaccard(sets[ids[a]], sets[ids[b]]) >= 0.8)
    return {ids[k] for k in low}


def passages_cut(texts):
    held, out = {}, {}
    for i, x in texts.items():
        b = x.encode()
        for p in range(len(b) - 49):
            held[b[p : p + 50]] = min(held.get(b[p : p + 50], i), i)
    for i, x in texts.items():
        b = x.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if held[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(21)
    base = [words(rng, rng.randint(20, 80)) + "." for _ in range(40)]
    passage = words(rng, 25)
    good = [*base, *[b + " " + words(rng, 2) for b in base[:8]], *base[8:12], *[words(rng, 30) + "\n" + passage + "\n" + words(rng, 30) for _ in range(6)], *[words(rng, 12) + "\nRead on at page 7 of the site\n" + words(rng, 9) for _ in range(5)]]
    junk = [" | ".join(words(rng, 30).split()) for _ in range(30)]
    texts = [*good, *junk]
    rng.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(t in good), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = quality.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    left = {i: t for (i, t), s in zip(enumerate(texts), model.score(texts), strict=True) if s >= 0.5}
    assert 0 < len(left) < len(texts)
    left = lines_kept(left)
    firsts = group_firsts(left)
    assert len(firsts) < len(left) - 8
    left = passages_cut({i: left[i] for i in firsts})
    rows = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    tok = Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))
    assert set(rows.doc_id) == set(left)
    for i, part in rows.sort_values("start").groupby("doc_id"):
        ids, at = [*tok.encode(left[i], add_special_tokens=False).ids, 1], 0
        for r in part.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_next_documents_of_null_ids(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "WINDOW_DOCS", 3)
    rng = random.Random(4)
    texts = [words(rng, 20) for _ in range(30)]
    ids = [None] * 12 + list(range(18))
    rows = spotsigs.with_next(docs(spark, texts, ids)).collect()
    after = {r.text: r.next_text for r in rows}
    assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(map(repr, ids)) and sorted(after.values()) == sorted(texts)
    for i in range(1, 18):
        assert after[texts[12 + i]] == texts[11 + i]
    assert after[texts[12]] in texts[:12] and sum(after[t] in texts[:12] for t in texts[:12]) == 11  # null ids come last, then the first again
    alone = spotsigs.with_next(docs(spark, texts[:5], [None] * 5)).collect()
    assert sorted(r.next_text for r in alone) == sorted(texts[:5])


def test_lines_of_a_template_meet_however_many_others_their_leaf_has(spark):
    rng = random.Random(17)
    three = [f"a b c {x} same words in all of them" for x in ("red", "green", "blue")]
    texts = [f"own {words(rng, 3)}\n{x}" for x in three]
    crowd = ["\n".join(f"a b c {i} {j} {k}" + f" {rng.randrange(9**9):o}q" * 4 for j in "xyz" for k in "uvw") for i in range(2400)]  # 21,600 lines of that leaf
    crowd = [re.sub(r"\d", lambda d: "ghijklmnop"[int(d[0])], x) for x in crowd]
    assert len({x for t in crowd for x in t.split("\n")}) == 21_600
    few = {r.doc_id: r.kept for r in line_dedup.cleaned(docs(spark, texts)).collect()}
    assert few == lines_kept(dict(enumerate(texts))) and three[1] not in few[1]
    got = {r.doc_id: r.kept for r in line_dedup.cleaned(docs(spark, texts + crowd)).collect()}
    assert {i: got[i] for i in few} == few and [got[i + 3] for i in range(2400)] == crowd


@pytest.mark.parametrize("scanned", [1, 5, 64])
def test_templates_found_by_runs_are_those_of_a_scan(monkeypatch, scanned):
    monkeypatch.setattr(line_dedup, "SCANNED", scanned)
    rng = random.Random(scanned)
    for width in [*range(1, 16), 25]:
        base = [[rng.choice("abcdef") for _ in range(width)] for _ in range(40)]
        some = [[rng.choice(["<*>", *"abcdef"]) if rng.random() < 0.15 else t for t in rng.choice(base)] for _ in range(300)]
        some = [x.split(" ") for x in sorted({" ".join(x) for x in some})]
        known, want = [], []
        for w in some:
            same = [sum(a == b for a, b in zip(k, w, strict=True)) for k in known]
            best = same.index(max(same)) if same and max(same) >= 0.8 * width else len(known)
            if best == len(known):
                known.append(w)
            known[best] = [a if a == b else "<*>" for a, b in zip(known[best], w, strict=True)]
            want.append(best)
        assert line_dedup.templates(some, 0.8) == want


def test_quality_sample_is_bounded_however_often_ids_repeat(spark, monkeypatch):
    """One row an id: the label that is largest, the text of smallest hash."""
    many = docs(spark, [f"good words here {i % 7}" if i % 2 else f"!!! ??? {i % 5}" for i in range(60)] * 5, list(range(60)) * 5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 3, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Model, "train", lambda self, x, y, aside: seen.append(len(y)))
    assert quality.fit(many, labels, sample_rows=10) is not None and seen == [10]


def test_texts_of_a_megabyte_and_repeated_ids(spark):
    """Long texts and repeated ids are rows like others."""
    rng = random.Random(5)
    long = " ".join(words(rng, 50) for _ in range(5000))
    table = docs(spark, [long, long + " end", "short text", None, long], [1, 1, 2, 2, 3])
    assert len(long) > 1_000_000
    assert sorted(r.doc_id for r in simhash.fingerprints(table, 3).collect()) == [1, 1, 2, 2, 3]
    assert sorted(r.doc_id for r in line_dedup.cleaned(table).collect()) == [1, 1, 2, 2, 3]
    packed = packing.pack(table).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3}
    assert len(quality.score(table, None).collect()) == 5


def test_common_shingles_lose_no_pair():
    """Prefixes of sets with a likeness of 4/5 meet whatever is called common: the sample decides on an order only."""
    from loomlog.llm import shingles

    rng = np.random.default_rng(9)
    for _ in range(300):
        both = rng.choice(1 << 20, size=rng.integers(4, 200), replace=False).astype(np.int64)
        spare = len(both) // 4
        one = rng.integers(0, spare + 1)
        a = np.sort(np.concatenate([both, (1 << 21) + np.arange(one)]))
        b = np.sort(np.concatenate([both, (1 << 22) + np.arange(rng.integers(0, spare - one + 1))]))
        assert shingles.alike(a.tobytes(), b.tobytes())
        for common in (np.zeros(0, dtype=np.int64), both, np.sort(rng.choice(both, size=len(both) // 2, replace=False)), a):
            assert np.intersect1d(shingles.prefix(a, np.sort(common)), shingles.prefix(b, np.sort(common))).size
