"""Every operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shiprisk.llm import bpe, chat, embedding_dedup, license_scan, packing, records, secret_scan, simhash, tokens, topk, toxicity
from shiprisk.llm.common import connected_components, ship, stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, fp string, length int, ids string"


def documents(spark, texts, ids=None):
    ship(spark)
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 7, "x", 1, "y") for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma.", "délta", "don't", "$$$", "x1", "\n", "", "日本", "<|endoftext|>", "a" * 300]
    out = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)]
    return [*out, None, "", " ", "  \n ", out[3], out[3], "long " * 9000, "one", "two words"]


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(50, 120), rng.randint(50, 120)) for _ in range(60)] + [(3, 3), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups(121, links)
    assert got == {i: want[i] for i in range(121) if any(i in x and x[0] != x[1] for x in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tokens_equal_the_library(texts):
    encoder = tokens.encoder(tokens.default_vocabulary())
    own = bpe.rank_encoder(tokens.default_vocabulary())
    for t in [t or "" for t in texts] + ["a  b", "a \n b", " a", "a\n\n b ", "x\nYz, w"]:
        whole = encoder.whole(t)
        assert encoder.encode(t) == whole == own.encode(t)
        assert own.decode(whole) == t


def test_a_memo_of_its_own_size_changes_no_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 20)
    assert records.WORDS > 1_000_000  # a writing task holds little else
    memo = tokens.WordEncoder(tokens.default_vocabulary(), 40)
    rng, sizes = random.Random(8), []
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcé,", k=rng.choice([1, 5, 90]))) for _ in range(rng.randint(0, 12)))
        assert memo.encode(text) == memo.whole(text)
        sizes.append(len(memo.words))
        assert all(len(w) <= tokens.LONG for w in memo.words)
    assert 20 < max(sizes) <= 40


def test_full_word_memos_change_no_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 20)
    rng = random.Random(9)
    encoder = tokens.WordEncoder(tokens.default_vocabulary())
    for _ in range(2000):
        t = "".join(rng.choice(["a", "the", "'s", "\n", " ", "  ", "\t", "\x1c", "\u00a0", "é", "日", "1", "!", "\r\n"]) for _ in range(12))
        assert encoder.encode(t) == encoder.whole(t)
        assert len(encoder.odd) <= 20


def test_tested_runs_are_those_outside_base_spans():
    rng = random.Random(2)
    key, run, line = "AKIA" + "7Q" * 10, "0123456789abcdef" * 2, "Zk3" * 9
    for _ in range(200):
        text = rng.choice(["", " "]).join(rng.choice([key, run, line, "token=", "x ", "=", "é"]) for _ in range(rng.randint(0, 12)))
        base = secret_scan.base_spans(text)
        got = {c[:2] for c in secret_scan.candidates(text, base)}
        for m in secret_scan.CANDIDATE.finditer(text):
            inside = any(a <= m.start() and m.end() <= b for a, _, b in base)
            mixed = re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())
            assert (m.span() in got) == bool(not inside and mixed and secret_scan.battery(m.group()))


def test_bpe_round_trip(spark, texts):
    got = bpe.decode(bpe.encode(documents(spark, texts))).orderBy("doc_id").collect()
    assert [r.text for r in got] == [t or "" for t in texts]
    assert bpe.encode(documents(spark, [])).count() == 0


def test_packing(spark, texts):
    got = packing.pack_documents(documents(spark, texts), capacity=64, keep_ids=True)
    rows = got.toPandas().sort_values(["sequence_id", "offset"])
    sizes = rows.groupby("sequence_id").length
    assert (sizes.cumsum() - rows.length == rows.offset).all() and sizes.sum().max() <= 64
    encoder = tokens.encoder(tokens.default_vocabulary())
    for i, t in enumerate(texts):
        ids = encoder.whole(t or "") + bytes(4)
        own = rows[rows.doc_id == i].sort_values("piece")
        assert b"".join(map(bytes, own.ids)) == ids and list(own.start) == [0, *own.length.cumsum()[:-1]]
        assert (own.length[1:] == 64).all() and list(own.ids_crc32) == [zlib.crc32(x) for x in own.ids]
    # not above best-fit decreasing by more than one sequence in a hundred, or one
    gaps, n = [], 0
    for size in sorted(rows.length, reverse=True):
        fit = min((g for g in gaps if g >= size), default=None)
        if fit is None:
            n, fit = n + 1, 64
        else:
            gaps.remove(fit)
        gaps.append(fit - size)
    assert rows.sequence_id.nunique() <= n * 1.01 + 1
    joined = {r.sequence_id: r for r in packing.sequences(got).collect()}
    assert len(joined) == rows.sequence_id.nunique() and all(len(r.ids) == 4 * r.n_ids for r in joined.values())
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_packing_many_equal_lengths(spark):
    got = packing.pack_documents(documents(spark, [""] * 500 + ["alpha beta"] * 100, [None] * 600), capacity=32).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 32 and len(got) == 600
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 32) + 1


def test_records(spark, texts, tmp_path):
    ids = [5, 5, None, *range(10, 7 + len(texts))]
    folder = f"file://{tmp_path}/out"
    index = records.write_records(documents(spark, texts, ids), folder, file_bytes=20_000)
    rows = records.number_records(records.read_records(index, folder, records._crc, records.READ), index).orderBy("start").toPandas()
    encoder = tokens.encoder(tokens.default_vocabulary())
    order = sorted(range(len(ids)), key=lambda i: (-1 if ids[i] is None else ids[i], i))
    want = [encoder.whole(texts[i] or "") + (2).to_bytes(4, "little") for i in order]
    assert list(rows.ids_crc32) == [zlib.crc32(x) for x in want]
    assert list(rows.start) == [0, *np.cumsum([len(x) // 4 for x in want])[:-1].tolist()]
    shuffled = index.where("doc_id % 2 = 0").orderBy(F.rand(3))
    assert records.read_records(shuffled, folder, records._crc, records.READ).count() == sum(i is not None and i % 2 == 0 for i in ids)
    with pytest.raises(ValueError):
        records.unframe([b"\x01" + records.frame([b"payload"])[0][1:]])
    assert records.crc32c([b"123456789", b""]) == [0xE3069283, 0]
    empty = records.write_records(documents(spark, []), f"file://{tmp_path}/none")
    assert empty.count() == 0


def test_exact_top_k(spark):
    rng = np.random.default_rng(0)
    v = np.floor(rng.normal(size=(300, 8)) * rng.lognormal(1.5, 1, size=(300, 1)))
    v[5], v[100:160] = 0, v[40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1020, [float("nan")] * 8), (1040, []), (None, v[0].tolist()), (1060, [1.0, None])]
    got = topk.top_k(spark.createDataFrame(rows, "id long, v array<double>"), F.col("id") % 20 == 0, bucket=32).collect()
    want = set()
    for q in range(0, 300, 20):
        scores = v @ v[q]
        order = [j for j in np.lexsort((np.arange(300), -scores)) if j != q][:20]
        want |= {(q, r + 1, int(j), int(scores[j])) for r, j in enumerate(order)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(spark.createDataFrame([], "id long, v array<double>"), F.col("id") % 20 == 0).count() == 0


def test_licenses(spark):
    mit = "Released under the MIT License"
    texts = [f"Thing of reed. {mit}.\nThe end", None, "", f"{mit}. " + "word of the " * 5000 + f"{mit}!", "the of a under", "Released under the MIT Licence",
             "this work is LICENSED under the gnu general public license,\n version 3.", license_scan.TEMPLATES["MIT-text"]]
    got = {r.doc_id: r.licenses for r in license_scan.find_licenses(documents(spark, texts)).collect()}
    assert [x.name for x in got[0]] == ["MIT"] and texts[0][got[0][0].start:got[0][0].end] == mit
    assert got[1] == got[2] == got[4] == [] and [x.name for x in got[3]] == ["MIT", "MIT"]
    assert got[5][0].coverage == 0.8 and [x.name for x in got[6]] == ["GPL-3.0"] and [x.name for x in got[7]] == ["MIT-text"]
    rng = random.Random(2)
    for _ in range(200):  # anchors, their order, and no word twice
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert license_scan.align(list("xabcy"), list("abc")) == [(1, 0), (2, 1), (3, 2)]


def test_every_license_line_gets_a_span(spark):
    line = re.compile(r"(?:licensed|released|dedicated|licence) (?:under|to) [^\n]*", re.IGNORECASE)
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("text").rlike("(?i)licen[sc]ed? |released under"))
    text = {r.doc_id: r.text for r in d.collect()}
    found = {r.doc_id: r.licenses for r in license_scan.find_licenses(d).collect()}
    n = 0
    for i, t in text.items():
        for m in line.finditer(t):
            n += 1
            assert [x for x in found[i] if x.start < m.end() and m.start() < x.end], m.group()
    assert n >= 262
    assert {x.name for x in found[39]} == {"CC-BY-NC-4.0-line"}


def test_similar_notices_are_told_apart():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    for name in license_scan.LINES:
        t = license_scan.TEMPLATES[name]
        assert scanner.scan(f"Before it. {t}. After it") == [(11, 11 + len(t), name, 1.0)]
    assert scanner.scan("Licensed under the Example License") == []
    for name in ("GPL-2.0-header", "GPL-3.0-header", "Apache-2.0-header"):
        names = [x[2] for x in scanner.scan(license_scan.TEMPLATES[name])]
        assert names == (["Apache-2.0", name] if name == "Apache-2.0-header" else [name])


def test_repeated_notices_are_all_found():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    for name in ("GPL-3.0", "Apache-2.0", "MIT", "CC-BY-NC-4.0-line", "CC-BY-4.0-id", "CC-BY-SA-4.0", "ISC-text"):
        t = license_scan.TEMPLATES[name].rstrip(".")
        for before in range(8):
            text = "other " * before + f"{t}.\n" * 100
            at = [6 * before + i * (len(t) + 2) for i in range(100)]
            assert scanner.scan(text) == [(a, a + len(t), name, 1.0) for a in at]
    header = license_scan.TEMPLATES["Apache-2.0-header"]
    assert [x[2] for x in scanner.scan(f"one {header} " * 20)].count("Apache-2.0-header") == 20
    both = "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC-SA 4.0."
    assert [x[2] for x in scanner.scan(both)] == ["CC-BY-NC-4.0-line", "CC-BY-NC-SA-4.0-line"]
    spoilt = "Released under the great MIT License. Released by the MIT License. " * 30  # one word more, one changed
    assert [round(x[3], 1) for x in scanner.scan(spoilt)] == [1.0, 0.8] * 30
    assert license_scan.apart({(12, 0, 20), (11, 0, 12), (11, 12, 24)}) == [(11, 0, 12), (11, 12, 24)]


def test_secrets(spark):
    rng = random.Random(3)
    key = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=48))
    texts = [f"é token = \"{'0af3' * 10}\" and AKIA{'Q7' * 8}", None, "", f"see {key} here", "Password:short secret: token: abcdefgh", "k " * 30_000 + "api_key=abc.def=1",
             "tokens " + "gh" * 18 + "1 x", "paſſword=abcdefgh"]
    got = {r.doc_id: r for r in secret_scan.find_secrets(documents(spark, texts)).collect()}
    name = lambda i: [(secret_scan.KINDS[s.kind], texts[i][s.start:s.end]) for s in got[i].spans]
    assert name(0) == [("assign", f"token = \"{'0af3' * 10}"), ("hex", "0af3" * 10), ("access", f"AKIA{'Q7' * 8}")]
    assert got[1].spans == got[2].spans == [] and name(3) == [("random", key)]
    assert name(4) == [] and name(5) == [("assign", "api_key=abc.def=1")] and name(7) == []
    assert name(6) == []
    kept = {r.doc_id: r for r in secret_scan.redact(documents(spark, texts)).collect()}
    assert kept[3].text == "see [SECRET] here" and kept[3].n_chars == len(kept[3].text) and kept[4].text == texts[4] and kept[1].text is None
    assert secret_scan.redact(documents(spark, [])).columns == documents(spark, []).columns
    assert secret_scan.redact(documents(spark, [])).count() == 0 and secret_scan.find_secrets(documents(spark, [])).count() == 0
    clash = secret_scan.redact(documents(spark, texts).withColumn("_redacted", F.lit("own")))
    assert {(r.doc_id, r.text, r._redacted) for r in clash.collect()} == {(i, r.text, "own") for i, r in kept.items()}


def test_parts_of_runs_are_tested(spark):
    rng = random.Random(5)
    draw = lambda symbols, n: "".join(rng.choices(symbols, k=n))
    key, text = draw(secret_scan.ALPHABETS[5], 40), "w" * 30
    letters = draw("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 20)
    aws = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    lines = {f"aws_secret_access_key={aws}": [aws], f"CLIENT_KEY={key}==": [f"{key}=="], f"see /srv/my-app_1/{key}-/x": None,
             f"key {letters} here": [letters], "internationalisation and Kraftfahrzeughaftpflichtversicherung": [], "home/user/documents/projects": [],
             "the_long_name_of_an_option=the_long_name_of_its_value": [], f"{text}={text}": []}
    texts = list(lines) + [f"{text} {i}" for i in range(30)]
    got = {r.doc_id: r for r in secret_scan.find_secrets(documents(spark, texts)).collect()}
    for i, (t, want) in enumerate(lines.items()):
        spans = [t[x.start:x.end] for x in got[i].spans]
        assert all(s.kind == 3 for s in got[i].spans)
        assert spans == want if want is not None else any(key in x for x in spans), (t, spans)
    kept = {r.doc_id: r.text for r in secret_scan.redact(documents(spark, texts)).collect()}
    assert kept[0] == "aws_secret_access_key=[SECRET]" and kept[1] == "CLIENT_KEY=[SECRET]" and key not in kept[2] and letters not in kept[3]


def test_randomness_battery():
    rng = random.Random(4)
    for k, n, draws in [(0, 20, 8000), (5, 32, 8000), (5, 50, 8000), (6, 128, 4000), (7, 64, 4000)]:
        tested = [secret_scan.battery("".join(rng.choices(secret_scan.ALPHABETS[k], k=n))) for _ in range(draws)]
        p = [np.exp(x[1]) for x in tested if x[0] == k]
        for level in (0.1, 0.01, 0.001):
            expected = level * len(p)
            assert abs(sum(x < level for x in p) - expected) <= 0.2 * expected + 4 * expected ** 0.5 + 1, (k, n, level)
    assert secret_scan.battery("abababababababababababababababab12")[1] < np.log(1e-6)
    assert secret_scan.battery("no encoding!") is None


def test_planted_keys_against_identifiers(spark):
    rng = random.Random(8)
    own = "alpha beta gamma delta report invoice customer balance planning river mountain garden window".split()
    camel = lambda n: "get" + "".join(rng.choice(own).capitalize() for _ in range(n)) + rng.choice(["", "2"])
    names = ["getUserAccountInformation2"] + [camel(rng.randrange(4, 9)) for _ in range(150)] + ["_".join(rng.choices(own, k=6)) for _ in range(150)]
    keys = ["".join(rng.choices(secret_scan.ALPHABETS[rng.choice([2, 5, 5, 6])], k=rng.choice([20, 24, 32, 40, 64]))) for _ in range(100)]
    texts = [f"see {x} here" for x in names + keys] + [" ".join(rng.choices(own, k=80)) for _ in range(200)]
    got = [bool(r.spans) for r in sorted(secret_scan.find_secrets(documents(spark, texts)).collect(), key=lambda r: r.doc_id)]
    false, found = sum(got[:len(names)]), sum(got[len(names):len(names) + len(keys)])
    assert not got[0] and found >= 90 and false <= 0.1 * (false + found) and not any(got[len(names) + len(keys):])
    kept = {r.doc_id: r.text for r in secret_scan.redact(documents(spark, texts)).collect()}
    assert all((kept[i] != t) == got[i] for i, t in enumerate(texts))


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    ids = [*range(100, 100 + len(texts) - 1), None]
    got = simhash.near_duplicates(documents(spark, texts, ids)).collect()
    want = [brute_fingerprint(t) for t in texts]
    assert sorted((r.doc_id or 0, r.fp % (1 << 64)) for r in got) == sorted((i or 0, f) for i, f in zip(ids, want))
    links = [(a, b) for a in range(len(want)) for b in range(a) if (want[a] ^ want[b]).bit_count() <= 2]
    component = groups(len(want), links)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {i: ids[c] for i, c in zip(ids, component) if i}
    kept = simhash.keep_one(documents(spark, [*texts, texts[0]], [*ids, ids[0]]))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted({i for i, c in zip(ids, component) if i and ids[c] == i} | {0})
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_keep_one_by_row(spark):
    """Ids that are null or repeat, over the same and over other texts: one row for each component, that of the least (id, fingerprint)."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(6)]
    rows = [(5, 0), (5, 1), (3, 1), (7, 2), (7, 3), (None, 4), (None, 4), (None, 0), (9, 5), (9, 5), (8, 5), (4, 2)]
    docs = documents(spark, [texts[t] for _, t in rows], [i for i, _ in rows])
    got = sorted(((r.doc_id, texts.index(r.text)) for r in simhash.keep_one(docs).collect()), key=str)
    want = sorted(((min((i for i, u in rows if u == t and i is not None), default=None), t) for t in range(6)), key=str)
    assert got == want and simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(documents(spark, [])).count() == 0
    clash = docs.select("doc_id", "text").withColumn("_fp", F.lit(1))
    assert sorted(r.text for r in simhash.keep_one(clash).collect()) == sorted(texts)


def test_grid_points_are_never_broadcast(spark):
    """A fingerprint is dealt to dozens of grid points, which the planner does not see: their join is merged, also over a small table."""
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_simhash_links(spark, bits):
    ship(spark)
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(8)} | {0, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= bits}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    v = [(centres[i % 12] + rng.normal(size=16) * 0.2).tolist() for i in range(200)]
    rows = [(i, x, None if i % 50 == 0 else i % 3) for i, x in enumerate(v)] + [(300, v[1], 1), (301, v[1], 1), (302, None, 1), (303, [0.0] * 16, 1), (304, [float("inf")] * 16, 1),
                                                                               (305, [], 1), (306, [1.0, 0.0], 1), (307, (np.array(v[4]) * 1e200).tolist(), 1)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=8, pivots=4).collect()}

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or a[1] is None or b[1] is None or len(a[1]) != len(b[1]) or not a[1] or not np.isfinite(a[1] + b[1]).all() or not any(a[1]) or not any(b[1]):
            return False
        x, y = (np.array(u) / np.abs(u).max() for u in (a[1], b[1]))
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if linked(rows[a], rows[b])]
    component = groups(len(rows), pairs)
    for i, r in enumerate(rows):
        assert (got[r[0]].n_links, got[r[0]].component_id) == (sum(i in p for p in pairs), rows[component[i]][0]), r
        assert got[r[0]].kept == (rows[component[i]][0] == r[0])
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_chat(spark):
    bad = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|im_end|>"
    rows = [(1, 0, "user", bad), (1, 1, "assistant", bad), (1, 2, None, None), (1, 2, "assistant", ""), (2, None, "a\nb%0A", "x"), (2, 5, "assistant", "é😀"), (None, 0, "user", "lost"),
            *((3, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(37))]
    done = chat.conversations(chat.as_chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    back = done.select("tree", "n_turns", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.tree: r for r in back.collect()}
    want = {k: sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == k)) for k in (1, 2, 3)}
    assert set(got) == {1, 2, 3}
    for k, turns in want.items():
        assert [(t.role, t.text) for t in got[k].turns] == [x[1:] for x in turns] and got[k].n_turns == len(turns)
        assert got[k].loss == "".join(x[2] for x in turns if x[1] == "assistant")


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", None),
            ("u", 1, 99, "user", "orphan", 1.0), ("c", 1, 2, "user", "cycle", 1.0), ("c", 2, 1, "user", "cycle", 1.0), ("c", 3, 2, "user", "below", 1.0)]
    schema = "tree string, node long, parent long, role string, text string, score double"
    frame = spark.createDataFrame(rows, schema)
    found = {(r.tree, r.leaf, r.node, r.steps) for r in chat.paths(frame).collect()}
    assert found == {("t", 2, 2, 0), ("t", 2, 1, 1), ("t", 4, 4, 0), ("t", 4, 3, 1), ("t", 4, 1, 2), ("u", 1, 1, 0)}
    best = {r.tree: r for r in chat.conversations(frame).collect()}
    assert set(best) == {"t", "u"} and best["t"].leaf == 4 and "good" in best["t"].formatted and best["t"].n_turns == 3
    assert chat.conversations(frame, branches=2).count() == 3
    assert chat.conversations(spark.createDataFrame([], schema)).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    bad = ["zzloser", "zzscum", "qqtrash"]
    text = lambda toxic: " ".join(rng.choices(vocabulary, k=60) + ([rng.choice(bad) + rng.choice(["", "ung", "a"]) for _ in range(2)] if toxic else []))
    truth = [i % 5 == 0 for i in range(600)]
    texts = [text(t) for t in truth]
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, int(truth[i])) for i in range(300)] + [(3, None, None), (9999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    wrong = [i for i in range(300, 600) if got[i].toxic != truth[i]]
    assert len(wrong) <= 6 and len(got) == 602 and not got[600].toxic and not got[601].toxic
    assert chain.categories == ("junk", "toxic", "severe") and all(len(w) == toxicity.FOLDS + 1 for w in chain.weights)
    kept = toxicity.filter_clean(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got.values())
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("toxic").count() == 0


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = labels.where("doc_id % 3 > 0")
    scored = toxicity.score(docs, toxicity.train(docs, known)).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id")
    n = {(r.truth, r.toxic): r.n for r in scored.groupBy("truth", "toxic").agg(F.count("*").alias("n")).collect()}
    assert n.get((1, True), 0) >= 0.9 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * n[(0, False)]


def test_pipeline(spark):
    import corpus_pipeline as cp
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = cp.run(spark, d).toPandas()
    stages, at = [], docs
    for name, function in cp.STAGES[:3]:
        at = stage(function(spark, at, d), "test")
        assert at.columns == docs.columns
        stages.append({r.doc_id: r for r in at.collect()})
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))).collect() if r.toxic}
    all_docs = {r.doc_id: r for r in docs.collect()}
    assert set(stages[0]) == set(all_docs) - bad
    ids = sorted(stages[0])
    fps = [brute_fingerprint(all_docs[i].text) for i in ids]
    component = groups(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert set(stages[1]) == {ids[c] for c in component} == set(stages[2]) == set(rows.doc_id)
    encoder = tokens.encoder(tokens.default_vocabulary())
    want = {i: len(encoder.whole(r.text or "")) // 4 + 1 for i, r in stages[2].items()}
    assert rows.groupby("doc_id").length.sum().to_dict() == want and rows.groupby("sequence_id").length.sum().max() <= 2048
