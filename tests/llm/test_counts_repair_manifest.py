"""Token counts, conversation repair and Merkle manifests against brute force; SQL of the queries that have it."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from shiprisk.llm import catalog, merkle, oracles, repair, token_counts
from shiprisk.llm.common import ship

SF = "/root/testdata/sf0.001"


def table(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# Token counts --------------------------------------------------------------
def whole_counts(rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_vocabulary())
    return sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows), key=str)


def counted_rows():
    rng = random.Random(1)
    words = ["hello", "the", "straße", "日本語", "aaaaaaaaaaaa", "\n", "  ", "é", "😀", "</s>", "http://a.b/c?d=e", "0\x00▁"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", ""]) for _ in range(rng.randint(0, 400)))) for i in range(30)]
    return [*rows, (100, None), (101, ""), (102, " "), (103, "a" * 5000), (104, "ab" * 3000 + " x" * 300), (104, "a" * 5000), (None, "x y" * 500), (105, " " * 3000)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (40, 4)])
def test_token_counts(spark, chunk, overlap):
    rows = counted_rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, uid string, n_tokens int")
    assert sorted(map(tuple, token_counts.count_tokens(df, chunk=chunk, overlap=overlap).collect()), key=str) == whole_counts(rows)


def test_token_counts_of_nothing(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_common_token_widens(spark):
    """Equal letters leave chunks out of step: no seam of the first round is spliced, and the count is right all the same."""
    rows = [(1, "a" * 1003)]
    first = token_counts._first_pass(spark.createDataFrame(rows, "doc_id long, text string"), token_counts.default_vocabulary(), 50, 12)
    ship(spark)
    spliced = token_counts._spliced(token_counts._encoded(first.where("uid is not null"), token_counts.default_vocabulary(), 50, 12))
    assert [r.n_tokens for r in spliced.collect()] == [None]
    assert sorted(map(tuple, token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), chunk=50, overlap=12).collect())) == whole_counts(rows)


def test_token_counts_by_tokenizers(spark):
    from shiprisk.llm import tokens

    path = tokens.default_vocabulary()
    rows = [(i, t) for i, t in counted_rows() if t]
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, 64, 16).collect()}
    assert got == {(i, len(t.encode())): len(tokens.encoder(path).whole(t)) // 4 for i, t in rows}


def test_op11(spark, tmp_path):
    rows = [(1, "word " * 4096), (2, "word " * 4095), (3, None)]
    folder = table(spark, rows, "doc_id long, text string", tmp_path, "documents")
    got = sorted(map(tuple, token_counts.op11_token_counts(spark, folder).collect()))
    assert got == [(i, b, n, n > 4096) for i, b, n in whole_counts(rows)] and [x[3] for x in got] == [True, False, False]


# Conversation repair -------------------------------------------------------
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, audit, repaired) of (role, text, fault) rows: least (cost, audit) first from a heap of all edits."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        seen.add((i, state))

        def push(edit, price, role, text, done, initial=None):
            to = state if role is None else FOLLOWS.get((state, role[:1] if initial is None else initial))
            if to is not None:
                heapq.heappush(heap, (cost + price, audit + edit, i + done, to, out if role is None else (*out, (role, text))))
        for role in ("user", "assistant"):
            push("I", 5, role, "", 0)
        if i < len(rows):
            own, text, fault = rows[i]
            push("D", 2, None, None, 1)
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                push("R", 1 + extra, "user", text, 1)
                push("R", 1 + extra, "assistant", text, 1)
                push("K", extra, own, text, 1)


def repaired(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = []
        for turn, role, text in (r[1:] for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if d:
                text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
                turns += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            end = text.rstrip("\x20\t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, kept = cheapest([(role, text, f) for (_, role, text), f in zip(turns, faults)])
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in kept).encode()).hexdigest()
        out.append((conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("kinds", ["uuuaaassxUAS1234", "uaua1s", "aaU", "sssu"])
def test_search_is_optimal(kinds):
    rng = random.Random(kinds)
    for _ in range(300):
        marks = "".join(rng.choices(kinds, k=rng.randint(0, 14)))
        rows = [("suax"[repair.GONE.index(c)], "", "blank") if c in repair.GONE else (c.lower(), "", "truncated" if c.isupper() else None) for c in marks]
        cost, audit, _ = cheapest(rows)
        assert repair.search(marks, 0, (0, 3))[:2] == (cost, audit)
        cut = [marks[i:i + 3] for i in range(0, len(marks), 3)]
        parts = [[dict(zip(("entry", "exit", "cost", "audit"), x)) for x in repair.answers(s, i == 0, i == len(cut) - 1)] for i, s in enumerate(cut)]
        if parts:
            whole, steps = repair.chain(parts)
            assert (whole, "".join(a for _, a in steps)) == (cost, audit)


def test_op12(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 4)  # conversations of several segments
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(12)]), rng.choice([None, "", "user", "assistant", "system", "tool", "User"]),
             rng.choice([None, "", " \n", "Hi.", "What? ", "abc", "é!\x0b", "x" * 50 + "."]), "clash") for _ in range(200)]
    folder = table(spark, rows, "conv_id long, turn long, role string, text string, mark string", tmp_path, "conversations")
    assert sorted(map(tuple, repair.op12_conversation_repair(spark, folder).collect()), key=str) == repaired([r[:4] for r in rows])


def test_long_conversation_and_none(spark, tmp_path):
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["A b.", "cut", "", f"n{i}!"])) for i in range(700)]
    folder = table(spark, rows, "conv_id long, turn long, role string, text string", tmp_path / "long", "conversations")
    assert list(map(tuple, repair.op12_conversation_repair(spark, folder).collect())) == repaired(rows)
    folder = table(spark, [], "conv_id long, turn long, role string, text string", tmp_path / "none", "conversations")
    assert repair.op12_conversation_repair(spark, folder).collect() == []


def test_conversation_that_is_dropped_whole(spark, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    folder = table(spark, [(conv, 0, "user", "x.")], "conv_id long, turn long, role string, text string", tmp_path, "conversations")
    assert list(map(tuple, repair.op12_conversation_repair(spark, folder).collect())) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# Merkle manifest -----------------------------------------------------------
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proved(rows, fanout=16):
    def leaf(row):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def siblings(levels, i):
        for nodes in levels[:-1]:
            base = i // fanout * fanout
            yield nodes[base:i], nodes[i + 1:base + fanout]
            i //= fanout

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((r, leaf(r)) for r in rows if r[1] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, tree([h for _, h in own])))
    top, out = tree([t[-1][0] for _, t in trees]), []
    for g, (own, t) in enumerate(trees):
        for i, (row, h) in enumerate(own):
            path, folded = [*siblings(t, i), *siblings(top, g)], h
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                folded = leaf((*row[:4], row[4].translate({c: c + 32 for c in range(65, 91)})))
            for before, behind in path:
                folded = sha(*before, folded, *behind)
            out.append((row[0], h, t[-1][0], top[-1][0], sha(*(x for a, b in path for x in a + b)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def leaf_rows():
    rng = random.Random(3)
    return [(rng.choice([None, *range(200)]), rng.choice([None, "", "a", "a", "a", "b", "é"]), rng.choice([None, "en"]), i if i % 7 else None,
             rng.choice([None, "", "Ab C" * (i % 9), "lower", "Z" * 9000])) for i in range(330)]


@pytest.mark.parametrize("n", [0, 1, 2, 330])
def test_op13(spark, tmp_path, n):
    rows = leaf_rows()[:n]
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash int"
    folder = table(spark, [(*r, "x", 1) for r in rows], schema, tmp_path, "documents")
    assert sorted(map(tuple, merkle.op13_merkle_manifest(spark, folder).collect()), key=str) == proved(rows)


def test_one_node_left_over(spark, tmp_path):
    rows = [(i, "s", None, 1, "T") for i in range(17)]
    folder = table(spark, rows, "doc_id long, source string, lang string, n_chars long, text string", tmp_path, "documents")
    assert sorted(map(tuple, merkle.op13_merkle_manifest(spark, folder).collect()), key=str) == proved(rows)


def test_binary_tree(spark):
    from pyspark.sql import functions as F

    leaves = spark.createDataFrame([(i, "t", sha(str(i))) for i in range(11)], "doc_id long, tree string, leaf string")
    got = merkle.manifest(leaves, 2).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    nodes = [sha(str(i)) for i in range(11)]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    assert len(got) == 11 and all(r.root == r.subroot == r.folded == nodes[0] and len(r.path) == 4 for r in got)


# SQL -------------------------------------------------------------------------
@pytest.mark.parametrize("name", oracles.ORACLE)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(catalog.ORACLE[name])
    columns = list(want.columns)
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
