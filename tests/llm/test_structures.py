"""Runs, prefix tries and fingerprints against plain versions; with nulls, empty and long texts, repeated rows and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import prefix_trie as P
from lakeloom.llm import queries as Q
from lakeloom.llm.fingerprints import as_text, containment, distinct_shingles, edited_likeness, fingerprints, from_text, merge_sketches, merged, resemblance
from lakeloom.llm.periodic_runs import find_runs, squares, suffix_array, text_runs

PATH = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    """Runs by trying all periods at all places: (start, length, period)."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in best.items() if n >= max(least, times * q)), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng):
    words = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randrange(40))]
    unit = words[: rng.randrange(1, 6)]
    return words[: rng.randrange(len(words) + 1)] + unit * rng.randrange(1, 9) + words[:3]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (2, 3)])
def test_runs_equal_all_periods_tried(least, times):
    rng = random.Random(times)
    for _ in range(400):
        texts = [periodic(rng) for _ in range(rng.randrange(1, 6))]
        n, owner, (start, length, period), shorter = text_runs([" ".join(t).encode() for t in texts], least, times)
        assert n.tolist() == list(map(len, texts))
        for i, t in enumerate(texts):
            mine = np.flatnonzero(owner == i)
            want = plain_runs(t, least, times)
            assert list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True)) == want
            assert shorter[i].decode() == collapsed(t, want)


def test_suffix_array_and_squares():
    words = np.array([0, 1, 0, 1, 0, 2, 0, 1, 3])
    order, place, levels = suffix_array(words)
    assert order.tolist() == sorted(range(9), key=lambda i: words[i:].tolist())
    assert place[order].tolist() == list(range(9)) and len(levels) >= 2
    i, d = squares(order, place, levels)
    assert list(zip(i.tolist(), d.tolist(), strict=True)) == [(1, 2)]  # 1 0 1 0, followed by 2


def test_runs_in_parts_of_the_tests(monkeypatch):
    from lakeloom.llm import periodic_runs as R

    rng = random.Random(8)
    texts = [" ".join(periodic(rng)).encode() for _ in range(50)]
    whole = text_runs(texts)
    monkeypatch.setattr(R, "TESTS", 7)
    parts = text_runs(texts)
    assert all((a == b).all() for a, b in zip(whole[2], parts[2], strict=True)) and whole[3] == parts[3]


def test_find_runs_of_odd_rows(spark):
    texts = [None, "", "  \t ", "a", "a " * 5000, "x y " * 7, "p q " * 4 + "\x1c", "a " * 6, "a " * 6, "é " * 6, "one two three " * 30_000]
    df = spark.createDataFrame([(i if i else None, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, runs int, collapsed string")
    got = find_runs(df, {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id or 0: r for r in got}
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        want = plain_runs(words) if len(words) < 100 else [(0, len(words), 1 if i == 4 else 3)]
        assert [tuple(r) for r in by_id[i].runs] == want and by_id[i].n_words == len(words)
        assert by_id[i].collapsed == collapsed(words, want)
    assert find_runs(df.limit(0), {"doc_id": F.col("doc_id")}).count() == 0


def plain_op11(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return doc_id, len(found), start, length, period, period and 1000 * length // period, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest()


def test_periodic_runs_query_equals_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").where(F.length("text") < 6000)
    odd = spark.createDataFrame([(9000 + i, t) for i, t in enumerate([None, "", "a b", "w " * 50, *["u v w " * k for k in range(1, 30)]])], "doc_id long, text string")
    docs.select("doc_id", "text").union(odd).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = {r.doc_id: plain_op11(*r) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r) == want[r.doc_id]
    assert sum(r.n_runs > 0 for r in got) > 20


def plain_trie(rows):
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}:{x}".encode()).digest(), (r, x)))
    conv = {c: [v[2] for v in sorted(turns, key=lambda v: v[:2])] for c, turns in conv.items()}
    members, ends = {}, {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        full = conv.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(full) + 1):
            members.setdefault(tuple(full[:d]), []).append(c)
        ends.setdefault(tuple(full), []).append(c)
    children, total, out = {}, {}, []
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        total[k] = (sum(total[x][0] for x in below) or 1, sum(total[x][1] for x in below) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), *total[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rng, long):
    rows = []
    for c in range(40):
        if rng.random() < 0.8:
            for i in range(rng.choice([1, 2, 3, 8, long])):
                rows.append((c if rng.random() < 0.97 else None, rng.choice([i, i, None, i // 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "longer text"]), 7))
    return rows + [(45, i, "user", "the same", 7) for i in range(120)] * 2  # a hot id, whose rows all repeat


@pytest.mark.parametrize("local", [1, 9, 1000])
def test_trie_equals_a_plain_version(spark, local):
    rows = conversations(random.Random(local), 20)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int").repartition(5)
    got = sorted(map(tuple, P.conversation_trie(df, local).collect()), key=repr)
    assert got == plain_trie([r[:4] for r in rows])


def test_trie_of_nothing_and_of_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert P.conversation_trie(df).count() == 0 and P.conversation_trie(df.limit(0)).count() == 0


def test_list_digests_of_a_large_group(spark):
    df = spark.range(20_000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id").unionByName(spark.createDataFrame([(5, 10**12)], "k int, id long")).repartition(7)
    got = {r.k: r.d for r in P.list_digests(df, "k", "id", "d").collect()}
    of = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {0: of([i for i in range(20_000) if i % 3]), 1: of(range(0, 20_000, 3)), 5: of([10**12])}


def shingles(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_fingerprints_estimate_sets(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = words(3000)
    texts = [" ".join(base), " ".join(base[:1500]), " ".join(base[:2400] + words(600)), "a b c", "A  b\tC", "", None, " ".join(words(50)), "x " * 1000]
    df = spark.createDataFrame([(i, t, "s" if i < 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = fingerprints(df).select("doc_id", "source", "sketch")
    a, b = found.alias("a"), found.alias("b")
    pairs = a.crossJoin(b).select(
        F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), resemblance(F.col("a.sketch"), F.col("b.sketch")).alias("j"), containment(F.col("a.sketch"), F.col("b.sketch")).alias("c"),
        distinct_shingles(F.col("a.sketch")).alias("n"), from_text(as_text(F.col("a.sketch"))).eqNullSafe(F.col("a.sketch")).alias("round"),
    )
    for r in pairs.collect():
        s, t = shingles(texts[r.x]), shingles(texts[r.y])
        want = len(s & t) / len(s | t) if s | t else 1.0
        small = len(s | t) <= 128
        assert r.round and abs(r.j - want) <= (1e-12 if small else 0.15), (r, want)
        assert r.n == len(s) if len(s) < 128 else abs(r.n / len(s) - 1) < 0.3
        if r.c is not None:
            assert abs(r.c - (len(s & t) / len(s) if s else 1.0)) <= (1e-12 if small else 0.2), r
    groups = {r.source: r.sketch for r in merge_sketches(found.repartition(4), ["source"], "sketch").collect()}
    union = found.where("doc_id < 3").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))).alias("u")).first().u
    assert groups["s"] == union[:128]
    both = found.alias("p").join(found.alias("q"), F.expr("p.doc_id = 0 AND q.doc_id = 2")).select(merged(F.col("p.sketch"), F.col("q.sketch")).alias("u"), F.col("p.sketch").alias("p")).first()
    assert len(both.u) == 128 and both.u == sorted(both.u)


def test_edited_likeness_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9000, ""), (9002, "ab"), (9003, "ünï çö 日本 " * 300), (9004, "x")], "doc_id long, text string")
    df = docs.unionByName(odd).withColumns({c: F.lit("clash") for c in ("key", "sketch", "_key", "head", "at")}).repartition(4)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
    got = {r.doc_id: r for r in edited_likeness(df).collect()}
    assert len(got) == len(rows)
    for (i, text), (j, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(text) // 3
        edited = text[: len(text) - m] + other[:m]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.next_id) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), j)
        for near, t in ((r.near_edited, edited), (r.near_next, other)):
            s, u = shingles(text), shingles(t)
            want = len(s & u) / len(s | u) if s | u else 1.0
            assert abs(near - want) <= (1e-12 if len(s | u) <= 128 else 0.2)


def test_edited_likeness_of_repeated_ids_one_row_and_none(spark):
    rows = [(None, "a b c d e f")] * 30 + [(7, "x y z u v w")] * 40 + [(9, f"text number {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = edited_likeness(df).collect()
    assert len(got) == len(rows) and len({r.fingerprint for r in got if r.doc_id == 7}) == 1
    one = edited_likeness(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert edited_likeness(df.limit(0)).count() == 0
