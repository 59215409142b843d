"""Operators on whole tables against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lakeloom.llm import jaccard_join as J
from lakeloom.llm.components import connected_components
from lakeloom.llm.decontaminate import align, close_pairs, find_leaks, pair_counts
from lakeloom.llm._text import word_hashes
from lakeloom.llm.jaccard_join import COORDINATES, RUNS, candidate_edges, gram_sets, jaccard_join
from lakeloom.llm.mixing import fly, mix_sources
from lakeloom.llm.topk import top_k_products
from pyspark.sql import functions as F


def plain_join(texts, least=0.8):
    """Class (first index of the component) and links of each text."""
    sets = [frozenset(s.tolist()) for s in gram_sets([t or "" for t in texts], 5)]
    up, links = list(range(len(texts))), [set() for _ in texts]

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= least * len(a | b) - 1e-9:
                x, y = sorted((find(i), find(j)))
                up[y] = x
                if a != b:
                    links[i].add(b)
                    links[j].add(a)
    return [find(i) for i in range(len(texts))], [len(x) for x in links]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.random()}"
    return " ".join(out)


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(5)
    bases = [[f"v{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 120]))] for _ in range(25)]
    texts = [None, "", "one", "one", "Two words", "two, words!", *[" ".join(b) for b in bases]]
    texts += [edited(rng, b, rng.randrange(4)) for b in bases for _ in range(3)]
    dense = [f"d{i}" for i in range(150)]
    texts += [edited(rng, dense, rng.randrange(1, 4)) for _ in range(260)]  # one large group of near copies
    shared = [f"p{i}" for i in range(60)]
    texts += [" ".join(shared + [f"q{rng.random()}" for _ in range(60)]) for _ in range(120)]  # a passage that many share
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    got = {r.doc_id: r for r in jaccard_join(df).collect()}
    classes, links = plain_join(texts)
    assert len(got) == len(texts)
    assert [got[i].class_id for i in range(len(texts))] == classes
    assert [got[i].n_links for i in range(len(texts))] == links
    assert got[2].n_copies == 2 and got[0].n_copies == 1


def test_large_buckets_are_split_on_tokens_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(J, "HELD", 64)  # buckets that no task holds, at the size of a test
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 2**32, (640, COORDINATES), dtype=np.uint32).astype("<u4")
    sig[:, :RUNS] = 1  # all runs have all sets in one bucket, which is not dense
    for i in range(40):
        sig[600 + i] = sig[i]
        sig[600 + i, RUNS + i % 8 * 2 : RUNS + i % 8 * 2 + 2] = 0
    sets = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sig)], "set_id long, sig binary")
    edges = candidate_edges(sets.select("set_id", J.first_paths().alias("paths")), sets).collect()
    assert {(min(e.a, e.b), max(e.a, e.b)) for e in edges} == {(i, 600 + i) for i in range(40)}


def test_buckets_inside_a_task_are_split_and_keep_pairs():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 3, (3000, COORDINATES), dtype=np.uint32).astype("<u4")  # a third agrees by chance
    kept = 0
    for pair in range(200):
        sig[2 * pair + 1] = sig[2 * pair]
        sig[2 * pair + 1, rng.permutation(COORDINATES)[:13]] = 9
    groups = list(J._split(sig, np.arange(3000), np.random.default_rng(1), np.arange(RUNS, COORDINATES)))
    assert max(map(len, groups)) <= J.SMALL
    for pair in range(200):
        kept += any({2 * pair, 2 * pair + 1} <= set(g.tolist()) for g in groups)
    assert kept > 180  # of one run; there are ten


def test_parts_of_a_bucket_equal_plain_components():
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 2**32, (300, COORDINATES), dtype=np.uint32).astype("<u4")
    for i in range(1, 200):
        sig[i] = sig[i - 1] if i % 7 else sig[i]
        sig[i, rng.permutation(COORDINATES)[: rng.integers(10, 34)]] = rng.integers(0, 2**32)
    near = (sig[:, None] == sig[None]).sum(2) >= J.LINK
    want = J._roots(near & ~np.eye(300, dtype=bool))
    assert (J.connect(sig) == want).all()
    known = np.zeros(300, bool)
    known[[5, 250, 299]] = True
    part = J.connect(sig, known)
    assert len({*part[known]}) == 1 and len({*part}) == len({*want} - {want[250], want[299]})


def test_jaccard_join_of_a_dense_bucket_that_no_task_holds(spark, monkeypatch):
    monkeypatch.setattr(J, "HELD", 64)
    monkeypatch.setattr(J, "BLOCK_SETS", 40)
    rng = random.Random(6)
    base = [f"d{i}" for i in range(150)]
    texts = [edited(rng, base, rng.randrange(1, 5)) for _ in range(300)] + [edited(rng, base, 12) for _ in range(40)]
    texts += ["", " ".join(base) * 40]
    got = {r.doc_id: r for r in jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    classes, links = plain_join(texts)
    assert [got[i].class_id for i in range(len(texts))] == classes
    assert [got[i].n_links for i in range(len(texts))] == links


def test_jaccard_join_with_null_and_repeated_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (None, text + " more"), (4, text), (4, text), (4, "something else, by the same id"), (None, "alone and without an id"), (9, None)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted((r.class_id or 0, r.n_links) for r in got) == [(0, 0), (4, 0), (4, 1), (4, 1), (4, 1), (4, 1), (9, 0)]


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def plain_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best / (2 * max(1, len(a)))


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(0)
    items = [rng.integers(0, 6, n).astype(np.uint64) for n in (1, 7, 20, 33, 0)]
    passages = [rng.integers(0, 6, n).astype(np.uint64) for n in (5, 1, 40, 12, 4)]
    assert np.allclose(align(items, passages), [plain_align(a, b) for a, b in zip(items, passages)])


def test_leaks(spark):
    rng = random.Random(9)
    word = lambda: f"k{rng.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (12, 30, 60, 3)]
    text = lambda n: [word() for _ in range(n)]
    docs, want = [], set()
    for d in range(40):
        body = text(rng.randrange(0, 300))
        if d % 4 == 0:
            i = d // 4 % 3
            copy = list(items[i])
            if d % 8 == 0:
                for _ in range(len(copy) // 8):
                    copy[rng.randrange(len(copy))] = "edited"
                del copy[rng.randrange(len(copy))]
            at = rng.randrange(len(body) + 1)
            body[at:at] = copy
            want.add((d, i))
        docs.append((d, " ".join(body), 1))
    docs += [(90, None, 1), (91, "", 1), (0, docs[0][1], 1)]
    bench = spark.createDataFrame([*[(i, " ".join(x).upper()) for i, x in enumerate(items)], (7, None)], "item_id long, text string")
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert sum(r.doc_id == 0 for r in found) == 2
    assert find_leaks(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0
    assert find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), bench.where("item_id < 0")).count() == 0


def test_leaks_equal_plain_alignment_at_all_edit_rates(spark):
    rng = random.Random(31)
    items = [[f"m{rng.randrange(60 if i % 2 else 2000)}" for _ in range(rng.choice([4, 5, 9, 16, 30]))] for i in range(12)]
    items.append([f"z{i}" for i in range(24)])
    docs = [list(items[12]), [f"e{i}" if i % 8 == 3 else w for i, w in enumerate(items[12])], [x for w in items[12] for x in (w, "in")], [f"e{i}" if i % 4 == 3 else w for i, w in enumerate(items[12])]]
    for rate in (0.05, 0.1, 0.2, 0.3):
        for item in items * 2:
            copy = []
            for w in item:
                kind = rng.choice("sid") if rng.random() < rate else ""
                copy += {"": [w], "s": [f"x{rng.randrange(10**9)}"], "i": [w, f"x{rng.randrange(10**9)}"], "d": []}[kind]
            pad = [f"m{rng.randrange(60)}" for _ in range(rng.randrange(20))]
            docs.append(pad + copy + pad[::-1])
    want = {(d, i): s for d, x in enumerate(docs) for i, y in enumerate(items) if (s := plain_align(y, x)) >= 0.5}
    found = find_leaks(
        spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    ).collect()
    assert len(found) == len(want) and {(1, 12), (2, 12), (3, 12)} <= want.keys()
    assert {(r.doc_id, r.item_id): pytest.approx(r.score) for r in found} == want


def test_pairs_are_counted_in_all_texts(spark):
    words = [[f"w{i % 5}", "of", f"x{i % 3}", f"w{i % 5}", "of"] for i in range(60)]
    texts = spark.createDataFrame([*[(" ".join(w),) for w in words], (None,), ("",)], "text string")
    want = Counter(p for w in words for far in (1, 2) for p in zip(w, w[far:], strict=False))
    of = {p: int(close_pairs(*word_hashes([" ".join(p)]))[0].view(np.int64)[0]) for p in want}
    found = {r.gram: r.n_found for r in pair_counts(texts, spark.createDataFrame([(h,) for h in of.values()], "gram long")).collect()}
    assert {p: found[h] for p, h in of.items()} == want


def test_leaks_of_items_of_a_few_words(spark):
    items = [(1, "Solo"), (2, "two words"), (3, "Three short words!"), (4, "..."), (4, None), (3, "three short words")]
    docs = [(1, "so the solo, it plays"), (2, "words two"), (3, "these are two\nwords"), (4, "of three short words"), (5, "three shorter words"), (None, "solo solo"), (None, None), (6, ""), (7, "solo " * 20_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.score) for r in got) == [(0, 1, 1.0), (1, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (4, 3, 1.0), (7, 1, 1.0)]


@pytest.mark.parametrize("land", [False, True])
def test_flight_keeps_totals(land):
    rng = np.random.default_rng(4)
    sizes = np.sort(rng.integers(1, 2000, 300))[::-1]
    pi = np.full(300, 0.37)
    out = fly(sizes, pi, np.random.default_rng(1), land)
    left = (out > 0) & (out < 1)
    assert left.sum() <= (0 if land else 2)
    if not land:
        assert abs((out * sizes).sum() - (pi * sizes).sum()) < 1e-3 and abs(out.sum() - pi.sum()) < 1e-6
    assert abs((out * sizes).sum() - (pi * sizes).sum()) <= 100


def plain_targets(sizes, weights):
    total, out, free = 1.5 * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    capped = set()
    while True:
        rest = total - sum(2 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        out = [2.0 * sizes[i] if i in capped else rest * weights[i] / sum(weights[j] for j in free) for i in range(len(sizes))]
        above = {i for i in free if out[i] > 2 * sizes[i]}
        if not above:
            return out
        capped |= above


def test_mixing(spark):
    rng = random.Random(8)
    sources = ["b", "a", None, "Z", "é", "aa"]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)) if i % 17 else None, rng.choice(sources)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(tuple(r) for r in mix_sources(d).collect()) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 3000
    source = {r[0]: r[2] for r in rows}
    order = [*sorted({s for s in sources if s is not None}), None]
    size = {s: sum(r[1] for r in one if source[r[0]] == s) for s in order}
    want = dict(zip(order, plain_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    for r in one:
        assert r[2] == size[source[r[0]]] and abs(r[3] - want[source[r[0]]]) < 1e-6 and r[5] <= 2 * r[1]
    for s in order:
        assert abs(sum(r[5] for r in one if source[r[0]] == s) - want[s]) <= 60
    assert mix_sources(df.where("doc_id < 0")).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)] + [(400, None), (401, [1.0, None, *[0.0] * 6]), (402, [float("nan")] * 8), (450, [0.5] * 8), (451, [0.5] * 8), (500, [1.0, 2.0]), (501, [3.0, 4.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data if v is not None and None not in v and not np.isnan(v).any()]
    want = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in top_k_products(df).collect()) == sorted(want)
    assert top_k_products(df.where("vec_id < 0")).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert 0 < out.count()


def test_pipeline_stages_decide_by_row(spark):
    import corpus_pipeline

    path, rng = "/root/testdata/sf0.001", random.Random(3)
    item = next(r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 20)
    text = lambda: " ".join(f"r{rng.randrange(10**6)}" for _ in range(30))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda stage, rows: sorted((r.doc_id or 0, r.text) for r in stage(spark, frame(rows), path).collect())
    one, two, three = text(), text(), text()
    leaking = [(None, item, "en", "a", 1), (5, item, "en", "a", 1), (None, one, "en", "a", 1), (5, two, "en", "a", 1)]
    assert left(corpus_pipeline.drop_leaks, leaking) == sorted([(0, one), (5, two)])
    near = [(None, one, "en", "a", 1), (None, one + " more", "en", "a", 1), (None, two, "en", "a", 1), (9, two + " more", "en", "a", 1), (4, three, "en", "a", 1), (4, three + " more", "en", "a", 1)]
    got = left(corpus_pipeline.drop_near_duplicates, near)
    assert len(got) == 3 and [i for i, _ in got] == [0, 4, 9]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(["w"] * (i % 40 + 1)), "en", "ab"[i % 2], 1) for i in range(3000)]
    target = dict(zip("ab", plain_targets([sum(len(r[1].split()) for r in rows if r[3] == s) for s in "ab"], [5, 2])))
    mixed = corpus_pipeline.mix(spark, frame(rows), path).collect()
    for s, t in target.items():
        assert abs(sum(len(r.text.split()) for r in mixed if r.source == s) - t) <= 60


def test_pipeline_stages_with_clashing_names_and_empty_tables(spark):
    import corpus_pipeline

    path = "/root/testdata/sf0.001"
    names = ["turn", "times", "_row", "label", "id", "key", "a.b", "_turns", "size"]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(60).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "token_ids":
            assert out.columns == docs.columns and out.select("`a.b`", "_row").distinct().collect() == [(6, 2)], name
        else:
            assert out.count() == 60
        assert stage(spark, docs.limit(0), path).count() == 0, name


def test_whole_pipeline_equals_its_stages_one_by_one(spark, tmp_path):
    """run() over its own folder: what each stage keeps is checked, and the ids of the last one against the library."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs.unionByName(docs.where("doc_id < 20")).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, rows, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        before, rows = rows.count(), spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert 0 < rows.count() <= (before if name != "mixing" else 2 * before), name
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    library, kept = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sorted((r.doc_id, r.text) for r in rows.collect())
    assert [r.doc_id for r in got] == [i for i, _ in kept]
    ids = {(i, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in kept}
    assert {(r.doc_id, r.ids_crc32) for r in got} == ids
