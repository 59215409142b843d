"""Operators on texts against the libraries, plain versions, and round trips; with nulls, empty and long texts, repeated rows."""

import os
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeloom.llm._common import sampled, written
from lakeloom.llm.language_id import LanguageFilters, identify_languages, learn_languages
from lakeloom.llm.licenses import KNOWN_LICENSES, scan_licenses
from lakeloom.llm.token_counts import token_counts
from lakeloom.llm.token_ids import Encoder, decode_words, encode_words, encoder, token_id_table
from lakeloom.llm.toxicity import learn_toxicity, score_toxicity
from lakeloom.llm.url_filter import GlobSet, filter_urls, split_url
from pyspark.sql import functions as F

ODD = [None, "", " ", "a", "a  b", "x\n\ny", "\n\n\nz", "end  ", "<|endoftext|> x <|startoftext|>", "don't WE'LL 'S", "１２ ½ Ǆ İ Σσς", "e\u0301 \u0301x", "tab\tand\x1csep", "日本語 text", "... ,,. a.b,c", "word. " * 400, "no" * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema="doc_id long, text string, source string, row string"):
    return spark.createDataFrame([(i, t, "s", "clash") for i, t in enumerate(texts)], schema)


def test_token_counts_equal_the_library(spark):
    texts = [*ODD, *ODD[:6]]
    file = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    got = {r.doc_id: r for r in token_counts(frame(spark, texts), file, limit=50).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 50), t
    assert token_counts(frame(spark, []), file).count() == 0


def test_token_ids_round_trip(spark):
    texts = [*ODD, "a b " * 40_000]
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    got = {r.doc_id: r for r in token_id_table(frame(spark, texts).repartition(5), file).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)
    assert token_id_table(frame(spark, []), file).count() == 0


def test_encoder_equals_the_library():
    rng = random.Random(3)
    signs = ["a", "The", " ", " ", "\n", "é", ".", ",", "'s", "7", "\t", "ß", "\u00a0", "-", "x" * 30]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(800)]
    own = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [np.array(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for batch in (texts, texts[::-1]):
        ids, counts = own.encode(batch)
        assert [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] == (want if batch is texts else want[::-1])
    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=20)  # forgets between batches
    for i in range(0, 800, 50):
        ids, counts = own.encode(texts[i : i + 50])
        assert ids.tobytes() == b"".join(want[i : i + 50]) and (counts == [len(x) // 4 for x in want[i : i + 50]]).all()


def test_token_ids_of_repeated_and_null_ids(spark):
    rows = [(None, "no id"), (None, "no id"), (3, "three"), *[(7, f"text {i} of one id") for i in range(300)], (9, None)]
    file = public_tokenizers.path("byte_bpe_50k.json")
    got = token_id_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), file).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3, *[7] * 300, 9]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert got[-1].n_tokens == 1


def test_token_counts_of_letters_whose_lower_case_ends_in_a_mark(spark):
    file = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    rng = random.Random(11)
    signs = ["İ", "I", "a", "e\u0301", "\u0307", ".", ",", " ", "ß", "Ǆ", "ﬁ", "１", "<|endoftext|>", "'s"]
    texts = ["İ.", "İ,", "xİ. y", *["".join(rng.choice(signs) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]]
    got = {r.doc_id: r.n_tokens for r in token_counts(frame(spark, texts), file).collect()}
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 5000])
@pytest.mark.parametrize("top", [1, 2, 5, 300, 70_000, 2**59])
def test_simple8b_round_trip(n, top):
    codes = np.random.default_rng(n).integers(0, top, n)
    assert (decode_words(encode_words(codes), n).astype(np.int64) == codes).all()


def test_simple8b_refuses_wide_codes():
    with pytest.raises(ValueError):
        encode_words(np.array([2**60], np.uint64))


def test_url_filter_equals_plain_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "", "/ads"), ("block", "very-long-host-name-of-a-site-that-takes-more-than-one-word.example.org", "/with/a/long/path/too")]
    urls = [None, "", "nothing", "http://", "http://EXAMPLE.com", "https://a.example.com/en/x?q#f", "http://www.example.com/en/", "http://xexample.com/en/", "http://a.net/es/1", "http://net/es/", "http://é.com/ß", "x://a.org/ads/1", "http://com/", "http://com", "http://a.com:80/", "http://sub.very-long-host-name-of-a-site-that-takes-more-than-one-word.example.org/with/a/long/path/too/x", "http://a.com/" + "y" * 5000]

    def plain(url):
        host, path = split_url(url)
        fits = [r for r in rules if (not r[1] or host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        return host, path, best and best[1] + best[2], best[0] if best else "allow"

    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    for r in filter_urls(df, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id])


def test_globs():
    globs = GlobSet(["a*c", "a**c", "**", "*" * 1])
    assert globs.first([b"abc", b"a/c", b"zz/", b"a/cx"]).tolist() == [0, 1, 2, 2]


def test_globs_of_long_urls_and_few_at_a_time():
    """Against regular expressions; a URL of a million bytes is decided long before its end, or taken alone."""
    rng = random.Random(1)
    pattern = lambda g: re.compile(b"".join({b"**": b"(?s:.*)", b"*": b"[^/]*"}.get(p, re.escape(p)) for p in re.split(rb"(\*\*|\*)", g.encode())))
    for size in (9, 60):
        globs = [re.sub(r"\*{3,}", "**", "".join(rng.choice(["a", "b", "/", "*", "**"]) for _ in range(rng.randrange(1, size)))) for _ in range(40)]
        for n in (1, 5, 60):
            urls = ["".join(rng.choice("ab/") for _ in range(rng.choice([0, 1, 5, 30, 80]))).encode() for _ in range(n)]
            some = rng.sample(globs, 5)
            rules = [pattern(g) for g in some]
            assert GlobSet(some).first(urls).tolist() == [next((k for k, r in enumerate(rules) if r.fullmatch(u)), -1) for u in urls]
    long = GlobSet(["*.com/**", "a*b"])
    assert long.first([b"x.com/" + b"y" * 1_000_000, b"a" * 1_000_000 + b"b", b"q/" + b"z" * 1_000_000]).tolist() == [0, 1, -1]


def test_languages(spark):
    words = {"aa": "ka lo mi ta re".split(), "bb": "shu gre wox plu dri".split()}
    rng = random.Random(1)
    make = lambda x: " ".join(rng.choice(words[x]) + rng.choice(words[x]) for _ in range(30))
    data = [(i, make("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(200)] + [(900, None, "aa"), (901, "123 ...", None), (902, "", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    filters = learn_languages(df.where("doc_id < 150"))
    got = {r.doc_id: r for r in identify_languages(df.select("doc_id", "text"), filters, {"doc_id": F.col("doc_id")}).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") and 0 < got[i].score <= 1 for i in range(200))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert learn_languages(df.where("doc_id < 0")).predict(["abc"])[0] == ["und"]
    assert isinstance(filters, LanguageFilters) and filters.langs == ["aa", "bb"]


def test_toxicity(spark):
    rng = random.Random(2)
    common = ["lorem", "ipsum", "dolor", "amet", "elit", "sed"]
    data = [(i, " ".join(rng.choices(common, k=20) + (["vilething"] if i % 4 == 0 else []))) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)] + [(250, None)], "doc_id long, toxic int")
    model = learn_toxicity(docs, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, model, {"doc_id": F.col("doc_id")}).collect()}
    assert len(got) == 302 and all(got[i].predicted == int(i % 4 == 0) for i in range(300))
    assert 0 <= got[900].score < 0.3 and got[900].score == got[901].score
    none = learn_toxicity(docs, labels.where("toxic = 0"))
    assert 0 < score_toxicity(docs, none, {"doc_id": F.col("doc_id")}).first().score < 0.3


ODD_IDS = {"distinct": lambda i: i, "a third under one id": lambda i: 5 if i % 3 == 0 else i, "one id": lambda i: 7, "another id": lambda i: 8, "no id": lambda i: None}


@pytest.mark.parametrize("ids", list(ODD_IDS))
def test_samples_are_drawn_by_row(spark, ids):
    """The bound of learned rows holds, and both models are right, however ids repeat."""
    rng = random.Random(6)
    words = {"aa": "ka lo mi ta re".split(), "bb": "shu gre wox plu dri".split()}
    lang = lambda i: "aa" if i // 3 % 2 else "bb"
    data = [(ODD_IDS[ids](i), " ".join(rng.choice(words[lang(i)]) + rng.choice(words[lang(i)]) for _ in range(12)), lang(i), "clash") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, _key string").repartition(3)
    filters = learn_languages(df, rows=500)
    assert filters.langs == ["aa", "bb"]
    got = identify_languages(df, filters, {"lang": F.col("lang")})
    assert got.where("lang <> lang_pred").count() == 0
    assert 350 < sampled(df, 500 / 3000, "languages").count() < 650


@pytest.mark.parametrize("ids", list(ODD_IDS))
def test_toxicity_learns_each_row_once(spark, ids, monkeypatch):
    """Repeated ids of documents and of labels multiply no rows; an id's label is the more frequent one."""
    import lakeloom.llm.toxicity as toxicity

    tables, rng = [], random.Random(4)
    monkeypatch.setattr(toxicity, "written", lambda df: tables.append(made := written(df)) or made)
    bad = lambda i: (ODD_IDS[ids](i) if ODD_IDS[ids](i) is not None else i) % 4 == 0
    docs = spark.createDataFrame([(ODD_IDS[ids](i), " ".join(rng.choices(["lorem", "ipsum", "dolor"], k=9) + ["vilething"] * bad(i)), 1, 2) for i in range(1200)], "doc_id long, text string, label int, id int")
    labels = spark.createDataFrame([(ODD_IDS[ids](i), int(bad(i))) for i in range(1200)] + [(4, 0), (4, 1), (4, 1)], "doc_id long, toxic int")
    model = learn_toxicity(docs, labels, rows=400)
    assert (tables[0].count() if tables else 0) <= 480
    if ids in ("distinct", "a third under one id"):
        got = score_toxicity(docs, model, {"text": F.col("text")}).collect()
        assert all(r.predicted == ("vilething" in r.text) for r in got)


def test_learning_from_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert learn_languages(docs).langs == []
    model = learn_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert score_toxicity(docs, model, {"doc_id": F.col("doc_id")}).count() == 0
    assert identify_languages(docs, learn_languages(docs), {"doc_id": F.col("doc_id")}).count() == 0


def test_only_the_most_frequent_languages_are_learned(spark):
    data = [(i, "ab" * (i + 2), f"l{i % 5}") for i in range(11)]
    assert learn_languages(spark.createDataFrame(data, "doc_id long, text string, lang string"), languages=2).langs == ["l0", "l1"]


def test_licenses(spark):
    mit = KNOWN_LICENSES[0][1]
    texts = [mit, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace("LICENSE", "LICENCE"), mit.replace("sublicense", "sub-licence").replace(".", " ;"), mit + " more", "first\nLicensed under the Apache Licence, Version 2.0\nlast", None, ""]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, texts)).collect()}
    assert [got[i].license_id for i in range(7)] == ["MIT", "MIT", "MIT", None, None, None, None]
    assert got[4].line_licenses == ["Apache-2.0"] and got[5].digest == got[6].digest
    assert scan_licenses(frame(spark, [])).count() == 0


def rewrapped(text):
    """The text with other line ends, cases and punctuation, and a copyright line of its own."""
    lines = []
    for part in text.split("\n\n"):
        lines += ["", *(textwrap.wrap(" ".join(part.split()), 47) if not re.search(r"(?i)copyright|\xa9|reserved|franklin st", part) else part.split("\n"))]
    return "Copyright (c) 2031 Some One, Inc.\n" + "\n".join(lines).upper().replace("LICENSE", "LICENCE").replace(";", " ,")


@pytest.mark.parametrize("name", sorted({n for n, _ in KNOWN_LICENSES}))
def test_every_listed_text_is_found_in_other_wrappings(spark, name):
    texts = [t for n, t in KNOWN_LICENSES if n == name]
    got = scan_licenses(frame(spark, [rewrapped(t) for t in texts] + ["x" + t for t in texts])).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == [name] * len(texts) + [None] * len(texts)


LONG = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the system has no licence texts")
def test_long_licences_are_found_in_other_wrappings(spark):
    found = {n: open(f"/usr/share/common-licenses/{f}", encoding="utf-8", errors="replace").read() for f, n in LONG.items() if os.path.exists(f"/usr/share/common-licenses/{f}")}
    names = sorted(found)
    got = scan_licenses(frame(spark, [rewrapped(found[n]) for n in names] + [found[n].partition("END OF TERMS AND CONDITIONS")[0] for n in names])).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == names * 2
    extra = spark.createDataFrame([("Own-1.0", "Do as you like, but be kind.")], "license_id string, text string")
    assert scan_licenses(frame(spark, ["do AS you like -- but be kind!", "do as you like"]), known=extra).orderBy("doc_id").collect()[0].license_id == "Own-1.0"
