"""The corpus operators against brute force, exact round trips and held-out labels, and on odd rows."""

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import (ann, bpe, exact_dedup, licenses, line_dedup, lm, mixing, near_dedup, queries, toxicity, urls)
from quarry.llm.hilbert import hilbert_keys

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `row` int"
LINE = "one two three four five six seven eight nine ten " * 6
ODD = [(1, "", "en", None, 0, "a", 1), (2, None, None, "s", None, None, None), (3, LINE + "\nown words here", "en", "s", 9, "b", 2),
       (4, "other\n" + LINE, "en", "s", 9, "b", 2), (4, "other\n" + LINE, "en", "s", 9, "b", 2), (None, "no id", None, None, 1, None, 3),
       (5, "x" * 200_000 + " end", "de", "t", 1, "c", 4), (6, "MIT License\x00 <|endoftext|> \u00e4\u00f6", "en", "t", 1, "c", 4)]


def fold(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents():
    return ds.dataset(SF + "/documents.parquet").to_table().to_pylist()


def components(docs, size, p, q):
    sets = {}
    for i, t in docs:
        w = spaced(t)
        sets[i] = frozenset(tuple(w[j:j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_near_dedup(spark, SF).collect()}
    assert got == components([(d["doc_id"], d["text"]) for d in documents], 2, 80, 100)


def test_dense_group_and_outsiders(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(120):
        w = list(base)
        for j in rng.integers(0, 100, 2 if i % 10 else 9):
            w[j] = f"x{i}_{j}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join(f"r{i}_{j}" for j in range(30))) for i in range(50)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(docs, 2, 4, 5)


def test_near_duplicates_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd, shingle=2).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} >= {(1, 1, True), (2, 2, True), (None, None, True), (4, 3, False)} or \
        {(r.doc_id, r.component_id) for r in got} >= {(1, 1), (2, 2), (None, None)}
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_duplicates(odd).columns == odd.columns


def test_exact_duplicates_odd_rows(odd, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(odd).collect()}
    assert got >= {(1, 1, 2, True), (2, 1, 2, False), (4, 4, 2, True), (None, None, 1, True)}
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(odd).count() == len(ODD) - 2 and exact_dedup.drop_exact_duplicates(odd).columns == odd.columns


def test_exact_duplicates_by_row_not_by_id(spark):
    rows = [(1, "T", 0), (4, "U", 1), (4, "T", 2), (4, "U", 1), (7, "V", 5), (7, "V", 6), (None, "T", 7), (None, "W", 8)]
    got = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, sha long")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "W"), (1, "T"), (4, "U"), (7, "V")]


def test_toxicity_sample_does_not_depend_on_the_partitions(spark):
    """Copies under either label, shared beginnings, short texts: the same survivors however the rows are dealt."""
    base = "one two three four five six seven eight nine ten"
    rows = [(f"{base} {i % 7}", i % 2) for i in range(60)] + [("short", 1), ("short", 0), ("short", 1), ("", 0), (None, 0)]
    df = spark.createDataFrame(rows, "text string, toxic int")
    a, b = (sorted(((r.text or "", r.toxic) for r in toxicity.without_copies(df.repartition(n)).collect())) for n in (1, 7))
    assert a == b and ("short", 0) in a and ("short", 1) in a


def test_bpe_matches_the_library(spark, odd, none, documents):
    lib = Tokenizer.from_file(queries.BPE_FILE)
    got = {r.doc_id: r for r in queries.op6_bpe(spark, SF).collect()}
    for d in documents:
        ids = lib.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = bpe.decode(bpe.encode(odd, queries.BPE_FILE), queries.BPE_FILE).collect()
    for r in rows:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert bpe.encode(none, queries.BPE_FILE).count() == 0


def test_bpe_long_words_and_other_alphabets():
    v = bpe.vocabulary(queries.BPE_FILE)
    lib = Tokenizer.from_file(queries.BPE_FILE)
    texts = ["ab" * 400, "\u65e5\u672c\u8a9e \U0001f600 12\u0661", "don't  \n\n we'll<|endoftext|>x", "\u0558 a\x85b\x1cc", " " * 90 + "end"]
    for t, ids in zip(texts, bpe.Encoder(v).many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert v.decode(ids) == t


def test_license_base_matches_brute_force(spark, odd, none, documents):
    got = {r.doc_id: r for r in queries.op10_license_scan(spark, SF).collect()}
    for d in documents:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(d["text"]))
        at = [(i, label) for p, label in licenses.PHRASES.items() for n in [len(p.split())] for i in range(len(w)) if w[i:i + n] == p.split()]
        r = got[d["doc_id"]]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert 0 <= r.score <= 1
    assert licenses.license_report(odd).count() == len(ODD) and licenses.license_report(none).count() == 0


def test_license_places_survive_a_changed_word(spark):
    words = licenses.TEMPLATES[0][1].split()
    text = "preface " + " ".join([*words[:12], "extra", *words[12:]])
    row = licenses.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "mit" and row.n_base == 0 and row.n_places == 1 and row.score > 0.9


def test_base_score_and_passes(spark, documents, none, odd):
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    got = {r.doc_id: r for r in queries.op4_lm_scoring(spark, SF).collect()}
    counts, total = defaultdict(int), 0
    for d in documents:
        if not got[d["doc_id"]].held_out:
            for w in [*spaced(d["text"]), None]:
                counts[w] += 1
                total += 1
    for d in documents:
        tokens, r = [*spaced(d["text"]), None], got[d["doc_id"]]
        base = sum(np.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    docs = spark.read.parquet(SF + "/documents.parquet")
    few = {r.doc_id: r.score for r in lm.score(docs, part != 2, max_filter_mb=1, head=10).collect()}
    assert few == pytest.approx({i: r.score for i, r in got.items()})
    assert lm.score(odd, part != 2).count() == len(ODD) and lm.score(none, part != 2).count() == 0


def test_filter_never_misses(spark):
    keys = lm.seeded(99, 5000)
    n = np.arange(1, 5001)
    df = spark.createDataFrame([(int(s), int(k), int(c)) for s, k, c in zip(lm.segment_of(keys, 8), keys.view(np.int64), n, strict=True)],
                               "seg int, key long, n long").repartition(4, "seg")
    parts = lm.filter_segments(df).cache()
    f = lm._load(parts, 8, {r.seg: r.words for r in parts.collect()})
    level = f.level(keys)
    assert (lm.high(level) >= n).all() and (lm.low(level) <= n).mean() > 0.95
    assert (f.level(lm.seeded(98, 5000)) > 0).mean() < 0.1


def test_toxicity_on_held_out_labels(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(sf + "/labels.parquet")
    rows = queries.op7_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    bad = [r.predicted for r in rows if r.toxic == 1]
    good = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(bad) > 0.8 and np.mean(good) < 0.02
    out = queries.scored_toxicity(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.toxicity <= 1 for r in out)
    assert queries.scored_toxicity(none, labels).count() == 0


def test_restored_words():
    words = ["idiot", "the", "tion", "and", "stone"]
    grams = defaultdict(int)
    for w in words:
        for i in range(len(w) + 1):
            grams[("^^" + w + "$")[i:i + 3]] += 50
    lexicon = toxicity.Lexicon({"idiot ": 0.99}, dict(grams), 0.01)
    for t in ("1d10t", "i d i o t", "idiooot", "ID!OT", "i.d.i.o.t"):
        assert lexicon.score(f"the {t} and") > 0.9, t
    assert lexicon.score("the stone 12345 and") < 0.1


def test_restored_runs():
    words = ["stupid", "idiot", "you", "are", "a", "ass", "clown", "the", "hello", "and", "trash", "stone"]
    grams = defaultdict(int)
    for w in words:
        for i in range(len(w) + 1):
            grams[("^^" + w + "$")[i:i + 3]] += 50
    lexicon = toxicity.Lexicon({"stup": 0.99, "idiot ": 0.99, "trash ": 0.99, "ass ": 0.99}, dict(grams), 0.01)
    long = " ".join("thestone" * 8 + "idiot" + "and")
    assert len(long) > 80
    for t in ("y o u a r e a s t u p i d c l o w n", "y o u  a r e  s t u p i d", "i  d  i  o  t", "i\nd\ni\no\nt", "a s s", long, long.replace(" ", "."),
              "hello,1d10t", "so/tr4sh", "x" * 100 + ",1d10t"):
        assert lexicon.score(f"hello {t}") > 0.9, t
    for t in ("t h e s t o n e a n d y o u", "hello,st0ne/th3", "1 2 3 4 5 6"):
        assert lexicon.score(f"hello {t}") < 0.1, t


def test_line_dedup_odd_rows(odd, none):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(odd).collect()}
    assert out[3].text == ODD[2][1] and out[4].text == "other" and out[4].n_deleted == 1
    assert out[2].text is None and out[1].text == ""
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(odd).columns == [*odd.columns, "n_lines", "n_deleted"]


def test_line_dedup_repeats_within_one_text(spark):
    text = "\n".join(["first", *["alpha beta gamma"] * 60, "last"])
    row = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.text == "first\nalpha beta gamma\nlast"


def test_mixing(spark, odd, none):
    docs = spark.createDataFrame([(i, "w " * 10, "big" if i < 400 else f"s{i % 4}") for i in range(600)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, max_repeats=2.0).groupBy("source").agg(F.min("copies").alias("low"), F.sum("copies").alias("n"), F.count("*").alias("docs"))
    by = {r.source: r for r in mixed.collect()}
    assert by["big"].low == 1 and by["big"].n == 400 and all(1.9 <= by[s].n / by[s].docs <= 2 for s in ("s0", "s1", "s2", "s3"))
    even = mixing.mix(docs, entropy=float(np.log(5)) - 1e-6).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert max(r.n for r in even) - min(r.n for r in even) <= 8
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0
    assert mixing.realise(mixing.mix(odd)).count() >= len(ODD)


def test_hilbert_neighbours():
    g = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    key = hilbert_keys(g, 3)
    assert len(set(key.tolist())) == 512 and (np.abs(np.diff(g[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_nearest_neighbours(spark):
    t = ds.dataset(SF + "/embeddings.parquet").to_table()
    x = np.array(t["embedding"].to_pylist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = t["vec_id"].to_numpy()
    got = defaultdict(list)
    for r in queries.op5_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(got[ids[q]]))
        n += 5
    assert hits >= 0.9 * n
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]),
            (6, [0.5, 0.5]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (100, [1e-30, 2e-30])]
    few = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in few if r.query_id == 0) == [(1, 1), (2, 50), (3, 6), (4, 100)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_ties_and_repeated_ids(spark):
    """Equal cosines by power-of-two and other multiples, more of them than are kept: the smallest ids; other columns and names play no part."""
    schema = "vec_id long, embedding array<float>, score double, point string, near double"
    rng = np.random.default_rng(8)
    rows = [(0, [3.0, 4.0, 0.0, 0.0])] + [(120 - i, [0.0, 0.5 * 2.0 ** i, 0.0, 0.0]) for i in range(20)]
    rows += [(200 + i, [float(c) for c in -np.abs(rng.normal(size=4))]) for i in range(40)]
    got = ann.nearest(spark.createDataFrame([(*r, None, None, None) for r in rows], schema), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [101, 102, 103, 104, 105] and {r.score for r in got} == {0.8}
    rows = [(0, [1.0, 0.0])] + [(30 - i, [float(3 * i + 1), 0.0]) for i in range(20)] + [(50, [0.0, 1.0]), (50, [1.0, 0.0]), (50, [-1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 11, 1.0), (0, 2, 12, 1.0), (0, 3, 13, 1.0), (50, 1, 0, 1.0), (50, 2, 11, 1.0),
                                                                              (50, 3, 12, 1.0)]


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.NET/en/x?q#f"), (2, "http://example.net/de/"), (3, "http://b.example.com/de/1"), (4, None),
                                   (5, "nothing"), (6, "https://c.org/fr/x"), (6, "https://c.org/fr/x"), (7, "http://net"), (None, "x://y.org/en")],
                                  "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 1)], "doc_id long, quality int, toxic int")
    out = urls.judge(pages, labels, queries.URL_RULES, bad=F.col("toxic") == 1).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == 9 and got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4] == got[5] == ("", "", None, "allow") and got[6][2:] == ("org/fr/", "allow")
    assert got[7][:3] == ("net", "", None)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, labels, queries.URL_RULES, bad=F.col("toxic") == 1).count() == 0


def test_mined_rules_against_brute_force(spark):
    rows = [(list("abcde"), 3, 3), *[([x for x in "abcde" if x != y], 0, 2) for y in "abcde"],
            (sorted(["ends:net", "ends:x.net", "label:x", "label:net", "segment:p"]), 2, 2), (["ends:net", "label:net", "segment:p"], 0, 1), (["segment:p"], 0, 3)]
    total = sum(b for _, b, _ in rows)
    sure = {}
    for items in {c for t, b, _ in rows if b for n in range(1, len(t) + 1) for c in itertools.combinations(t, n)}:
        held = [(b, n) for t, b, n in rows if set(items) <= set(t)]
        bad, n = map(sum, zip(*held, strict=True))
        if bad >= 0.2 * total and bad / n >= 0.6:
            sure[items] = (bad / n, bad)
    want = {i: v for i, v in sure.items() if not any(set(j) < set(i) and w[0] >= v[0] for j, w in sure.items())}
    got, _ = urls.mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad long, n long"), 0.2, 0.6)
    assert {tuple(r["items"]): (r.confidence, r.support) for r in got.collect()} == want and tuple("abcde") in want


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(SF + "/documents.parquet")
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = p.materialize(stage(spark, now, SF))
        assert now.columns == docs.columns, name
    out = p.bpe_stage(spark, now, SF)
    assert out.count() == now.count() and set(docs.columns) < set(out.columns)
