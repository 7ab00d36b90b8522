"""Ranked search, language of documents, and the divergence audit: brute force, enumeration, held-out accuracy, odd tables."""

import glob
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrail.llm import divergence, langid, queries, search

SF = "/root/testdata/sf0.001"
DOC = "DOC_ID long, text string, lang string, source string, term string, chunk string, n string, seat string, value long"
ODD = [
    (1, "alpha beta Beta gamma", "en", "s", "x", "y", "z", "w", 1),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "s", "", "", "", "", 0),
    (4, " \n\t 12 -- ²", "en", "t", "", "", "", "", 0),
    (5, "alpha 7 Éa éa", "fr", "s", "", "", "", "", 0),
    (5, "alpha 7 Éa éa", "fr", "s", "", "", "", "", 0),
    (None, "alpha beta", "en", "s", "", "", "", "", 0),
    (6, "long " * 60000 + "beta", "en", "u", "", "", "", "", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", ["op11_search", "op13_divergence"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE[name]).df()
    key = list(want.columns)
    assert len(got) and got[key].sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True).astype(got[key].dtypes))


# 11 ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(docs, items, k):
    bags = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs if t is not None]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(TERM.findall(lowered(text)))
    out = []
    for item, terms in asked.items():
        scored = []
        for place, (i, b) in enumerate(bags):
            m = 50 + 50 * sum(b.values()) * n // length
            s = sum(weight[t] * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, place))
        out += [(item, r, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [search.BLOCK_CHARS, 300])
def test_search_equals_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(search, "CHUNK_ROWS", 7)
    monkeypatch.setattr(search, "SEGMENT", 3)
    monkeypatch.setattr(search, "FEW", 5)
    rng = random.Random(4)
    word = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(word, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(150)] + [(1000 + i, "w50 w51 w52 same") for i in range(20)]
    items = [(i, text(12)) for i in range(30)] + [(90, "w50 w51 nowhere"), (90, "w52"), (91, None), (None, "w1"), (92, "nowhere"), (93, "W1 w1 w2")]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 10, chars)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 10)


def phases(docs, bench, k):
    """The bounds of phase one, what phase two fetches, and how many documents phase three looks up."""
    asked = next(search.blocks(docs.sparkSession, bench))
    index = search.forward(docs, asked).cache()
    known = search.statistics(index, asked)
    table = search.postings(index, known).cache()
    first = search.heads(table, k).toPandas()
    assert first.groupby("term").size().max() == k
    bound, largest = np.zeros(len(asked.ids), np.int64), np.zeros(len(asked.vocabulary), np.int64)
    for t, part in first[["term", "part"]].itertuples(index=False):
        largest[t] = max(largest[t], part)
    for i, terms in enumerate(asked.terms):
        seen = first[first["term"].isin(terms)].groupby(["chunk", "at"])["part"].sum().sort_values(ascending=False)
        bound[i] = seen.iloc[k - 1] if len(seen) >= k else 0
    limits = search.Thresholds.of(asked, largest, bound)
    for i in range(len(asked.ids)):  # what no list shows stays below the bound
        assert bound[i] == 0 or int(limits.below[i].sum()) < bound[i]
    whole = table.select(F.sum(F.size("ats"))).first()[0]
    taken = search.fetched(table, limits).select(F.sum(F.size("ats"))).first()[0]
    near = search.bounded(search.fetched(table, limits), asked, limits, k)
    looked = near.join(search.kth(near, "seen", k), "item", "left").where(F.col("most") >= F.coalesce("bound", F.lit(0))).count()
    index.unpersist()
    table.unpersist()
    return whole, taken, looked / (len(asked.ids) * known.documents)


def test_few_documents_are_looked_up(spark):
    """Over real items the upper bounds leave few documents of each item."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    assert phases(docs, bench, 50)[2] < 0.1


def test_lists_below_the_threshold_are_not_fetched(spark):
    """The list of a common word is cut by the bound that rare words give."""
    docs = [(i, ("common " if i % 2 == 0 else "own ") + ("rare other" if i % 40 == 0 else f"x{i % 7}")) for i in range(2000)]
    whole, taken, looked = phases(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "common rare other")], "item_id long, text string"), 10)
    assert (whole, taken, looked) == (1100, 100, 50 / 2000)


def test_search_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "ALPHA 7", 0), (2, "", 0), (3, None, 0), (4, "beta éa", 0)], "item_id long, text string, score long")
    got = [tuple(r) for r in search.search(odd, items).orderBy("item_id", "rank").collect()]
    plain = [(r[0], r[1]) for r in ODD]
    assert sorted(got, key=str) == brute_search(plain, [(1, "ALPHA 7"), (4, "beta éa")], 50)
    assert search.search(empty, items).count() == 0
    assert search.search(odd, items.limit(0)).count() == 0


# 12 language of documents


@pytest.mark.parametrize("tags", [2, 4])
def test_marginals_equal_enumeration(tags):
    rng = np.random.default_rng(1)
    score, trans = rng.normal(size=(5, tags)) * 2, rng.normal(size=(tags, tags))
    weight = {}
    for path in itertools.product(range(tags), repeat=5):
        weight[path] = math.exp(sum(score[t, k] for t, k in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
    total = sum(weight.values())
    want = np.array([[sum(w for p, w in weight.items() if p[t] == k) / total for k in range(tags)] for t in range(5)])
    assert np.allclose(langid.marginals(score, np.array([5]), trans), want)


def test_marginals_over_segments_equal_a_plain_pass():
    rng = np.random.default_rng(2)
    lengths = [1, 64, 65, 3, 200, 128, 1]
    score, trans = rng.normal(size=(sum(lengths), 3)) * 3, rng.normal(size=(3, 3))
    got, at = langid.marginals(score, np.array(lengths), trans), 0
    for n in lengths:
        e = score[at : at + n]
        a, b = [e[0]], [np.zeros(3)]
        for t in range(1, n):
            a.append(e[t] + np.logaddexp.reduce(a[-1][:, None] + trans, 0))
        for t in range(n - 2, -1, -1):
            b.append(np.logaddexp.reduce(trans + (e[t + 1] + b[-1])[None], 1))
        x = np.array(a) + np.array(b[::-1])
        assert np.allclose(got[at : at + n], np.exp(x - np.logaddexp.reduce(x, 1)[:, None]))
        at += n


def test_gradient_of_the_chain_likelihood():
    rng = np.random.default_rng(3)
    lengths, tag = np.array([4, 3]), rng.integers(0, 3, 7)
    score, trans = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))

    def loss(score, trans):
        out, at = 0.0, 0
        for n in lengths:
            e, k = score[at : at + n], tag[at : at + n]
            a = e[0]
            for t in range(1, n):
                a = e[t] + np.logaddexp.reduce(a[:, None] + trans, 0)
            out += np.logaddexp.reduce(a) - e[np.arange(n), k].sum() - trans[k[:-1], k[1:]].sum()
            at += n
        return out

    by_score, by_trans = langid.gradient(score, lengths, trans, tag)
    for by, x, of in ((by_score, score, lambda d: loss(score + d, trans)), (by_trans, trans, lambda d: loss(score, trans + d))):
        for place in np.ndindex(x.shape):
            d = np.zeros(x.shape)
            d[place] = 1e-5
            assert abs((of(d) - of(-d)) / 2e-5 - by[place]) < 1e-6


def test_features_of_words_together_equal_those_of_one():
    words = ["a", "ab", "straße", "éçà", "language", "x" * 300]
    lexicon = {"ab": (5, 9)}
    owner, bucket = langid.features(words, lexicon)
    for i, w in enumerate(words):
        alone = langid.features([w], lexicon)[1]
        n = len(w)
        assert sorted(bucket[owner == i].tolist()) == sorted(alone.tolist())
        assert len(alone) == 2 * min(n, 3) + max(0, n - 1) + max(0, n - 2) + len(lexicon.get(w, langid.NO_WORD))


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_language_of_held_out_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = langid.label(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]]
    assert len(rows) == docs.count() and (held["lang"] == held["lang_pred"]).mean() >= 0.99
    assert rows["score"].between(0, 1).all()


def test_language_of_switched_text(spark, model):
    """Words of spliced texts are labelled by their language, and the switch is found where it is."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 800").select("doc_id", "lang", "text").toPandas()
    held = docs[[zlib.crc32(str(i).encode()) % 5 == 0 for i in docs["doc_id"]]]
    by = {lang: [langid.words_of(t)[:60] for t in held[held["lang"] == lang]["text"][:20]] for lang in sorted(set(held["lang"]))}
    made, truth = [], []
    for a, b in itertools.permutations(by, 2):
        for x, y in zip(by[a], by[b], strict=False):
            made.append((len(made), " ".join(x + y)))
            truth.append([a] * len(x) + [b] * len(y))
    right = words = 0
    for r in langid.label(spark.createDataFrame(made, "doc_id long, text string"), model).collect():
        got = [x["lang"] for x in r["runs"] for _ in range(x["end"] - x["start"])]
        assert len(got) == len(truth[r["doc_id"]]) and r["runs"][0]["start"] == 0
        words += len(got)
        right += sum(g == t for g, t in zip(got, truth[r["doc_id"]], strict=True))
    assert len(made) >= 100 and right / words >= 0.97


def test_scores_equal_a_plain_computation(spark, model):
    """Text by text: features added up by hand, a plain pass over the chain, the mean of the marginals."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in langid.label(docs, model).collect()}
    for doc_id, text in docs.where("length(text) < 3000").limit(150).collect():
        words = langid.words_of(text)
        if not words:
            assert got[doc_id]["lang_pred"] == "und" and got[doc_id]["score"] == 0
            continue
        e = np.array([model.weights[langid.features([w], model.lexicon)[1]].astype(float).sum(0) for w in words])
        a, b = [e[0]], [np.zeros(e.shape[1])]
        for t in range(1, len(e)):
            a.append(e[t] + np.logaddexp.reduce(a[-1][:, None] + model.trans, 0))
        for t in range(len(e) - 2, -1, -1):
            b.append(np.logaddexp.reduce(model.trans + (e[t + 1] + b[-1])[None], 1))
        x = np.array(a) + np.array(b[::-1])
        p = np.exp(x - np.logaddexp.reduce(x, 1)[:, None]).mean(0)
        assert got[doc_id]["lang_pred"] == model.langs[int(p.argmax())] and abs(got[doc_id]["score"] - p.max()) < 1e-4


def test_language_odd(spark, odd, empty, model):
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in langid.identify(odd).collect()]
    assert len(got) == len(ODD)
    assert {(i, p, s) for i, _, p, s in got if i in (2, 3, 4)} == {(i, "und", 0.0) for i in (2, 3, 4)}
    assert all(h is (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, h, _, _ in got)
    assert all(p in ("en", "fr", "und") and 0 <= s <= 1 for _, _, p, s in got)
    assert langid.identify(empty).count() == 0
    # Nothing to learn from: all is unknown.
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.label(odd, model).collect()} <= {"und", *model.langs}


# 13 divergence audit


def brute_audit(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", term.findall(lowered(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in own for t in set(w))
        kept = [t for t, n in df.items() if n >= 30]
        groups = {s: Counter(t for _, x, w in own if x == s for t in w) for s in {d[1] for d in own}}

        def share(count, kept=kept):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        whole, by = share(sum(groups.values(), Counter())), {s: share(c) for s, c in groups.items()}
        for s, p in by.items():
            pairs = sorted((-sum(abs(p[t] - q[t]) for t in kept), x.encode(), x) for x, q in by.items() if x != s)
            out += [(lang, s, "pair", x, -v, r) for r, (v, _, x) in enumerate(pairs, 1)]
            terms = sorted((whole[t] - p[t], t.encode(), t) for t in kept if groups[s][t] > 0 and p[t] > whole[t])
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(terms[:50], 1)]
    return sorted(out)


@pytest.mark.parametrize(("sources", "seats", "terms"), [(9, 64, 1 << 14), (11, 4, 16), (1, 64, 16), (2, 64, 8)])
def test_audit_equals_brute_force(spark, monkeypatch, sources, seats, terms):
    monkeypatch.setattr(divergence, "SEATS", seats)
    monkeypatch.setattr(divergence, "SEAT_GROUPS", 2)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    rng = random.Random(sources)
    word = [f"{a}{b}" for a in "abcdé" for b in "xyzß"] * 4 + ["Éx", "AB", "zz"]
    rows = [(" ".join(rng.choices(word, k=rng.randrange(0, 30))) + f" own{i % 3}", rng.choice(["en", "de", None]), f"s{rng.randrange(sources)}") for i in range(600)]
    rows += [("", "en", "without"), (None, "xx", "a"), (None, "xx", "b"), ("rare words", "xx", None)]
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4))
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got.collect()) == brute_audit(rows)


@pytest.mark.parametrize("seats", [2, 4, 6, 12, 64])
def test_every_two_seats_meet_once(spark, seats):
    table = spark.range(seats).select(F.col("id").alias("seat"), F.lit(seats).cast("long").alias("seats"))
    met = []
    for turn in range(seats - 1):
        rows = table.select("seat", divergence.partner(F.col("seat"), F.col("seats"), turn).cast("long").alias("to")).collect()
        by = {r["seat"]: r["to"] for r in rows}
        assert all(by[by[s]] == s and by[s] != s for s in by)
        met += [tuple(sorted(x)) for x in by.items()]
    assert Counter(met) == {pair: 2 for pair in itertools.combinations(range(seats), 2)}


def test_shares_are_exact_for_large_counts():
    total = 8_999_999_999_999_999
    counts = np.array([5, 1, total, total - 1, 123_456_789_012_345], np.int64)
    assert divergence.scaled(counts, total).tolist() == [1 + 10**9 * int(c) // total for c in counts]


def test_vectors_come_back():
    groups = [("é", 5, 2, np.array([1, 9, 1 << 40], np.int64), np.array([1, 2, 3], np.int64)), ("", 0, 0, np.empty(0, np.int64), np.empty(0, np.int64))]
    got = divergence.unpacked(divergence.packed(groups))
    assert [(g[0], g[1], g[2], g[3].tolist(), g[4].tolist()) for g in got] == [(g[0], g[1], g[2], g[3].tolist(), g[4].tolist()) for g in groups]


def test_audit_odd(odd, empty):
    got = divergence.audit(odd)
    assert {(r["lang"], r["source"], r["item"], r["value"], r["rank"]) for r in got.collect() if r["lang"] == "en"} == {("en", "s", "t", 0, 1), ("en", "s", "u", 0, 2), ("en", "t", "s", 0, 1), ("en", "t", "u", 0, 2), ("en", "u", "s", 0, 1), ("en", "u", "t", 0, 2)}
    assert divergence.audit(empty).count() == 0
