import zlib

import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellgrove.llm import classlm, language, toxicity
from cellgrove.llm.queries import queries


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_fold_is_crc_of_the_id_as_text(spark):
    from cellgrove.llm import common

    rows = spark.createDataFrame([(i,) for i in (0, 7, 123, 99999)], "doc_id long").select("doc_id", common.fold(5).alias("f")).collect()
    assert [r.f for r in rows] == [crc(r.doc_id, 5) for r in rows]


def test_staged_tables_can_be_cleared(spark):
    from cellgrove.llm import common

    assert common.staged(spark, spark.range(3), "x").count() == 3
    common.clear_staged(spark)
    assert common.staged(spark, spark.range(3), "x").count() == 3


# toxicity
def test_toxicity_generalises_to_misspellings():
    rng = np.random.default_rng(0)
    plain, bad = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"], ["idiotic", "idioti", "idiots", "idiotx"]
    text = lambda toxic: " ".join(list(rng.choice(plain, 60)) + ([str(rng.choice(bad))] if toxic else []))
    y = np.arange(300) % 3 == 0
    scorer = toxicity.train([text(t) for t in y], y).scorer()
    p = scorer.score(["wai wbj idiotz wck wdl wem wfn", "wai wbj wck wdl wem wfn", text(True), text(False)])
    assert p[0] > 0.5 > p[1] and p[2] > 0.5 > p[3]


def test_toxicity_on_held_out_documents(spark, medium):
    out = queries()["op1_toxicity"](spark, medium).persist()
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == 1000 and {r.predicted == (r.score >= 0.5) for r in rows} == {True}
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right >= 0.85


def test_toxicity_odd_rows(odd, spark):
    none = toxicity.score_documents(odd, None)
    assert none.count() == 9 and {r.score for r in none.collect()} == {0.0}
    labels = spark.createDataFrame([(3, 1, 1), (5, 0, 0), (6, None, None), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels, holdout=None)
    got = toxicity.score_documents(odd, model)
    assert got.count() == 9 and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.fit(odd.where("false"), labels) is None and toxicity.fit(odd, labels.where("false")) is None


def test_run_means_and_word_means():
    assert toxicity.run_means(np.arange(3.0)).tolist() == [1.0]
    assert len(toxicity.run_means(np.ones(toxicity.RUN + 4))) == 5
    assert toxicity.word_means([], np.ones(toxicity.BUCKETS)).tolist() == []
    assert toxicity.word_means([b"a", b"abc"], np.ones(toxicity.BUCKETS)).tolist() == [1.0, 1.0]


# language
def test_gram_counts_against_brute_force():
    def brute(text):
        import itertools

        t = "".join("0" if c in "0123456789" else c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower() + "\n")
        t = "".join(k if k != " " else " " for k, _ in itertools.groupby(t) for _ in (range(1) if k == " " else range(len(list(_)))))
        return sum(max(0, len(t) - n + 1) for n in (1, 2, 3))

    texts = ["Ab  c1d", "", "élan!", "a", "½ ²①x", "e\u0301 12"]
    got, letters = language.gram_counts(texts)
    assert got.sum(axis=1).tolist() == [brute(t) for t in texts]
    assert letters.tolist() == [4, 0, 4, 1, 1, 2]
    for i, t in enumerate(texts):
        assert (language.gram_counts([t])[0][0] == got[i]).all()


def test_language_on_held_out_documents(spark, medium):
    out = queries()["op2_language"](spark, medium)
    rows = out.join(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.98
    assert sum(r.rejected for r in rows) / len(rows) <= 0.01


def test_language_odd_rows(odd, docs):
    model = language.fit(docs(*((i, f"{'the cat sat on a mat' if i % 2 else 'der hund lief durch das haus'} {i}") for i in range(40)), lang={i: "en" if i % 2 else "de" for i in range(40)}), holdout=None)
    got = language.identify(odd, model).collect()
    assert len(got) == 9
    for r in got:
        if r.doc_id in (1, 2, 4):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert language.identify(docs((1, "le chat"), (2, "the mat sat")), model).collect()[1].lang_pred == "en"
    empty = language.fit(odd.where("false"))
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 4})


def test_language_against_brute_force(docs):
    """Each text goes to the centroid with the largest cosine, computed anew from the definition."""
    rows = [(i, f"{'the cat sat on a mat' if i % 2 else 'der hund lief durch das haus'} {'xyz'[i % 3]}") for i in range(60)]
    model = language.fit(docs(*rows, lang={i: "en" if i % 2 else "de" for i in range(60)}), holdout=None)
    texts = ["a mat", "das haus", "hund cat", "zzz"]
    for t, r in zip(texts, sorted(language.identify(docs(*enumerate(texts)), model).collect(), key=lambda r: r.doc_id), strict=True):
        x = np.log1p(language.gram_counts([t])[0][0].astype(float)) * model.idf
        cos = [float(x @ c / (np.linalg.norm(x) * np.linalg.norm(c) or 1)) for c in model.centroids]
        assert r.lang_pred == model.langs[int(np.argmax(cos))] and r.score == pytest.approx(max(0, *cos), abs=1e-5)


def test_numbers_are_no_letters(docs):
    model = language.fit(docs(*((i, "the cat sat on the mat") for i in range(9))), holdout=None)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs((1, "½ ² ①"), (2, "12 34"), (3, "ª the"), (4, "ⅷ½x")), model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == got[4][0] == "en"


def test_junk_and_foreign_texts_are_rejected(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    model = language.fit(docs)
    rng = np.random.default_rng(3)
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(300)]
    polish = "nie jest to co się na do że jak ale po tak za już czy tylko przez jego może był dla być mnie kiedy bardzo".split()
    finnish = "ja on se että ei ole kun mutta niin hän oli myös vain kuin jo sitä minä sinä tämä talo kissa järvi".split()
    cyrillic = "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой".split()
    texts = [" ".join(rng.choice(w, n)) for w in (letters, polish, finnish, cyrillic) for n in (20, 300)] + ["1234 5678 a 99 " * 40, "0f3a9c 77be01 d4e5 " * 40]
    assert model.predict(texts)[2].all()
    kept = language.keep_identified(docs, model)
    assert kept.count() >= 0.99 * docs.count()


def test_far_texts_are_rejected(docs):
    model = language.fit(docs(*((i, "the cat sat on the mat and ate the rat " * 3) for i in range(60))), holdout=None)
    got = language.identify(docs((1, "the rat ate the cat"), (2, "жжжщщщ ъыь")), model).collect()
    assert [r.rejected for r in got] == [False, True]


# language model
def brute_base(rows, held):
    from collections import Counter

    count, n = Counter(), 0
    words = lambda t: (t or "").encode().lower().split() + [None]
    for i, t in rows:
        if not held(i):
            count.update(words(t))
            n += len(words(t))
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, len(w), sum(count[x] > 0 for x in w), n, sum(np.log10((count[x] + 0.1) / (n + 0.1 * (len(count) + 1))) for x in w)))
    return out


def test_lm_base_against_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) % 500) + " x") for i in range(60)] + [(70, None), (71, ""), (None, "w1 w1")]
    df = docs(*rows)
    held = lambda i: i is None or crc(i, 10) == 0
    train = classlm._rows(df).where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0)
    counts = classlm.count_words(train)
    for part_words, least in ((3, 2), (100_000, 5), (100_000, 10**9)):
        model = classlm.fit(train, counts, least=least, part_words=part_words, core=(8, 8))
        assert least > 100 or model.parts == -(-counts.where(F.col("n") >= least).count() // part_words)
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in classlm.score_documents(df, counts, model).collect()), key=str)
        words = {int(r.word): (r.n, r.cls) for r in model.vocabulary.collect()} if model.vocabulary is not None else {}
        known = {int(r.word): r.n for r in counts.collect()}
        for g, w, (_, t) in zip(got, sorted(brute_base(rows, held), key=str), sorted(rows, key=str), strict=True):
            assert g[:4] == w[:4] and g[4] == pytest.approx(w[4]) and g[5] == pytest.approx(brute_class(model, words, known, t))


def brute_class(model, words, known, text):
    """The class score of one text, token by token."""
    at, total = model.end, 0.0
    h = [x for _, _, h, _ in classlm._slices(pa.array([text or ""])) for x in h.tolist()]
    for x in h:
        n, c = words.get(x, (known.get(x, 0), model.rare))
        total += model.log_next[at, c] + (np.log10(n) - model.log_class[c] if x in words else np.log10(n + 0.1) - model.rare_norm)
        at = c
    return total + model.log_next[at, model.end]


def test_lm_is_a_distribution_and_beats_the_base(spark, medium):
    rows = queries()["op9_classlm"](spark, medium).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("text IS NOT NULL")
    train = classlm._rows(docs)
    counts = classlm.count_words(train)
    m = classlm.fit(train, counts)
    assert np.allclose((10**m.log_next).sum(axis=1), 1)
    words = m.vocabulary.toPandas()
    assert len(words) == counts.where(F.col("n") >= classlm.LEAST).count() > 512  # all words met often enough have a class
    for c, part in words.groupby("cls"):
        assert (10 ** (np.log10(part.n) - m.log_class[c])).sum() == pytest.approx(1)
    rare = counts.where(F.col("n") < classlm.LEAST).toPandas().n
    assert ((rare + 0.1).sum() + 0.1) / 10**m.rare_norm == pytest.approx(1)


def test_words_beyond_the_core_go_to_the_class_they_stand_like(docs):
    rng = np.random.default_rng(5)
    kinds = [[f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]]
    weight = np.array([30.0] * 4 + [2.0] * 8) / 136
    rows = [(i, " ".join(str(rng.choice(kinds[k % 2], p=weight)) for k in range(40))) for i in range(60)]
    train = classlm._rows(docs(*rows))
    counts = classlm.count_words(train)
    model = classlm.fit(train, counts, core=(8, 8))
    cls = {r.word: r.cls for r in model.vocabulary.collect()}
    h = {w: int(next(classlm._slices(pa.array([w])))[2][0]) for k in kinds for w in k}
    sides = [{cls[h[w]] for w in k if h[w] in cls} for k in kinds]
    assert len(cls) > 16 and sides[0].isdisjoint(sides[1])


def test_exchange_finds_words_that_stand_alike():
    rng = np.random.default_rng(0)
    b = np.zeros((10, 10))
    for a in range(4):
        b[a, 4:8] = rng.integers(20, 30, 4)  # one kind is followed by the other
        b[4 + a, :4] = rng.integers(20, 30, 4)
    of = classlm.exchange(b, 2)
    assert len(set(of[:4])) == 1 and len(set(of[4:8])) == 1 and of[0] != of[4]


def test_lm_without_training_rows(odd):
    train = classlm._rows(odd).where("false")
    counts = classlm.count_words(train)
    got = classlm.score_documents(odd, counts, classlm.fit(train, counts)).collect()
    assert len(got) == 9 and all(r.n_known == 0 and np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
