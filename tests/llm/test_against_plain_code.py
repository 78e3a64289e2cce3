"""Trained operators against plain code: Kneser-Ney by dictionaries, compressed sizes one by one, alignment at every place."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from virosight.llm import compression, language_id, licenses, quality, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the er on an re he in ed nd ha at".split(), "de": "sch ung lich ein ver keit ich".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[i], "s", 0) for i, t in enumerate(texts)], DOCS)


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over the last byte of runs of five, by the textbook sums."""

    def __init__(self, texts):
        runs = [b"\n" * 4 + t.encode() for t in texts]
        self.n = {5: Counter(r[i : i + 5] for r in runs for i in range(len(r) - 4))}
        for k in range(4, 0, -1):
            self.n[k] = Counter(r[1:] for r in self.n[k + 1])
        self.off, self.total, self.left = {}, {}, {}
        for k, counts in self.n.items():
            c = Counter(counts.values())
            y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.0
            d = [i - (i + 1) * y * c[i + 1] / c[i] if c[i] and c[i + 1] else 0.5 for i in (1, 2, 3)]
            self.off[k] = [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d)]
            self.total[k], self.left[k] = Counter(), Counter()
            for r, n in counts.items():
                self.total[k][r[:-1]] += n
                self.left[k][r[:-1]] += self.off[k][min(n, 3) - 1]

    def p(self, run):
        k = len(run)
        if k == 0:
            return 1 / 256
        total = self.total[k][run[:-1]]
        if not total:
            return self.p(run[1:])
        n = self.n[k][run]
        return (n - self.off[k][min(n, 3) - 1] if n else 0) / total + self.left[k][run[:-1]] / total * self.p(run[1:])

    def bits(self, text):
        data = b"\n" * 4 + text.encode()
        return -sum(math.log2(self.p(data[i : i + 5])) for i in range(len(data) - 4)) / (len(data) - 4)


def test_perplexity_against_plain_kneser_ney_both_ways(spark):
    rng = random.Random(1)
    trusted = [prose(rng, "en", 30) for _ in range(40)]
    plain = PlainKneserNey(trusted)
    texts = [prose(rng, "en", 20), "zzz QQQ", "é", prose(rng, "de", 3000), None, "", prose(rng, "en", 5)]
    tables = quality.train_tables(docs_of(spark, [*trusted, None, ""]).select("text"))
    docs = docs_of(spark, texts + [texts[0]])
    local = {r["doc_id"]: r["_bits"] for r in quality.score(docs, quality.collected(tables)).collect()}
    sharded = {r["doc_id"]: (r["_bytes"], r["_bits"]) for r in quality.score_sharded(docs, tables).collect()}
    for i, t in enumerate([*texts, texts[0]]):
        if not t:
            assert local[i] is None and sharded[i] == (0, None)
        else:
            want = plain.bits(t)
            assert local[i] == pytest.approx(want, abs=2e-3) and sharded[i][1] == pytest.approx(want, abs=2e-3) and sharded[i][0] == len(t.encode())
    assert quality.score_sharded(docs.limit(0), tables).count() == 0


def test_quality_of_odd_tables(spark):
    rng = random.Random(2)
    texts = [prose(rng, "en", 60) for _ in range(60)]
    docs = docs_of(spark, [*texts, *texts[:3], "#%&" * 90, prose(rng, "en", 30_000)]).withColumn("bits", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id in (0, 63)"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == 67
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["bits"], r["rejected"]))
    assert all(len(v) == 1 for v in by.values()) and [by[60 + i] for i in range(3)] == [by[i] for i in range(3)]
    assert next(iter(by[63]))[1] and not next(iter(by[64]))[1]
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.keep_good(docs, labels).columns == docs.columns
    # The sample holds no copy and no held-out text, whatever the order of rows.
    drawn = sorted(r["text"] for r in quality.trusted_sample(docs, labels).collect())
    again = sorted(r["text"] for r in quality.trusted_sample(docs.repartition(7), labels.repartition(3)).collect())
    held = {r["text"] for r in docs.where(quality._is_held("text")).collect()}
    assert drawn == again and len(drawn) == len(set(drawn)) and not held & set(drawn) and held


def plain_sizes(text, contents, size, level):
    """Compressed size of each window of a text under each dictionary, each by a call of its own."""
    form = compression.plain(text)
    windows = [compression._PAD + form[a : a + n] + compression._TAIL for a, n in compression.cuts(form, size)]
    return [[len(compression.compressor(c, level).compress(w)) for w in windows] for c in contents]


def test_language_is_that_of_the_least_plain_size(spark):
    rng = random.Random(3)
    langs = ["en", "de"] * 30
    docs = docs_of(spark, [prose(rng, g, 50) for g in langs], langs)
    model = language_id.learn_languages(docs)
    texts = [prose(rng, "en", 5), prose(rng, "de", 900), prose(rng, "en", 40) + " " + prose(rng, "de", 40), "q", "the", "ich the"]
    odd = docs_of(spark, [*texts, texts[0]]).withColumns({"lang_pred": F.lit(1), "score": F.lit("clash")})
    got = language_id.predict_languages(odd, model).orderBy("doc_id").collect()
    for r, t in zip(got, [*texts, texts[0]], strict=True):
        total = {g: sum(s) for g, s in zip(model, plain_sizes(t, model.values(), language_id.WINDOW_BYTES, language_id.LEVEL), strict=True)}
        best = min(total, key=lambda g: (total[g], g))
        margin = max(total.values()) - total[best]
        assert r["lang_pred"] == best and r["rejected"] == (margin < max(language_id.LEAST_MARGIN, language_id.NARROW * total[best]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin * 8 / language_id.TEMPER)))
    assert language_id.predict_languages(odd.limit(0), model).count() == 0
    assert language_id.keep_identified(odd, {}).count() == odd.count()


def test_more_languages_than_a_worker_holds(monkeypatch):
    model = {k: prose(random.Random(k), "en", 300).encode() for k in "abcde"}
    text = [model["d"].decode(), "the ha", None]
    want = language_id.classify(text, model)
    monkeypatch.setattr(language_id, "HELD_LANGUAGES", 2)
    got = language_id.classify(text, model)
    assert got[0] == want[0] and got[0][0] == "d" and (got[1] == want[1]).all() and (got[2] == want[2]).all()


def test_toxicity_score_from_plain_sizes(spark):
    rng = random.Random(4)
    insult = "scumbag worthless pathetic moron".split()

    def text(toxic, n=60):
        words = prose(rng, "en", n).split()
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insult))
        return " ".join(words)

    train = [(k % 2, text(k % 2)) for k in range(400)]
    model = toxicity.learn_toxicity(train)
    # What sets the toxic dictionary apart stands in toxic texts word for word.
    own = model.toxic[: -len(model.ordinary) + model.ordinary.rindex(b" ", 0, -1)].decode()
    assert any(w in own for w in insult) and model.toxic[-1000:] == model.ordinary[-1000:]
    texts = [text(1), text(0), text(1, 20_000), "", None, "x"]
    docs = docs_of(spark, [*texts, texts[0]]).withColumn("score", F.lit("clash"))
    got = [r["score"] for r in toxicity.toxicity_scores(docs, model).orderBy("doc_id").collect()]
    for s, t in zip(got, [*texts, texts[0]], strict=True):
        a, b = (np.array(x) for x in plain_sizes(t, (model.ordinary, model.toxic), toxicity.WINDOW_BYTES, toxicity.LEVEL))
        gain = a - b
        x = np.array([1, max([0, *np.clip(gain, 0, 12)]), np.log1p((gain >= 3).sum()), np.log1p((gain >= 5).sum()), np.maximum(gain, 0).mean() if len(gain) else 0.0, np.log1p(len(gain))])
        z = ((x - model.mean) / model.scale) @ np.array(model.weights)
        assert s == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_labelled_texts_hold_no_copies_and_do_not_hang_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_CLASS", 5)
    docs = docs_of(spark, ["same words"] * 300 + [f"text {i}" for i in range(40)] + [None, ""])
    labels = spark.createDataFrame([(i, i % 2) for i in range(342)] + [(None, 1), (3, None), (900, 1)], "doc_id long, toxic int")
    one = toxicity.labelled_texts(docs, labels)
    assert one == toxicity.labelled_texts(docs.repartition(5), labels.repartition(3)) and len(one) == 10 and len(set(one)) == 10


def test_search_near_telling_words_loses_no_place(spark):
    rng = random.Random(5)
    notice = licenses.TEMPLATES["bsd-grant"]
    template = licenses.words_of(notice.encode())
    scanner = licenses.Scanner({"own": notice})
    for _ in range(15):
        body = [w for w in template if rng.random() > 0.15]
        for _ in range(5):
            body.insert(rng.randrange(len(body)), b"zq%d" % rng.randrange(99))
        text = [b"w%d" % rng.randrange(50) for _ in range(rng.randrange(40))] + body + [b"w%d" % rng.randrange(50) for _ in range(rng.randrange(40))]
        reach = len(template) + len(template) // 4 + 2
        best = max(len(licenses.align(text[i : i + reach + len(template) // 2], template)) for i in range(len(text)))
        assert scanner.scan(b" ".join(text), 0.8)[1] * len(template) >= 0.97 * best
    docs = docs_of(spark, [notice, notice, None, notice * 300]).withColumn("found", F.lit("clash"))
    got = licenses.scan_licenses(docs).orderBy("doc_id").collect()
    assert [r["best_coverage"] for r in got] == [1.0, 1.0, 0.0, 1.0] and got[0]["found"] == got[1]["found"]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_loaded_vocabulary_and_long_urls(spark, monkeypatch):
    table = spark.createDataFrame([("Foo", "strict"), ("bar", "soft"), ("bar", "STRICT"), ("baz", "soft"), ("qux", " soft "), (None, "soft"), ("x", None), ("", "soft")], "term string, class string")
    strict, soft = url_filter.load_vocabulary(table)
    assert (strict, soft) == (("bar", "foo"), ("baz", "qux"))
    urls = ["http://h.com/" + "a/" * 50_000 + "foo", "http://h.com/baz-qux", "http://h.com/baz"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[1]])], "page_id long, url string")
    got = [r["verdict"] for r in url_filter.judge_urls(df, rules=(), strict=strict, soft=soft).orderBy("page_id").collect()]
    assert got == ["block", "block", "allow", "block"]
    monkeypatch.setattr(url_filter, "MAX_TERMS", 2)
    with pytest.raises(ValueError):
        url_filter.load_vocabulary(table)
