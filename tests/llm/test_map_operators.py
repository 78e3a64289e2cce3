"""URL filter, decontamination, language, tokens, toxicity, licenses: small cases, odd inputs, brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from virosight.llm import compression, decontaminate, language_id, licenses, pieces, quality, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[i], "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def test_url_rules_and_terms(spark):
    urls = [
        None, "", "no scheme spam", "http://A.Example.NET/en/x?q", "http://x.net", "http://x.net/a", "https://b.example.com/de/1", "http://c.org/fr/xxx", "http://d.com/spamming",
        "http://d.com/cheap-pills", "http://d.com/cheap-cheap", "http://d.com/a#://e.net/", "http://notexample.com/de/", "http://example.com/DE/",
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [tuple(r)[1:5] for r in url_filter.judge_urls(df).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "block"), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("x.net", "", None, "allow"), ("x.net", "/a", "net/", "block"),
        ("b.example.com", "/de/1", "example.com/de/", "block"), ("c.org", "/fr/xxx", "org/fr/", "allow"), ("d.com", "/spamming", None, "allow"), ("d.com", "/cheap-pills", None, "block"),
        ("d.com", "/cheap-cheap", None, "allow"), ("d.com", "/a", None, "allow"), ("notexample.com", "/de/", None, "allow"), ("example.com", "/DE/", None, "allow"),
    ]
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    twice = url_filter.judge_urls(df.unionByName(df)).where("page_id = 9").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def brute_spans(words, items, window):
    hit, who = set(), set()
    for item, own in items.items():
        for i in range(max(1, len(own) - window + 1) if own else 0):
            win = own[i : i + window]
            for p in range(len(words) - len(win) + 1):
                if words[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    who.add(item)
    return hit, sorted(who)


@pytest.mark.parametrize("block_words", [200_000, 12])
def test_decontamination_against_brute_force(spark, block_words):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "É", "c3"])
    items = {str(i): [word() for _ in range(n)] for i, n in enumerate((3, 5, 9, 14, 1, 0))}
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["!!".join(items["3"]), None, "", "...", "É, B-c3 " * 500]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(int(i), " ".join(w).upper().replace("É", "É")) for i, w in items.items()] + [(7, None), (None, "a b c")], "item_id long, text string")
    out = decontaminate.contamination(docs, bench, window=5, block_words=block_words, with_offsets=True)
    for r in out.collect():
        text = texts[r["doc_id"]]
        words = [w.decode() for w in decontaminate.words_of(text.encode() if text else None)]
        hit, who = brute_spans(words, items, 5)
        assert r["n_words"] == len(words) and r["items"] == who
        assert {p for a, b in zip(r["spans"][::2], r["spans"][1::2]) for p in range(a, b)} == hit
        if hit:
            data = text.encode()
            for k, (a, b) in enumerate(zip(r["spans"][::2], r["spans"][1::2])):
                cut = data[r["byte_spans"][2 * k] : r["byte_spans"][2 * k + 1]]
                assert [w.decode() for w in decontaminate.words_of(cut)] == words[a:b]
    assert decontaminate.contamination(docs, bench.limit(0)).where("size(items) > 0").count() == 0


@pytest.mark.parametrize("block_words", [200_000, 3])
def test_decontamination_keeps_rows_of_equal_and_null_ids(spark, block_words):
    docs = spark.createDataFrame([(1, "a b c"), (1, "x d e f g"), (1, "a b c"), (None, "q"), (None, "d e f a b c"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "item_id long, text string")
    out = decontaminate.contamination(docs, bench, block_words=block_words, with_offsets=True)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["spans"], r["items"], r["byte_spans"]) for r in out.collect())
    assert got == [(0, 0, [], [], []), (0, 1, [], [], []), (0, 6, [0, 6], ["1", "2"], [0, 11]), (1, 3, [0, 3], ["1"], [0, 5]), (1, 3, [0, 3], ["1"], [0, 5]), (1, 5, [1, 4], ["2"], [2, 7])]


def test_decontamination_of_odd_tables(spark):
    docs = docs_of(spark, ["a b c " * 20_000, "a b c", "a b c", ""]).withColumns({"spans": F.lit("clash"), "items": F.lit(1), "_text": F.lit("x")})
    bench = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "...")], "item_id long, text string")
    got = decontaminate.contamination(docs, bench, with_offsets=True).orderBy("doc_id").collect()
    assert [(r["n_words"], r["spans"], r["items"]) for r in got] == [(60_000, [0, 60_000], ["1"]), (3, [0, 3], ["1"]), (3, [0, 3], ["1"]), (0, [], [])]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0 and decontaminate.drop_contaminated(docs.drop("_text"), bench).count() == 1


def test_contaminated_documents_go(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = docs_of(spark, ["x " + item.upper() + " y", "clean text", None, " ".join(f"w{i}" for i in range(9))])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = pieces.default_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(1)
    letters = " ▁aeéßthinst.,\n\t  0129_|ﬁÅ①　\xa0łž中文字한😀\r\x00<>s/"
    texts = ["", None, " ", "▁", "\n", "<s>", "a" * 300, " " * 70, "é" * 50, "The quick brown fox. " * 300] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    docs = docs_of(spark, texts).withColumn("ids", F.lit("clash"))
    for r in pieces.encode_documents(docs).collect():
        want = [lib.bos_id(), *lib.encode(texts[r["doc_id"]] or ""), lib.eos_id()]
        packed = b"".join(i.to_bytes(4, "little") for i in want)
        assert bytes(r["ids"]) == packed and r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert r["decoded"] == lib.decode(want) and r["decoded_sha256"] == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    same = pieces.token_digests(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in same] == [tuple(r) for r in pieces.encode_documents(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").orderBy("doc_id").collect()]


def test_pieces_of_odd_tables(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    long = "The quick brown fox " * 20_000
    docs = docs_of(spark, [long, "same text", "same text"])
    docs = docs.unionByName(docs.where("doc_id = 1"))
    got = pieces.token_digests(docs).collect()
    assert len(got) == 4 and len({r["ids_sha256"] for r in got if r["doc_id"] != 0}) == 1
    assert next(r["n_tokens"] for r in got if r["doc_id"] == 0) == len(lib.encode(long)) + 2
    assert pieces.token_digests(docs.limit(0)).count() == 0


SYLLABLES = {"en": "the er on an re he in ed nd ha at".split(), "de": "sch ung lich ein ver keit ich".split(), "fr": "eau oi ent tion elle aux que".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(2)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(150)]
    docs = docs_of(spark, [prose(rng, g, 80) for g in langs], langs)
    model = language_id.learn_languages(docs)
    assert sorted(model) == sorted(set(langs))
    odd = docs_of(spark, [None, "", "12 34 !!", *(prose(rng, g, 40) for g in ("en", "de", "fr")), prose(rng, "de", 20_000)])
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language_id.predict_languages(odd, model).collect()}
    assert got == {0: ("und", True), 1: ("und", True), 2: ("und", True), 3: ("en", False), 4: ("de", False), 5: ("fr", False), 6: ("de", False)}
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    none = language_id.learn_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.predict_languages(odd, none).collect()} == {"und"}


def test_narrow_language_margins_are_rejected(spark):
    rng = random.Random(6)
    base, more = prose(rng, "en", 2000).encode(), prose(rng, "en", 30)
    text = prose(rng, "en", 20_000)
    docs = docs_of(spark, [text, "ka", f"{text} {more} {text}"])
    for model, ids in (({"a": base, "b": base}, (0, 1, 2)), ({"a": base, "b": base + b" " + more.encode() + b" "}, (2,))):
        got = {r["doc_id"]: r for r in language_id.predict_languages(docs, model).collect()}
        assert all(got[i]["rejected"] for i in ids)
        assert not set(ids) & {r["doc_id"] for r in language_id.keep_identified(docs, model).collect()}
    assert got[2]["lang_pred"] == "b" and got[2]["score"] > 0.9


def test_copies_do_not_fill_the_labelled_sample(spark):
    docs = docs_of(spark, ["the same text"] * 2000 + [f"text {i}" for i in range(6)])
    assert len({t for _, t in compression.labelled_sample(docs, "lang", "text", 4, 100, 5)}) == 4


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(3)
    insult = ["scumbag", "worthless", "pathetic", "moron"]

    def text(toxic):
        words = prose(rng, "en", 60).split()
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insult))
        return " ".join(words)

    train = [(k % 2, text(k % 2)) for k in range(400)]
    model = toxicity.learn_toxicity(train)
    tests = [(k % 2, text(k % 2)) for k in range(100)]
    scores = toxicity.score_texts([t for _, t in tests], model)
    assert sum((s >= 0.7) == bool(y) for (y, _), s in zip(tests, scores)) >= 95
    out = toxicity.toxicity_scores(docs_of(spark, [None, "", text(0), text(1)]), model).orderBy("doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in out) and out[3]["score"] > 0.7 > out[0]["score"]
    assert toxicity.learn_toxicity([(0, "a"), (0, "b")]) is None
    assert {r["score"] for r in toxicity.toxicity_scores(docs_of(spark, ["a"]), None).collect()} == {0.0}


def test_licenses(spark):
    notice = licenses.TEMPLATES["mit-notice"]
    words = notice.split()
    worn = " ".join(w for i, w in enumerate(words) if i % 9)
    texts = [None, "", "the of and", f"Some text. {licenses.TEMPLATES['gpl-3.0']} More.", "x " * 3000 + worn + " y" * 3000, "Licensed under CC BY-NC 4.0. " * 3, "the license of the public version"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    best = {i: r["found"][0]["license"] if r["found"] else None for i, r in got.items()}
    assert best == {0: None, 1: None, 2: None, 3: "gpl-3.0", 4: "mit-notice", 5: "cc-by-nc-4.0", 6: None}
    assert licenses.scan_licenses(docs_of(spark, texts), templates={}).where("size(found) > 0").count() == 0
    table = spark.createDataFrame([("own", "Quux frobnicates the zyzzyva."), ("own", "Zz later copy"), (None, "x"), ("none", None)], "license string, text string")
    assert licenses.load_templates(table) == {"own": "Quux frobnicates the zyzzyva."}
    f = got[3]["found"][0]
    assert texts[3].encode()[f["start"] : f["end"]].decode() == licenses.TEMPLATES["gpl-3.0"].rstrip(".") and f["coverage"] == 1.0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        template = [rng.choice("abcdefghijkl").encode() for _ in range(rng.randint(1, 12))]
        text = [rng.choice("abcdefghijkl").encode() for _ in range(rng.randint(0, 20))]
        pairs = licenses.align(text, template)
        assert all(template[t] == text[x] for t, x in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest_common(template, text)
    unique = [str(i).encode() for i in range(30)]
    assert len(licenses.align([b"x", *unique[3:20], b"y", *unique[22:]], unique)) == 25


def test_quality_model_sums_to_one_and_rejects_noise(spark):
    rng = random.Random(6)
    texts = [prose(rng, "en", 60) for _ in range(80)] + ["".join(rng.choice("#%&$*QXZ!") for _ in range(300)) for _ in range(20)] + [None, "", "the"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(quality.trusted_sample(docs, labels))
    import numpy as np

    context = int.from_bytes(b"\n\n\n\n", "big")
    every = quality.chance((context << 8) | np.arange(256), model)
    assert abs((2.0**every).sum() - 1) < 1e-3
    for ctx in (b"the ", b"zzzz"):
        assert abs((2.0 ** quality.chance((int.from_bytes(ctx, "big") << 8) | np.arange(256), model)).sum() - 1) < 1e-3
    got = {r["doc_id"]: r["rejected"] for r in quality.judge(docs, labels).collect()}
    assert sum(got[i] for i in range(80)) <= 1 and all(got[i] for i in range(80, 102)) and not got[102]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if not got[i])
    assert quality.judge(docs, labels.limit(0)).where("rejected").count() == 2
