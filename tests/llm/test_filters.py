"""Quality, toxicity, language, URLs and decontamination against plain versions and planted cases."""

import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillvec.llm import decontam_pigeonhole as decontam
from quillvec.llm import langid_ftrl as langid
from quillvec.llm import quality_ordinal as quality
from quillvec.llm import toxicity_crf as toxicity
from quillvec.llm import url_markov as urls
from quillvec.llm.labelled import labelled_sample

FOLDER = "/root/testdata/sf0.01"
AWKWARD = [(None, "a null id"), (7, None), (8, ""), (9, " \n"), (10, "12 !!"), (11, "wort " * 30000), (12, "same"), (12, "same")]


def awkward(spark, *extra):
    rows = [(i, t, "en", "src", 1, *("x" for _ in extra)) for i, t in AWKWARD]
    names = "doc_id bigint, text string, lang string, source string, n_chars int" + "".join(f", {e} string" for e in extra)
    return spark.createDataFrame(rows, names)


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars int")


# -- toxicity ------------------------------------------------------------------------------


def brute_marginals(e, moves, start):
    n, step = len(e), np.exp(moves)
    forward, backward = np.zeros((n, 2)), np.ones((n, 2))
    for t in range(n):
        forward[t] = [1, np.exp(start)] if t == 0 else forward[t - 1] @ step
        forward[t] *= [1, np.exp(e[t])]
        forward[t] /= forward[t].sum()
    for t in range(n - 2, -1, -1):
        backward[t] = step @ (backward[t + 1] * [1, np.exp(e[t + 1])])
        backward[t] /= backward[t].sum()
    p = forward * backward
    return p[:, 1] / p.sum(axis=1) if n else np.zeros(0)


def test_chain_equals_brute_force():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 3, 96, 97, 400, 0]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    emission, moves = rng.normal(size=offsets[-1]) * 2, rng.normal(size=(2, 2))
    got = toxicity.chain(emission, offsets, moves, -1.5)
    for a, b in zip(offsets, offsets[1:]):
        assert np.allclose(got[a:b], brute_marginals(emission[a:b], moves, -1.5), atol=1e-12)


def planted(n=240, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for k in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        bad = k % 3 == 0
        for _ in range(3 * bad):
            body.insert(rng.randrange(len(body)), "zonk" + rng.choice(["er", "ing", "s"]))
        rows.append((k, " ".join(body), int(bad)))
    return rows


def test_toxicity_finds_planted_spans(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels.where("doc_id < 160"))
    got = {r.doc_id: r for r in toxicity.tag(docs, model).collect()}
    for i, text, y in rows[160:]:
        assert (got[i].toxic_score >= 0.7) == bool(y)
        if y:
            assert any("zonk" in text[s.start : s.end] for s in got[i].toxic_spans)


def test_toxicity_learns_from_its_fold_only(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id bigint, toxic int")
    kept = {r.doc_id for r in toxicity.learnable(labels).collect()}
    assert kept == {i for i in range(60) if crc32(str(i).encode()) % 3 != 1}


def test_toxicity_held_out(spark):
    from sklearnless import precision_recall

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = toxicity.query(spark, FOLDER).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    precision, recall = precision_recall([(r[0], r[1]) for r in got])
    assert recall >= 0.7 and precision >= 0.7


def test_long_texts_leave_their_places_to_others(spark):
    docs = spark.createDataFrame([(i, "long " * 100 if i % 5 else f"short {i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(260)], "doc_id bigint, toxic int")
    got = labelled_sample(docs, labels, "toxic", 12, 50).to_pylist()
    assert sorted(r["y"] for r in got) == [0] * 12 + [1] * 12
    with pytest.warns(UserWarning, match=r"toxic: no text .* \[1\]"):
        labelled_sample(docs.where("doc_id % 2 = 0"), labels, "toxic", 12, 50)


def test_one_text_of_each_id_is_learnt_from(spark, monkeypatch):
    rows = [(i, f"wort {i}", "de") for i in range(10)] + [(3, f"mehr {k}", "de") for k in range(50)] + [(3, "mot", "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id bigint, toxic int")
    assert sorted(r["y"] for r in labelled_sample(docs, labels, "toxic", 5, 50).to_pylist()) == [0] * 5 + [1] * 5
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, *_: seen.extend(texts.column("lang").to_pylist()))
    langid.train(docs, per_lang=10)
    assert sorted(seen) == ["de"] * 10 + ["fr"]


# -- awkward rows --------------------------------------------------------------------------


def trained(spark):
    docs = spark.createDataFrame([(i, t, "en" if y else "de") for i, t, y in planted()], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in planted()], "doc_id bigint, toxic int, quality int")
    return docs, labels


def test_awkward_rows(spark):
    docs, labels = trained(spark)
    odd = awkward(spark, "toxic_score", "lang_pred", "expected_grade", "leaks")
    tagged = toxicity.tag(odd, toxicity.train(docs, labels)).collect()
    graded = quality.score(odd, quality.train(docs, labels)).collect()
    named = langid.predict(odd, langid.train(docs)).collect()
    for rows in (tagged, graded, named):
        assert len(rows) == len(AWKWARD)
    assert all(0 <= r.toxic_score <= 1 for r in tagged)
    assert all(0 <= r.tail_probability <= 1 for r in graded)
    by_text = {r.text: r.lang_pred for r in named}
    assert [by_text[t] for t in (None, "", " \n", "12 !!")] == ["und"] * 4 and by_text["same"] != "und"
    assert len({r.toxic_score for r in tagged if r.text == "same"}) == 1


def test_without_labels_or_rows(spark):
    docs, labels = trained(spark)
    none = labels.limit(0)
    assert {r.toxic_score for r in toxicity.tag(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert {r.expected_grade for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.0}
    unnamed = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.lang_score) for r in langid.predict(docs, langid.train(unnamed)).collect()} == {("und", 0.0)}
    nothing = empty(spark)
    assert toxicity.tag(nothing, toxicity.train(nothing, none)).count() == 0
    assert quality.score(nothing, quality.train(nothing, none)).count() == 0
    assert langid.predict(nothing, langid.train(nothing)).count() == 0
    one = labels.where("toxic = 1")
    assert {r.toxic_score for r in toxicity.tag(docs, toxicity.train(docs, one)).collect()} == {1.0}


# -- quality -------------------------------------------------------------------------------


def test_quality_separates_grades():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts, grades = [], []
    for k in range(300):
        y = k % 3
        body = [rng.choice(words) + ("###" if rng.random() < (2 - y) / 2.5 else "") for _ in range(60)]
        texts.append(" ".join(body))
        grades.append(y)
    model = quality.fit(pa.table({"text": texts[:200], "y": grades[:200]}))
    assert model.cuts[0] < model.cuts[1]
    expected, tail = quality.Scorer(model, 2)(pa.array(texts[200:]))
    means = [expected[np.array(grades[200:]) == g].mean() for g in range(3)]
    assert means[0] < 0.4 < 0.7 < means[1] < 1.3 < 1.6 < means[2]
    assert ((tail > 0.5) == (np.array(grades[200:]) == 2)).mean() > 0.9


# -- language ------------------------------------------------------------------------------


def plain_grams(word):
    padded = f" {word} "
    return sorted(padded[i : i + n] for n in langid.LENGTHS for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")


def test_grams_of_words():
    words = ["été", "a", "straße", "日本語"]
    table = langid.GramTable()
    numbers, offsets = table(pa.array(words))
    sizes = [len(table.of(numbers[a:b])) for a, b in zip(offsets, offsets[1:])]
    assert sizes == [len(plain_grams(w)) for w in words]
    assert sorted(table.of(numbers[:1])) == sorted(table.of(langid.GramTable()(pa.array(["été"]))[0]))


def test_document_frequencies_count_every_document(spark):
    docs = spark.createDataFrame([(i, "ab ab" if i % 2 else "cd") for i in range(50)], "doc_id bigint, text string").repartition(4)
    found, rows = langid.document_frequencies(docs)
    assert rows == 50 and set(found[found > 0].tolist()) == {25}


def test_language_held_out(spark):
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    got = langid.query(spark, FOLDER).where("held_out").join(truth, "doc_id").select("lang_pred", "lang").collect()
    assert np.mean([a == b for a, b in got]) >= 0.97


def test_language_stage_rejects_only_und(spark):
    # five languages with the same words: no score reaches 0.4
    rows = [(i, f"wort satz text{i % 3}", f"l{i // 3 % 5}") for i in range(150)] + [(200, "12 !!", "l1"), (201, None, "l2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in langid.stage(spark, docs, FOLDER).collect()) == list(range(150))
    unnamed = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.stage(spark, unnamed, FOLDER).count() == len(rows)


def test_language_of_long_texts_only(spark):
    rows = [(i, f"wort satz text{i % 3}", "de") for i in range(40)] + [(i, f"mot phrase texte{i % 3} " * 20, "fr") for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, longest=100)
    assert model.langs == ["de", "fr"]
    assert all(r.lang_pred == r.lang for r in langid.predict(docs, model).collect())


# -- URLs ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://a.Example.COM/fr/1?x=/en/", "a.example.com", "/fr/1", "com/", "allow"),
        ("https://example.com/en/#top", "example.com", "/en/", "example.com/en/", "block"),
        ("https://x.www.example.com/en/y", "x.www.example.com", "/en/y", "www.example.com/en/", "allow"),
        ("ftp://b.net/es/", "b.net", "/es/", "net/es/", "block"),
        ("http://net/fr/q", "net", "/fr/q", "net/fr/", "block"),
        ("http://badexample.org/en/", "badexample.org", "/en/", None, None),
        ("http://example.com", "example.com", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("x://h\n.com/a://b", "h\n.com", "/a://b", "com/", "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    row = spark.createDataFrame([(url,)], "url string").select(
        urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path")
    )
    says = urls.rule_of(F.col("host"), F.col("path"))
    got = row.select("host", "path", says[0], says[1]).collect()[0]
    assert tuple(got) == (host, path, rule, verdict)


def brute_ratio(rows, order=urls.ORDER):
    """{url: z} of distinct (url, verdict, held) by the recursion in the docstring."""
    counts = [{}, {}]
    for url, verdict, held in rows:
        if held or verdict is None:
            continue
        text = "\x02" * (order - 1) + url + "\x03"
        side = counts[0 if verdict == "allow" else 1]
        for i in range(order - 1, len(text)):
            for k in range(1, order + 1):
                gram = text[i - k + 1 : i + 1]
                side[gram] = side.get(gram, 0) + 1
                side[(gram[:-1],)] = side.get((gram[:-1],), 0) + 1

    def p(side, gram):
        if not gram:
            return 1 / urls.ALPHABET
        shorter = p(side, gram[1:])
        return (side.get(gram, 0) + urls.STRENGTH * shorter) / (side.get((gram[:-1],), 0) + urls.STRENGTH)

    out = {}
    for url, _, _ in rows:
        text = "\x02" * (order - 1) + url + "\x03"
        grams = [text[i - order + 1 : i + 1] for i in range(order - 1, len(text))]
        out[url] = sum(np.log(p(counts[0], g)) - np.log(p(counts[1], g)) for g in grams) / len(grams)
    return out


def test_markov_ratio_equals_brute_force(spark):
    pages = [f"http://h{i % 7}.{'com' if i % 2 else 'net'}/{'es' if i % 3 else 'fr'}/{i}" for i in range(60)] + ["", "é😀"]
    rows = [(u, "allow" if ".com/" in u else "block" if ".net/" in u else None) for u in pages]
    scored = urls.score_urls(spark.createDataFrame(rows, "url string, verdict string")).collect()
    want = brute_ratio([(r.url, r.verdict, r.held) for r in scored])
    assert len(scored) == len(pages)
    for r in scored:
        assert r.z == pytest.approx(want[r.url], abs=1e-9)


def test_judge_awkward_pages(spark):
    rows = [(1, None), (None, "http://a.com/x"), (3, ""), (3, ""), (4, "http://b.net/es/1"), (5, "x" * 20000), (6, "http://a.org/q")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = urls.judge(pages).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert urls.judge(pages.limit(0)).count() == 0


def test_a_long_url_costs_its_length(spark):
    rng = random.Random(12)
    long = "http://a.com/" + "".join(rng.choice("abcdefghij0123456789") for _ in range(200_000))
    rows = [(long, None), *((f"http://h{i}.{'com' if i % 2 else 'net'}/fr/{i}", "allow" if i % 2 else "block") for i in range(40))]
    scored = urls.score_urls(spark.createDataFrame(rows, "url string, verdict string")).collect()
    want = brute_ratio([(r.url, r.verdict, r.held) for r in scored])
    assert len(scored) == len(rows) and all(r.z == pytest.approx(want[r.url], abs=1e-9) for r in scored)


# -- decontamination -----------------------------------------------------------------------


def brute_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def test_myers_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(200):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        b = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        assert decontam.myers(a, b)[0] == brute_distance(a, b)


def test_every_match_within_the_budget_is_found(spark):
    rng = random.Random(8)
    items = ["".join(rng.choice("abcde  ") for _ in range(rng.choice([10, 60, 120]))) for _ in range(12)]
    items = [re.sub(" +", " ", t).strip() for t in items]
    docs = []
    for k in range(60):
        passage = list(rng.choice(items))
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randint(0, 1)] = rng.choice(["a", "", "e", "bc"])
        docs.append((k, "xyz " + "".join(rng.choice("abcde ") for _ in range(30)) + "".join(passage).upper() + " tail"))
    found = decontam.find(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"), block_bytes=300
    )
    got = {(r.doc_id, x.item_id): x.distance for r in found.collect() for x in r.leaks}
    want = {}
    for d, t in docs:
        norm = " ".join(re.findall(r"[^\W_]+", t.lower()))
        for i, item in enumerate(items):
            distance = brute_distance(item, norm)
            if distance <= int(decontam.RATE * len(item)):
                want[d, i] = distance
    assert got == want and len(want) > 10


def test_decontamination_awkward_rows(spark):
    items = spark.createDataFrame([(1, None), (2, "!!"), (None, "wort wort wort"), (3, "same")], "item_id bigint, text string")
    odd = awkward(spark, "leaks", "__norm")
    got = decontam.find(odd, items).collect()
    assert len(got) == len(AWKWARD)
    assert [[x.item_id for x in r.leaks] for r in got if r.text == "same"] == [[3], [3]]
    assert [[x.item_id for x in r.leaks] for r in got if r.doc_id == 11] == [[None]]
    assert decontam.find(empty(spark), items).count() == 0
    assert all(not r.leaks for r in decontam.find(odd, items.limit(0)).collect())


def test_short_items_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "his eyes"), (2, "Yes!"), (3, "oh, yes-man"), (4, "yesterday"), (5, "eyes, yes")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "yes")], "item_id bigint, text string")
    words = {r.doc_id: [(x.start, x.end) for x in r.leaks] for r in decontam.find(docs, items, whole_words=True).collect()}
    assert words == {1: [], 2: [(0, 3)], 3: [(3, 6)], 4: [], 5: [(5, 8)]}
    assert all(r.leaks for r in decontam.find(docs, items).collect())
