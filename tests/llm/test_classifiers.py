from __future__ import annotations

import zlib

import numpy as np
import pytest
from brute import ODD
from pyspark.sql import functions as F

from logsift.llm import langid, quality, toxicity
from logsift.llm.queries import op2_language, op6_quality, op7_toxicity
from logsift.llm.toxicity import Matcher, hits

MEDIUM = "/root/testdata/sf0.01"


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = op2_language(spark, MEDIUM).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean(right) > 0.97


def test_language_of_odd_rows(spark, odd, none):
    texts = [("en", "the cat sat on the mat"), ("de", "die Katze saß auf der Matte"), ("en", "the dog and the cat"), ("de", "der Hund und die Katze"), (None, "x"), ("fr", None)]
    training = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(training)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert langid.identify(odd, model).count() == len(ODD)
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    scorer = langid.Scorer(model)
    assert scorer.score("der Kater saß") == scorer.score("der Kater saß") and scorer.score("der Kater saß")[0] == "de"
    assert scorer.score("catzz doggg")[0] == "en"  # unknown words: n-grams
    assert scorer.score("12 ² — !")[0] == "und" and scorer.score("世界")[0] in model.languages
    assert scorer.score("the " * 100_000)[0] == "en"
    assert scorer.score("zz" * 50 + "katze" + "zz" * 50)[0] == "de"  # the middle of a long run counts
    assert langid.identify(none, model).count() == 0
    nothing = langid.fit(training.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_backoff_takes_the_longest_known_grams():
    model = langid.Model(["a", "b"], {"word": (-1.0, -9.0)}, {"<wor": (-2.0, -8.0), "w": (-9.0, -1.0), "x": (-3.0, -4.0)}, (0.0, 0.0))
    assert model.evidence("word") == (-1.0, -9.0)
    assert model.evidence("worx") == (-2.0, -8.0)
    assert model.evidence("xw") == (-6.0, -2.5)
    assert model.evidence("qq") == (0.0, 0.0)


@pytest.mark.parametrize("query,label,parts,part,cut", [(op6_quality, "quality", 3, 1, 0.5), (op7_toxicity, "toxic", 4, 2, 0.3)])
def test_label_queries(spark, query, label, parts, part, cut):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    got = query(spark, MEDIUM).collect()
    assert len(got) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    for wanted in (0, 1):
        assert np.mean([p == wanted for p, label in held if label == wanted]) > 0.9


def test_quality_of_odd_rows(spark, odd, none):
    labelled = spark.createDataFrame([(k, "plain words in a line %d" % k if k % 2 else "again again again again $$$ $$$", k % 2) for k in range(40)], "doc_id long, text string, quality int")
    model = quality.fit(labelled)
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.5}  # no term: the share of label 1
    found = {r.doc_id: r.score for r in quality.score(labelled, model).collect()}
    assert all((found[k] > 0.5) == bool(k % 2) for k in range(40))
    assert quality.score(none, model).count() == 0
    nothing = quality.fit(labelled.limit(0))
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}
    one = quality.fit(labelled.where("quality = 1"))
    assert {round(r.score, 6) for r in quality.score(odd, one).collect()} == {1.0}


def test_a_small_fit_decides_like_a_full_one_on_unbalanced_labels(spark):
    random = np.random.default_rng(4)
    text = lambda: " ".join(f"w{k}" for k in random.integers(0, 60, 40))
    rows = [(k, text(), int(k % 10 > 0)) for k in range(2000)]  # of one kind, nine in ten with label 1
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs = spark.createDataFrame([(k, text()) for k in range(200)] + [(-1, "")], "doc_id long, text string")
    full, few = ({r.doc_id: r.score for r in quality.score(docs, quality.fit(labelled, n)).collect()} for n in (3000, 150))
    assert abs(full[-1] - 0.9) < 1e-6 and abs(few[-1] - 0.9) < 1e-6
    assert {k: x >= 0.5 for k, x in few.items()} == {k: x >= 0.5 for k, x in full.items()}


def test_blocks_of_neighbours_give_the_same_votes():
    random = np.random.default_rng(1)
    counts = random.random((30, quality.TERMS)).astype(np.float32)
    vectors = random.normal(size=(500, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = quality.Model(np.ones(quality.TERMS, np.float32), random.normal(size=(quality.TERMS, 8)).astype(np.float32), vectors, random.integers(0, 2, 500).astype(np.float32))
    cosines = model.place(counts) @ vectors.T
    want = []
    for row in cosines:
        best = np.argsort(-row, kind="stable")[: quality.NEIGHBOURS]
        weights = np.maximum(row[best], 0) ** quality.SHARPNESS + 1e-9
        want.append((weights * model.labels[best]).sum() / weights.sum())
    assert np.allclose(model.score(counts, block=64), want, atol=1e-5)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automata_find_what_edit_distance_finds():
    random = np.random.default_rng(4)
    terms = ["idiot", "stupid", "scum", "trash", "loser"]
    matcher = Matcher(terms, ["vequ"])
    letters = list("idotsupcmrahle")
    words = set(terms) | {"vequ", "vequille", "ve", "veq", ""}
    for term in terms:
        for _ in range(300):
            word = list(term)
            for _ in range(random.integers(1, 3)):
                at, kind = int(random.integers(0, len(word))), random.integers(0, 3)
                word[at : at + (kind != 0)] = [] if kind == 2 else [str(random.choice(letters))]
                word = word or ["x"]
            words.add("".join(word))
    for word in words:
        near = [edit_distance(word, t) for t in terms]
        want = 0 if word.startswith("vequ") or 0 in near else 1 if any(d == 1 and len(t) >= 5 for d, t in zip(near, terms, strict=True)) else -1
        assert matcher.edits(word) == want, word
    assert matcher.edits("idiot" * 20) == -1


def test_context_of_hits():
    matcher = Matcher(["idiot"], [], frozenset({"idiots"}))
    assert hits("you are an idiot, an idiott", matcher) == (2, 0)
    assert hits('he heard the word "idiot" there', matcher) == (0, 1)
    assert hits("„Idiot“ was on the wall", matcher) == (0, 1)
    assert hits("she said idiot", matcher) == (0, 1)
    assert hits("idiots and radiators", matcher) == (0, 0)
    assert hits(None, matcher) == hits("", matcher) == hits("...", matcher) == (0, 0)


def test_misspellings_beside_stems_and_of_short_terms(spark):
    forms = ["idiot", "idiots", "idiott", "idioot", "idiotic", "idiota"]
    rows = [(k, f"you are {forms[k // 4 % 6] if k % 4 else 'idiot'} and scum here", 1) for k in range(0, 240, 2)]
    rows += [(k, "you are able and friendly here", 0) for k in range(1, 240, 2)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert lexicon.stems and "idiot" in lexicon.words
    matcher = Matcher(lexicon.words, lexicon.stems, lexicon.spared, lexicon.edited)
    assert all(matcher.hit(w) for w in ("idiot", "idiotically", "ediot", "idot", "iidiot", "scumm", "skum"))
    assert not any(matcher.hit(w) for w in ("able", "friendly", "you", "here"))


def test_toxicity_of_odd_rows(spark, odd, none):
    rows = [(k, f"you are an idiot number{k} here" if k % 3 == 0 else f"you are an able and friendly text{k} here", int(k % 3 == 0)) for k in range(90)]
    labelled = spark.createDataFrame([*rows, (91, None, 1), (92, "idiot", None)], "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(labelled)
    assert "idiot" in lexicon.words and "able" not in lexicon.words
    found = {r.doc_id: r.score for r in toxicity.score(labelled, lexicon).collect()}
    assert all((found[k] >= 0.3) == (k % 3 == 0) for k in range(90))
    got = toxicity.score(odd, lexicon).collect()
    assert len(got) == len(ODD) and all(r.score < 0.3 for r in got)
    assert toxicity.score(none, lexicon).count() == 0
    for few in (labelled.limit(0), labelled.where("toxic = 0")):
        assert {r.score for r in toxicity.score(odd, toxicity.learn(few)).collect()} == {0.0}
    assert toxicity.score(odd, toxicity.learn(labelled.where("toxic = 1"))).where(F.col("score").isNull()).count() == 0


def test_a_quoted_use_does_not_spare_a_misspelling(spark):
    rows = [(k, f"you are an {'idyot' if k < 2 else 'idiot'} number{k}", 1) for k in range(60)]
    rows += [(k, f"you are able and friendly text{k} idium", 0) for k in range(100, 160)]
    rows += [(200, 'he said: "idyot" and left', 0)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    matcher = Matcher(lexicon.words, lexicon.stems, lexicon.spared, lexicon.edited)
    assert "idiot" in lexicon.words and matcher.hit("idyot") and matcher.hit("idiott")
    plain = [(300 + k, f"the village of idiox is green {k}", 0) for k in range(5)]
    lexicon = toxicity.learn(spark.createDataFrame(rows + plain, "doc_id long, text string, toxic int"))
    assert lexicon.spared == {"idiox"}


def test_a_rare_language_is_learned(spark):
    rows = spark.range(60_000).selectExpr("id as doc_id", "concat('the cat sat on a mat ', id) as text", "'en' as lang")
    rare = spark.createDataFrame([(100_000 + k, "die Katze saß auf der Matte", "de") for k in range(3)], "doc_id long, text string, lang string")
    model = langid.fit(rows.union(rare), fit_rows=1000)
    assert model.languages == ["de", "en"] and langid.Scorer(model).score("der Kater saß auf der Katze")[0] == "de"


def brute_language(training, text):
    """The documented rule in plain Python: word frequencies first, then ever shorter n-grams of different words."""
    words, pieces = {}, {}
    for sample, lang in training:
        words.setdefault(lang, langid.Counter()).update(langid.LETTERS.findall(sample.lower()))
    for lang, held in words.items():
        pieces[lang] = langid.Counter(g for w in held for n in range(1, 5) for g in langid.grams(w, n))
    log = lambda counts, lang, x: np.log((counts[lang][x] + 0.5) / (sum(counts[lang].values()) + 1))
    totals = dict.fromkeys(sorted(words), 0.0)
    for word, n in langid.Counter(langid.LETTERS.findall(text.lower())).items():
        for lang in totals:
            evidence = 0.0
            if any(word in held for held in words.values()):
                evidence = log(words, lang, word)
            else:
                for size in range(4, 0, -1):
                    known = [g for g in langid.grams(word, size) if any(g in held for held in pieces.values())]
                    if known:
                        evidence = np.mean([log(pieces, lang, g) for g in known])
                        break
            totals[lang] += evidence * (1 + np.log(n))
    best = max(totals, key=lambda x: (totals[x], -sorted(totals).index(x)))
    return best, 1 / sum(np.exp(v - totals[best]) for v in totals.values())


def test_language_against_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("lang is not null and length(text) < 3000").orderBy("doc_id").limit(60).collect()
    training, asked = [(r.text, r.lang) for r in docs[:40]], docs[40:]
    model = langid.fit(spark.createDataFrame([(k, *x) for k, x in enumerate(training)], "doc_id long, text string, lang string"))
    scorer = langid.Scorer(model)
    for r in [*asked, *docs[:5]]:
        got, want = scorer.score(r.text), brute_language(training, r.text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-6


def test_sample_of_labels_is_bounded(spark):
    from logsift.llm.common import labelled_sample

    docs = spark.range(400).selectExpr("id % 350 as doc_id", "concat('text ', id) as text", "1 as quality").union(spark.sql("select null, 'x', 1"))
    labels = spark.range(300).selectExpr("id as doc_id", "if(id % 4 = 0, 0, if(id % 50 = 1, null, 1)) as quality").union(spark.sql("select 3L, 1")).union(spark.sql("select null, 1"))
    sample, totals = labelled_sample(docs, labels, "quality", 20)
    want = {label: sum(1 for k in range(400) if k % 350 < 300 and (k % 350 % 4 == 0 if label == 0 else k % 350 % 4 and k % 350 % 50 != 1)) for label in (0, 1)}
    assert totals == want and sample.columns == ["doc_id", "text", "quality"]
    assert all(sample.where(f"quality = {x}").select("doc_id").distinct().count() == 20 for x in (0, 1))
    assert labelled_sample(docs.limit(0), labels, "quality", 20)[0].count() == 0
    quality.fit(sample, 20, totals)
    half = quality.fit(sample, 5, totals)
    assert sorted(half.labels.tolist()) == [0.0] * 5 + [1.0] * 5 and abs(half.stands.sum() - sum(totals.values())) < 1e-9


def test_models_reach_workers_without_the_package(spark):
    """A broadcast model is read where ``logsift`` cannot be imported."""
    import subprocess
    import sys

    from logsift.llm.common import shared_value

    lexicon = toxicity.Lexicon(["idiot"], [], frozenset(["idiot"]), frozenset(), {(0, False): 0.0})
    data = shared_value(spark, lexicon).value
    code = "import pickle, sys; x = pickle.loads(sys.stdin.buffer.read()); print(x.words, 'logsift' in sys.modules)"
    found = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True, cwd="/", env={"PATH": "/usr/bin"})
    assert found.stdout.decode().split() == ["['idiot']", "False"], found.stderr.decode()


def test_kept_words_take_one_number_each():
    counter = quality.Counter()
    texts = ["Some words, some WORDS 12 and ünd more.".encode(), b"", b"some words"]
    for text in texts:
        want = np.bincount(np.array([quality.terms_of(w) for w in text.split()], dtype=np.int64).ravel(), minlength=quality.TERMS) / max(1, len(text.split()))
        shapes = quality.TERMS - quality.REPEATS
        assert np.allclose(counter.counts(text)[:shapes], want[:shapes])
    assert len(counter.kept) == 9 and all(type(x) is int for x in counter.kept.values())
