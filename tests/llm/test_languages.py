import itertools
import zlib

import numpy as np
import pytest

from sortloom.llm import languages as L
from tests.llm.helpers import empty, odd, sampled


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy_and_flags(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(4000)
    got = L.identify(docs, L.learned_outside(docs)).alias("a").join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "lang_pred", "score").collect()
    own = [r for r in got if held(r["doc_id"])]
    assert sum(r["lang"] == r["lang_pred"] for r in own) > 0.99 * len(own) and all(0 <= r[3] <= 1 for r in got)


def test_query(spark):
    rows = L.op5_language(spark, "/root/testdata/sf0.001").collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows) and len(rows) == 200


def test_held_out_labels_are_not_learned(spark):
    """With the labels of held-out rows turned to nonsense nothing changes."""
    from pyspark.sql import functions as F

    docs = sampled(spark, 300)
    lied = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = L.learned_outside(docs), L.learned_outside(lied)
    assert a.languages == b.languages and (a.scores == b.scores).all()


def test_viterbi_equals_all_paths():
    model = L.Model.learn(iter([("aa", "ba bab abba bb"), ("bb", "dod odd do dodo"), ("cc", "ikki kik iki")]))
    words = ["ba", "od", "dod", "kik", "ab", "iki", "qq"]
    for switch in (0.5, 3.0):
        labels, _ = model.label([words], switch)
        scores, numbers = model.score_words([words])
        s = scores[numbers[0], :3]
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - switch * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(value(p) for p in itertools.product(range(3), repeat=len(words)))
        assert abs(value(labels[0].tolist()) - best) < 1e-3


def test_texts_side_by_side_equal_one_by_one():
    model = L.Model.learn(iter([("en", "the house and the hill of the world"), ("de", "der hund und die katze von der welt")]))
    texts = ["the hund", "", "die katze und the house " * 30, "der", "of the world " * 5]
    together = model.decide(texts)[0]
    assert together == [model.decide([t])[0][0] for t in texts]


def test_spans_of_mixed_text():
    model = L.Model.learn(iter([("en", "the house is on the hill and the dog was there with them " * 20), ("de", "der hund ist nicht in die schule und das haus war auf dem berg " * 20)]))
    text = "The house is on the hill and the dog was there. Der Hund ist nicht in die Schule und das Haus war auf dem Berg."
    (language, score, spans), = model.predict([text])
    assert language == "de" and [x for _, _, x in spans] == ["en", "de"] and abs(spans[1][0] - text.index("Der")) < 6 and 0.4 < score < 0.7


def test_scripts_narrow_the_languages():
    model = L.Model.learn(iter([("en", "the house and hill " * 10), ("ru", "дом и холм и мир " * 10), ("el", "το σπίτι και ο λόφος " * 10)]))
    assert [x[0] for x in model.predict(["zzz qqq", "жжж щщщ", "ωωω ξξξ"])] == ["en", "ru", "el"]
    language, score, _ = model.predict(["日本語"])[0]
    assert language in model.languages and score == 0.0
    assert np.array_equal(L.script_of(np.array([ord("a"), ord("ж"), ord("λ"), ord("語"), 32])) > 0, [True, True, True, True, False])


def test_undefined_rare_and_no_rows(spark):
    docs = odd(spark)
    model = L.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs, model).where("doc_id is not null").collect()}
    assert got[9001] == got[9002] == got[9003] == got[9008] == ("und", 0.0) and got[9005][0] == "en"
    assert L.identify(docs, L.learn(empty(spark))).where("lang_pred <> 'und'").count() == 0
    assert L.identify(empty(spark), model).count() == 0
    many = spark.createDataFrame([(i, "the house", "en") for i in range(3000)] + [(9999, "der hund", "de")], "doc_id long, text string, lang string")
    assert L.learn(many, sample=20).languages == ["de", "en"]
    spans = L.identify(docs, model, with_spans=True).where("doc_id = 9005").first()["spans"]
    assert spans[0]["start"] == 0 and spans[-1]["lang"] == "en"


def test_more_labels_than_a_few_hundred_are_all_learned(spark):
    """300 labels with letters of their own; more than LABELS are an error."""
    rows = [(i, f"{chr(0x4E00 + i % 300) * 3} abc", f"l{i % 300:03d}") for i in range(900)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300 and model.predict([chr(0x4E00 + 299) * 3])[0][0] == "l299"
    with pytest.raises(ValueError, match="more than"):
        L.learn(spark.createDataFrame([(i, "a", f"l{i}") for i in range(L.LABELS + 1)], "doc_id long, text string, lang string"))


def test_an_id_repeated_often_is_counted_once_a_text(spark):
    rows = [(1, "the house on the hill", "en")] * 3000 + [(2, "der hund im haus", "de"), (3, "dog and cat", "en")]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=5000)
    one = L.Model.learn(iter([("en", "the house on the hill"), ("en", "dog and cat"), ("de", "der hund im haus")]))
    assert model.languages == one.languages and (model.codes == one.codes).all() and (model.scores == one.scores).all()


def test_labels_equal_a_plain_viterbi(spark):
    """lang_pred and score of real documents against word scores and a table written out in plain Python."""
    docs = sampled(spark, 60)
    model = L.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs, model).collect()}
    number = {c: i for i, c in enumerate(model.codes.tolist())}

    def scores(word):
        out = [0.0] * len(model.languages)
        padded = "\x02" + word + "\x03"
        for i in range(len(word)):
            a, b, c = map(ord, padded[i : i + 3])
            row = model.scores[number.get(a << 42 | b << 21 | c, -1)]
            out = [x + float(y) for x, y in zip(out, row, strict=True)]
        if word in model.words:
            out = [x + L.WORD_WEIGHT * float(y) for x, y in zip(out, model.words[word], strict=True)]
        return [x - max(out) for x in out]

    for r in docs.collect():
        words = L.WORD.findall(L.lowered(r["text"] or ""))
        if not words:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        best, back = scores(words[0]), []
        for w in words[1:]:
            top = max(range(len(best)), key=best.__getitem__)
            back.append([k if best[k] >= best[top] - L.SWITCH else top for k in range(len(best))])
            best = [max(x, best[top] - L.SWITCH) + y for x, y in zip(best, scores(w), strict=True)]
        k = max(range(len(best)), key=best.__getitem__)
        letters = dict.fromkeys(range(len(best)), 0)
        for w, b in zip(reversed(words), [*reversed(back), None], strict=True):
            letters[k] += len(w)
            k = b[k] if b else k
        want = max(letters, key=letters.get)
        assert got[r["doc_id"]][0] == model.languages[want] and abs(got[r["doc_id"]][1] - letters[want] / sum(letters.values())) < 1e-6
