import hashlib
import random

import pytest
import sentencepiece

from sortloom.llm import sentencepieces as P
from tests.llm.helpers import ODD, both, empty

STRANGE = ["  a  b ", "▁x ▁▁", "\n\n a\tb\r\n", "日本語 テキスト 😀", "a\xa0b", " " * 40 + "x", "\x00a", "the&&& x|y | z", "é \u200b", "x" * 4000, "aaaaaaaaaa bbbb", "…„“—", "\ud7ff\ufffd", "e\u0301"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.public_model())


def test_agenda_equals_the_library(library):
    """Without the check against the library, so that nothing is put right by it."""
    own = P.Encoder(P.public_model(), check=False)
    rng = random.Random(1)
    texts = [t for _, t in ODD if t] + STRANGE + ["".join(rng.choices("abcdefgh THE.\n▁éñ😀&|1", k=rng.randint(1, 80))) for _ in range(500)]
    for t in texts:
        assert own.encode(t) == list(library.encode(t)), t


def test_side_by_side_equals_one_by_one():
    own = P.Encoder(P.public_model(), check=False)
    rng = random.Random(2)
    parts = [" " * rng.randint(0, 2) + "".join(rng.choices("thereinonaeéß.,x😀", k=rng.randint(1, 30))) for _ in range(800)]
    assert own.agendas(parts) == [P.packed(own.agenda(p)) for p in parts]


def test_a_table_that_turns_over_changes_nothing(library):
    own = P.Encoder(P.public_model(), remembered=20)
    texts = [f"word{i % 37} and {i % 11} more" for i in range(300)]
    assert [own.encode(t) for t in texts] == [list(library.encode(t)) for t in texts]


def test_every_stretch_is_checked_and_a_difference_is_an_error(library):
    texts = ["a b\nwords after\tothers|x 日本語\n\n| tail", *STRANGE]
    own = P.Encoder(P.public_model())
    seen = []
    hold = own._held_against
    own._held_against = lambda mine, asked, skip: (seen.extend(a if skip else " " + a for a in asked), hold(mine, asked, skip))
    assert [ids for ids, _ in own.encode_all(texts)] == [list(library.encode(t)) for t in texts]
    stretches = {s for t in texts for s in own.stretches(" " + t.replace(P.MARK, " "))} - {" "}
    assert stretches <= {s if s[0] == " " else s[len(own.before) :] for s in seen} | set(seen)
    for text in ("one two", "x\nthree"):
        wrong = P.Encoder(P.public_model())
        wrong.agendas = lambda parts, made=wrong.agendas: [x[:-4] + P.packed([7]) if p.strip() in ("two", "three") else x for p, x in zip(parts, made(parts), strict=True)]
        with pytest.raises(ValueError, match="differ"):
            wrong.encode(text)


def test_query_equals_the_library(spark, library):
    docs = both(spark, 300)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    rows = P.encode_documents(docs)
    got = [tuple(r) for r in rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert rows.agg({"n_checked": "sum"}).first()[0] > 0
    assert P.encode_documents(empty(spark)).count() == 0


def test_round_trip(spark):
    docs = both(spark, 100).where("text is not null and doc_id is not null").dropDuplicates(["doc_id"])
    back = {r["doc_id"]: r["text"] for r in P.decode_documents(P.encode_documents(docs, with_ids=True)).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
