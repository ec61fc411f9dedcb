import corpus_pipeline as C
from sortloom.llm import languages, sentencepieces
from sortloom.llm.personal import redacted
from tests.llm.helpers import SF, both, empty, sampled
from tests.llm.test_decontaminate import brute_contaminated
from tests.llm.test_neardup import brute_components


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage against a plain version of it, on all that the stage before has kept."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    told = " ".join(f"the house number {k} and the hill" for k in range(12))
    more = [(None, told), (None, told + " again"), (7, told), (None, f"and {item} is the one"), (12, f"the {item} and so on"), (12, "the garden of the old man in the town is wide and green")]
    docs = both(spark, 400).unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"file://{tmp_path}/0")
    for k, (name, stage) in enumerate(C.STAGES):
        before = spark.read.parquet(f"{tmp_path}/{k}")
        stage(spark, before, SF).write.parquet(f"file://{tmp_path}/{k + 1}")
        after = spark.read.parquet(f"{tmp_path}/{k + 1}")
        rows, got = before.collect(), after.collect()
        if k < len(C.STAGES) - 1:
            assert after.columns == before.columns == C.COLUMNS
        if name == "language":
            model = languages.learned_outside(before)
            want = [r for r, (language, score) in zip(rows, model.decide([r["text"] or "" for r in rows])[0], strict=True) if language != "und" and score >= 0.3]
            assert sorted(map(str, got)) == sorted(map(str, want)) and 0 < len(got) < len(rows)
        elif name == "near_duplicates":
            distinct = sorted({(r["doc_id"], r["text"]) for r in rows}, key=str)
            component = brute_components([(k, t) for k, (_, t) in enumerate(distinct)], 5)
            ids = {}
            for k, (d, _) in enumerate(distinct):
                ids.setdefault(component[k], []).append(d)
            stay = [(r["doc_id"], r["text"]) for r in got]
            assert {component[distinct.index(x)] for x in stay} == set(ids) and len(stay) == len(ids) < len(rows)
            assert all(d == min((i for i in ids[component[distinct.index((d, t))]] if i is not None), default=None) for d, t in stay)
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = {k for k, _ in brute_contaminated([(k, r["text"]) for k, r in enumerate(rows)], items)}
            assert sorted(map(str, got)) == sorted(str(r) for k, r in enumerate(rows) if k not in held) and held
        elif name == "personal_data":
            assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
            assert sorted(r["text"] for r in got) == sorted(r["text"] for r in redacted(before).collect())
        else:
            library = sentencepieces.encoder(sentencepieces.public_model()).library
            want = sorted(([int(x) for x in library.encode(r["text"])] for r in rows), key=str)
            assert sorted((list(r["ids"]) for r in got), key=str) == want
            assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_run_and_no_rows(spark, tmp_path):
    sampled(spark, 60).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = C.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 30
    docs = empty(spark)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_rows_are_decided_by_themselves_whatever_their_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    told = [" ".join(f"{name}{k}" for k in range(30)) for name in ("alpha", "beta", "gamma", "delta")]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], shape)
    ids_and_texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    held = [(None, f"before {item} after"), (1, item)]
    clean = [(None, told[0]), (None, told[1]), (1, told[2]), (2, told[3])]
    assert ids_and_texts(C.decontamination(spark, frame(held + clean), SF)) == sorted(clean, key=str)
    # Copies of a document with an id, copies among rows without, near copies, an id twice.
    rows = [(5, told[0]), (None, told[0]), (None, told[1]), (None, told[1] + " more"), (7, told[2]), (7, told[3]), (7, told[3]), (8, told[3])]
    got = ids_and_texts(C.near_duplicates(spark, frame(rows), SF))
    one = [t for i, t in got if i is None]
    assert [g for g in got if g[0] is not None] == sorted([(5, told[0]), (7, told[2]), (7, told[3])], key=str)
    assert len(one) == 1 and one[0] in (told[1], told[1] + " more")
