import random
import zlib

from cases import documents, odd_texts

from rollcall.llm import quality


def good(rng):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 200))) + "."


def bad(rng):
    kind = rng.randrange(3)
    words = good(rng).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["###", "$$$"]) for w in words)
    return " ".join([words[0], words[1], words[2]] * 40)


def test_held_out_accuracy_and_clean_documents_stay(spark):
    rng = random.Random(15)
    marks = [int(rng.random() < 0.8) for _ in range(500)]
    texts = [good(rng) if m else bad(rng) for m in marks]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, m, None) for i, m in enumerate(marks)] + [(None, 1, 0), (3, None, 0), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, sample_rows=300)
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    apart = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(500) if rows[i].held_out] == apart
    assert sum(rows[i].predicted == marks[i] for i in apart) >= 0.95 * len(apart)
    assert sum(rows[i].predicted for i in apart if marks[i]) >= 0.97 * sum(marks[i] for i in apart)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in rows if rows[i].predicted}


def test_odd_texts_and_missing_labels(spark):
    texts = odd_texts(random.Random(16))
    docs = documents(spark, texts, [None, None, 1, 1, *range(4, len(texts))])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(texts) and all(r.score == 0.5 and r.predicted == 0 for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0
    one = quality.fit(docs, spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r.score <= 1 for r in quality.score(docs, one).collect())


def test_features_do_not_depend_on_labels_or_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = dict(zip(*map(list, quality.counted(text)), strict=True))
    assert whole and sum(whole.values()) > len(text)
    monkeypatch.setattr(quality, "PIECE_BYTES", 4096)
    parts = dict(zip(*map(list, quality.counted(text)), strict=True))
    assert sum(abs(whole.get(k, 0) - parts.get(k, 0)) for k in whole | parts) < 0.02 * sum(whole.values())


def test_without_labels_the_stage_keeps_all(spark, tmp_path):
    import corpus_pipeline

    given = spark.createDataFrame([(i, f"text {i}") for i in range(5)] + [(None, None)], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, given, str(tmp_path))
    assert kept.columns == given.columns and kept.count() == 6
