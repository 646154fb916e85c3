import random

import corpus_pipeline
from greenlight.llm import jaccard_join


def prose(r, n):
    return " ".join(r.choice(["the", "and", "ing", "tion", "ou", "er", "wh"]) + r.choice(["th", "ed", "st", "re"]) + str(r.choice("abcdefghij")) for _ in range(n))


def test_stages_keep_clean_documents(spark, tmp_path):
    r = random.Random(8)
    clean = [(k, prose(r, 80), "en", "s", 1) for k in range(20)]
    item = prose(r, 30)
    near = clean[3][1].split()
    near[40] = "changed"
    odd = [
        (100, None, "en", None, None), (101, "12 34", None, "s", 5), (102, clean[5][1], "en", "s", 1), (103, " ".join(near), "en", "s", 1),
        (104, prose(r, 40) + " " + item + " " + prose(r, 40), "en", "s", 1), (None, prose(r, 60), None, None, None),
        (105, clean[6][1] + "\n" + prose(r, 50), "en", "s", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(clean + odd, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append({row.doc_id: row for row in docs.collect()})
    kept = set(range(20)) | {None}
    assert set(seen[0]) == kept | {102, 103, 104, 105}
    assert set(seen[1]) == kept | {103, 104, 105}  # 102 has lost its only line
    assert seen[1][105].text.count("\n") == 0 and seen[1][105].n_chars == len(seen[1][105].text)
    assert set(seen[2]) - {103} == kept | {104, 105}
    assert set(seen[3]) - {103} == kept | {105}
    assert set(seen[4]) == set(seen[3])


def test_near_duplicates_on_their_own_input(spark):
    r = random.Random(9)
    rows = [(k, prose(r, 100)) for k in range(6)]
    near = rows[2][1].split()
    near[10] = "changed"
    docs = spark.createDataFrame(rows + [(9, rows[1][1]), (10, " ".join(near))], "doc_id long, text string")
    assert sorted(x.doc_id for x in jaccard_join.keep_one(docs).collect()) == [0, 1, 2, 3, 4, 5]
