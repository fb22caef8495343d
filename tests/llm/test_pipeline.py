"""The stages, one by one, over a fixture with planted cases."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    words = "the a of and on is it was by to in as at be or an we he".split()
    prose = lambda n=60: " ".join(rng.choices(words, k=n) + ["w%d" % rng.randrange(500) for _ in range(n)])
    rows = [(i, prose(), "en", f"s{i % 4}", 1) for i in range(200)]
    rows += [(200 + i, rows[i][1].replace(" ", "\n  ", 3), "en", "s9", 1) for i in range(10)]  # equal after normalising
    rows += [(300 + i, rows[20 + i][1] + " one", "en", "s9", 1) for i in range(10)]  # near copies
    rows += [(400 + i, "SPAM!! " * 40, "en", "s0", 1) for i in range(10)] + [(500, None, None, None, None), (501, "", "en", "s0", 0), (502, "short", "en", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(400 + i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == before.columns
        docs.write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        ids.append(sorted(r.doc_id for r in docs.collect()))
    clean = {*range(200)}
    assert ids[0] == sorted(clean | {*range(200, 210), *range(300, 310)})
    assert ids[1] == sorted(clean | {*range(300, 310)})
    assert ids[2] == sorted(clean)
    assert set(ids[3]) <= clean and max(Counter(ids[3]).values()) <= 3 and len(ids[3]) > 150
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r[0]: r[1] for r in rows}
    for r in docs.collect():
        assert r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids[4]
    assert len(corpus_pipeline.STAGES) in (4, 5)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, before.limit(0), str(tmp_path)).count() == 0
