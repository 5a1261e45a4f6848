"""The pipeline's stages against what the single operators say in plain Python."""

from test_dedup import plain_classes
from test_text import plain_leaks

import corpus_pipeline
from tidepanel.llm import packing, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "packing"]

    bad = {r.doc_id for r in toxicity.predictions(docs, queries.table(spark, SF, "labels")).filter("predicted = 1").collect()}
    left = {i: t for i, t in rows.items() if i not in bad}
    largest = {t: i for i, t in sorted(left.items())}
    left = {i: t for i, t in left.items() if largest[t] == i}
    left = {i: left[i] for i, _, c in plain_classes(list(left.items())) if i == c}
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    leaks = {d for d, _ in plain_leaks(list(left.items()), items)}
    left = {i: t for i, t in left.items() if i not in leaks}

    packed = corpus_pipeline.run(spark, SF)
    want = packing.pack(docs.filter(docs.doc_id.isin(list(left))), packing_path())
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, packed.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_stages_keep_columns_and_take_odd_tables(spark, odd, empty):
    odd = odd.withColumnRenamed("h", "lang").withColumnRenamed("__k0", "__row")
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= df.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() >= df.count()
