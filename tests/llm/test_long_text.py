"""The pipeline's stages on a text that is read in pieces."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import text
from lodestone.llm.store import Scratch

DATA = "/root/testdata/sf0.001"


def test_stages_keep_a_long_text_whole(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, rng = spark.read.parquet(f"{DATA}/documents.parquet"), random.Random(3)
    words = sorted({w for r in docs.where("lang = 'en'").select("text").collect() for w in (r["text"] or "").split() if w.isalpha()})
    long_ = " ".join(rng.choice(words) for _ in range(900_000))
    assert len(long_) > text.PIECE_BYTES
    row = spark.createDataFrame([(10**6, long_, "en", None, len(long_))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(row.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])).write.parquet(str(tmp_path / "documents.parquet"))
    kept, scratch = spark.read.parquet(str(tmp_path / "documents.parquet")), Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        if name == "mix_sources":  # a draw decides on whole documents only
            assert stage(spark, kept, str(tmp_path)).where("doc_id = 1000000").where(F.col("text") != long_).count() == 0
            continue
        kept = scratch.keep(stage(spark, kept, str(tmp_path)), name)
        if name != "best_fit_packing":
            assert kept.where("doc_id = 1000000").first()["text"] == long_
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(long_, add_special_tokens=False).ids
    assert kept.where("doc_id = 1000000").agg(F.sum("length")).first()[0] == len(tokens) + 1
