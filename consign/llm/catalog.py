"""The subpackage's registered queries: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, chat, doubling, lexical, minhash, negatives, packing, quality, rpforest, secrets, suffixes, tokenfile
from .common import drop_scratch, ship_package, table
from .oracles import ORACLES
from .simhash import near_duplicates

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_forest(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents")).drop("k", "len")


def op2_rp_forest(spark, sf_dir):
    return rpforest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_rows(docs, model).select(
        "doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_bpe(spark, sf_dir):
    ids = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.decode(ids, RANKS).select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                         F.sha2(text, 256).alias("ids_sha256"),
                                         F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_packing(spark, sf_dir):
    p = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, length=2048, end_id=1)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_doubling(spark, sf_dir):
    f = doubling.find(table(spark, sf_dir, "documents"), size=35)
    return f.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_array(spark, sf_dir):
    f = suffixes.find(table(spark, sf_dir, "documents"), size=50)
    runs = F.transform("passages", lambda p: F.concat_ws("-", p["from"].cast("string"), p["to"].cast("string")))
    return f.withColumn("passages", F.array_join(runs, " "))


def op8_token_files(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=0)
    return tokenfile.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_minhash(spark, sf_dir):
    f = minhash.fingerprints(table(spark, sf_dir, "documents"))
    return f.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                    "edited_fingerprint", "near_edited", "near_next")


def op10_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op11_lexical(spark, sf_dir):
    index = lexical.build(table(spark, sf_dir, "documents"))
    found = lexical.search(index, table(spark, sf_dir, "benchmark"), k=10)  # a written table
    drop_scratch(spark, index.path)
    return found


def op12_gnat_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.union(own)))


def _shipped(query):
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_secret_forest": op1_secret_forest,
    "op2_rp_forest": op2_rp_forest,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_packing": op5_packing,
    "op6_doubling": op6_doubling,
    "op7_suffix_array": op7_suffix_array,
    "op8_token_files": op8_token_files,
    "op9_minhash": op9_minhash,
    "op10_simhash": op10_simhash,
    "op11_lexical": op11_lexical,
    "op12_gnat_negatives": op12_gnat_negatives,
    "op13_chat": op13_chat,
}
QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}
