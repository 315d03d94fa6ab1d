"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..plans.durable import fresh_path
from . import bpe, codes, exact, hosts, language, minhash, packing, pii, quality, rans, repeats, vectors, whiten
from .common import fold, table


def _byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op3_token_files(spark, sf_dir):
    folder = fresh_path(spark, "token-files")
    rans.write_tokens(table(spark, sf_dir, "documents"), folder, _byte_bpe(), end_id=0)
    return rans.read_tokens(spark, folder, digest=True)


def op4_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_quality(spark, sf_dir):
    held_out = fold("doc_id", 3) == 1
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    found = language.identify(docs, language.fit_profiles(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_bpe(spark, sf_dir):
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), _byte_bpe())


def op10_vectors(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_codes(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark, sf_dir):
    return hosts.url_verdicts(spark, sf_dir)


def op13_whitening(spark, sf_dir):
    found = whiten.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))  # null where a long cannot hold it


QUERIES = {
    "op1_near_dedup": (op1_near_dedup, None),
    "op2_pii": (op2_pii, None),
    "op3_token_files": (op3_token_files, None),
    "op4_repeats": (op4_repeats, None),
    "op5_exact_dedup": (op5_exact_dedup, exact.OP5_SQL),
    "op6_packing": (op6_packing, None),
    "op7_quality": (op7_quality, None),
    "op8_language": (op8_language, None),
    "op9_bpe": (op9_bpe, None),
    "op10_vectors": (op10_vectors, vectors.OP10_SQL),
    "op11_codes": (op11_codes, codes.OP11_SQL),
    "op12_url_filter": (op12_url_filter, hosts.OP12_SQL),
    "op13_whitening": (op13_whitening, None),
}
