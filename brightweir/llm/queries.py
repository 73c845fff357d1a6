"""One query for each operator: it applies the operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..runtime import new_dir
from . import align, bpe, decontaminate, exact, licenses, lm, phrases, pii, simhash, token_counts, topk, toxicity, warc
from .common import fold, table, text_or_empty
from .registry import CHECKS, QUERIES, query

__all__ = ["CHECKS", "QUERIES"]


#: Key of the surrogates; a real run passes its own.
PII_KEY = "an example key"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def bpe_digests(docs, tokenizer: str = TOKENIZER):
    """Encode every text, decode the ids, and give digests of both."""
    ranks = bpe.read_ranks(public_tokenizers.path(tokenizer))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_byte_bpe")
def _(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"))


@query("op4_simhash_near_dedup")
def _(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=4, max_bits=4)


@query("op6_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


@query("op9_lm_scoring")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lm.score(docs.withColumn("held_out", fold() == 1))


@query("op10_exact_top_k", topk.CHECK)
def _(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op7_warc", warc.CHECK)
def _(spark, sf_dir):
    path = new_dir(spark, "pages-warc")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages"), least_bytes=0), path)
    records = warc.read_warc(spark, path, payload=False, verify=True)
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        warc.page_id_of("record_id").alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        warc.page_id_of("refers_to").alias("refers_to"),
    )


@query("op3_decontamination", decontaminate.CHECK)
def _(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_pii_surrogates")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.replace(docs, key=PII_KEY).select("doc_id", "text", "pii_entities")


@query("op8_license_scans", licenses.check_sql())
def _(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


@query("op5_token_counts", token_counts.CHECK)
def _(spark, sf_dir):
    """Insert all documents, delete all copies but the first, count German and French anew, and deliver one batch twice."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, new_dir(spark, "token-rollup"))
    first = docs.groupBy(F.md5(text_or_empty()).alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copied = first.where("n > 1").select("digest", "first")
    marked = docs.withColumn("digest", F.md5(text_or_empty())).join(copied, "digest", "left")
    copies = marked.where("first is not null and doc_id <> first")
    moved = marked.where("lang in ('de', 'fr') and (first is null or doc_id = first)")
    rollup.commit("insert", token_counts.inserted(token_counts.counted(docs, "words-1")))
    rollup.commit("delete", token_counts.deleted(token_counts.counted(copies, "words-1")))
    for _ in range(2):
        rollup.commit("revise", token_counts.revised(token_counts.counted(moved, "words-1"), token_counts.counted(moved, "words-2")))
    rollup.fold(["insert", "delete"], "base")
    return rollup.totals(["base", "revise"])


@query("op11_token_alignment")
def _(spark, sf_dir):
    files = [align.read_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.align(table(spark, sf_dir, "documents"), *files)


@query("op12_phrase_collocations", phrases.CHECK)
def _(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"), min_count=30, per_lang=2_000)


@query("op13_exact_dedup", exact.CHECK)
def _(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))
