"""The queries of this subpackage, and SQL for those that SQL can express.

Each takes ``(spark, folder)`` and covers its whole table.
"""

import public_tokenizers
from pyspark.sql import functions as F

from lexisweep.llm import (
    bpe,
    filter_audit,
    fingerprints,
    neardup,
    neighbours,
    oracles,
    packing,
    private_data,
    quality,
    repeats,
    secrets,
    sharding,
    spelling,
    toxicity,
)

QUERIES = {}
ORACLES = {}


def register(sql=None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register()
def op2_bpe(spark, folder):
    """Ids of every text and the bytes they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(
        table(spark, folder, "documents"), path, public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register()
def op6_sharding(spark, folder):
    """All documents in 8 shards of nearly equal bytes."""
    return sharding.shard_by_bytes(table(spark, folder, "documents"), 8)


@register()
def op9_packing(spark, folder):
    """Every document's ids, packed into sequences of 2048."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, folder, "documents"), path, 2048)


@register(oracles.SECRETS)
def op5_secrets(spark, folder):
    """Secret spans of every document; owners are sources."""
    docs = table(spark, folder, "documents")
    repository = F.concat_ws("/", "source", "lang")
    return secrets.find_secrets(docs, F.col("source"), repository)


@register(oracles.NEARDUP)
def op8_neardup(spark, folder):
    """Near-duplicate classes of all documents at 85 % of 5-word shingles."""
    docs = table(spark, folder, "documents")
    return neardup.near_duplicates(docs, 85).drop("text_digest", "component")


@register()
def op10_repeats(spark, folder):
    """All documents without the passages that stand elsewhere first."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs)


@register()
def op3_quality(spark, folder):
    """Quality scores of all documents, from weak labels."""
    return quality.classify(table(spark, folder, "documents"))


@register()
def op4_fingerprints(spark, folder):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.edited_likeness(table(spark, folder, "documents"))


@register()
def op7_toxicity(spark, folder):
    """Toxicity scores of all documents, from labelled examples."""
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register()
def op1_neighbours(spark, folder):
    """The 20 nearest of every 20th embedding."""
    return neighbours.nearest(table(spark, folder, "embeddings"))


@register(oracles.FILTERS)
def op13_filter_audit(spark, folder):
    """Five filters of documents in all 120 orders, by source."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register()
def op12_private(spark, folder):
    """Spans of personal data in every document."""
    return private_data.digests(private_data.find_private(table(spark, folder, "documents")))


@register(oracles.SPELLING)
def op11_spelling(spark, folder):
    """Words of all documents, each with the form that it is a variant of."""
    return spelling.variants(table(spark, folder, "documents"))
