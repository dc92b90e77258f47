"""From a raw corpus to packed sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` in
``docs``; ``run`` writes what a stage returns as Parquet and hands the written
table to the next.  All but the last return those columns again.

* quality: documents whose score is too low go.
* near_duplicates: one document of each group stays.
* repeats: sentences that stand elsewhere first are cut; a document of which
  nothing is left goes.
* secrets: what looks like a live secret is masked; every document stays.
* packing: the pieces of all documents and their places in sequences.
"""

import public_tokenizers
from pyspark.sql import functions as F

from lexisweep.llm.neardup import keep_one
from lexisweep.llm.packing import pack_documents
from lexisweep.llm.quality import keep_good
from lexisweep.llm.repeats import remove_repeats
from lexisweep.llm.secrets import mask_secrets
from lexisweep.staging import inner_tables, staged

CAPACITY = 2048

# Bytes of words that a Python worker remembers in the last stage: less than packing
# alone takes, because the stages before have grown the executors.
KEPT_WORDS = 24 << 20

# Bytes of texts that go to a Python worker at once.  Spark's own bound is 64 MB, held
# outside the heap by the executor and again by each worker, beside what stages keep.
BATCH_BYTES = "4m"

# The scorer, minhashes and the plan of sequences are beyond SQL; the stages are
# tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def _bounded(spark):
    """Sets the session's bound for batches; a stage's rows are computed later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _counted(docs):
    """With ``n_chars`` of the present text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint"))


def quality(spark, docs, sf_dir):
    _bounded(spark)
    return keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    _bounded(spark)
    return keep_one(docs)


def repeats(spark, docs, sf_dir):
    _bounded(spark)
    cut = remove_repeats(docs)
    nothing_left = (F.col("cut_chars") > 0) & (F.trim("text") == "")
    return _counted(cut.filter(~F.coalesce(nothing_left, F.lit(False))).select(*docs.columns))


def secrets(spark, docs, sf_dir):
    _bounded(spark)
    repository = F.concat_ws("/", "source", "lang")
    return _counted(mask_secrets(docs, F.col("source"), repository))


def packing(spark, docs, sf_dir):
    _bounded(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(docs, path, CAPACITY, KEPT_WORDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with inner_tables(spark) as inner:
            result = stage(spark, docs, sf_dir)
        docs = staged(result, name)
        inner.drop()  # what the stage has written for itself
    return STAGES[-1][1](spark, docs, sf_dir)
