"""Secrets in texts, judged by who owns them across the whole corpus.

Patterns propose spans.  A value copied over many owners and repositories is an
example (of a manual, say); one that only few owners have looks live.  So the
values' hashes are counted by distinct owners and repositories over the corpus,
and the counts come back to the spans.  Opaque tokens without a telling context
are spans only if they look live.

All in built-in expressions.  A match's position is the sum of the lengths of
the gaps and matches before it in its row; gaps come from splitting the text.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexisweep.llm.common import join_facts, text_digest
from lexisweep.staging import staged

# Kinds in their order; pattern, group that holds the value, and
# the least number of characters of that value.
KINDS = [
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # whole runs, as with + and a later test
    ("opaque", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
]
BASE = 3

# Distinct owners and repositories from which on a value is an example.
EXAMPLE_OWNERS = 5
EXAMPLE_REPOSITORIES = 5

MASK = "[secret]"


def _matches(number):
    name, pattern, group, _ = KINDS[number]
    text, literal = F.col("text"), F.lit(pattern)
    whole = F.regexp_extract_all(text, literal, F.lit(0))
    values = F.regexp_extract_all(text, literal, F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    found = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), values.alias("value")),
        lambda m: F.struct(
            F.lit(number).alias("kind"),
            F.char_length(m["gap"]).alias("gap"),
            F.char_length(m["whole"]).alias("length"),
            F.char_length(m["value"]).alias("value_length"),
            (m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")).alias("mixed"),
            F.unhex(F.md5(m["value"])).alias("hash"),
        ),
    )
    none = F.array().cast(
        "array<struct<kind:int,gap:int,length:int,value_length:int,mixed:boolean,hash:binary>>"
    )
    return F.when(F.coalesce(text, F.lit("")).rlike(pattern), found).otherwise(none)


def rows_of(docs: DataFrame, owner, repository) -> DataFrame:
    """Staged (row, doc_id, digest, owner, repository, found), one per row; the
    only pass over the texts.  Row numbers are stable because they are written."""
    return staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            text_digest().alias("digest"),
            F.coalesce(owner, F.lit("")).alias("owner"),
            F.coalesce(repository, F.lit("")).alias("repository"),
            F.concat(*(_matches(k) for k in range(len(KINDS)))).alias("found"),
        ),
        "found",
    )


def judged_spans(rows: DataFrame) -> DataFrame:
    """(row, digest, kind, start, end, hash, owners, repositories, live), for the
    rows of ``rows_of``; places in code points, end exclusive."""
    each = rows.select(
        "row", "digest", "owner", "repository", F.posexplode("found").alias("pos", "m")
    ).select("row", "digest", "owner", "repository", "pos", "m.*")
    in_kind = Window.partitionBy("row", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("length")).over(in_kind).cast("int")
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    fits = (F.col("value_length") >= least) & ((F.col("kind") < BASE) | F.col("mixed"))
    placed = (
        each.repartition("row")
        .withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("length"))
        .filter(fits)
    )
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < BASE
    reached = F.max(F.when(base, F.col("end"))).over(
        by_start.rowsBetween(Window.unboundedPreceding, -1)
    )
    coming = F.min(F.when(base, F.col("start"))).over(
        by_start.rowsBetween(1, Window.unboundedFollowing)
    )
    apart = (F.coalesce(F.col("reached"), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.col("coming"), F.col("end")) >= F.col("end")
    )
    spans = staged(
        placed.withColumn("reached", reached)
        .withColumn("coming", coming)
        .filter(base | apart)
        .select("row", "digest", "owner", "repository", "kind", "start", "end", "hash"),
        "spans",
    )
    owned = spans.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("rows"))
    facts = staged(
        owned.groupBy("hash").agg(
            F.sum("rows").alias("rows"),
            F.count_distinct("owner").alias("owners"),
            F.count_distinct("repository").alias("repositories"),
        ),
        "owners",
    )
    example = (F.col("owners") >= EXAMPLE_OWNERS) & (
        F.col("repositories") >= EXAMPLE_REPOSITORIES
    )
    joined = join_facts(spans, facts, "hash", "rows").withColumn("live", ~example)
    return joined.filter((F.col("kind") < BASE) | F.col("live")).select(
        "row", "digest", "kind", "start", "end", "hash", "owners", "repositories", "live"
    )


def find_secrets(docs: DataFrame, owner, repository) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live) per row.

    ``owner`` and ``repository`` are columns of ``docs``; a null is an owner of
    its own kind.  A null text is empty; without spans counts are 0 and ``spans``
    is empty.  Repeated rows get a result each and count as one owner.  An empty
    table gives an empty one.
    """
    rows = rows_of(docs, owner, repository)
    spans = judged_spans(rows)
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live")))
    per_row = spans.groupBy("row").agg(listed.alias("all"))
    every = F.coalesce(
        "all", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    )
    written = lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]
    )
    count = lambda test: F.size(F.filter("all", test)).cast("bigint")
    text = lambda column: F.concat_ws(",", F.transform(column, written))
    return (
        rows.select("row", "doc_id")
        .join(per_row, "row", "left")
        .withColumn("all", every)
        .select(
            "doc_id",
            *(count(_is_kind(k)).alias(f"n_{KINDS[k][0]}") for k in range(BASE)),
            F.sha2(text(F.filter("all", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"),
            text("all").alias("spans"),
            count(lambda s: s["live"]).alias("n_live"),
        )
    )


def _is_kind(kind):
    return lambda span: span["kind"] == kind


def mask_secrets(docs: DataFrame, owner, repository) -> DataFrame:
    """``docs`` with live-looking secrets in ``text`` replaced by MASK.

    Every row and column stays; texts without live secrets stay as they are.
    """
    spans = judged_spans(rows_of(docs, owner, repository)).filter("live")
    # Positions depend on the text alone, so equal texts need one list.
    once = spans.select("digest", "start", "end").distinct()
    by_start = (
        Window.partitionBy("digest")
        .orderBy("start", "end")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = F.coalesce(F.max("end").over(by_start), F.lit(0))
    cuts = (
        once.withColumn("reached", reached)
        .filter(F.col("end") > F.col("reached"))
        .withColumn("start", F.greatest("start", "reached"))
    )
    weights = rows_weight(docs)
    lists = cuts.groupBy("digest").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "reached"))).alias("__cuts")
    )
    facts = staged(lists.join(weights, "digest"), "cuts")
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("__doc"), text_digest().alias("digest"))
    joined = join_facts(keyed, facts, "digest", "__rows")
    text, size = F.col("__doc")["text"], F.size("__cuts")
    kept = F.transform(
        "__cuts",
        lambda c: F.concat(
            text.substr(c["reached"] + 1, c["start"] - c["reached"]),
            F.when((c["start"] > c["reached"]) | (c["start"] == 0), MASK).otherwise(""),
        ),
    )
    rest = text.substr(F.element_at("__cuts", -1)["end"] + 1, F.char_length(text))
    masked = F.when(size > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(text)
    return joined.select(
        *((masked if n == "text" else F.col("__doc")[n]).alias(n) for n in names)
    )


def rows_weight(docs):
    return docs.groupBy(text_digest().alias("digest")).agg(F.count(F.lit(1)).alias("__rows"))
