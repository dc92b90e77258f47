"""Every operator and job as a named query over the given tables, with SQL.

Each entry of ``QUERIES`` takes ``(spark, folder)`` and covers whole tables and
whole texts; ``ORACLES`` holds the SQL that must give the same rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexisweep.functions.codec import decode_text, encode_text
from lexisweep.functions.match import (
    count_substring,
    count_whole_word,
    count_word_chars,
    match_count,
)
from lexisweep.operators import clean, hits, layout, runlog, stats
from lexisweep.operators import queries as query_ops
from lexisweep.operators.queries import Query
from lexisweep.operators.score import filter_min_matches, score_pages
from lexisweep.plans import prepare as prepare_plan
from lexisweep.plans import search
from lexisweep.schema import ROWS_PER_CHUNK
from lexisweep.sources.chunk_files import (
    read_chunk_corpus,
    read_chunk_sizes,
    read_chunks,
    write_chunks,
)
from lexisweep.sources.dataset import OpenDataset, dataset_head
from lexisweep.sources.dump import read_dump, write_dump
from lexisweep.staging import new_path, staged

QUERIES = {}
ORACLES = {}

DOCS_PER_CHUNK = 64
PAGES_PER_CHUNK = 16
SMALL_CAPACITY = 4


def register(sql=None, name=None):
    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return add


# Corpora made of the given tables, in Spark and in SQL.


def table(spark, folder, name) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        f"cast(doc_id div {DOCS_PER_CHUNK} as int) as chunk_id",
        "doc_id as seq",
        "concat(source, '/', doc_id) as title",
        "text",
    )


def web_pages(spark, folder) -> DataFrame:
    return table(spark, folder, "pages").selectExpr(
        f"cast(page_id div {PAGES_PER_CHUNK} as int) as chunk_id",
        "page_id as seq",
        "regexp_extract(html, '<title>(.*?)</title>', 1) as title",
        "html as text",
    )


DOCS = f"""docs as (
  select cast(doc_id // {DOCS_PER_CHUNK} as int) as chunk_id, doc_id as seq,
         source || '/' || doc_id as title, text
  from documents)"""

PAGES = f"""docs as (
  select cast(page_id // {PAGES_PER_CHUNK} as int) as chunk_id, page_id as seq,
         regexp_extract(html, '<title>(.*?)</title>', 1) as title, html as text
  from pages)"""


def sql_substring(pattern, text="text"):
    """Occurrences of a pattern that cannot overlap itself."""
    size = len(pattern.encode())
    return f"(strlen({text}) - strlen(replace({text}, '{pattern}', ''))) // {size}"


def sql_doubled(half, text="text"):
    """Overlapping occurrences of a pattern that is ``half`` twice."""
    runs = f"regexp_extract_all({text}, '(?:{half}){{2,}}')"
    count = f"lambda x: length(x) // {len(half)} - 1"
    return f"coalesce(list_sum(list_transform({runs}, {count})), 0)::bigint"


def sql_word(word, text="text"):
    return f"len(regexp_extract_all({text}, '\\b{word}\\b'))"


def scored(corpus, count):
    return f"""with {corpus}, scored as (
  select chunk_id, seq, title, {count} as cnt, strlen(text) as bytes from docs)"""


TION = scored(DOCS, sql_substring("tion"))
THE = scored(DOCS, sql_word("the"))
PAGE_THE = scored(PAGES, sql_word("the"))


def _tion(spark, folder):
    return score_pages(documents(spark, folder), "tion")


def _the(spark, folder):
    return score_pages(documents(spark, folder), "the", whole_words=True)


def _page_the(spark, folder):
    return score_pages(web_pages(spark, folder), "the", whole_words=True)


# Match functions.


@register(
    f"""select doc_id, {sql_substring('tion')} as tion, {sql_doubled('er')} as erer,
       {sql_doubled('en')} as enen from documents"""
)
def count_substring_(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        count_substring("text", "tion").alias("tion"),
        count_substring("text", "erer").alias("erer"),
        count_substring("text", "enen").alias("enen"),
    )


@register(
    f"""select doc_id, {sql_word('the')} as the_count, {sql_word('tion')} as tion_count
       from documents"""
)
def count_whole_word_(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        count_whole_word("text", "the").alias("the_count"),
        count_whole_word("text", "tion").alias("tion_count"),
    )


@register(
    """select doc_id,
       length(regexp_replace(text, '[^A-Za-z0-9_]', '', 'g')) as word_chars
       from documents"""
)
def is_word_char_(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", count_word_chars("text").alias("word_chars")
    )


@register(
    f"""select conv_id, turn, {sql_substring('tion')} as anywhere,
       {sql_word('the')} as whole from conversations"""
)
def match_count_(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        match_count("text", "tion").alias("anywhere"),
        match_count("text", "the", whole_words=True).alias("whole"),
    )


# Cleaning.


def _dump(spark, folder):
    """The documents in the shape of a dump."""
    return table(spark, folder, "documents").selectExpr(
        "doc_id as id",
        "concat(source, '/', doc_id) as title",
        """named_struct('id', doc_id + 1, 'timestamp', '2024-01-01T00:00:00Z',
             'text', named_struct('_VALUE', text, '_space', 'preserve')) as revision""",
    )


@register("select source || '/' || doc_id as title, text from documents")
def select_page_text(spark, folder):
    return clean.select_page_text(_dump(spark, folder))


@register("select source || '/' || doc_id as title, text from documents where lang not in ('fr', 'de')")
def drop_null_pages(spark, folder):
    pages = table(spark, folder, "documents").selectExpr(
        "case when lang <> 'fr' then concat(source, '/', doc_id) end as title",
        "case when lang <> 'de' then text end as text",
    )
    return clean.drop_null_pages(pages)


@register(
    """select * from (
         select doc_id, source || case when lang = 'en' then ':' else ': ' end || lang as title
         from documents)
       where not regexp_matches(title, '[A-Za-z_0-9]+:[^ ].*')"""
)
def drop_meta_pages(spark, folder):
    pages = table(spark, folder, "documents").selectExpr(
        "doc_id", "concat(source, case when lang = 'en' then ':' else ': ' end, lang) as title"
    )
    return clean.drop_meta_pages(pages)


# Fixed values, as in functions/wiki.py: the link, title and address patterns in
# the SQL below.
_LINKED = (
    "concat('[[a|', text, ']] [[File:p|thumb|cap [[', source, '|r]] z]] [[e|]] [[', lang, ']]')"
)
_STRIPPED = r"""regexp_replace(regexp_replace(linked,
    '\[\[(?:[^\]\[]+\|)?([^\]\[]+)\]\]', '\1', 'g'),
    '\[\[(?:[^\]\[]+\|)?([^\]\[]+)\]\]', '\1', 'g')"""


@register(
    f"""select doc_id, {_STRIPPED} as text
       from (select doc_id, {_LINKED} as linked from documents)"""
)
def strip_links(spark, folder):
    linked = table(spark, folder, "documents").selectExpr("doc_id", f"{_LINKED} as text")
    return clean.strip_links(linked)


# Hits and totals.


@register(f"{TION} select title, cnt as count from scored where cnt >= 20", "filter_min_matches")
def filter_min_matches_(spark, folder):
    return filter_min_matches(_tion(spark, folder), 20).select("title", "count")


@register(
    f"""{TION} select title, cnt as count, 'https://en.wikipedia.org/wiki/' || title as link
       from scored where cnt >= 1"""
)
def result_link(spark, folder):
    found = filter_min_matches(_tion(spark, folder)).select("title", "count")
    return hits.link_hits(found)


@register(f"{TION} select sum(cnt)::bigint as num_word_matches from scored")
def num_word_matches(spark, folder):
    return _tion(spark, folder).agg(stats.num_word_matches())


@register(f"{TION} select count(*) as num_page_matches from scored where cnt >= 20")
def num_page_matches(spark, folder):
    return _tion(spark, folder).agg(stats.num_page_matches(20))


@register(
    f"""{THE} select cnt as max_word_matches, title as max_page_title
       from scored order by cnt desc, seq desc limit 1"""
)
def best_page(spark, folder):
    return _the(spark, folder).agg(stats.max_word_matches(), stats.best_page())


@register(
    f"""with {DOCS} select sum(strlen(text) + 4)::bigint as input_size from docs"""
)
def input_size(spark, folder):
    return _tion(spark, folder).agg(stats.input_size())


_PARTIALS = """, partials as (
  select chunk_id, sum(cnt)::bigint as num_word_matches,
         count(*) filter (cnt >= 2) as num_page_matches, max(cnt) as max_word_matches,
         arg_max(title, (cnt, seq)) as max_page_title, sum(bytes + 4)::bigint as input_size,
         least(count(*) filter (cnt >= 2), 4) as num_records
  from scored group by chunk_id)"""


@register(f"{PAGE_THE}{_PARTIALS} select * from partials")
def partial_stats(spark, folder):
    return stats.partial_stats(_page_the(spark, folder), 2, SMALL_CAPACITY)


@register(
    f"""{PAGE_THE} select sum(cnt)::bigint as num_word_matches,
         count(*) filter (cnt >= 2) as num_page_matches, max(cnt) as max_word_matches,
         arg_max(title, (cnt, seq)) as max_page_title, sum(bytes + 4)::bigint as input_size
       from scored"""
)
def merge_stats(spark, folder):
    return stats.merge_stats(stats.partial_stats(_page_the(spark, folder), 2, SMALL_CAPACITY))


@register(
    f"{PAGE_THE}{_PARTIALS} select bool_and(num_records >= num_page_matches) as all_known from partials"
)
def all_known(spark, folder):
    return stats.all_known(stats.partial_stats(_page_the(spark, folder), 2, SMALL_CAPACITY))


_FIRST = """, hits as (select * from scored where cnt >= 2),
first as (
  select * from (
    select *, row_number() over (partition by chunk_id order by seq) as position from hits)
  where position <= 4)"""

_MERGED = f"""{_FIRST}, inserted as (
  select chunk_id, 1 as kind, seq, title, cnt from first
  union all
  select chunk_id, 0, seq, title, cnt from (
    select *, row_number() over (partition by chunk_id order by cnt desc, seq desc) as r from hits)
  where r = 1),
merged as (
  select title, arg_max(cnt, (chunk_id, kind, seq)) as count from inserted group by title)"""

_KNOWN = """, complete as (
  select bool_and(n <= 4) as all_known
  from (select chunk_id, count(*) as n from hits group by chunk_id))"""

_RANKED = f"""{_MERGED}{_KNOWN}, ranked as (
  select (row_number() over (order by count desc, title))::int as rank, title, count, all_known
  from merged, complete),
banded as (
  select rank, case when rank = 1 then 'top' when all_known and rank <= 10 then 'top_ten'
               else 'other' end as band, title, count, all_known
  from ranked where rank <= case when all_known then 100 else 91 end)"""


def _merged(spark, folder):
    # Two branches: staged, so that they share one scan of the text.
    pages = staged(_page_the(spark, folder), "scored")
    return hits.merge_hits(
        hits.best_hits(pages, 2), hits.first_hits(pages, SMALL_CAPACITY, 2)
    )


@register(f"{PAGE_THE}{_FIRST} select chunk_id, seq, title, cnt as count, position::int as position from first")
def first_hits(spark, folder):
    return hits.first_hits(_page_the(spark, folder), SMALL_CAPACITY, 2).drop("bytes")


@register(f"{PAGE_THE}{_MERGED} select title, count from merged")
def merge_hits(spark, folder):
    return _merged(spark, folder)


@register(f"{PAGE_THE}{_MERGED} select count(*) as num_result_records from merged")
def num_result_records(spark, folder):
    return hits.num_result_records(_merged(spark, folder))


@register(f"{PAGE_THE}{_MERGED} select title, count from merged order by count desc, title")
def rank_hits(spark, folder):
    return hits.rank_hits(_merged(spark, folder))


@register(
    f"""{TION}, ranked as (
         select (row_number() over (order by cnt desc, title))::int as rank, title, cnt as count
         from scored where cnt >= 1)
       select rank, case when rank = 1 then 'top' when rank <= 10 then 'top_ten' else 'other' end
              as band, title, count, true as all_known
       from ranked where rank <= 100"""
)
def result_bands(spark, folder):
    return hits.result_bands(filter_min_matches(_tion(spark, folder)).select("title", "count"))


@register(
    f"""{PAGE_THE}{_RANKED} select *, case when band <> 'other' or all_known then rank end as label
       from banded"""
)
def rank_labels(spark, folder):
    return hits.rank_labels(hits.respond(_page_the(spark, folder), 2, SMALL_CAPACITY))


# Layout.

_POSITIONS = """with sized as (
  select doc_id as seq, strlen(text) as bytes, row_number() over (order by doc_id) - 1 as pos,
         sum(strlen(text)) over (order by doc_id)::hugeint as cum,
         sum(strlen(text)) over ()::hugeint as total, count(*) over () as n
  from documents)"""

_CHUNKED = f"""{_POSITIONS}, spared as (
  select *, (15 * (cum + 1) - 1) // total - pos as spare from sized),
chunked as (
  select seq, bytes, total,
         pos + least(1, min(spare) over (order by seq)) as closed,
         case when pos = 0 then 0 else pos - 1 + least(1, min(spare) over (
           order by seq rows between unbounded preceding and 1 preceding)) end as chunk_id
  from spared)"""


@register(f"{_CHUNKED} select seq, bytes, least(chunk_id, 14)::int as chunk_id from chunked")
def rechunk_by_bytes(spark, folder):
    positions = layout.scan_positions(documents(spark, folder))
    return layout.rechunk_by_bytes(positions).rows.select("seq", "bytes", "chunk_id")


@register(
    f"""{_CHUNKED} select max(total)::bigint as bytes_in, sum(bytes)::bigint as bytes_out,
         15::bigint as n_chunks, max(closed)::bigint as chunks_closed,
         max(closed) = 15 as ok from chunked"""
)
def rechunk_check(spark, folder):
    positions = layout.scan_positions(documents(spark, folder))
    return layout.rechunk_check(layout.rechunk_by_bytes(positions))


@register(f"{_POSITIONS} select seq, ((7 * (pos + 1) - 1) // n)::int as chunk_id from sized")
def split_rows(spark, folder):
    return layout.split_rows(layout.scan_positions(documents(spark, folder)), 7)


# Sources and sinks, as round trips through the shared folder.


@register(
    """select doc_id as id, source || '/' || doc_id as title, doc_id + 1 as revision_id,
       '2024-01-01T00:00:00Z' as revised, 'preserve' as space, text from documents"""
)
def read_dump_(spark, folder):
    path = new_path(spark, "dump")
    write_dump(_dump(spark, folder), path, compression="bzip2")
    return read_dump(spark, path).select(
        "id",
        "title",
        F.col("revision.id").alias("revision_id"),
        F.col("revision.timestamp").alias("revised"),
        F.col("revision.text._space").alias("space"),
        F.col("revision.text._VALUE").alias("text"),
    )


def _chunk_prefix(spark, folder):
    prefix = f"{new_path(spark, 'chunks')}/set"
    write_chunks(documents(spark, folder).withColumn("text", encode_text("text")), prefix)
    return prefix


def _chunk_files(spark, folder):
    return read_chunks(spark, _chunk_prefix(spark, folder))


@register(
    f"""with {DOCS} select chunk_id, count(*) as n_rows, sum(strlen(text))::bigint as text_bytes
       from docs group by chunk_id"""
)
def write_chunks_(spark, folder):
    text = F.octet_length(decode_text("text"))
    return (
        _chunk_files(spark, folder)
        .select("chunk_id", text.alias("text_bytes"))
        .groupBy("chunk_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("text_bytes").alias("text_bytes"))
    )


@register(
    f"""with {DOCS} select chunk_id, title, text,
         row_number() over (partition by chunk_id order by seq) - 1 as position from docs
       qualify chunk_id in (1, 3) or chunk_id >= 5 and position < 40"""
)
def read_some_chunks(spark, folder):
    """Only the files of the chunks asked for are opened."""
    prefix = _chunk_prefix(spark, folder)
    last = F.max("chunk_id").alias("last")
    n_chunks = 1 + read_chunk_sizes(spark, prefix).agg(last).first()["last"]
    position = F.col("seq") - F.col("chunk_id") * F.lit(ROWS_PER_CHUNK)
    some = read_chunks(spark, prefix, (1, 3)).union(
        read_chunks(spark, prefix, range(5, n_chunks)).filter(position < 40)
    )
    return some.select(
        "chunk_id", "title", decode_text("text").alias("text"), position.alias("position")
    )


@register(
    f"""with {DOCS} select chunk_id, title, text,
         row_number() over (partition by chunk_id order by seq) - 1 as position from docs"""
)
def read_chunks_(spark, folder):
    return _chunk_files(spark, folder).select(
        "chunk_id",
        "title",
        decode_text("text").alias("text"),
        (F.col("seq") - F.col("chunk_id") * F.lit(ROWS_PER_CHUNK)).alias("position"),
    )


@register(f"with {DOCS} select * from docs order by seq limit 100", "dataset_head")
def dataset_head_(spark, folder):
    return dataset_head(documents(spark, folder), 100)


@register("select doc_id, lang, source, strlen(text) as n_bytes from documents")
def open_dataset_(spark, folder):
    """Kept on the executors, reloaded, released, and read again."""
    path = f"{folder}/documents.parquet"
    dataset = OpenDataset(spark)
    kept = dataset.open(path, keep_loaded=True)
    rows = kept.count()
    again = dataset.open(path, force_reload=True, keep_loaded=True)
    if kept is again or again.count() != rows or not spark.catalog.tableExists(dataset.VIEW):
        raise AssertionError("the dataset did not reload")
    dataset.close()
    corpus = dataset.open(path)
    return corpus.select(
        "doc_id", "lang", "source", F.octet_length("text").cast("bigint").alias("n_bytes")
    )


@register(
    f"""{_CHUNKED} select seq, least(chunk_id, 14)::int as chunk_id,
         source || '/' || doc_id as title, text
       from chunked join documents on doc_id = seq"""
)
def rechunk(spark, folder):
    corpus = prepare_plan.rechunk(documents(spark, folder))
    return corpus.select("seq", "chunk_id", "title", "text")


@register(
    f"""with {DOCS} select title, text,
         row_number() over (order by seq) - 1 as position from docs"""
)
def rechunk_files(spark, folder):
    """Chunk files to 7 others, in the same order; chunks ascend with it."""
    source, target = _chunk_prefix(spark, folder), f"{new_path(spark, 'even')}/set"
    prepare_plan.rechunk_files(spark, source, target, 7)
    rows = read_chunk_corpus(spark, target)
    # Rows before each chunk, one number per chunk.
    sizes = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    place = F.col("seq") - F.col("chunk_id") * F.lit(ROWS_PER_CHUNK) + F.col("before")
    return rows.join(F.broadcast(before), "chunk_id").select("title", "text", place.alias("position"))


@register(
    f"""with {DOCS}, scored as (
         select chunk_id, seq, title, {sql_word('the')} as cnt from docs)
       select sum(cnt)::bigint as num_word_matches,
              count(*) filter (cnt >= 3) as num_page_matches, max(cnt) as max_word_matches,
              arg_max(title, (cnt, seq)) as max_page_title from scored"""
)
def search_chunk_files(spark, folder):
    """A search in chunk files; their stored size depends on the codec."""
    corpus = read_chunk_corpus(spark, _chunk_prefix(spark, folder))
    return search.search_stats(corpus, Query("the", True, 3)).drop("input_size")


@register(
    rf"""with linked as (
         select source || case when lang = 'en' then ':' else ': ' end || doc_id as title,
                {_LINKED} as linked
         from documents where lang <> 'fr')
       select title, {_STRIPPED} as text, strlen({_STRIPPED}) as bytes
       from linked where not regexp_matches(title, '[A-Za-z_0-9]+:[^ ].*')"""
)
def prepare(spark, folder):
    """French articles have no text and are dropped, English titles are meta."""
    path = new_path(spark, "dump")
    dump = table(spark, folder, "documents").selectExpr(
        "concat(source, case when lang = 'en' then ':' else ': ' end, doc_id) as title",
        f"""named_struct('text', named_struct(
              '_VALUE', case when lang <> 'fr' then {_LINKED} end,
              '_space', 'preserve')) as revision""",
    )
    write_dump(dump, path)
    return prepare_plan.prepare(spark, path).select("title", "text", "bytes")


@register(
    """select 'p/' || doc_id as title, row_number() over (order by doc_id % 3, doc_id) as position
       from documents"""
)
def prepare_order(spark, folder):
    """Pages of a dump of three files: numbered in the order of files and pages."""
    path = new_path(spark, "dumps")
    docs = table(spark, folder, "documents")
    for part in range(3):
        # The names of the files follow the order of their pages.
        pages = docs.filter(F.col("doc_id") % 3 == part)
        pages = pages.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
        shaped = pages.selectExpr(
            "concat('p/', doc_id) as title",
            "named_struct('text', named_struct('_VALUE', text, '_space', 'preserve')) as revision",
        )
        write_dump(shaped, f"{path}/{part}")
    corpus = prepare_plan.prepare(spark, f"{path}/*").select("seq", "title", "bytes")
    corpus = staged(corpus, "order")
    positions = layout.scan_positions(corpus).rows.select("seq", "pos")
    return corpus.join(positions, "seq").select("title", (F.col("pos") + 1).alias("position"))


# Query tables and run logs.

_ASKED = """select conv_id * 1000 + turn as query_id, text as pattern,
  case when turn > 0 then turn > 1 end as whole_words, nullif(turn, 0) as min_matches,
  case when role <> 'user' then role end as wiki from conversations"""


@register(
    f"""select query_id, pattern, coalesce(whole_words, false) as whole_words,
         coalesce(min_matches, 1) as min_matches, 0 as mode, coalesce(wiki, 'en') as wiki
       from ({_ASKED}) where coalesce(wiki, 'en') = 'en' and pattern <> ''"""
)
def normalise_query(spark, folder):
    asked = table(spark, folder, "conversations").selectExpr(
        "conv_id * 1000 + turn as query_id",
        "text as pattern",
        "case when turn > 0 then turn > 1 end as whole_words",
        "nullif(turn, 0) as min_matches",
        "case when role <> 'user' then role end as wiki",
    )
    return query_ops.normalise_query(asked)


@register(
    """select conv_id, turn, text as pattern, role = 'user' as whole_words, 1 as min_matches
       from conversations"""
)
def parse_query_text(spark, folder):
    log = table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "case when role = 'user' then concat('~', text) else text end as line"
    )
    return query_ops.parse_query_text(log, "line").drop("line")


_RUNS = """runs as (
  select event_id, user_id as query, event_type as mode, event_id * 1000003 as input_size,
         round(value * 1000)::bigint + 1 as time_us from events)"""


def _runs(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "user_id as query",
        "event_type as mode",
        "event_id * 1000003 as input_size",
        "cast(round(value * 1000) as bigint) + 1 as time_us",
    )


@register(
    f"""with {_RUNS}, exact as (
         select event_id, (input_size::hugeint * 200 + time_us * 1000) // (time_us * 2000) as h
         from runs)
       select event_id, (h // 100) || '.' || lpad((h % 100)::varchar, 2, '0') || ' GB/s' as bandwidth
       from exact"""
)
def bandwidth(spark, folder):
    return runlog.run_metrics(_runs(spark, folder)).select("event_id", "bandwidth")


@register(f"with {_RUNS} select event_id, time_us // 1000 as time_taken_ms from runs")
def time_taken_ms(spark, folder):
    return runlog.run_metrics(_runs(spark, folder)).select("event_id", "time_taken_ms")


@register(
    f"""with {_RUNS}, times as (
         select query, max(time_us) filter (mode = 'view') as slow_us,
                max(time_us) filter (mode = 'click') as fast_us
         from runs group by query),
       exact as (
         select *, (slow_us * 200 + fast_us) // (fast_us * 2) as h
         from times where slow_us is not null and fast_us is not null)
       select query, slow_us, fast_us,
              (h // 100) || '.' || lpad((h % 100)::varchar, 2, '0') as speedup from exact"""
)
def speedup(spark, folder):
    return runlog.speedup(_runs(spark, folder), slow="view", fast="click")


# Whole searches.


@register(f"{THE} select chunk_id, seq, title, cnt as count from scored where cnt >= 3")
def search_hits(spark, folder):
    return search.search_hits(documents(spark, folder), Query("the", True, 3))


@register(
    f"""{THE} select sum(cnt)::bigint as num_word_matches,
         count(*) filter (cnt >= 3) as num_page_matches, max(cnt) as max_word_matches,
         arg_max(title, (cnt, seq)) as max_page_title, sum(bytes + 4)::bigint as input_size
       from scored"""
)
def search_stats(spark, folder):
    return search.search_stats(documents(spark, folder), Query("the", True, 3))


@register(f"{PAGE_THE}{_RANKED} select * from banded")
def search_response(spark, folder):
    return search.search_response(web_pages(spark, folder), Query("the", True, 2), SMALL_CAPACITY)


@register(
    f"""{PAGE_THE}, merged as (
         select title, arg_max(cnt, seq) as count from scored where cnt >= 2 group by title),
       ranked as (
         select (row_number() over (order by count desc, title))::int as rank, title, count
         from merged)
       select rank, case when rank = 1 then 'top' when rank <= 10 then 'top_ten' else 'other' end
              as band, title, count, true as all_known
       from ranked where rank <= 100"""
)
def search_response_all(spark, folder):
    """The response over all matches, with no limit per chunk."""
    return search.search_response(web_pages(spark, folder), Query("the", True, 2))


@register(
    f"""{PAGE_THE}{_PARTIALS}{_MERGED}
       select sum(num_word_matches)::bigint as num_word_matches,
              sum(num_page_matches)::bigint as num_page_matches,
              max(max_word_matches) as max_word_matches,
              arg_max(max_page_title, (max_word_matches, chunk_id)) as max_page_title,
              sum(input_size)::bigint as input_size,
              (select count(*) from merged) as num_result_records,
              bool_and(num_records >= num_page_matches) as all_known
       from partials"""
)
def search_response_stats(spark, folder):
    """The totals of the same response, from pages scored once."""
    run = search.Search.run(web_pages(spark, folder), Query("the", True, 2), SMALL_CAPACITY)
    return run.stats()


_WORDS = """words as (
  select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from benchmark)"""

# Whole words of [A-Za-z] are runs of word characters.
_BATCH = f"""with {DOCS}, {_WORDS}, runs as (
  select chunk_id, seq, title, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as word from docs),
asked as (
  select 'word ' || word as query_id from words
  union all
  select 'item ' || item_id from benchmark),
counted as (
  select 'word ' || word as query_id, chunk_id, seq, title, count(*) as count
  from runs join words using (word) group by all
  union all
  select 'item ' || item_id, chunk_id, seq, title,
         (strlen(docs.text) - strlen(replace(docs.text, b.text, ''))) // strlen(b.text)
  from docs join benchmark b on contains(docs.text, b.text))"""


def _asked(spark, folder):
    """A query for every benchmark text, anywhere, and one for every word of
    those, as a whole word."""
    items = table(spark, folder, "benchmark")
    words = items.select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")
    ).distinct()
    asked = words.selectExpr("concat('word ', word) as query_id", "word as pattern", "true as whole_words")
    return asked.union(items.selectExpr("concat('item ', item_id)", "text", "false"))


@register(f"{_BATCH} select * from counted")
def search_batch(spark, folder):
    return search.search_batch(documents(spark, folder), _asked(spark, folder))


@register(
    f"""{_BATCH} select query_id, coalesce(sum(count), 0)::bigint as num_word_matches,
         count(count) as num_page_matches, coalesce(max(count), 0) as max_word_matches,
         arg_max(title, (count, seq)) filter (count >= 1) as max_page_title
       from asked left join counted using (query_id) group by query_id"""
)
def search_batch_stats(spark, folder):
    return search.batch_stats(documents(spark, folder), _asked(spark, folder))


@register(
    f"""with {_WORDS}, languages as (select distinct lang from documents), runs as (
         select doc_id as seq, lang, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as word
         from documents)
       select lang || ' ' || word as query_id, seq, count(*) as count
       from runs join words using (word) group by all"""
)
def search_batch_languages(spark, folder):
    """Every word asked in every language of the corpus."""
    corpus = table(spark, folder, "documents").selectExpr("doc_id as seq", "text", "lang as wiki")
    words = _asked(spark, folder).filter("whole_words").select("pattern", "whole_words")
    # A row per word and language, of which there are few: languages are copied.
    wikis = corpus.agg(F.collect_set("wiki").alias("wikis"))
    asked = words.withColumn("wiki", F.explode(wikis.select("wikis").scalar()))
    named = asked.withColumn("query_id", F.concat_ws(" ", "wiki", "pattern"))
    return search.search_batch(corpus, named)


@register(
    f"""{PAGE_THE}{_RANKED} select rank, band, title, count from banded"""
)
def response_document(spark, folder):
    """The nested answer, taken apart again: bands in order, ranked from 1."""
    run = search.Search.run(web_pages(spark, folder), Query("the", True, 2), SMALL_CAPACITY)
    lists = F.array(
        F.struct(F.lit("top").alias("band"), F.array("top_result").alias("hits")),
        F.struct(F.lit("top_ten").alias("band"), F.col("top_ten_results").alias("hits")),
        F.struct(F.lit("other").alias("band"), F.col("other_results").alias("hits")),
    )
    before = F.when(F.col("band") == "top", 0).when(F.col("band") == "top_ten", 1)
    before = before.otherwise(1 + F.col("tens"))
    return (
        run.document()
        .select(F.inline(lists), F.size("top_ten_results").alias("tens"))
        .select("band", before.alias("before"), F.posexplode("hits").alias("at", "hit"))
        .filter("hit is not null")
        .select((F.col("before") + F.col("at") + 1).alias("rank"), "band", "hit.*")
    )


# A trailing underscore only keeps a function apart from the one it calls.
for _names in (QUERIES, ORACLES):
    for _key in [key for key in _names if key.endswith("_")]:
        _names[_key.rstrip("_")] = _names.pop(_key)
