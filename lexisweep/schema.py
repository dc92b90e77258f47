"""Fixed schemas of the data model and the scan order."""

from pyspark.sql import types as T


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# One <page> element of an XML dump.  Fixed values: element and attribute names
# of the dump format; attributes carry a leading underscore, element text is
# `_VALUE`.
DUMP_PAGE = _struct(
    id=T.LongType(),
    ns=T.LongType(),
    redirect=_struct(_VALUE=T.StringType(), _title=T.StringType()),
    revision=_struct(
        comment=_struct(_VALUE=T.StringType(), _deleted=T.StringType()),
        contributor=_struct(
            _VALUE=T.StringType(),
            _deleted=T.StringType(),
            id=T.LongType(),
            ip=T.StringType(),
            username=T.StringType(),
        ),
        format=T.StringType(),
        id=T.LongType(),
        minor=T.StringType(),
        model=T.StringType(),
        parentid=T.LongType(),
        sha1=T.StringType(),
        text=_struct(_VALUE=T.StringType(), _space=T.StringType()),
        timestamp=T.StringType(),
    ),
    title=T.StringType(),
)

# A corpus has no order of its own, so its scan order is data: `seq` is unique
# and ascending over the whole corpus, and chunks are contiguous runs of it.
CORPUS_KEYS = ("chunk_id", "seq", "title")

# Positions inside chunk or partition k start at k * ROWS_PER_CHUNK, the spacing
# `monotonically_increasing_id` uses too.
ROWS_PER_CHUNK = 1 << 33
