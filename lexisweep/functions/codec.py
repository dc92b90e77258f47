"""Raw Snappy blocks of UTF-8 text, as Arrow-batched column functions.

Spark has no built-in for a bare Snappy block, so these two are the only Python
functions that see text.  For storage alone Parquet compresses by itself.
"""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def _block_size(block: bytes) -> int:
    """Size of the uncompressed data: a little-endian base-128 number in front."""
    size = 0
    for place, byte in enumerate(block[:5]):
        size |= (byte & 0x7F) << (7 * place)
        if byte < 0x80:
            return size
    raise ValueError("corrupt Snappy block: bad length")


def _compress(text):
    return None if text is None else pa.compress(text.encode("utf-8"), "snappy", asbytes=True)


def _decompress(block):
    if block is None:
        return None
    data = pa.decompress(block, _block_size(block), codec="snappy", asbytes=True)
    return data.decode("utf-8")


def decode_blocks(blocks: pa.Array) -> pa.Array:
    return pa.array([_decompress(block.as_py()) for block in blocks], pa.string())


@F.arrow_udf(BinaryType())
def encode_text(text: pa.Array) -> pa.Array:
    """Text to the raw Snappy block of its UTF-8 bytes."""
    return pa.array([_compress(value.as_py()) for value in text], pa.binary())


@F.arrow_udf(StringType())
def decode_text(block: pa.Array) -> pa.Array:
    """Raw Snappy block to text; a corrupt block fails the task."""
    return decode_blocks(block)
