"""The file relation: one row for each regular file."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("size", T.LongType(), False),
        T.StructField("mtime", T.DoubleType(), False),
        T.StructField("dev", T.LongType(), False),
        T.StructField("ino", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("sample", T.StringType()),
        T.StructField("digest", T.StringType()),
    ]
)

#: Bytes of one sample window, of one read, and the largest file that is never sampled.
SAMPLE_BYTES = 4096
READ_BYTES = 1 << 20
SMALL_BYTES = 3 * SAMPLE_BYTES

#: Ends of the ranges that files which still collide are read by, before they are read whole.
CUTS = (1 << 16, 1 << 20, 1 << 22, 1 << 24, 1 << 26)
