"""Files to lines.

A file is a row of a DataFrame: one or more key columns (its path, or whatever stands for
it) and its text, or its bytes in `content`. Lines end at "\\n" only; a final "\\n" begins no
line; an empty file has none. Searching drops one "\\r" from the end of each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINARY_PROBE = 1024


def text_is_binary(text: Column) -> Column:
    """For text: of its UTF-8 bytes, so the probe counts octets of what stands before the NUL."""
    at = F.instr(F.substring(text, 1, BINARY_PROBE), "\0")
    return (at > 0) & (F.octet_length(F.substring(text, F.lit(1), at)) <= BINARY_PROBE)


def line_array(text: Column, end: str = "\n") -> Column:
    """The lines of a text, without what ends them (a pattern). Linear in the text: it is split once and the empty last part sliced off."""
    parts = F.split(text, end)
    return F.when(text.endswith("\n") | (text == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def chomped(line: Column) -> Column:
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.char_length(line) - 1)).otherwise(line)


def lines(files: DataFrame, keys: list[str], text: str = "text", where: Column | None = None, keep_cr: bool = False) -> DataFrame:
    """keys, line (1-based), text: the lines of each file that isn't binary and, with where, of those files alone."""
    kept = ~text_is_binary(F.col(text))
    if where is not None:
        kept = kept & where
    # Only the keys stand beside the generator: whatever else of the file a later step read would be copied to every line.
    out = files.where(kept).select(*keys, F.posexplode(line_array(F.col(text))).alias("__i", "__text"))
    value = F.col("__text") if keep_cr else chomped(F.col("__text"))
    return out.select(*keys, (F.col("__i") + 1).cast("long").alias("line"), value.alias("text"))


def line_profile(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Of each file with lines: lines, bytes in lines, longest line, in its own row and without a shuffle."""
    kept = files.where(~text_is_binary(F.col(text))).where(F.col(text) != "")
    sizes = kept.select(*keys, F.transform(line_array(F.col(text)), lambda x: F.octet_length(x).cast("long")).alias("__sizes"))
    total = F.aggregate("__sizes", F.lit(0).cast("long"), lambda a, n: a + n)
    return sizes.select(*keys, F.size("__sizes").cast("long").alias("line_count"), total.alias("line_bytes"), F.array_max("__sizes").alias("longest_line"))


def size_tiers(files: DataFrame, text: str = "text") -> DataFrame:
    """Files by the tier that a loader picks for their size."""
    n = F.octet_length(text)
    tier = F.when(n < 16 * 1024, "tiny").when(n <= 256 * 1024, "heap").otherwise("mapped")
    return files.groupBy(tier.alias("tier")).agg(F.count("*").alias("n_files"), F.sum(n.cast("long")).alias("total_bytes"))
