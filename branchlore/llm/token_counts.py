"""Token counts of documents from flat token files without an index.

A flat file is nothing but token numbers, little-endian and of one width, with an end number
after each document.  Files are read in blocks; a vectorised search gives each block's end
numbers; a prefix scan over the blocks of a file carries on the count of documents and the place
of the last end, which stitches documents that cross blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from branchlore.llm.common import whole
from branchlore.staging import stage, staging_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256  # free in that vocabulary
WIDTH = 2  # bytes of a token number
BLOCK_TOKENS = 1 << 19
FILE_TOKENS = 1 << 22  # a flat file with as many gets no further document; readers load a file at once
# Fixed value: how the public tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: base64 of a token's bytes and its number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoding(vocabulary: str, ranks: dict[bytes, int], pattern: str = PATTERN):
    """The tokenizer of a vocabulary, made once per worker."""
    import tiktoken

    if vocabulary not in _encodings:
        _encodings[vocabulary] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def file_name():
    """The stored file a row comes from; with the row's place in it a key, however scans split the file."""
    return F.hex(F.xxhash64("_metadata.file_path"))


def write_flat_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, width: int = WIDTH) -> None:
    """Tokenizes the texts of a stored table into flat files, one folder ``run=FILE-FIRST`` per run of rows.

    A run holds the documents of a stored file from row FIRST on without a gap, in the table's
    order, and ends with the document that fills ``FILE_TOKENS``; a missing text is an empty document.  The end number is the line end of Spark's text
    sink, so files are written and committed by Spark.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    kind, most = f"<u{width}", FILE_TOKENS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, held = None, "", 0
        for batch in batches:
            # few rows at a time: what a task holds does not depend on the batch size
            for at in range(0, batch.num_rows, 256):
                part, runs, tokens = batch.slice(at, 256), [], []
                for file, row, text in zip(*(part.column(c).to_pylist() for c in ("file", "row", "text")), strict=True):
                    if last != (file, row - 1) or held >= most:
                        run, held = f"{file}-{row}", 0
                    last = file, row
                    numbers = encoding(vocabulary, ranks.value).encode_ordinary(text.decode())
                    held += len(numbers) + 1
                    runs.append(run)
                    tokens.append(np.array(numbers, dtype=kind).tobytes())
                made = [pa.array(runs, pa.string()), part.column("row"), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["run", "row", "tokens"])

    rows = docs.select(file_name().alias("file"), F.col("_metadata.row_index").alias("row"), whole("text").cast("binary").alias("text"))
    tokens = rows.mapInArrow(encode, "run string, row long, tokens binary").sortWithinPartitions("run", "row")
    line_end = end.to_bytes(width, "little").decode("latin-1")
    flat = tokens.select("run", F.col("tokens").cast("string").alias("value"))
    flat.write.partitionBy("run").option("encoding", "ISO-8859-1").option("lineSep", line_end).text(path)


def read_blocks(spark: SparkSession, path: str, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The flat files under a folder in blocks: ``file``, ``block``, ``n_blocks``, ``data``."""
    size = block_tokens * width
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    n_blocks = F.ceil(F.col("length") / size).cast("int")
    cuts = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.struct(i.alias("block"), F.substring(F.col("content"), i * size + 1, F.lit(size)).alias("data"))
    )
    files = files.where("length > 0").select(F.col("path").alias("file"), n_blocks.alias("n_blocks"), "content")
    return files.select("file", "n_blocks", F.explode(cuts).alias("cut")).select("file", "n_blocks", "cut.block", "cut.data")


def find_ends(blocks: DataFrame, end: int = END, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per block the places of its end numbers in the file (``ends``); a file that stops without one ends there."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block, n_blocks, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                tokens = np.frombuffer(data.as_buffer(), dtype=f"<u{width}")
                ends = np.flatnonzero(tokens == end) + block * block_tokens
                if block == n_blocks - 1 and tokens[-1] != end:
                    ends = np.append(ends, block * block_tokens + len(tokens))
                found.append(ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["file", "block", "ends"]
            )

    return blocks.select("file", "block", "n_blocks", "data").mapInArrow(search, "file string, block int, ends array<long>")


def documents_of(ends: DataFrame) -> DataFrame:
    """Per document ``file``, ``nth`` (from 0), ``start`` (token) and ``n_tokens``, by a scan over a file's blocks."""
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = ends.select(
        "file",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(ahead), F.lit(0)).alias("docs_before"),
        (F.coalesce(F.max(F.array_max("ends")).over(ahead), F.lit(-1)) + 1).alias("last_start"),
    )
    each = scanned.select("file", "ends", "docs_before", "last_start", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("last_start")).otherwise(F.get("ends", F.col("i") - 1) + 1)
    return each.select(
        "file", (F.col("docs_before") + F.col("i")).alias("nth"), start.alias("start"), (F.col("end") - start).alias("n_tokens")
    )


def flat_file_counts(
    spark: SparkSession, path: str, end: int = END, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """The documents of all flat files under a folder and their token counts.

    An empty document counts 0; an empty file has none; a folder without files fails.
    """
    return documents_of(find_ends(read_blocks(spark, path, width, block_tokens), end, width, block_tokens))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokenizes a stored table into flat files and counts from these: ``doc_id``, ``n_tokens``, ``start`` in its file.

    Missing and empty texts have 0 tokens; repeated rows stay; an empty table gives none; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    path = staging_path(spark, "flat-tokens")
    numbered = docs.select("doc_id", file_name().alias("of"), F.col("_metadata.row_index").alias("row"))
    n_docs = docs.count()
    if not n_docs:
        return numbered.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("start"))
    write_flat_files(docs, path, vocabulary)
    run = lambda i: F.regexp_extract("file", "run=([^/-]+)-([0-9]+)/", i)
    counts = flat_file_counts(spark, path).select(run(1).alias("of"), (run(2).cast("long") + F.col("nth")).alias("row"), "n_tokens", "start")
    counts = stage(counts, "token-counts")
    found, places = counts.agg(F.count(F.lit(1)), F.count_distinct("of", "row")).first()
    if not n_docs == found == places:
        raise ValueError(f"{n_docs} documents, but {found} in the flat files at {places} places")
    joined = numbered.join(counts, ["of", "row"], "left")
    lost = F.raise_error(F.concat(F.lit("no token count for row "), F.col("row").cast("string"), F.lit(" of file "), F.col("of")))
    return joined.select("doc_id", F.coalesce("n_tokens", lost.cast("long")).alias("n_tokens"), "start")
