"""Helpers of more than one operator."""

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logmill.sources.shared import remove_folder, shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Cuts the lineage: what comes after survives lost executors without redoing ``df``.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def free(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` has returned, once nothing reads them any more."""
    for table in tables:
        remove_folder(table.sparkSession, table._stored_at)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows stored with ``number``, one of its own for each, and ``row``, the row itself.

    Written, so that numbers stay what they are wherever the rows are read again.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return stored(docs.select(F.monotonically_increasing_id().alias("number"), whole.alias("row")), "numbered")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_fold(key: Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; NULL keys give NULL."""
    return (F.crc32(key.cast("string").cast("binary")) % folds).cast("int")


# Text handled at once by a Python worker; a longer text is handled alone.
PIECE_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some MB of ``column``, each of at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def map_batches(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: StructType | str,
    column: str = "text",
) -> DataFrame:
    """``function`` over Arrow batches, in slices of some MB of ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                yield function(piece)

    return df.mapInArrow(run, schema)


def remember(memory: dict, fresh: dict, asked: int, absent: int, limit: int) -> dict:
    """``memory`` with ``fresh`` entries while it has room.

    A full memory stays as it is, since what came first is mostly what comes often; it
    starts anew when it no longer fits the texts, that is when half of what is asked for
    is absent.
    """
    if len(memory) >= limit:
        return fresh if 2 * absent > asked else memory
    memory.update(fresh)
    return memory
