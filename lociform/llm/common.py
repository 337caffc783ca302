"""Shared plumbing of the training-data operators.

* ``append_columns`` runs an Arrow kernel over bounded slices of every batch
  and keeps the other columns. An input column whose name equals (in any case)
  that of a column the operator adds is replaced by the operator's column.
* ``Scratch`` (of the storage module) writes intermediate tables under ``spark.checkpoint.dir``, the
  folder that all executors of a cluster share.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from ..storage import Scratch  # noqa: F401  used by the operators

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lowered(text: str) -> str:
    """text with A-Z in lower case and all else as it is."""
    return text.lower() if text.isascii() else text.translate(UPPER)


def stretches(text: str, cut: re.Pattern, size: int = 4_000_000) -> Iterator[str]:
    """text in parts of ``size`` characters and up to the next match of cut, which begins the next part."""
    at = 0
    while len(text) - at > size and (found := cut.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    if at < len(text):
        yield text[at:]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str):
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of df whose names differ from all names, whatever the case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def slices(batch: pa.RecordBatch, rows: int, nbytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of at most ``rows`` rows and about ``nbytes`` bytes."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(rows, int(n * nbytes / max(1, batch.nbytes))))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def append_columns(
    df: DataFrame,
    inputs: Sequence,
    fields: Sequence[T.StructField],
    kernel: Callable[..., list[pa.Array]],
    rows: int = 512,
    nbytes: int = 4 << 20,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """df with the columns that ``kernel(*input arrays)`` returns; a narrow, shuffle-free map."""
    kept = without(df, [f.name for f in fields]) if keep is None else list(keep)
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    n_kept, names = len(kept), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, nbytes):
                made = kernel(*part.columns[n_kept:])
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *made], names=names)

    columns = [F.col(quoted(c)) for c in kept]
    return map_arrow(df.select(*columns, *(c.alias(f"__in_{i}") for i, c in enumerate(inputs))), run, schema)


def open_uri(uri: str, mode: str):
    """Open a file of the shared folder from an executor, by any scheme that pyarrow knows."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if "w" in mode:
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return where.open_output_stream(path, compression=None)
    return where.open_input_file(path)


def remove_uri(uri: str) -> None:
    """Delete a file of the shared folder; one that is gone is no error."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    try:
        where.delete_file(path)
    except FileNotFoundError:
        pass


def sort_key(df: DataFrame, *names: str) -> list:
    """Columns that order rows and break ties of the first ones."""
    return [F.col(quoted(n)) for n in names if n in df.columns]
