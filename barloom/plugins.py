"""Extension points: strategies, document loaders and metrics supplied by users."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.operators import signals
from barloom.operators.series import BY_SYMBOL, INDEX, Layout

Loader = Callable[[SparkSession, dict], DataFrame]
LOADERS: dict[str, Loader] = {}


def register_strategy(
    name: str,
    generate: Callable[..., DataFrame],
    defaults: dict,
    validate: Callable[[dict], None] | None = None,
) -> None:
    """Add a strategy built from column expressions.

    ``generate(df, layout=..., **params)`` takes indexed bars and adds ``signal``.
    """

    def checked(df: DataFrame, layout: Layout = BY_SYMBOL, **params) -> DataFrame:
        if validate is not None:
            validate(params)
        return generate(df, layout=layout, **params)

    signals.GENERATORS[name] = checked
    signals.DEFAULTS[name] = dict(defaults)


def register_pandas_strategy(
    name: str, generate: Callable[[pd.DataFrame, dict], "pd.Series"], defaults: dict
) -> None:
    """Add a strategy written over one symbol's bars in time order.

    A group is one series of bars, which the calendar bounds; do not feed raw ticks to it.
    """

    def run(df: DataFrame, layout: Layout = BY_SYMBOL, **params) -> DataFrame:
        def per_series(bars: pd.DataFrame) -> pd.DataFrame:
            bars = bars.sort_values(INDEX).reset_index(drop=True)
            return bars.assign(signal=pd.Series(generate(bars, params)).astype("int32").to_numpy())

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        return df.groupBy(*layout.keys).applyInPandas(per_series, f"{schema}, signal int")

    register_strategy(name, run, defaults)


def register_loader(name: str, load: Loader) -> None:
    """Add a document source: ``(spark, options)`` to rows of the document shape."""
    LOADERS[name] = load


@dataclass(frozen=True)
class Share(InputPartition):
    """What one task of a loader reads: anything that can be pickled."""

    value: object


def register_source(name: str, schema: str, split: Callable[[dict], Iterable], read: Callable[[object, dict], Iterator]) -> None:
    """Add a document source written in Python, as a data source of Spark.

    ``split(options)`` names the shares that tasks read in parallel, and ``read(share, options)`` yields
    Arrow batches or tuples of ``schema``. Both run outside the session: they get plain options and
    must not use Spark. A lost task reads its share again.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = dict(options)

        def partitions(self):
            return [Share(v) for v in split(self.options)] or [Share(None)]

        def read(self, partition):
            return iter(()) if partition.value is None else read(partition.value, self.options)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    def load(spark: SparkSession, options: dict) -> DataFrame:
        spark.dataSource.register(Source)
        return spark.read.format(name).options(**options).load()

    register_loader(name, load)


def _opened(path: str):
    """(file system, path in it) if Python can open ``path``, else None."""
    import pyarrow as pa
    import pyarrow.fs as fs

    try:
        store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        return (store, inner) if store.get_file_info(inner).type != fs.FileType.NotFound else None
    except (pa.ArrowInvalid, OSError):
        return None


def _parquet_shares(options: dict) -> list[tuple[str, int]]:
    """(file, row group) of a Parquet file, or of all those of a folder but hidden ones."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    store, path = _opened(options["path"])
    files = [path]
    if store.get_file_info(path).type == fs.FileType.Directory:
        inside = store.get_file_info(fs.FileSelector(path, recursive=True))
        names = (f.path for f in inside if f.type == fs.FileType.File)
        files = sorted(f for f in names if not any(p[0] in "._" for p in f[len(path) :].split("/") if p))
    shares = []
    for file in files:
        with store.open_input_file(file) as f:
            shares += [(file, k) for k in range(pq.ParquetFile(f).num_row_groups)]
    return shares


def register_parquet_source(name: str, columns: list[str], schema: str, convert: Callable) -> None:
    """Add a document source over the ``columns`` of Parquet files in ``path``, written in Python:
    ``convert(batch)`` makes an Arrow batch of ``schema`` from one of the files.

    Where Python can open the path, it is a data source whose tasks read a row group each. In a store that
    only Spark reaches, Spark reads the columns and hands the batches to the same function.
    """

    def read(share: tuple[str, int], options: dict) -> Iterator:
        import pyarrow.parquet as pq

        file, group = share
        store, _ = _opened(options["path"])
        with store.open_input_file(file) as f:
            yield from map(convert, pq.ParquetFile(f).iter_batches(row_groups=[group], columns=columns))

    register_source(name, schema, _parquet_shares, read)
    by_python = LOADERS[name]

    def load(spark: SparkSession, options: dict) -> DataFrame:
        if _opened(options["path"]):
            return by_python(spark, options)
        return spark.read.parquet(options["path"]).select(*columns).mapInArrow(lambda batches: map(convert, batches), schema)

    register_loader(name, load)


def load_all(spark: SparkSession, options: dict[str, dict]) -> DataFrame:
    """Union of the named sources, each with its own options."""
    from barloom.sources.documents import union_sources

    return union_sources(*[LOADERS[n](spark, o) for n, o in options.items()])


def pandas_metric(fn: Callable[[pd.Series], float]):
    """A user metric over a return column, usable in ``groupBy().agg()``."""

    @F.pandas_udf("double")
    def metric(values: pd.Series) -> float:
        return float(fn(values.dropna()))

    return metric
