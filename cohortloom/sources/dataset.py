"""Datasets: named folders of Parquet tables, and the sessions that hold them open."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class Dataset:
    """A folder of Parquet tables, used like a dictionary of DataFrames. Column metadata travels with the files."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "r"):
        if mode not in ("r", "r+", "w"):
            raise ValueError("mode must be r, r+ or w")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        exists = self._fs.exists(self._path())
        if mode != "w" and not exists:
            raise FileNotFoundError(path)
        if mode == "w":
            if exists:
                self._fs.delete(self._path(), True)
            self._fs.mkdirs(self._path())

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.parquet" if name else self.path)

    def _writable(self) -> None:
        if self.mode == "r":
            raise PermissionError("the dataset was opened to be read only")

    def keys(self) -> list[str]:
        found = [x.getPath().getName() for x in self._fs.listStatus(self._path())]
        return sorted(n.removesuffix(".parquet") for n in found if n.endswith(".parquet"))

    def __contains__(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self:
            raise ValueError(f"there is no table {name}")
        return self.spark.read.parquet(self._path(name).toString())

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        return ((n, self[n]) for n in self.keys())

    def create(self, name: str, df: DataFrame, mode: str = "error") -> DataFrame:
        """Writes a table. mode: error, overwrite or append, as for a writer."""
        self._writable()
        df.write.mode(mode).parquet(self._path(name).toString())
        return self[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self.create(name, df)

    def require(self, name: str, like: DataFrame) -> DataFrame:
        """The table, made empty with the columns of another one if it isn't there."""
        return self[name] if name in self else self.create(name, like.limit(0))

    def create_like(self, name: str, like: DataFrame) -> DataFrame:
        """A new, empty table with the columns and kinds of another one. Raises where there is one of that name."""
        return self.create(name, like.limit(0))

    def drop(self, name: str) -> None:
        self._writable()
        if name not in self:
            raise ValueError(f"there is no table {name}")
        self._fs.delete(self._path(name), True)

    def rename(self, name: str, to: str) -> None:
        self._writable()
        if to in self:
            raise ValueError(f"there is a table {to} already")
        self._fs.rename(self._path(name), self._path(to))

    def copy(self, name: str, other: Dataset, to: str | None = None) -> DataFrame:
        return other.create(to or name, self[name])

    def move(self, name: str, other: Dataset, to: str | None = None) -> DataFrame:
        self._writable()
        out = self.copy(name, other, to)
        self.drop(name)
        return out


class Session:
    """Open datasets by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._open: dict[str, Dataset] = {}

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self._open.clear()

    def open_dataset(self, path: str, mode: str, name: str) -> Dataset:
        if name in self._open:
            raise ValueError(f"a dataset {name} is open already")
        self._open[name] = Dataset(self.spark, path, mode)
        return self._open[name]

    def get_dataset(self, name: str) -> Dataset:
        return self._open[name]

    def list_datasets(self) -> list[str]:
        return list(self._open)

    def close_dataset(self, name: str) -> None:
        self._open.pop(name, None)
