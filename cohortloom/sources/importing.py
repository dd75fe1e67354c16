"""Importing delimited files into a dataset, from Python and from the command line."""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from cohortloom.sources.csv import read_csv, read_csv_set_apart
from cohortloom.sources.dataset import Dataset
from cohortloom.sources.schema import load_schema


def import_with_schema(spark: SparkSession, dataset: str, schema_file: str, files: Mapping[str, str], overwrite: bool = False, include: Mapping[str, Sequence[str]] | None = None, exclude: Mapping[str, Sequence[str]] | None = None, timestamp: datetime | None = None, set_apart: bool = False) -> Dataset:
    """Reads each file by its table's schema into the dataset. Without overwrite, tables that exist get the rows appended as a new snapshot.

    With set_apart, lines that can't be read go with their reason into a table `<name>_errors` instead of failing the import.
    """
    schema = load_schema(schema_file)
    for names in (files, include or {}, exclude or {}):
        unknown = set(names) - set(schema)
        if unknown:
            raise ValueError(f"the schema has no tables {sorted(unknown)}")
    at = timestamp or datetime.now(timezone.utc)
    try:
        out = Dataset(spark, dataset, "w" if overwrite else "r+")
    except FileNotFoundError:
        out = Dataset(spark, dataset, "w")
    for name, path in files.items():
        only = {"include": (include or {}).get(name), "exclude": (exclude or {}).get(name), "timestamp": at}
        if set_apart:
            df, errors = read_csv_set_apart(spark, path, schema[name], name, **only)
            out.create(f"{name}_errors", errors, "append")
        else:
            df = read_csv(spark, path, schema[name], **only)
        out.create(name, df, "append")
    return out


def _pairs(text: str | None) -> dict[str, str]:
    """'users:a.csv, assessments:b.csv' as a dictionary."""
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in (text or "").split(",") if x.strip())}


def _lists(text: str | None) -> dict[str, list[str]]:
    """'users:(id,bmi), assessments:(id)' as a dictionary of lists."""
    import re

    return {m[1]: [x.strip() for x in m[2].split(",")] for m in re.finditer(r"(\w+)\s*:\s*\(([^)]*)\)", text or "")}


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cohortloom")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("import", help="import delimited files into a dataset")
    i.add_argument("-s", "--schema", required=True)
    i.add_argument("-i", "--import", dest="files", required=True, help="table:file, table:file, ...")
    i.add_argument("-ds", "--dataset", required=True, help="folder of the dataset")
    i.add_argument("-w", "--overwrite", action="store_true")
    i.add_argument("-ts", "--timestamp", help="time of the snapshot, ISO 8601")
    i.add_argument("-n", "--include", help="table:(field, field), ...")
    i.add_argument("-x", "--exclude", help="table:(field, field), ...")
    i.add_argument("-a", "--set-apart", action="store_true", help="put unreadable lines into a table of errors")
    a = p.parse_args(argv)
    at = datetime.fromisoformat(a.timestamp) if a.timestamp else None
    if at is not None and at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    spark = SparkSession.builder.appName("cohortloom import").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    import_with_schema(spark, a.dataset, a.schema, _pairs(a.files), a.overwrite, _lists(a.include), _lists(a.exclude), at, a.set_apart)


if __name__ == "__main__":
    main()
