"""Schema files: JSON that declares the fields of the tables of an import."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import IO

from cohortloom.sources.csv import Field

# The versions of the format.
VERSIONS = ("1.0.0", "1.1.0")


def load_schema(source: str | Path | IO[str] | Mapping) -> dict[str, dict[str, Field]]:
    """table name -> field name -> Field. Raises where the version is unknown or a field is declared wrongly."""
    data = source if isinstance(source, Mapping) else json.loads(Path(source).read_text() if isinstance(source, (str, Path)) else source.read())
    # The part that holds the version is named after the program that wrote the file; any name will do.
    versions = [x.get("version") for k, x in data.items() if k != "schema" and isinstance(x, Mapping)]
    if not any(v in VERSIONS for v in versions):
        raise ValueError("the schema has no known version")
    if not isinstance(data.get("schema"), Mapping):
        raise ValueError("the schema has no 'schema' part")
    return {name: {f: _field(f, x) for f, x in part["fields"].items()} for name, part in data["schema"].items()}


def _field(name: str, x: Mapping) -> Field:
    def needed(part: Mapping, key: str):
        if key not in part:
            raise ValueError(f"field {name}: {key!r} is missing")
        return part[key]

    kind = needed(x, "field_type")
    if kind == "categorical":
        c = needed(x, "categorical")
        # The presence of out_of_range counts, whatever it holds; a text names the column.
        other = (c["out_of_range"] if isinstance(c["out_of_range"], str) and c["out_of_range"] else "freetext") if "out_of_range" in c else None
        return Field(kind, needed(c, "value_type"), labels=needed(c, "strings_to_values"), out_of_range=other)
    if kind == "fixed_string":
        return Field(kind, strlen=int(needed(x, "length")))
    if kind == "numeric":
        return Field(kind, needed(x, "value_type"), validation_mode=x.get("validation_mode", "allow_empty"), invalid_value=x.get("invalid_value", 0), flag=x.get("create_flag_field", True), flag_suffix=x.get("flag_field_name", "_valid"))
    if kind in ("datetime", "date"):
        return Field(kind, day=bool(x.get("create_day_field", False)), flag=bool(x.get("create_flag_field", False) or x.get("optional", False)))
    if kind == "string":
        return Field(kind)
    raise ValueError(f"field {name}: unknown type {kind!r}")
