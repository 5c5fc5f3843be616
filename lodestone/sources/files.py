"""Sources besides tables: files that are fetched once, lists in JSON, settings from the environment and dotenv files."""

from __future__ import annotations

import json
import os
import shutil
import urllib.request
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def fetched(url: str, path: str, fetch: Callable[[str, str], object] | None = None) -> str:
    """The path of a file, fetched unless it is there and not empty; a broken fetch leaves no file behind."""
    if os.path.exists(path) and os.path.getsize(path) > 0:
        return path
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part"
    try:
        (fetch or _fetch)(url, part)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path


def _fetch(url: str, path: str) -> None:
    with urllib.request.urlopen(url) as source, open(path, "wb") as to:
        shutil.copyfileobj(source, to)


def string_list(spark: SparkSession, text: str, column: str = "query") -> DataFrame:
    """n and column of a JSON array of strings; anything else is an error."""
    values = json.loads(text)
    if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
        raise ValueError("the file must be a JSON array of strings")
    return spark.createDataFrame(list(enumerate(values)), f"n long, {column} string")


def parse_dotenv(text: str) -> dict[str, str]:
    """KEY=value lines; quotes around a value go, comments and lines without a key are left out."""
    out = {}
    for line in text.splitlines():
        key, sep, value = line.strip().removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if not sep or not key or key.startswith("#"):
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key] = value
    return out


def settings(paths: list[str], environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """The environment, then the dotenv files in order; the first that has a key wins, missing files are passed over."""
    out = dict(os.environ if environment is None else environment)
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for key, value in parse_dotenv(f.read()).items():
                    out.setdefault(key, value)
    return out


def first_of(values: Mapping[str, str], *names: str, default: str | None = None) -> str | None:
    """The first of several names that has a value that isn't empty."""
    return next((values[n] for n in names if values.get(n)), default)
