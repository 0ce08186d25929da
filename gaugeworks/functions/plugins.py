"""Scorers and classes that are named by a path or a module, checked when they are loaded."""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
from pathlib import Path
from types import ModuleType

from pyspark.sql import SparkSession


def load_module(path: str, needed: list[str], sha256: str | None = None, spark: SparkSession | None = None) -> ModuleType:
    """The module in a file, which must have the needed names and, if given, the digest; with a session, executors get it too."""
    text = Path(path).read_bytes()
    if sha256 is not None and hashlib.sha256(text).hexdigest() != sha256:
        raise ValueError(f"{path} isn't the frozen file")
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if missing := [n for n in needed if not hasattr(module, n)]:
        raise AttributeError(f"{path} lacks {', '.join(missing)}")
    if spark is not None:
        spark.sparkContext.addPyFile(path)
    return module


def plug_in(name: str, methods: list[str], *args: object, **kwargs: object) -> object:
    """An instance of "module:Class", which must have the methods."""
    module, _, kind = name.partition(":")
    made = getattr(importlib.import_module(module), kind)
    if missing := [m for m in methods if not callable(getattr(made, m, None))]:
        raise TypeError(f"{name} lacks {', '.join(missing)}")
    return made(*args, **kwargs)
