"""Options of the card provider: from the session's configuration, then the environment, then a file of defaults."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

#: The levels of effort that a provider knows.
EFFORTS = ("low", "medium", "high", "xhigh", "max")
DEFAULTS = {"model": "default", "effort": "medium", "api_key": ""}


class ProviderOptionError(ValueError):
    """An option has a value that no provider takes."""


class MissingKeyError(ProviderOptionError):
    """A remote provider was asked for without credentials."""


def defaults_file(path: Path) -> dict[str, str]:
    """name=value lines as a mapping; blank lines and comments are skipped, quotes around a value go."""
    found = {}
    for line in path.read_text(encoding="utf-8").splitlines() if path.is_file() else ():
        name, sign, value = line.partition("=")
        if sign and not name.lstrip().startswith("#"):
            found[name.strip()] = value.strip().strip("\"'")
    return found


def provider_options(spark: SparkSession | None = None, *, environ: Mapping[str, str] | None = None, file: Path | None = None) -> dict[str, str]:
    """model, effort and api_key. `spark.lamina.provider.<name>` comes first, then LAMINA_<NAME> in the environment,
    then the same name in the file (./.env), then the default."""
    environ = os.environ if environ is None else environ
    written = defaults_file(file or Path(".env"))
    spark = spark or SparkSession.getActiveSession()
    out = {}
    for name, default in DEFAULTS.items():
        key = f"LAMINA_{name.upper()}"
        own = spark.conf.get(f"spark.lamina.provider.{name}", None) if spark else None
        out[name] = own or environ.get(key) or written.get(key) or default
    out["effort"] = out["effort"].lower()
    if out["effort"] not in EFFORTS:
        raise ProviderOptionError(f"effort {out['effort']!r}: choose from {', '.join(EFFORTS)}")
    return out


_clients: dict[tuple, Any] = {}


def _client(connect: Callable[..., Any], key: str) -> Any:
    name = (getattr(connect, "__module__", ""), getattr(connect, "__qualname__", repr(connect)), key)
    if name not in _clients:
        _clients[name] = connect(api_key=key)
    return _clients[name]


def client_factory(connect: Callable[..., Any], options: Mapping[str, str] | None = None) -> Callable[[], Any]:
    """A factory to ship to the executors: there it calls `connect(api_key=...)` once for each Python worker and key,
    however many tasks the worker runs. Without a key it raises here, before any job starts."""
    key = (options or provider_options())["api_key"]
    if not key:
        raise MissingKeyError("no api_key among the provider's options (spark.lamina.provider.api_key or LAMINA_API_KEY)")

    return functools.partial(_client, connect, key)
