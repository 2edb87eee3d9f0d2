"""Settings from a file of ``KEY=value`` lines."""

from __future__ import annotations

import os


def read_env(path: str, into: dict | None = None) -> dict[str, str]:
    """Keys and values of a settings file on the driver; blank lines, comments and lines without ``=`` go.

    The first ``=`` of a line parts it.  Keys that ``into`` (``os.environ``, say) already
    has keep what they have there.
    """
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                if line and not line.startswith("#") and "=" in line:
                    key, value = line.split("=", 1)
                    found[key.strip()] = value.strip()
    if into is not None:
        for k, v in found.items():
            into.setdefault(k, v)
    return found
