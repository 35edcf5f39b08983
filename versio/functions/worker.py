"""State of a Python worker process.

The package's functions travel to the workers by value (see ``versio/__init__``),
so a module's globals are those of one task there. What should outlive a task,
such as a parsed model or open descriptors, is kept in the process itself.
"""

from __future__ import annotations

import sys
import types


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the process, one for each ``name``."""
    return sys.modules.setdefault(f"versio worker state {name}", types.ModuleType(name)).__dict__
