"""versio: document extraction, token-limited chunking, translation dispatch
and usage accounting as Spark DataFrame operators."""

import sys as _sys

# Ship this package's functions and classes inside the pickled UDFs, so Python
# workers need no install of it (executors of any cluster, any working dir).
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without by-value support
    pass

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
