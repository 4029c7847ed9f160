"""fraudframe: transaction profiling, look-back features, model fitting and
streaming scoring expressed as Spark DataFrame / SQL / ML operators."""

import sys

__version__ = "0.1.0"

# Python functions shipped to executors (pandas UDFs, state functions) are
# pickled by value, so workers need no installed copy of this package.  A
# cluster deployment may still ship it with --py-files.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
