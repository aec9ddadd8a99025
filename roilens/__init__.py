"""roilens: AI-usage ROI and governance analytics as Spark DataFrame operators."""

try:  # ship this package's functions to Python workers by value, so the few
    # Arrow UDF helpers work even where the package is not installed on executors
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
