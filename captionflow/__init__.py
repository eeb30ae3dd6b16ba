"""captionflow: caption-corpus analytics on Spark DataFrames."""


def _ship_by_value() -> None:
    # Python functions handed to Spark (the two ordered folds) are pickled with
    # their code, so executors need no install of this package.
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()
