"""Behavioural features, time-to-event analytics and leakage audits as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from ebbtide.window import ObservationWindow

__all__ = ["ObservationWindow"]
__version__ = "0.1.0"

# functions sent to tasks travel with the task, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
