"""Operators for preparing training data. Nothing outside this folder imports them."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Workers may run without this package on their path, so its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
