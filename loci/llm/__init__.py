"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage. Functions that run in
Python workers travel by value, so a cluster needs no copy of this package on
its machines.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
