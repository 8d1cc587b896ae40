"""Operators for preparing training data: counting, deduplication, extraction, packing, mixing, scoring.

Functions that run in Python workers are sent by value, so executors need this
package neither installed nor on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
