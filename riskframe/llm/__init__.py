"""Operators for building training corpora: dedup, packing, extraction, mixing, quality, privacy, toxicity, chat, archives.

Nothing outside this package imports it.  Task functions travel with the job (pickled by value), so executors need no
copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
