"""framewise: distributed analytics over hand-coded, time-stamped observation frames.

A *fact* is one row per (subject, frame, item): ``site, subject, age, wearer, frame,
reason, category, item, ts``.  ``reason`` says why a frame was excluded; a usable row
has no reason and a category.  Everything here takes and returns lazy DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
