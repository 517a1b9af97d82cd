"""tokengrove: curate, account for and render corpora of text files with Spark.

Every operator takes and returns DataFrames. A corpus is a table of files keyed
by ``(repo, rel_path)``; see :mod:`tokengrove.sources.tables`.
"""

import sys

from pyspark import cloudpickle

from tokengrove.session import build_session

# The few Python functions that run in tasks travel with the job, so executors need
# this package neither installed nor on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
