"""sentimart: daily text sentiment on Spark.

Reads nested JSON posts, cleans them, scores each text against a sentiment
lexicon in Arrow batches, classifies the scores by thresholds and
reports per topic and day how many posts fell in each class and how the
scores were distributed.

Layout:
    sources/     readers (JSON posts, folders, fixture view) and writers
    functions/   column-level helpers (tokens, dates, lexicon tables)
    operators/   clean, score, classify, match, daily aggregates
    plans/       composed jobs (per-movie daily outputs, folders, chunks)
    streaming/   the same daily job over a growing folder
"""

import sys

from pyspark import cloudpickle

from sentimart.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]

# Functions that run in tasks travel with the task, so executors need no copy
# of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
