"""Analytics over ordered, multi-version key-value data, on Spark.

A table of mutations (``k, seq, op, v, exp``) is the one source of truth; every
view of it is a DataFrame.  ``sources`` builds and stores logs, ``operators``
derive views, ``functions`` are column expressions, ``streaming`` ingests,
``plans`` holds the registered queries, and ``api`` a client with put, get,
range and the rest.
"""

from strandline.api import Client

__all__ = ["Client"]
