"""Set-at-a-time jobs over the tables of a batch-pipeline fleet, written for Spark.

Every public operator takes DataFrames and returns DataFrames. Clock values (``now``,
``tick_end``, ``as_of``) are always arguments, never read from the wall clock, so a job
that is run again over the same input gives the same answer.
"""

__version__ = "0.1.0"
