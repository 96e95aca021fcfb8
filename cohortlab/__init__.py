"""cohortlab: cohort building and association statistics as Spark DataFrame plans.

Sub-packages
------------
sources    reading/writing tables, snapshots, versions, TSV bundles (A*)
functions  column-expression helpers: recodes, text rules, distribution tails, formatting (B*, T*)
operators  relational, aggregate, reshape and statistical operators (C*, D*, E*, R*, K*)
plans      composite cohort plans (J*), report frames (X*) and the driver-table query catalogue
streaming  (empty by design: the reference is batch-only)
"""

__version__ = "0.1.0"
