"""mathgrade: DataFrame operators for grading model answers to math problems.

Everything is expressed with Spark DataFrame / SQL primitives so Catalyst can
push filters, prune columns and plan shuffles; Python only runs inside tasks
where a caller-supplied model function has to be called.
"""

__version__ = "0.1.0"
