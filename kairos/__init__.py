"""kairos: market-signal analytics expressed as Spark DataFrame plans.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small
family of them). Nothing is collected to the driver inside an operator.
"""

__all__ = ["session"]
