"""cardlens: card-spend, discount-limit, campaign and query-log analytics on Spark.

Every report runs for all accounts at once as a DataFrame job; single-account
questions are the same job with an account filter.
"""

from cardlens.params import Params

__all__ = ["Params"]
