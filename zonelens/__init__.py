"""zonelens: DNS measurement and domain-ranking analytics on Spark.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame
operators), ``sources`` (readers and sinks), ``plans`` (composite jobs,
fixture views and the registered queries) and ``streaming`` (daily reports
as Structured Streaming queries).
"""

__version__ = "0.1.0"
