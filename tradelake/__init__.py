"""tradelake: Spark-native trade-archive analytics.

Archive files -> typed raw layer -> issuers, instruments, calendar, daily facts (last file wins)
-> daily metrics, drawdowns, summary, anomalies -> analyst queries and data-quality checks.
"""

__version__ = "0.1.0"
