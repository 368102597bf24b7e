"""lettermill: a Spark-native engine for mailbox corpora.

Everything relational is a DataFrame plan; Python runs only in Arrow batches.
"""

__version__ = "0.1.0"
