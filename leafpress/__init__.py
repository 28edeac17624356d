"""leafpress: a Spark-native document digitization engine.

Page images come in as binary records, are checked and cleaned by vectorized
kernels, recognised into nested fragments, assembled into text with native
array functions and written as Word documents; an append-only ledger keeps each
scan's status and is queried as an ordinary DataFrame or SQL view.
"""

__version__ = "0.1.0"
