"""weftline: a PySpark-native analytics engine for code graphs, change feeds, logs and documents.

Operators are plain functions ``DataFrame -> DataFrame``.  Nothing here collects data that grows with the
input; iterative operators only bring counters to the driver.
"""

__version__ = "0.1.0"
