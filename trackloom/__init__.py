"""Analytics of tracked objects over time, as DataFrame functions for Spark.

``sources`` read and write tables, ``operators`` transform them, ``plans`` put
operators together into the questions that users ask, ``streaming`` runs the
row-local steps on unbounded input, and ``functions`` holds column expressions.
"""
