"""Training-data operators: deduplication, extraction, scanning, scoring, packing and search on Spark.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
