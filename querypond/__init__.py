"""querypond: search, ranking, extraction and evaluation analytics as batched PySpark DataFrame pipelines."""
