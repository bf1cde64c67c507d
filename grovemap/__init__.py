"""grovemap: code-graph analytics and training-data preparation as Spark DataFrame programs."""
