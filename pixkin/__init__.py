"""A near-duplicate engine for images on Spark, and operators for training-data pipelines."""
