"""A Spark-first engine for ragged multimodal atlases."""
