"""A PySpark engine that turns document images and recognised tokens into one structured row per document."""
