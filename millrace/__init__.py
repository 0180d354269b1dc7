"""A PySpark engine for curating text corpora and scoring ranking models over them."""
