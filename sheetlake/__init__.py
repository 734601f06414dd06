"""Evidence-backed extraction of drawing batches as Spark DataFrames."""
