"""Text from images as a dataflow, on Spark."""
