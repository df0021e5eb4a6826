"""Reports assembled from operators."""
