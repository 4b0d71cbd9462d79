"""Array kernels in NumPy; Spark calls them inside Arrow or pandas batches."""
