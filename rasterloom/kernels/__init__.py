"""Array kernels: pure functions of numpy arrays, without Spark."""
