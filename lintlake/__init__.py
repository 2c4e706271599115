"""Code-quality analytics over tables of source files, on Spark."""
