"""Spatial deconvolution and method benchmarking as Spark DataFrame jobs."""
