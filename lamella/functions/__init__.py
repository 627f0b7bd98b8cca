"""Scalar column functions and small dense numeric kernels."""
