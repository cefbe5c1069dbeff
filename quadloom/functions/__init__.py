"""Scalar expressions over typed and generic columns."""
