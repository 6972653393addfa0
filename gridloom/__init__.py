"""Gridloom: lazy frames and n-dimensional arrays as Spark plans."""

from gridloom.operators.frame import Frame
from gridloom.operators.ndarray import NDArray, arange, ones, zeros
from gridloom.sources.files import read_csv

__all__ = ["Frame", "NDArray", "arange", "ones", "read_csv", "zeros"]
