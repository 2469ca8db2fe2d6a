"""raywalk: anomalous subsequences of long series, by walks across a fan of rays, on Spark."""

from raywalk.params import Params

__all__ = ["Params"]
