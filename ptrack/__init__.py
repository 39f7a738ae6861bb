"""Event-camera particle tracking on Spark DataFrames."""
from ptrack.params import Params

__all__ = ["Params"]
