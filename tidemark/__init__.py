"""Customer-behaviour analytics over event logs, written as Spark DataFrame jobs."""

from .params import Params
from .sources.streams import Streams

__all__ = ["Params", "Streams"]
