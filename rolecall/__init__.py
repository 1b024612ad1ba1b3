"""Role attribution over crawled open-source snapshots, as Spark jobs."""

from .config import Config
from .schemas import Inputs

__all__ = ["Config", "Inputs"]
