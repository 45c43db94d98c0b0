"""All queries of this package, with their SQL where SQL can say it."""

from papertally.llm import (  # noqa: F401
    binary, collocations, fingerprints, infilling, jaccard, katz, media, mixing, packing, secrets, sharding, toxicity, urls,
)
from papertally.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
