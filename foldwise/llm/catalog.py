"""Importing this module fills the registers with the corpus queries."""

from foldwise.llm import (  # noqa: F401
    bpe, decontamination, embedding_duplicates, hard_negatives, html_text, katz, mixing, near_duplicates, phrases, quality, repeated_passages, secrets, toxicity,
)
from foldwise.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
