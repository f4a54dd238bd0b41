"""Operators for training-data pipelines. Importing the package registers their queries."""

from . import (decontaminate, exact_dedup, histogram_sort, lm_scoring, near_dedup, packing, periodic_runs, quality_rules,
               spelling_variants, substring_dedup, suffix_dedup, url_filter, warc)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "decontaminate", "exact_dedup", "histogram_sort", "lm_scoring", "near_dedup", "packing",
           "periodic_runs", "quality_rules", "spelling_variants", "substring_dedup", "suffix_dedup", "url_filter", "warc"]
