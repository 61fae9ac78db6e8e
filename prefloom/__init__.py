"""Preference-data preparation on PySpark.

The main entry points, all `DataFrame -> DataFrame` unless noted:
"""

from .functions.ratings import mean_rating, parse_rating  # Column -> Column
from .functions.text import image_prompt, py_strip  # Column -> Column
from .functions.tokens import ArrowTokenizer, CodepointTokenizer
from .operators.annotate import annotation_prompts, parse_annotations, parse_quarantine, rating_domain_check
from .operators.batches import pad_batches
from .operators.chatml import chatml_render, drop_leading_nonuser, encode_turns, make_conversations, turn_answers, turn_prompts
from .operators.encode import EncodeConfig, encode_pairs, encode_prompt_rows, length_report, truncate_pairs
from .operators.pairs import build_pairs, build_pairs_join, completion_scores, pair_outcomes, unnest_completions
from .operators.prompts import format_prompts, full_texts
from .operators.sampling import sample_by_domain, sample_models
from .operators.split import exact_split_rule, split_by_prompt, split_exact
from .sources.jsonl import read_jsonl, write_jsonl
from .sources.preferences import read_preference_table, write_table

__all__ = [n for n in dir() if not n.startswith("_")]
