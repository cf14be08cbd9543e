"""Queries opN_<name> of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op3_neighbours
from .media import op1_media
from .mixing import OP6_SQL, op6_mix
from .packing import op2_packing
from .preference import OP7_SQL, op7_preferences
from .quality import op5_quality
from .simhash import op10_simhash
from .substring_dedup import OP8_SQL, op8_substrings
from .suffix_dedup import OP4_SQL, op4_suffixes
from .url_filter import OP9_SQL, op9_urls

QUERIES = {"op1_media": op1_media, "op2_packing": op2_packing, "op3_neighbours": op3_neighbours, "op4_suffixes": op4_suffixes, "op5_quality": op5_quality, "op6_mix": op6_mix, "op7_preferences": op7_preferences, "op8_substrings": op8_substrings, "op9_urls": op9_urls, "op10_simhash": op10_simhash}
ORACLES = {"op4_suffixes": OP4_SQL, "op8_substrings": OP8_SQL, "op6_mix": OP6_SQL, "op7_preferences": OP7_SQL, "op9_urls": OP9_SQL}
