from .text import (  # noqa: F401
    abstract_preview, clc_code, clean_key, derive_is_core, derive_paper_id,
    extract_journal, extract_year, split_authors, split_keywords, split_multi,
    strip, to_int_year, tokenize,
)
from .vectors import add_hashed_vectors, cosine  # noqa: F401
