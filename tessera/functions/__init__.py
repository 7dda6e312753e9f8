from tessera.functions.text import (  # noqa: F401
    argmax, attention_mask, clean_text, clean_text_steps, collapse_ws, fix_encoding,
    format_metric, parse_vector, remove_empty_lines, remove_links, softmax,
    strip_timestamp, word_count,
)
from tessera.functions.keys import composite_key, order_hash, with_id  # noqa: F401
