"""DuckDB spellings of the cleaning expressions, built from the same fixed
patterns as :mod:`tessera.functions.text` (RE2 accepts the same classes)."""

from tessera.functions.text import (ENCODING_FIXES, LINK_PATTERN, SPACE_CLASS, SPACE_RUN_PATTERN,
                                    TIMESTAMP_PATTERN, BLANK_PATTERN)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fix_encoding(x: str) -> str:
    for old, new in ENCODING_FIXES:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^[' + SPACE_CLASS + ']+|[' + SPACE_CLASS + ']+$')}, '', 'g')"


def remove_links(x: str) -> str:
    return strip_ws(f"regexp_replace({x}, {q(LINK_PATTERN)}, '', 'g')")


def remove_empty_lines(x: str) -> str:
    return f"regexp_replace(CASE WHEN regexp_full_match({x}, {q(BLANK_PATTERN[1:-1])}) THEN '' ELSE {x} END, ' +', ' ', 'g')"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(SPACE_RUN_PATTERN)}, ' ', 'g'), ' ')"


def strip_timestamp(x: str) -> str:
    return strip_ws(f"regexp_replace({x}, {q(TIMESTAMP_PATTERN)}, '', 'g')")


def clean_text(x: str) -> str:
    y = fix_encoding(x)
    y = f"regexp_replace({y}, {q(LINK_PATTERN)}, '', 'g')"
    y = collapse_ws(y)
    return f"trim(regexp_replace({y}, {q(TIMESTAMP_PATTERN)}, '', 'g'), ' ')"


def md5_key(seed, key: str, *salt: str) -> str:
    parts = [q(str(seed))] + list(salt) + [f"CAST({key} AS VARCHAR)"]
    return "md5(" + " || ':' || ".join(parts) + ")"
