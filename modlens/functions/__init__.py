from modlens.functions.columns import (
    MD5_UNIFORM_SCALE,
    TOKEN_SPLIT,
    WHITESPACE_SPLIT,
    dot,
    fill_cast,
    flag_eq,
    flag_ge,
    flag_gt,
    key_string,
    lower_columns,
    md5_hex,
    md5_uniform,
    ngrams,
    numeric_guard,
    sanitize_label,
    sanitize_numeric_label,
    sigmoid,
    softplus,
    split_words,
    tokens,
)

__all__ = [
    "MD5_UNIFORM_SCALE", "TOKEN_SPLIT", "WHITESPACE_SPLIT", "dot", "fill_cast", "flag_eq",
    "flag_ge", "flag_gt", "key_string", "lower_columns", "md5_hex", "md5_uniform", "ngrams",
    "numeric_guard", "sanitize_label", "sanitize_numeric_label", "sigmoid", "softplus",
    "split_words", "tokens",
]
