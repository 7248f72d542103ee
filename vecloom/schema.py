"""Logical columns by alias, and the schemas of result tables."""

from __future__ import annotations

# Names under which a logical column may come, first present wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "sentence_id": ("sentence_id", "sent_id", "sid", "SentenceID"),
    "tokens": ("tokens", "Tokens", "words", "Words"),
    "pos": ("pos", "upos", "POS", "Pos"),
    "index": ("index", "token_index", "position", "positions", "idx"),
    "head_dist": ("head_dist", "head_distance", "dep_head_dist", "gov_dist"),
    "relation_type": ("relation_type", "deprel", "dep_rel", "relation", "rel"),
    "arity": ("arity", "ariety", "head_ariety", "dep_ariety"),
}
#: Index aliases of the class-by-index form.
INDEX_CLASS_ALIASES = ("index", "token_index", "positions", "position", "idx", "INDEX", "Index")
REQUIRED = ("sentence_id", "tokens")

# The columns of the result tables, by layer and by class and layer.
METRIC_BY_LAYER = ("model", "model_tag", "word_rep_mode", "metric", "layer", "mean", "ci_low", "ci_high", "n_tokens", "source_csv")
METRIC_BY_CLASS = ("subset", "model", "feature", "class", "metric", "layer", "mean", "ci_low", "ci_high", "n_tokens", "word_rep_mode", "source_csv")


def resolve(columns: list[str], logical: str, aliases: tuple[str, ...] | None = None) -> str | None:
    """The column that stands for a logical one, by exact case, or None."""
    return next((a for a in aliases or ALIASES[logical] if a in columns), None)
