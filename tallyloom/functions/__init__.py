"""Column expressions shared by the operators."""

from tallyloom.functions.columns import folded, label_uniform, not_in, number_text, quoted

__all__ = ["folded", "label_uniform", "not_in", "number_text", "quoted"]
