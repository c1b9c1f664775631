"""Scalar expressions that queries share, all of them columns."""

from ..operators.churn import auto_bucket_size, author_filter, glob_filter, shade
from ..operators.imports import absolute_module, ancestors, candidates, normalise, package_of
from ..operators.text import basename, bounded_text, clip, dirname, escape_attribute, extension, head_lines, language, line_count, strip_ansi
from ..operators.tree import directory_importance, file_importance

__all__ = [
    "absolute_module", "ancestors", "author_filter", "auto_bucket_size", "basename", "bounded_text", "candidates", "clip", "directory_importance", "dirname", "escape_attribute",
    "extension", "file_importance", "glob_filter", "head_lines", "language", "line_count", "normalise", "package_of", "shade", "strip_ansi",
]
