from dialoom.functions.scalar import PY_WHITESPACE, basename, ellipsis, fixed, py_strip, strip_prompt

__all__ = ["PY_WHITESPACE", "basename", "ellipsis", "fixed", "py_strip", "strip_prompt"]
