"""Operators for large training-data pipelines. Nothing outside this subpackage imports it."""

QUERY_MODULES = [f"tagloom.llm.{m}" for m in ("topn", "formatting", "neardup", "consensus", "lookalike", "packing", "leakage", "residue")]
