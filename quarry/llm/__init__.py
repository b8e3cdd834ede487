"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; the query registry lives in
``quarry.llm.queries``.
"""
