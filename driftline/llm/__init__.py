"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; :mod:`driftline.llm.queries` wraps them as the registered ``opN_<name>`` queries.
"""
