"""Operators for preparing training text: one module each, and their registered queries.

``symbolweave.llm.queries.QUERIES`` and ``ORACLES`` list what is registered.  Every
operator selects the columns it needs by name first, so further columns of its input,
whatever they are called, neither reach it nor clash with what it adds.
"""
