"""Operators for preparing large text corpora, one module each.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin
``opN_*`` queries; each operator module has the general interface.
"""
