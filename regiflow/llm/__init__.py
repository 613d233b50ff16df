"""Operators of a training-data pipeline: deduplication, scans, quality
rules, tokenising, formatting, packing and page extraction.

Each module holds one operator with a general interface; ``queries`` holds
the registered queries that apply them to whole tables.  Nothing outside this
package imports it.
"""
