"""Training-data operators: deduplication, filtering, mixing, archiving, counting.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``queries.py`` registers the thin queries over them.
"""
