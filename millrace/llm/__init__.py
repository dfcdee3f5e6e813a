"""Training-data operators: dedup, decontamination, mixing, scans, classifiers, token files.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries`` holds the
thin ``opN_*`` queries and their SQL.
"""
