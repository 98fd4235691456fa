"""Training-data operators: ten corpus operators and the pipeline built from them.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries`` registers the fixed ``opN_*`` queries.
"""
