"""Training-data operators: ten building blocks of a text-corpus pipeline.

Nothing outside this package imports it. Each module holds one operator with a
general interface; `queries` derives the registered `opN_*` results from them.
"""
