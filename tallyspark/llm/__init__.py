"""Training-data operators: cleaning, de-duplication, scanning, mixing and tokenising of text corpora.

Each module holds one operator with a general DataFrame interface.
``queries`` registers the thin ``opN_`` queries over the ``documents`` table.
Nothing outside this subpackage imports it.
"""
