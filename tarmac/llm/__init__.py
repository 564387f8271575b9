"""Training-data operators: text, page and url tables in, scores, spans, groups or files out.

One module per operator; ``queries.py`` holds the registered ``opN_<name>`` queries. Nothing outside this
subpackage imports it, apart from the driver entry and ``corpus_pipeline.py``.
"""
