"""Training-data operators.

One module per operator.  ``kmerweave.llm.registry`` lists their queries and
SQL.  Nothing outside this subpackage imports it except ``corpus_pipeline`` and
the guarded import in ``__spark_entry__``.
"""
