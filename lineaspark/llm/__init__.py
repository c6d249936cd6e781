"""Training-data operators.

Operators for large text corpora, each in a module of its own.  Nothing
outside this subpackage imports it; ``__spark_entry__`` adds its queries only
where it can be imported.

Conventions that all operators share:

* Input columns are picked by name (``doc_id`` and ``text``, plus what an
  operator documents).  Extra columns, whatever their names, are ignored.
* ``text`` may be null (treated as documented per operator), empty or very
  long; ``doc_id`` may be null or repeated: such rows are kept and get the
  result that their text gives.
* Intermediate tables are written to the shared folder in
  ``spark.checkpoint.dir`` (see :mod:`lineaspark.sources.snapshots`), so that a lost
  executor costs a re-run of tasks and never the lineage of the whole job.
"""
