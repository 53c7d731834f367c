"""Operators for preparing language-model training data, one module per operator.

Nothing outside this package imports it.  Conventions shared by all operators:

* An operator takes DataFrames and returns a DataFrame; extra input columns are carried or ignored, never
  mixed up with working columns, which all start with ``__cs_`` (a reserved prefix).
* A null text counts as the empty text.  A null id is an ordinary id value that sorts first.
* Rows equal in id and text are one document that is listed more than once.
* Intermediate tables go to the shared folder of ``spark.checkpoint.dir`` (see ``common.shared_dir``).
"""
