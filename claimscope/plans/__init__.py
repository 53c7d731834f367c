"""Named queries over the test tables (``registry``) and their SQL twins."""
