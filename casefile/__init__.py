"""PySpark jobs for building and searching a large collection of documents."""
