"""Column to Column helpers; none of them uses a Python UDF."""
