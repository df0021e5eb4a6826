"""Operations of a training-data pipeline, each one a set of Spark jobs.

Nothing outside this subpackage imports it.
"""
