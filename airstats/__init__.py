"""airstats: airline on-time analytics as plain PySpark DataFrame functions.

``functions``  Column -> Column expressions
``operators``  DataFrame -> DataFrame relational operators
``sources``    CSV and partitioned Parquet readers, writers and listings
``plans``      several operators put together: sampling, validation, training, scoring
``streaming``  incremental loading and scoring with Structured Streaming
"""
