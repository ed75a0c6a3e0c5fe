"""Operations of a training-data pipeline: packing, token counts, deduplication, search, filtering and mixing.

Nothing else in the library imports this subpackage. `entry.QUERIES` and `entry.ORACLES` list what
`__spark_entry__.py` registers.
"""
