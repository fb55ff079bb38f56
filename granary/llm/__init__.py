"""Training-data operators: ten text operators and their queries.

Nothing outside this package imports it; ``queries.py`` lists what
``__spark_entry__`` registers.
"""
