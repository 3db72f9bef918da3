"""Training-data pipeline operators (near-duplicates, decontamination, packing and so on).

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
