"""Disclosure analytics on Spark: what artifacts reveal, how certainly, and what cleaning would leave."""
