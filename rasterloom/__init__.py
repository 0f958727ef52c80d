"""Mask-driven image patches and their bookkeeping as Spark jobs."""
