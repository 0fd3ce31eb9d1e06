"""Cotejo: DataFrame operators for comparing, scoring and profiling tables extracted from documents."""
