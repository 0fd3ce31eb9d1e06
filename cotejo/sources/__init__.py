"""Readers, writers and the shared working folder."""

from cotejo.sources.tables import clear, cut, scratch, table, work_dir, work_path

__all__ = ["clear", "cut", "scratch", "table", "work_dir", "work_path"]
