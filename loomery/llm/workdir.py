"""Where operators put intermediate tables and files that several executors must see."""

from __future__ import annotations

from loomery.sources.shared import fresh_path, partitions, remove, scratch, shared_dir, written

__all__ = ["fresh_path", "partitions", "remove", "scratch", "shared_dir", "written"]
