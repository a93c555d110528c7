from almudi.core.runtime import cut, read_table, shared_dir, written

__all__ = ["cut", "read_table", "shared_dir", "written"]
