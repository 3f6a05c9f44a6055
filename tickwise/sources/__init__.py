from .bars import normalise_dates, read_bars, read_blocks, sorted_layout, write_bars, write_blocks

__all__ = ["normalise_dates", "read_bars", "read_blocks", "sorted_layout", "write_bars", "write_blocks"]
