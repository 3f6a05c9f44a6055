from .kernels import (block_window, ewm_means, first_difference, gain, in_blocks, in_one_pass, loss,
                      out_of_blocks, rolling_mean, rolling_std, series_window, trailing)

__all__ = ["block_window", "ewm_means", "first_difference", "gain", "in_blocks", "in_one_pass", "loss",
           "out_of_blocks", "rolling_mean", "rolling_std", "series_window", "trailing"]
