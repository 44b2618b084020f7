"""Stateful detectors on Structured Streaming."""

from statewatch.streaming.kernels import cusum_kernel, eprocess_kernel, factor_kernel, sr_kernel
from statewatch.streaming.ordered import dropped_rows, run_to_table, run_to_tables, stream_detector
from statewatch.streaming.rolling import box_kernel, contrast_kernel, counted, held, simplex_kernel, sliding_kernel, witness_step

__all__ = [
    "box_kernel", "contrast_kernel", "counted", "cusum_kernel", "dropped_rows", "eprocess_kernel", "factor_kernel", "held", "run_to_table", "run_to_tables",
    "simplex_kernel", "sliding_kernel", "sr_kernel", "stream_detector", "witness_step",
]
