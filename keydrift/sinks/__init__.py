"""Writers."""

from keydrift.sinks.delimited import read_diff, write_delimited, write_diff
from keydrift.sinks.publish import publish_dataset
from keydrift.sinks.report import (
    CompareResult,
    render_markdown,
    results_frame,
    write_file,
    write_json,
    write_markdown,
)

__all__ = [
    "CompareResult",
    "publish_dataset",
    "read_diff",
    "render_markdown",
    "results_frame",
    "write_delimited",
    "write_diff",
    "write_file",
    "write_json",
    "write_markdown",
]
