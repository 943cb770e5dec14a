"""vellumine: document analytics on Spark DataFrames.

The package ships its own functions to executors by value, so a cluster needs
no installation step on the workers.
"""

import importlib
import sys

from pyspark import cloudpickle

#: Public names by the module that has them; a module is loaded when a name of it is first asked for.
_EXPORTS = {
    "vellumine.batches": ("Conversion", "Progress"),
    "vellumine.convert": ("diagnose", "main", "save", "supported_targets"),
    "vellumine.operators.markup": ("html_blocks", "html_cells"),
    "vellumine.sources.files": ("BLOCKS", "READERS", "WRITERS", "blocks_of", "cells_of", "convert_files", "detect", "properties", "read", "runs_of", "scan", "write"),
    "vellumine.sources.formats": ("FORMATS", "ENGINES", "direct", "engine_table", "extensions", "formats", "routes"),
    "vellumine.sources.lines": ("read_lines",),
    "vellumine.sinks.committed": ("write_files",),
    "vellumine.sources.office": ("Options", "ReadError"),
    "vellumine.sources.runs": ("block", "run"),
    "vellumine.streaming.ingest": ("arriving", "convert_stream"),
}
_MODULE_OF = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str):
    if name not in _MODULE_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_MODULE_OF[name]), name)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
