"""Panel sources and sinks. Inputs are never written to."""

from arbora.sources.dictionary import commented, read_dictionary
from arbora.sources.panel import blanks_to_null, read_mapping, read_mapping_csv, read_panel_csv, split_lists, table_digest, write_if_changed, write_result
from arbora.sources.stata import StataDataSource, read_stata, stata_files, stata_rows

__all__ = [
    "StataDataSource", "blanks_to_null", "commented", "read_dictionary", "read_mapping", "read_mapping_csv", "read_panel_csv", "read_stata",
    "split_lists", "stata_files", "stata_rows", "table_digest", "write_if_changed", "write_result",
]
