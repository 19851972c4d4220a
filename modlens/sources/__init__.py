from modlens.sources.files import (
    append_metric_log,
    parse_json_column,
    read_csv,
    read_json,
    read_term_list,
    read_tsv,
    write_csv,
    write_split_table,
    write_tsv_report,
)
from modlens.sources.tables import TABLES, table

__all__ = [
    "TABLES", "append_metric_log", "parse_json_column", "read_csv", "read_json",
    "read_term_list", "read_tsv", "table", "write_csv", "write_split_table", "write_tsv_report",
]
