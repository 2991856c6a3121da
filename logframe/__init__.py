"""Exploration of delimited files and logs on Spark DataFrames."""

from logframe.functions.patterns import NAMED_PATTERNS, PatternError
from logframe.operators.aggregate import chart_series, group_aggregate, group_total
from logframe.operators.columns import reconcile_columns, select_view
from logframe.operators.compare import align_tables, common_columns, labels, overlay
from logframe.operators.crosstab import crosstab, default_axes, largest_cell, pivot_wide
from logframe.operators.diff import changed_fields, diff_samples, diff_summary, row_diff, schema_diff
from logframe.operators.drill import from_category, from_cell, from_field, from_range, narrow
from logframe.operators.ordering import multi_sort, page, top_k, with_position
from logframe.operators.predicates import OPERATORS, Condition, condition, filter_all, filter_groups, operators_for
from logframe.operators.profile import bin_bounds, column_kinds, column_stats, distinct_counts, histogram, top_values
from logframe.operators.redact import redact
from logframe.operators.search import extract_matches, quick_pattern, search
from logframe.plans.view import View, apply_to_all, apply_view
from logframe.schema import Field, field_of, fields_of, signature, with_row_id, with_types
from logframe.session import configure, materialize, scratch_dir
from logframe.sources.delimited import (
    dataset_summary,
    load_many,
    malformed_records,
    profile_files,
    read_delimited,
    stack_tables,
)
from logframe.sources.files import EmptyFile, UnsupportedFile, detect_delimiters, detect_encodings, lines_of
from logframe.sources.headers import column_keys
from logframe.sources.inference import coerce, infer_types, retype, to_typed, type_votes
from logframe.sources.logs import SNIPPETS, TEMPLATES, NoMatch, compile_pattern, parse_log, parse_log_report, read_lines
from logframe.sources.sinks import write_csv, write_json
from logframe.streaming.ingest import append_delimited, append_rows, bucket_counts, ingest_delimited_stream, ingest_stream, month_counts

__all__ = [name for name in dir() if not name.startswith("_")]
